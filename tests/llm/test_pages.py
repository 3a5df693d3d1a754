"""WARC round trips and HTML text."""

import base64
import gzip
import hashlib
import io

import pytest

from terrace.llm import html_text, warc

PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b", None), (3, None, ""), (4, "http://c", "<p>one</p>"), (9, "http://d", "<p>é</p>"),
    (7, "http://e", "<p>é</p>"), (9, "http://d", "<p>é</p>"), (None, "http://n", "<p>lost</p>"), (12, "http://f\r\nx", "z" * 300_000),
]


def test_warc_round_trip(spark, table):
    out = warc.round_trip(spark, table(PAGES, "page_id long, url string, html string")).collect()
    assert len(out) == len(PAGES)
    last = {}
    for page, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    texts = {p: h or "" for p, _, h in PAGES}
    for r in out:
        payload = texts[r.page_id].encode()
        first = r.page_id is None or last[texts[r.page_id]] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[texts[r.page_id]]))
        assert r.payload is None if not first else bytes(r.payload) == payload
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_keeps_both_texts_of_one_page_id(spark, table):
    pages = [(1, "http://a", "own"), (1, "http://a", "shared"), (5, "http://b", "shared"), (2, "http://c", "x"), (2, "http://c", "y"), (7, "http://d", "x"), (8, "http://e", "y")]
    out = warc.round_trip(spark, table(pages, "page_id long, url string, html string")).collect()
    found = sorted((r.page_id, r.record_type, r.refers_to or 0, bytes(r.payload or b"").decode()) for r in out)
    assert found == [
        (1, "response", 0, "own"), (1, "revisit", 5, ""), (2, "revisit", 7, ""), (2, "revisit", 8, ""),
        (5, "response", 0, "shared"), (7, "response", 0, "x"), (8, "response", 0, "y"),
    ]


def test_reader_rejects_broken_archives():
    whole = warc.record(3, "http://x", b"payload", warc.sha1(b"payload"), None, True)
    assert [r[0] for r in warc.read_stream(io.BytesIO(warc.member(whole) * 2))] == [3, 3]
    for broken in (gzip.compress(whole.replace(b"payload\r\n", b"pAyload\r\n")), warc.member(whole)[:-12], warc.member(whole + whole), warc.member(b"GET /")):
        with pytest.raises((warc.BrokenArchive, KeyError)):
            list(warc.read_stream(io.BytesIO(broken)))


CASES = {
    "<title>x</title>a <b>b</b><script>no</script>": "a b",
    "<p>one<p>two<br>three": "one\n\ntwo\nthree",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<table><tr><th>Name<th>N<tr><td>longer name<td>12</table>": "Name         N\nlonger name  12",
    "<table><caption>Cap</caption><td>日本<td>1<tr><td>a<td>2</table>z": "Cap\n日本  1\na     2\n\nz",
    "<pre>\n  keep   this\n</pre>x": "  keep   this\n\nx",
    "<div hidden>no</div><div style='display : none'>no</div>yes<template>no</template>": "yes",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n    d\n    e",
    "a &amp; b &#233;&nbsp;c &lt; 3 < 4": "a & b é c < 3 < 4",
    "<a title=\"x>y\" href='>'>link</a> <!-- <p>no --> end": "link end",
    "x<p": "x",
    "": "",
    "<details><summary>s</summary>no</details><details open>yes</details>": "s\nyes",
    "<td>stray</td> text</p>more": "stray text\n\nmore",
    "<table><form><tr><td>a<td>b</tr></form></table>c": "a  b\n\nc",
    "<form>x<table><tr><form><td>a</td></form></tr></table>y</form>": "x\n\na\n\ny",
    "<table>text<tr><td>a</table>": "text\n\na",
    "<table><div>text</div><tr><td>a</td></tr></table>": "text\n\na",
    "<table><tr><p>one<p>two<td>a</td></tr><b>bold</b></table>": "one\n\ntwo\n\nbold\n\na",
    "<table><div><tr><td>a</table>b": "a\n\nb",
    "<table><tr><td>a<tr><caption>c<table><tr><td>in</table></table>": "c\nin\na",
    "<table><tr><td>a<table>x<tr><td>b</table>c</table>d": "ax b c\n\nd",
    "<table><table><tr><td>a</table>": "a",
    "<table><tr><td><template><tr>no</tr></template>a</table>": "a",
    "<svg><title/><defs/><path d='M0'/>no<g><text>yes</text></g></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "yes x=1",
    "<b/>one<i/>two": "onetwo",
}


@pytest.mark.parametrize("source", CASES)
def test_visible_text(source):
    assert html_text.visible_text(source) == CASES[source]


def test_deep_and_broken_markup_ends():
    assert html_text.visible_text("<b>" * 50_000 + "x") == "x"
    assert html_text.visible_text('<a x="' * 20_000) == ""
    assert html_text.visible_text("<table><tr><td>" * 500 + "x") == "x"


def test_extract(spark, table):
    out = html_text.extract(table(PAGES, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text[:4], r.n_lines) for r in out) == sorted(
        (p or 0, (h or "").replace("<p>", "").replace("</p>", "")[:4], 1 if h else 0) for p, _, h in PAGES)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
