"""Queries of the pipeline operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import ann, byte_bpe, embed_dedup, html_text, language, merkle, near_dup, packing, part_codes, quality, substring_dedup, suffix_dedup, warc
from terrace.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left when later copies of 100-byte strings are removed."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), 100).drop("kept_text", "carried")


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), with_payload=False).drop("payload", "url")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's ids in windows of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 1).drop("ids")


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and what they decode to, as digests."""
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from text and metadata."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of word pairs."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


@query
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label with cosine 0.93 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document in the tree of its language and the tree of languages."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), 2, tampered)


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document left when 13-word windows of smaller documents are removed."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), 13).drop("kept_text")


@query
def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts, 16 entries each, 6 rounds."""
    return part_codes.compress(table(spark, sf_dir, "embeddings"), 8, 16, 6)


# Check SQL by brute force over the whole tables, where SQL can express the result.
SQL["op4_warc"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p),
    d AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS groups FROM h)
    SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(groups, lambda v: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""

SQL["op9_embedding_dedup"] = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
    c AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u), n AS (SELECT u AS vec_id, count(DISTINCT v) AS n FROM links GROUP BY u)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

SQL["op6_near_dup"] = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
        ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
    x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach(u, v) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
    c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(n_chars: str) -> str:
    texts = [f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"


# CRC-32 bit by bit, as DuckDB has no function for it
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""

SQL["op11_merkle"] = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS shown FROM documents),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
    low(tree, level, place, digest, n) AS (SELECT tree, 0, place, leaf, n FROM r
        UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, place // 2, n),
    t AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top_place, count(*) OVER () AS top_n FROM low WHERE n = 1),
    high(level, place, digest, n) AS (SELECT 0, top_place, subroot, top_n FROM t
        UNION ALL SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, place // 2, n),
    sib AS MATERIALIZED (SELECT r.tree, r.place, l.level, l.digest, l.place > (r.place >> l.level) AS behind FROM r JOIN low l ON l.tree = r.tree AND l.place = xor(r.place >> l.level, 1) AND l.n > 1
        UNION ALL SELECT r.tree, r.place, 100 + h.level, h.digest, h.place > (t.top_place >> h.level) FROM r JOIN t USING (tree) JOIN high h ON h.place = xor(t.top_place >> h.level, 1) AND h.n > 1),
    deep AS (SELECT tree, max(level) AS depth FROM low GROUP BY tree), tall AS (SELECT max(level) AS depth FROM high),
    fold(tree, place, level, digest) AS (SELECT tree, place, CASE WHEN depth = 0 THEN 100 ELSE 0 END, shown FROM r JOIN deep USING (tree)
        UNION ALL SELECT f.tree, f.place, CASE WHEN f.level < 100 AND f.level + 1 >= deep.depth THEN 100 ELSE f.level + 1 END,
            sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN s.behind THEN f.digest || s.digest ELSE s.digest || f.digest END)
        FROM fold f JOIN deep USING (tree) CROSS JOIN tall LEFT JOIN sib s ON s.tree = f.tree AND s.place = f.place AND s.level = f.level
        WHERE f.level < 100 + tall.depth),
    p AS (SELECT tree, place, string_agg(digest, '' ORDER BY level) AS proof FROM sib GROUP BY tree, place),
    x AS (SELECT tree, place, arg_max(digest, level) AS folded_root FROM fold GROUP BY tree, place)
    SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
        folded_root = (SELECT digest FROM high WHERE n = 1) AS verified, place, n AS tree_leaves, CAST(length(coalesce(proof, '')) // 64 AS BIGINT) AS proof_digests
    FROM r JOIN t USING (tree) JOIN x USING (tree, place) LEFT JOIN p USING (tree, place)"""


def _codes_sql(positions: int, entries: int, rounds: int) -> str:
    book = f"""b0 AS MATERIALIZED (SELECT p, e, list_slice(v, p * len(v) // {positions} + 1, (p + 1) * len(v) // {positions}) AS c
        FROM (SELECT v, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k QUALIFY e < {entries}), parts)"""
    steps = [book]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT i, q.p, min((d, e)) AS best, any_value(x) AS x FROM (
            SELECT i, q.p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q JOIN b{r} ON q.p = b{r}.p) q GROUP BY i, q.p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
                SELECT p, e, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS HUGEINT) ORDER BY j) AS c FROM (
                    SELECT p, best[2] AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM q))) AS j) GROUP BY p, best[2], j) GROUP BY p, e) m
                ON b.p = m.p AND b.e = m.e)""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT unnest(range(0, {positions})) AS p),
        q AS MATERIALIZED (SELECT i, p, list_slice(v, p * len(v) // {positions} + 1, (p + 1) * len(v) // {positions}) AS x FROM k, parts),
        {", ".join(steps)},
        o AS (SELECT i, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN o USING (i)"""


SQL["op13_part_codes"] = _codes_sql(8, 16, 6)


SQL["op12_substring_dedup"] = """WITH w AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT i, doc_id, words, unnest(range(1, len(words) - 11)) AS j FROM w WHERE len(words) >= 13),
    h AS MATERIALIZED (SELECT i, doc_id, j, md5(array_to_string(words[j:j + 12], ' ')) AS h FROM s),
    g AS (SELECT i, j FROM h JOIN (SELECT h, min(doc_id) AS least FROM h GROUP BY h) USING (h) WHERE doc_id > least),
    c AS (SELECT i, list(DISTINCT k) AS gone FROM (SELECT i, unnest(range(j, j + 13)) AS k FROM g) GROUP BY i),
    o AS (SELECT doc_id, words, len(words) AS n, coalesce(gone, []) AS gone, list_transform(range(1, len(words) + 1), lambda k: list_contains(coalesce(gone, []), k)) AS cut FROM w LEFT JOIN c USING (i))
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(list_filter(list_transform(range(1, n + 1), lambda k: CASE WHEN NOT cut[k] THEN words[k] END), lambda x: x IS NOT NULL), ' '), '')) AS kept_sha256,
    CAST(len(list_filter(range(1, n + 1), lambda k: cut[k] AND (k = 1 OR NOT cut[k - 1]))) AS BIGINT) AS n_spans FROM o"""
