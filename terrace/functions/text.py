"""Text columns: cleaning keys, word tests, n-grams and message keys.

The character classes spell out what "word", "letter" and "blank" mean in
Unicode, because Java's own ``\\w`` and ``\\s`` are ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{L}\p{Nl}\p{No}"
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"

URL = rf"https?://[^{BLANK}]+"
MENTION = rf"[@#][{WORD}]+"

_BLANK_CHARS = (
    " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
)


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col, F.lit(_BLANK_CHARS))


def literal_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal term."""
    gone = F.char_length(F.replace(text, term, F.lit("")))
    return (F.char_length(text) - gone) / F.char_length(term)


def without_links(text: Column) -> Column:
    """Links and mentions as blanks. Literal tests come first: few texts hold either, and patterns are dear."""
    def unlinked(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("://")), F.regexp_replace(t, URL, " ")).otherwise(t)

    def unnamed(t: Column) -> Column:
        held = F.contains(t, F.lit("@")) | F.contains(t, F.lit("#"))
        return F.when(held, F.regexp_replace(t, MENTION, " ")).otherwise(t)

    return _bound(_bound(text, unlinked), unnamed)


def _bound(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` of a value computed once: a lambda's variable is not inlined."""
    return F.get(F.transform(F.array(text), change), F.lit(0))


def normalised(message: Column) -> Column:
    """De-duplication key: lower case, no links or mentions, runs and blanks collapsed.

    Single spaces stay where they are, only other blanks and longer runs are replaced.
    """
    text = F.regexp_replace(without_links(F.lower(message)), r"(.)\1{2,}", "$1$1")
    return strip(F.regexp_replace(text, f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]", " "))


def letter_runs(message: Column) -> Column:
    """Number of letter runs of two or more outside links and mentions."""
    return F.regexp_count(without_links(message), F.lit(f"[{LETTER}]{{2,}}"))


def message_key(message: Column) -> Column:
    """Stable 24-hex-digit key of a trimmed message."""
    return F.substring(F.sha2(strip(message), 256), 1, 24)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def leading_digits(col: Column) -> Column:
    """First digit run as a number, NULL when there is none."""
    return F.regexp_extract(col, r"(\p{Nd}+)", 1).try_cast("bigint")


def parse_utc(col: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; seconds and fraction optional, NULL when unusable."""
    text = strip(col)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX")),
        text.try_cast("timestamp"),
    )


def any_term(text: Column, terms: list[str]) -> Column:
    """True when any of a short list of literal terms occurs in the text."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def _no_text() -> Column:
    return F.array().cast("array<string>")


def char_runs(text: Column, n: int) -> Column:
    """Every run of ``n`` characters, in order.

    A look-ahead walks the text once; slicing by position would start over from
    the first byte for every run. The class keeps a run from starting inside a
    surrogate pair.
    """
    start = r"[^\x{DC00}-\x{DFFF}]"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({start}.{{{n - 1}}}))"), 1)


def word_runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by a blank."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(
        F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(_no_text())


def word_grams(text: Column, longest: int = 2) -> Column:
    """Lower-cased words of two or more characters and their runs up to ``longest``.

    The word list is bound once per row as the single element of an array;
    inlined into the run lambda it would be extracted again for every run.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"([{WORD}]{{2,}})"), 1)
    bound = F.transform(
        F.array(words), lambda ws: F.concat(ws, *[word_runs(ws, n) for n in range(2, longest + 1)])
    )
    return F.get(bound, F.lit(0))


def char_grams(text: Column, shortest: int = 2, longest: int = 5) -> Column:
    """Lower-cased character runs of every length in ``shortest..longest``."""
    bound = F.transform(
        F.array(F.lower(text)),
        lambda low: F.concat(*[char_runs(low, n) for n in range(shortest, longest + 1)]),
    )
    return F.get(bound, F.lit(0))
