"""Byte-level BPE as a monoid: halves are encoded, then joined at their seam.

A token sequence is the encoding of its bytes if and only if every two
neighbours are the encoding of their joined bytes. So a join re-encodes a window
around the seam and lets it grow until the tokens outside fit the window's edge.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import settings, table_of

LEAF = 16
MEMO_RUNS = 1_000_000
_ENCODERS: dict[tuple[str, str], BytePairs] = {}
# White_Space of the Unicode standard: a fixed value.
BLANKS = "\t-\r \x85\xa0  -     　"

ROWS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class BytePairs:
    """Encoder and decoder over a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        # A blank after a non-blank always starts a match of the pattern, so
        # (blanks, non-blanks) runs are cut alone.
        self.runs = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.memo: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.marks = {m: pack_ids(self.tree(m.encode())) for m in ".,"}

    @classmethod
    def of(cls, path: str, pattern: str) -> BytePairs:
        if (path, pattern) not in _ENCODERS:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            _ENCODERS[path, pattern] = cls(ranks, pattern)
        return _ENCODERS[path, pattern]

    def merged(self, data: bytes) -> list[int]:
        """Lowest-rank merges, one after another; for short byte strings."""
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        near = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best == 1 << 60:
                break
            i = near.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.fit(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join([self.bytes_of[t] for t in left[-i:] + right[:j]]))
            stable_left = i == len(left) or self.fit(left[-i - 1], window[0])
            stable_right = j == len(right) or self.fit(window[-1], right[j])
            if stable_left and stable_right:
                return left[:-i] + window + right[j:]
            i = i if stable_left else min(2 * i, len(left))
            j = j if stable_right else min(2 * j, len(right))

    def tree(self, data: bytes) -> list[int]:
        """Encoding of one match of the pattern: leaves joined pairwise up the tree."""
        if data in self.ranks:
            return [self.ranks[data]]
        level = [self.merged(data[i:i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def ids(self, run: str) -> bytes:
        """Little-endian 32-bit ids of one run."""
        word, mark = (run[:-1], run[-1]) if run[-1] in ".," else (run, "")
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            # one match, and one more for the mark
            ids = self.memo.get(word) if mark else None
            ids = ids or pack_ids(self.tree(word.encode("utf-8")))
            return ids + self.marks[mark] if mark else ids
        return pack_ids([t for m in self.pattern.findall(run) for t in self.tree(m.encode("utf-8"))])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        runs = self.runs.findall(text)
        memo = self.memo
        out = list(map(memo.get, runs))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = self.ids(runs[i])
                    if len(runs[i]) <= 64:
                        if len(memo) >= MEMO_RUNS:
                            memo.clear()
                        memo[runs[i]] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, joined in pairs up a tree."""
        table = self.bytes_of
        return joined_up([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def joined_up(parts: list[bytes]) -> bytes:
    """All parts in order, neighbours joined level by level."""
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else []
        parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + odd
    return parts[0] if parts else b""


def _over_texts(docs: DataFrame, ranks_path: str, pattern: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs.of(ranks_path, pattern)
        for batch in batches:
            made = []
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                made.append(row(ids, coder.decode(ids)))
            columns = dict(zip(schema.names[1:], zip(*made, strict=True) if made else [[]] * (len(schema) - 1), strict=True))
            yield table_of({"doc_id": batch.column(0)} | {k: list(v) for k, v in columns.items()}, schema)

    settings(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, ddl)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian 32-bit numbers, and the bytes they decode to.

    A null text counts as empty and gives no ids; repeated rows and null doc_ids
    are kept; an empty table gives no rows; other columns are ignored.
    """
    return _over_texts(docs, ranks_path, pattern, ROWS, "doc_id long, ids binary, decoded binary", lambda ids, back: (ids, back))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` as counts and digests, made where the ids are, so that no ids travel."""
    return _over_texts(
        docs, ranks_path, pattern, DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, back: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()),
    )
