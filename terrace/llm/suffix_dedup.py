"""Repeated passages by longest-previous-factor arrays over a distributed sparse suffix order.

Every string of ``length`` bytes has an anchor: the smallest hash among its
``GRAM``-byte windows. Equal strings have equal anchors at equal places, so all
strings that can match meet under one anchor key. A document becomes blocks, each
the strings that share an anchor; blocks whose key occurs once go no further.
Equal blocks fold into their first occurrence. The different blocks of a key are
laid out in document order in one task, which sorts their suffixes by prefix
doubling, finds the previous and next smaller position of each suffix in that
order, and takes the longer common prefix as the longest previous factor. A
factor of ``length`` or more bytes marks a later copy. Keys with very many
different blocks are dealt out again by whole strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.llm.common import settings, slices, stored, table_of

GRAM = 32
CHUNK_BYTES = 1 << 19
SORT_BYTES = 1 << 18
# More different blocks than this under one key are dealt out by whole strings.
WIDE_KEY = 2000
ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))

BLOCKS = pa.schema([
    ("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
])
BLOCKS_DDL = "key long, content long, doc long, version long, start int, end int, left int, right int"
FIRSTS = pa.schema([f for f in BLOCKS if f.name != "content"])
FIRSTS_DDL = "key long, doc long, version long, start int, end int, left int, right int"
TEXTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary()), ("whole", pa.bool_())])
TEXTS_DDL = "key long, doc long, version long, start int, bytes binary, whole boolean"
SPANS = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_DDL = "doc long, version long, start int, end int"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of all substrings of a byte string from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.back = np.full(n, INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        power = np.full(n, ODD, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.back[:len(self.sums) - size])


def window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` neighbours, by doubling."""
    wide = 1
    out = x
    while 2 * wide <= size:
        out = np.minimum(out[:-wide], out[wide:])
        wide *= 2
    return np.minimum(out[:len(out) - (size - wide)], out[size - wide:]) if size > wide else out


def blocks_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, content, document number, start, end, left, right) of the blocks of documents laid end to end.

    A string over the anchor holds half of the rest before the anchor or half of
    it behind: left and right are hashes of the anchor with that half, 0 where the
    document ends before. Blocks with neither in common have no string in common.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 7
    hashes = RollingHash(data)
    grams = hashes.windows(GRAM)
    bits = np.uint64(int(len(data)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = window_minima(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & low
    starts = np.concatenate([[0], ends[:-1]])
    doc_of = np.repeat(np.arange(len(ends)), ends - starts)[:len(place)]
    at = np.arange(len(place))
    inside = at + length <= ends[doc_of]
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | (doc_of[1:] != doc_of[:-1])
    last = inside.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~inside[1:] | (doc_of[1:] != doc_of[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + length
    doc = doc_of[start]
    anchor = place[start].astype(np.int64)
    half = (length - GRAM) // 2
    far = length - half
    left, right = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
    fits = anchor - half >= starts[doc]
    left[fits] = _short(hashes.of(anchor[fits] - half, anchor[fits] + GRAM))
    fits = anchor + far <= ends[doc]
    right[fits] = _short(hashes.of(anchor[fits], anchor[fits] + far))
    return grams[anchor].view(np.int64), hashes.of(start, end).view(np.int64), doc, start - starts[doc], end - starts[doc], left, right


def _short(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(33)).astype(np.int32) | np.int32(1)


def _laid_out(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, versions, bytes, ends) of bounded runs of rows, by rising place; of repeated rows one."""
    ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
    texts = batch.column(1).to_pylist()
    order = np.lexsort((versions, ids))
    if len(order):
        order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(versions[order]) != 0)])]
    for i, j in slices([len(texts[k]) for k in order], CHUNK_BYTES):
        part = order[i:j]
        chosen = [texts[k] for k in part]
        yield ids[part], versions[part], np.frombuffer(b"".join(chosen), np.uint8), np.cumsum([len(t) for t in chosen])


def block_rows(docs: DataFrame, length: int) -> DataFrame:
    """Blocks of every document; of equal blocks of one run of rows the first alone, the others as removed (no content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, versions, data, ends in _laid_out(batch):
                key, content, doc, start, end, left, right = blocks_of(data, ends, length)
                if not len(key):
                    continue
                keep = np.zeros(len(key), bool)
                keep[np.unique(mixed(key.view(np.uint64)) ^ content.view(np.uint64), return_index=True)[1]] = True
                later = np.flatnonzero(~keep)
                gone = _merged(ids[doc[later]], versions[doc[later]], start[later], end[later])
                columns = {
                    "key": np.concatenate([key[keep], mixed(gone[0].view(np.uint64)).view(np.int64)]),
                    "content": pa.array(np.concatenate([content[keep], np.zeros(len(gone[0]), np.int64)]), mask=np.arange(keep.sum() + len(gone[0])) >= keep.sum()),
                    "doc": np.concatenate([ids[doc[keep]], gone[0]]), "version": np.concatenate([versions[doc[keep]], gone[1]]),
                    "start": np.concatenate([start[keep], gone[2]]), "end": np.concatenate([end[keep], gone[3]]),
                    "left": np.concatenate([left[keep], np.zeros(len(gone[0]), np.int32)]),
                    "right": np.concatenate([right[keep], np.zeros(len(gone[0]), np.int32)]),
                }
                yield table_of(columns, BLOCKS)

    return docs.mapInArrow(run, BLOCKS_DDL)


def _merged(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of a document as one."""
    if not len(doc):
        return doc.astype(np.int64), version.astype(np.int64), start, end
    order = np.lexsort((start, version, doc))
    doc, version, start, end = (x[order].astype(np.int64) for x in (doc, version, start, end))
    other = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    number = np.cumsum(np.concatenate([[0], other]))
    far = np.maximum.accumulate(end + number * (1 << 40)) - number * (1 << 40)
    new = np.concatenate([[True], other | (start[1:] > far[:-1])])
    first = np.flatnonzero(new)
    return doc[first], version[first], start[first], far[np.concatenate([first[1:], [len(doc)]]) - 1]


def resolved(blocks: DataFrame) -> DataFrame:
    """Sorted blocks to first blocks of keys with different blocks, and removed spans (key null).

    A repeated row's blocks lie at the places of the blocks before them and are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # key, content and place of the last row
        waiting = None  # the only block so far of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            local = np.asarray(batch.column(1).is_null())
            key, doc, version, start, end, left, right = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 5, 6, 7))
            whole = (key, doc, version, start, end, left, right)
            content = batch.column(1).fill_null(0).to_numpy()
            real = np.flatnonzero(~local)
            out = [(None, doc[local], version[local], start[local], end[local], None, None)]
            if len(real):
                k, c = key[real], content[real]
                same_key = np.concatenate([[before is not None and before[0] == k[0]], k[1:] == k[:-1]])
                same = same_key & np.concatenate([[before is not None and before[1] == c[0]], c[1:] == c[:-1]])
                again = same.copy()
                for i, x in enumerate((doc[real], version[real], start[real])):
                    again &= np.concatenate([[before is not None and before[2 + i] == x[0]], x[1:] == x[:-1]])
                later = real[same & ~again]
                out.append((None, doc[later], version[later], start[later], end[later], None, None))
                firsts = real[~same]
                if len(firsts):
                    continued = same_key[~same]
                    if not continued[0]:
                        waiting = None
                    # a first block goes on if its key has another one before or behind it
                    more = continued | np.concatenate([continued[1:], [False]])
                    if continued[0] and waiting is not None:
                        out.append(tuple(np.array([x]) for x in waiting))
                        waiting = None
                    if not more[-1]:
                        waiting = tuple(c[firsts[-1]] for c in whole)
                    elif len(firsts) > 1 or continued[0]:
                        waiting = None
                    chosen = firsts[more]
                    out.append(tuple(c[chosen] for c in whole))
                before = k[-1], c[-1], doc[real[-1]], version[real[-1]], start[real[-1]]
            for key_of, d, v, first, last, before_, behind in out:
                if not len(d):
                    continue
                if key_of is None:
                    d, v, first, last = _merged(d, v, first, last)
                    key_of = before_ = behind = [None] * len(d)
                yield table_of(dict(zip(FIRSTS.names, (key_of, d, v, first, last, before_, behind), strict=True)), FIRSTS)

    return blocks.mapInArrow(run, FIRSTS_DDL)


def previous_factors(data: np.ndarray, ends: np.ndarray, length: int, depth: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(positions, longest previous factor up to ``depth - 1`` bytes) in pieces that end at ``ends``.

    Only positions with ``length`` bytes left in their piece are sorted: no other
    one starts a string that counts, earlier or later. At most 2**21 bytes.
    """
    n = len(data)
    low = np.int64((1 << 21) - 1)
    piece = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    left = ends[piece] - np.arange(n)  # bytes to the end of the piece

    def ahead(rank: np.ndarray, width: int) -> np.ndarray:
        """Rank of what follows ``width`` bytes later; behind the end of a piece nothing."""
        out = np.zeros(n, np.int64)
        out[:n - width] = rank[width:]
        out[left <= width] = 0
        return out

    # order-keeping ranks of prefixes of 1, 2, 4, ... bytes; position and rank sort as one number
    ranks = [data.astype(np.int64) + 1]
    ranks.append(ranks[0] * 257 + ahead(ranks[0], 1))
    width = 2
    while 2 * width <= depth:
        coded = np.sort(((ranks[-1] << 21 | ahead(ranks[-1], width)) << 21) | np.arange(n))
        order, pair = coded & low, coded >> 21
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], pair[1:] != pair[:-1]]))
        width *= 2
        ranks.append(rank)
    starts = np.flatnonzero(left >= length)
    suffixes = np.sort(ranks[-1][starts] << 21 | starts) & low
    m = len(suffixes)
    place = np.append(suffixes, -1)  # place[m]: smaller than any position
    best = np.zeros(m, np.int64)
    for step in (-1, 1):
        # previous (next) smaller position in suffix order, by jumping along those found so far
        found = np.arange(m) + step
        found[(found < 0) | (found >= m)] = m
        found = np.append(found, m)
        larger = np.flatnonzero(place[found[:-1]] > suffixes)
        while len(larger):
            found[larger] = found[found[larger]]
            larger = larger[place[found[larger]] > suffixes[larger]]
        there = np.flatnonzero(found[:-1] < m)
        a, b = suffixes[there], suffixes[found[there]]
        room = np.minimum(left[a], left[b])
        same = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            wide = 1 << level
            at = np.flatnonzero(same + wide <= room)
            equal = ranks[level][a[at] + same[at]] == ranks[level][b[at] + same[at]]
            same[at[equal]] += wide
        best[there] = np.maximum(best[there], same)
    return suffixes, best


def factor_spans(texts: DataFrame, length: int) -> DataFrame:
    """Spans of ``texts`` (by key, then place) whose strings start earlier under the same key."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[1:4])
        sizes = np.array([len(r[4]) for r in rows])
        ends = np.cumsum(sizes)
        at, best = previous_factors(np.frombuffer(b"".join([r[4] for r in rows]), np.uint8), ends, length)
        at = np.sort(at[best >= length])
        piece = np.searchsorted(ends, at, side="right")
        doc, version, first = (np.array([r[i] for r in rows], np.int64)[piece] for i in (1, 2, 3))
        start = first + at - (ends - sizes)[piece]
        return table_of(dict(zip(SPANS.names, _merged(doc, version, start, start + length), strict=True)), SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] == last:
                    continue  # of a repeated row
                last = row[:4]
                new_key = not held or held[-1][0] != row[0]
                if size >= SORT_BYTES and (new_key or row[5]):
                    yield spans(held)
                    # whole strings of one key are equal: the first stands for all
                    held = [] if new_key else [next(r for r in held if r[0] == row[0])]
                    size = sum(len(r[4]) for r in held)
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    return texts.mapInArrow(run, SPANS_DDL)


def _wanted_texts(docs: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted blocks of each document; wide keys as single strings, folded within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text, version, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted or []:
                    piece = text[w["start"]:w["end"]]
                    if w["wide"]:
                        hashes = RollingHash(np.frombuffer(piece, np.uint8)).windows(length).view(np.int64).tolist()
                        rows += [(h, doc, version, w["start"] + i, piece[i:i + length], True) for i, h in enumerate(hashes)]
                        size += length * len(hashes)
                    else:
                        rows.append((w["key"], doc, version, w["start"], piece, False))
                        size += len(piece)
                if size >= 1 << 20:
                    yield table_of(dict(zip(TEXTS.names, zip(*rows, strict=True), strict=True)), TEXTS)
                    rows, size = [], 0
            if rows:
                yield table_of(dict(zip(TEXTS.names, zip(*rows, strict=True), strict=True)), TEXTS)

    return docs.mapInArrow(run, TEXTS_DDL)


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, version, start, end) byte spans of ``docs`` (doc_id, raw, version) that are later copies; spans of a document may overlap."""
    blocks = block_rows(docs, length).repartition("key").sortWithinPartitions("key", "content", "doc", "version", "start")
    first = stored(resolved(blocks), "blocks")
    wanted = first.filter("key is not null").repartition("key")
    twins = [(F.col(side) != 0) & (F.count(F.lit(1)).over(Window.partitionBy("key", side)) > 1) for side in ("left", "right")]
    wanted = wanted.withColumn("twin", twins[0] | twins[1]).filter("twin")
    wanted = wanted.withColumn("wide", F.count(F.lit(1)).over(Window.partitionBy("key")) > WIDE_KEY)
    by_doc = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("key", "start", "end", "wide")).alias("wanted"))
    texts = docs.join(by_doc, (docs.doc_id == by_doc.doc) & (docs.version == by_doc.version)).select("doc_id", "raw", docs.version, "wanted")
    pieces = _wanted_texts(texts, length).repartition("key").sortWithinPartitions("key", "doc", "version", "start")
    return first.filter("key is null").select("doc", "version", "start", "end").union(factor_spans(pieces, length))


def _finish(docs: DataFrame, text_out: bool) -> DataFrame:
    carried = docs.schema["carried"]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, spans in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                runs: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if runs else raw
                rows.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if text_out else None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [batch.column(3)], names=[*names, "carried"])

    return docs.mapInArrow(run, StructType.fromDDL(ddl).add(carried))


def dedup(docs: DataFrame, length: int = 100, text_out: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, carried).

    A byte goes if a ``length``-byte string over it also starts earlier: in a
    document with a smaller doc_id, or before it in its own document. Null texts
    count as empty; texts below ``length`` bytes lose nothing. A row that repeats
    another one's doc_id and text lies at the same place, so neither is the
    other's earlier copy and both get the same result; different texts of one
    doc_id are documents of their own, in the order of their hashes (xxhash64). A
    null doc_id has no place, so its row stays whole and is no source. An empty
    table gives no rows. ``kept_text``
    (on request) drops characters cut in half; ``carried`` is a struct of the
    columns named in ``carry``, other columns are ignored.
    """
    settings(docs.sparkSession)
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"),
        F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("boolean").alias("carried"),
    )
    placed = raw.filter("doc_id is not null").withColumn("version", F.xxhash64("raw"))
    spans = removed_spans(placed.select("doc_id", "raw", "version"), length).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = placed.join(spans, (placed.doc_id == spans.doc) & (placed.version == spans.version), "left").select("doc_id", "raw", "spans", "carried")
    lost = raw.filter("doc_id is null").select("doc_id", "raw", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), "carried")
    return _finish(joined.union(lost), text_out)
