"""Repeated word passages by level-wise doubling.

Windows of ``FIRST`` words are looked for first. A window that several documents
hold is extended to twice its length, but only where the window beside it is held
by several as well; the rest is settled at its length. So each level asks about
fewer windows, until the wanted length is reached or no candidate survives.

Texts become blocks of whole documents, written once and bucketed by block, so
that no later pass shuffles them. At each level a block sends the sorted hashes
of its candidates, a few bytes each, to hash groups; a group answers with one bit
for a hash: held elsewhere too or not. A block finds its windows again from its
text, so neither places nor texts travel. Short hashes let a few windows through
that no other document holds; the last level compares 128-bit digests together
with the smallest doc_id that holds each, which settles the result. A passage
shared by any number of documents is one hash a block, so hot passages cost a
group no more than its share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import scratch, settings, stored, table_of

FIRST = 4
BLOCK_BYTES = 2 << 20
# Hashes of a group; the number of groups follows the number of words.
GROUP_HASHES = 2_000_000
HASH_BITS = 30
NO_ID = -(1 << 63)

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.int64()), ("payload", pa.binary())])
BLOCKS_DDL = "block long, ids array<long>, words long, payload binary"
ASKS = pa.schema([("hash_group", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])
ASKS_DDL = "hash_group int, block long, n int, hashes binary, docs binary"
ANSWERS = pa.schema([("block", pa.int64()), ("hash_group", pa.int32()), ("bits", pa.binary())])
ANSWERS_DDL = "block long, hash_group int, bits binary"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64()), ("kept_text", pa.string())])
KEPT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept_text string"


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels: doubled from ``first``, then ``window`` itself."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that high zero bytes compress to nothing."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Block:
    """Words of a run of whole documents, and the windows over them."""

    def __init__(self, ids: list[int | None], payload: bytes):
        self.text = zstandard.ZstdDecompressor().decompress(payload)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.docs = self.text.split(b"\n")[:len(ids)]
        of_doc = [d.split(b" ") if d else [] for d in self.docs]
        self.counts = np.array([len(w) for w in of_doc], np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        words = [w for d in of_doc for w in d]
        self.hashes = {1: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))}
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # one byte stands between words and between documents; an empty document has no word, so only its mark
        marks = np.searchsorted(np.cumsum(self.counts), np.arange(len(words)), "right") if len(words) else np.zeros(0, np.int64)
        before = np.cumsum(sizes) - sizes + np.arange(len(words))
        empty = np.cumsum(self.counts == 0)
        self.start = before + (empty[marks] if len(words) else 0)
        self.end = self.start + sizes

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, by doubling."""
        if size not in self.hashes:
            half = self.windows(-(-size // 2))
            shift = size // 2
            self.hashes[size] = mixed(half[:len(half) - shift], half[shift:]) if len(half) > shift else half[:0]
        return self.hashes[size]

    def inside(self, size: int) -> np.ndarray:
        """Does the window at each word end within its document?"""
        out = np.zeros(len(self.doc), bool)
        if len(out) >= size:
            out[:len(out) - size + 1] = self.doc[:len(out) - size + 1] == self.doc[size - 1:]
        return out

    def candidates(self, level: list[int], k: int, held: np.ndarray | None) -> np.ndarray:
        """Places of the windows of level ``k`` whose two halves ``held`` lets through."""
        out = self.inside(level[k])
        if held is not None:
            shift = level[k] - level[k - 1]
            beside = np.zeros(len(out), bool)
            beside[:max(len(out) - shift, 0)] = held[shift:]
            out &= held & beside
        return np.flatnonzero(out)

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        """(places, 2) digests of the windows' own words."""
        raw = b"".join([hashlib.blake2b(self.text[a:b], digest_size=16).digest() for a, b in zip(self.start[at].tolist(), self.end[at + size - 1].tolist(), strict=True)])
        return np.frombuffer(raw, "<u8").reshape(len(at), 2)


class Asked:
    """The different windows at some places of a block, in the order of group and hash."""

    def __init__(self, block: Block, at: np.ndarray, size: int, groups: int, last: bool):
        if last:
            high, low = block.digests(at, size).T
        else:
            high = block.windows(size)[at]
            low = high & np.uint64((1 << HASH_BITS) - 1)
        group = (high >> np.uint64(32)) % np.uint64(groups)
        order = np.lexsort((low, high, group)) if last else np.argsort((group << np.uint64(HASH_BITS)) | low, kind="stable")
        new = np.ones(len(at), bool)
        if last:
            new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        else:
            new[1:] = (group[order[1:]] != group[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        starts = np.flatnonzero(new)
        self.of = np.empty(len(at), np.int64)  # the number of the window at each place
        self.of[order] = np.cumsum(new) - 1
        self.group, self.high, self.low = group[order[starts]], high[order[starts]], low[order[starts]]
        owner = block.ids[block.doc[at]]
        ids = owner[order]
        self.least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        self.most = np.maximum.reduceat(ids, starts) if len(starts) else ids
        self.owner = owner

    def rows(self, number: int, last: bool) -> Iterator[tuple]:
        cuts = np.flatnonzero(np.diff(self.group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.group)], strict=True):
            if a == b:
                continue
            if last:
                hashes, docs = self.high[a:b].tobytes() + self.low[a:b].tobytes(), planes(self.least[a:b].astype("<i8"))
            else:
                hashes, docs = planes(np.diff(self.low[a:b].astype("<u4"), prepend=np.uint32(0)).astype("<u4")), None
            yield int(self.group[a]), number, b - a, hashes, docs

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answer's bit of each different window."""
        found, counts = np.unique(self.group, return_counts=True)
        bits = [np.unpackbits(np.frombuffer(answers[g], np.uint8), count=n) for g, n in zip(found.tolist(), counts.tolist(), strict=True)]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def settled(block: Block, level: list[int], answers: list[dict[int, bytes]], groups: int) -> np.ndarray | None:
    """After the answered levels: is the window at each word held by several documents; after the last, by a smaller one?"""
    held = None
    for k, answer in enumerate(answers):
        last = k == len(level) - 1
        at = block.candidates(level, k, held)
        asked = Asked(block, at, level[k], groups, last)
        bits = asked.answered(answer)
        held = np.zeros(len(block.doc), bool)
        if last:
            held[at] = bits[asked.of] | (asked.owner > asked.least[asked.of])
        else:
            held[at] = (bits | (asked.least != asked.most))[asked.of]
    return held


def blocks(docs: DataFrame) -> DataFrame:
    """The texts as compressed blocks of about ``BLOCK_BYTES`` of words, a table bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        texts: list[bytes] = []
        words = size = 0
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = raw.as_buffer().to_pybytes().split()
                ids.append(doc)
                texts.append(b" ".join(found))
                words += len(found)
                size += len(texts[-1]) + 1
                if size >= BLOCK_BYTES:
                    yield table_of({"block": [number], "ids": [ids], "words": [words], "payload": [pack.compress(b"\n".join(texts))]}, BLOCKS)
                    number, ids, texts, words, size = number + 1, [], [], 0, 0
        if ids:
            yield table_of({"block": [number], "ids": [ids], "words": [words], "payload": [pack.compress(b"\n".join(texts))]}, BLOCKS)

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"terrace_blocks_{uuid.uuid4().hex}"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    (
        text.mapInArrow(run, BLOCKS_DDL).repartition(parts, "block").write.bucketBy(parts, "block")
        .option("path", scratch(spark, "blocks")).option("compression", "uncompressed")
        # a row is a block: small row groups keep a scan batch small
        .option("parquet.block.size", str(16 << 20)).option("parquet.block.size.row.check.min", "4")
        .saveAsTable(name)
    )
    return spark.table(name)


def with_answers(texts: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The blocks with what the groups answered so far; only the answers are shuffled."""
    if not answers:
        return texts.select("block", "ids", "payload", F.lit(None).cast("array<struct<level:int,hash_group:int,bits:binary>>").alias("answers"))
    told = None
    for k, answer in enumerate(answers):
        part = answer.select("block", F.struct(F.lit(k).alias("level"), "hash_group", "bits").alias("answer"))
        told = part if told is None else told.union(part)
    gathered = told.groupBy("block").agg(F.collect_list("answer").alias("answers"))
    return texts.join(gathered.hint("shuffle_hash"), "block", "left").select("block", "ids", "payload", "answers")


def over_blocks(rows: DataFrame, levels: int, fn: Callable[[int, Block, list[dict[int, bytes]]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``fn`` over (number, block, answers of each level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, payload, told = (batch.column(c)[i].as_py() for c in range(4))
                answers: list[dict[int, bytes]] = [{} for _ in range(levels)]
                for a in told or []:
                    answers[a["level"]][a["hash_group"]] = a["bits"]
                yield from fn(number, Block(ids, payload), answers)

    return rows.mapInArrow(run, ddl)


def asks(rows: DataFrame, level: list[int], k: int, groups: int) -> DataFrame:
    """The windows of level ``k`` that survived so far, as hashes by group."""
    last = k == len(level) - 1

    def run(number: int, block: Block, answers: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        at = block.candidates(level, k, settled(block, level, answers, groups))
        found = list(Asked(block, at, level[k], groups, last).rows(number, last))
        if found:
            yield table_of(dict(zip(ASKS.names, zip(*found, strict=True), strict=True)), ASKS)

    return over_blocks(rows, k, run, ASKS_DDL)


def answered(asked: DataFrame, last: bool) -> DataFrame:
    """A bit for each asked hash: another block holds it too; at the last level: a document with a smaller doc_id does."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_numpy()
        if last:
            raw = [np.frombuffer(x, "<u8").reshape(2, -1) for x in group["hashes"].to_pylist()]
            high, low = np.concatenate(raw, axis=1)
            docs = np.concatenate([from_planes(x, "<i8") for x in group["docs"].to_pylist()])
            order = np.lexsort((docs, low, high))
            new = np.ones(len(order), bool)
            new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
            least = docs[order[np.flatnonzero(new)]]
            bits = np.empty(len(order), bool)
            bits[order] = least[np.cumsum(new) - 1] < docs[order]
        else:
            values = np.concatenate([np.cumsum(from_planes(x, "<u4"), dtype=np.uint32) for x in group["hashes"].to_pylist()])
            ordered = np.sort(values)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            near = np.minimum(np.searchsorted(twice, values), max(len(twice) - 1, 0))
            bits = twice[near] == values if len(twice) else np.zeros(len(values), bool)
        ends = np.cumsum(sizes)
        packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        return pa.table({"block": group["block"], "hash_group": group["hash_group"], "bits": packed}, schema=ANSWERS)

    return asked.groupBy("hash_group").applyInArrow(run, ANSWERS_DDL)


def kept(rows: DataFrame, level: list[int], done: int, groups: int, text_out: bool) -> DataFrame:
    """Each document without its covered words."""

    def run(number: int, block: Block, answers: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        gone = np.zeros(len(block.doc) + 1, np.int64)
        if done == len(level):
            at = np.flatnonzero(settled(block, level, answers, groups))
            gone[at] += 1
            np.subtract.at(gone, at + level[-1], 1)
        covered = np.cumsum(gone[:-1]) > 0
        ends = np.cumsum(block.counts)
        out: list[list] = [[] for _ in KEPT]
        for d, (text, a, b) in enumerate(zip(block.docs, (ends - block.counts).tolist(), ends.tolist(), strict=True)):
            cut = covered[a:b]
            removed, spans = int(cut.sum()), int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum())
            if removed:
                text = b" ".join([w for w, c in zip(text.split(b" "), cut.tolist(), strict=True) if not c])
            doc = int(block.ids[d])
            values = (None if doc == NO_ID else doc, b - a, removed, hashlib.sha256(text).hexdigest(), spans, text.decode("utf-8", "replace") if text_out else None)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield table_of(dict(zip(KEPT.names, out, strict=True)), KEPT)

    return over_blocks(rows, done, run, KEPT_DDL)


def dedup(docs: DataFrame, window: int = 13, text_out: bool = False, first: int = FIRST, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_words, n_removed, kept_sha256, n_spans, kept_text).

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller doc_id. Words are runs without blanks of ASCII, as they stand.

    Null and empty texts, and those of blanks alone, have no words and lose
    nothing, as texts of fewer words than a window do. Windows repeated inside
    one document alone stay. Rows of one doc_id are no smaller documents to each
    other. A null doc_id is smaller than every other (the smallest long counts
    as null). An empty table gives no rows. ``n_spans`` is the number of removed
    runs; ``kept_text``, on request, the words that stay. Other columns are
    ignored. One block's words are held at a time, a document longer than
    ``BLOCK_BYTES`` being a block of its own.
    """
    if window < 1 or first < 1:
        raise ValueError("a window has a word at least")
    settings(docs.sparkSession)
    level = lengths(window, first)
    texts = blocks(docs)
    words = texts.agg(F.sum("words")).first()[0] or 0
    groups = max(1, -(-words // group_hashes))
    answers: list[DataFrame] = []
    for k in range(len(level)):
        asked = asks(with_answers(texts, answers), level, k, groups)
        answers.append(stored(answered(asked, k == len(level) - 1), "answers"))
        if answers[-1].isEmpty():
            break  # no candidate survives
    return kept(with_answers(texts, answers), level, len(answers), groups, text_out)
