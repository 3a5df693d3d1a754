"""Near-duplicate documents by HyperMinHash over word shingles.

A document's distinct shingles fall into buckets; each bucket keeps its smallest
hash as a compressed register: leading zeros and a few mantissa bits. Empty
buckets borrow from others by a fixed probe order. Bands of registers propose
pairs, a collision-corrected estimate drops the hopeless ones, and the rest is
decided on full shingle sets.

Documents with equal sets are one class and only its first goes on. Small bands
propose all their pairs. Large ones compare all members with four pivots. The
documents that these links leave outside the largest component of their family
(what large bands tie together) are compared with the whole family in blocks,
exactly. So a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import components, settings, slices, stored, table_of

REGISTERS = 240
BAND = 6
MANTISSA = 10
PAIRED = 16
STRAY_BLOCK = 128
FAMILY_BLOCK = 256
SLACK = 0.2
CHUNK_BYTES = 1 << 20
EMPTY = np.uint64(2**64 - 1)

# up to so many ids (16 bytes each in a broadcast table) the wanted texts are picked where they lie
LISTED_IDS = 4_000_000

FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])
FEATURES_DDL = "doc_id long, n long, digest binary, registers binary"
BANDS = pa.schema([("key", pa.int64()), ("doc", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters A-Z in lower case, words cut at ASCII blanks."""
    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = runs.flatten()
    filled = pc.not_equal(flat, "")
    coded = flat.filter(filled).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[offsets]
    wide = hashes
    for k in range(1, words):
        wide = mixed(wide[:-1], k) + hashes[k:] if len(wide) > 1 else wide[:0]
    wide = mixed(wide, 99)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(wide[a:b - words + 1]))
        elif b > a:
            one = hashes[a:b].tobytes() + b"short"
            out.append(np.array([xxhash.xxh3_64_intdigest(one)], np.uint64))
        else:
            out.append(hashes[:0])
    return out


def probe_order(rounds: int) -> np.ndarray:
    """(rounds x REGISTERS) buckets from which an empty one borrows, in turn."""
    grid = np.arange(rounds * REGISTERS, dtype=np.uint64)
    return (mixed(grid, 7) % np.uint64(REGISTERS)).astype(np.int64).reshape(rounds, REGISTERS)


_PROBES = probe_order(4096)


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hashes, as 16 bits."""
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 63).astype(np.uint64)
    mantissa = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x REGISTERS) registers; rows of empty sets are meaningless."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    least = np.full(n * REGISTERS, EMPTY)
    np.minimum.at(least, row * REGISTERS + (x % np.uint64(REGISTERS)).astype(np.int64), mixed(x, 3))
    least = least.reshape(n, REGISTERS)
    open_row, open_at = np.nonzero((least == EMPTY) & np.array([len(s) > 0 for s in sets])[:, None])
    filled = least.copy()
    step = 0
    while len(open_row):
        # after the listed probes, the next bucket in turn: it ends for every non-empty set
        source = _PROBES[step, open_at] if step < len(_PROBES) else (open_at + step) % REGISTERS
        got = least[open_row, source]
        hit = got != EMPTY
        filled[open_row[hit], open_at[hit]] = got[hit]
        open_row, open_at = open_row[~hit], open_at[~hit]
        step += 1
    return compress(filled)


def bands(rows: np.ndarray) -> np.ndarray:
    """(rows x bands) keys, each with its band's number in it."""
    parts = rows.reshape(len(rows), REGISTERS // BAND, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(REGISTERS // BAND, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        key = mixed(key, k) + parts[:, :, k]
    return mixed(key, 11).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the share of chance matches expected at these sizes."""
    same = (a == b).mean(axis=1)
    levels = np.arange(1, 64)[:, None]

    def zeros_are(n: np.ndarray) -> np.ndarray:
        per = np.maximum(n / REGISTERS, 1.0)
        return (1 - 0.5 ** levels) ** per - (1 - 0.5 ** (levels - 1)) ** per

    chance = (zeros_are(n_a) * zeros_are(n_b)).sum(axis=0) / 2**MANTISSA
    return (same - chance) / (1 - chance)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    for i, j in slices(pc.binary_length(batch.column(1)).to_pylist(), CHUNK_BYTES):
        yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)


def features(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, registers) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, texts in _texts(batch):
                sets = shingle_sets(texts, words)
                n = np.array([len(s) for s in sets])
                rows = registers(sets)
                yield table_of({
                    "doc_id": doc, "n": n,
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "registers": [r.tobytes() if k else None for r, k in zip(rows, n, strict=True)],
                }, FEATURES)

    return docs.mapInArrow(run, FEATURES_DDL)


def band_rows(feats: DataFrame) -> DataFrame:
    """(key, doc) for each band of the sets that an unequal set can be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
                yield table_of({"key": keys.ravel(), "doc": np.repeat(batch.column(0).to_numpy(), keys.shape[1])}, BANDS)

    return feats.filter("n > 1").select("doc_id", "registers").mapInArrow(run, "key long, doc long")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, texts in _texts(batch):
                yield table_of({"doc_id": doc, "shingles": [s.tobytes() for s in shingle_sets(texts, words)]}, SETS)

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _hopeful(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose registers do not speak against it."""
    left = slim.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = slim.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    joined = pairs.join(left, "a").join(right, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r_a, r_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            keep = estimate(r_a, r_b, batch.column(4).to_numpy(), batch.column(5).to_numpy()) >= percent / 100 - SLACK
            yield table_of({"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}, schema)

    return joined.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity, as (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, s, t in zip(*batch.columns, strict=True):
                s, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
                both = np.sort(np.concatenate([s, t]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    rows.append((a.as_py(), b.as_py()))
            yield table_of({"u": [r[0] for r in rows], "v": [r[1] for r in rows]}, schema)

    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "u long, v long")


def _family_links(meeting: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between strays and members of other components, from rows sorted by (family, stray_block, block).

    One block of strays meets one block of the family: all shared counts come from
    products of 0/1 matrices over bounded runs of shingles, and only a star for
    each local component leaves the task.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[3])
        sets = [np.frombuffer(r[6].as_buffer(), np.uint64) for r in rows]
        doc, component = (np.array([r[i] for r in rows], np.int64) for i in (4, 5))
        n = int(sum(r[3] == 0 for r in rows))
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((n, len(rows) - n), np.float32)
        for first in range(0, int(column[-1]) + 1, 4096):
            i, j = np.searchsorted(column, (first, first + 4096))
            here = np.zeros((len(rows), 4096), np.float32)
            here[row[i:j], column[i:j] - first] = 1
            shared += here[:n] @ here[n:].T
        near = 100 * shared >= percent * (size[:n, None] + size[None, n:] - shared)
        a, b = np.nonzero(near & (component[:n, None] != component[None, n:]))
        if not len(a):
            return None
        star = {}
        for x, y in sorted(zip(doc[a].tolist(), component[n + b].tolist(), strict=True)):
            star.setdefault((x, y), y)
        return table_of({"u": [k[0] for k in star], "v": [k[1] for k in star]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*plain, batch.column(6), strict=True):
                if held and held[-1][:3] != row[:3]:
                    out = settle(held)
                    held = []
                    if out is not None:
                        yield out
                held.append(row)
        if held and (out := settle(held)) is not None:
            yield out

    return meeting.mapInArrow(run, "u long, v long")


def _strays_against_families(crowd: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large bands that the pivots missed.

    ``crowd`` pairs each document with the first one of each of its large bands;
    documents that share large bands form a family. Where its links so far leave
    documents outside its largest component, these strays are compared with the
    whole family, block by block.
    """
    families = components(crowd.select(F.col("doc").alias("u"), F.col("p0").alias("v"))).withColumnRenamed("component", "family")
    linked = components(found)
    placed = families.withColumnRenamed("node", "doc").join(linked, F.col("doc") == linked.node, "left")
    placed = stored(placed.select("doc", "family", F.coalesce("component", "doc").alias("component")), "families")
    sizes = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    largest = largest.filter(F.col("all") > F.col("top.n")).select(
        "family", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / STRAY_BLOCK).cast("int").alias("stray_blocks"),
        F.ceil(F.col("all") / FAMILY_BLOCK).cast("int").alias("blocks"))
    mixed_ = placed.join(largest, "family")
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = mixed_.filter("component <> main").select("family", own("stray_blocks").alias("stray_block"), every("blocks").alias("block"), F.lit(0).alias("side"), "doc", "component")
    rest = mixed_.select("family", every("stray_blocks").alias("stray_block"), own("blocks").alias("block"), F.lit(1).alias("side"), "doc", "component")
    meeting = strays.union(rest).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("family", "stray_block", "block", "side", "doc", "component", "shingles")
    meeting = meeting.repartition("family", "stray_block", "block").sortWithinPartitions("family", "stray_block", "block")
    return _family_links(meeting, percent)


def links(docs: DataFrame, feats: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) that connect every component of the class representatives in ``feats``."""
    slim = feats.select("doc_id", "n", "registers")
    rows = band_rows(feats)
    # counts alone go with all keys; pivots are sought in the large bands only
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(rows.join(sizes, "key"), "members")
    small = members.filter(F.col("size") <= PAIRED).select("key", "doc")
    pairs = small.select("key", F.col("doc").alias("a")).join(small.select("key", F.col("doc").alias("b")), "key").filter("a < b").select("a", "b")
    large = members.filter(F.col("size") > PAIRED).select("key", "doc")
    pivots = large.groupBy("key").agg(F.min("doc").alias("p0"), F.max("doc").alias("p1"), F.min_by("doc", F.xxhash64("doc")).alias("p2"), F.max_by("doc", F.xxhash64("doc")).alias("p3"))
    # the pivots are the same documents in most bands of a family
    led = stored(large.join(pivots, "key").select("doc", "p0", "p1", "p2", "p3").distinct(), "led")
    met = led.select("doc", F.explode(F.array("p0", "p1", "p2", "p3")).alias("pivot")).filter("doc <> pivot")
    met = met.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
    hopeful = stored(_hopeful(pairs.union(met).distinct(), slim, percent), "hopeful")
    crowd = stored(led.select("doc", "p0").distinct(), "crowd")
    wanted = hopeful.select(F.col("a").alias("doc_id")).union(hopeful.select(F.col("b").alias("doc_id"))).union(crowd.select(F.col("doc").alias("doc_id"))).distinct()
    wanted = stored(wanted, "wanted")
    if wanted.count() <= LISTED_IDS:
        wanted = F.broadcast(wanted)
    sets = stored(full_sets(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), words).dropDuplicates(["doc_id"]), "sets")
    found = stored(_confirmed(hopeful, sets, percent), "links")
    return found.union(_strays_against_families(crowd, found, sets, percent))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if 100 * shared >= ``percent`` * all of their
    distinct ``words``-word shingles; fewer words make one shingle. Null, empty
    and blank texts have no shingles and no links. component_id is the smallest
    doc_id reachable; kept marks the document that bears it. Rows that repeat a
    doc_id stand for the same document and are judged alike (if their texts
    differ, one of them speaks for it in links). A null doc_id has no place in
    that order: its row has no component, is linked with nothing and is kept. An
    empty table gives no rows; other columns are ignored.
    """
    settings(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    feats = stored(features(source, words), "features")
    classes = feats.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    firsts = classes.select(F.col("first").alias("doc_id")).distinct()
    chosen = stored(feats.join(firsts, "doc_id").dropDuplicates(["doc_id"]), "classes")
    found = links(source.filter("doc_id is not null"), chosen, words, percent)
    same = feats.filter("doc_id is not null and digest is not null").select("doc_id", "digest").join(classes, "digest")
    # a doc_id with several texts ties their classes together
    tied = same.select(F.col("doc_id").alias("u"), F.col("first").alias("v")).filter("u <> v").groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    twice = tied.filter("v <> w").select("v", F.col("w").alias("u")).select("u", "v")
    reached = components(found.union(twice)).select(F.col("node").alias("first"), "component")
    of_doc = same.groupBy("doc_id").agg(F.min("first").alias("first")).join(reached, "first", "left").select(
        "doc_id", F.least(F.coalesce("component", "first"), "doc_id").alias("component_id"))
    out = feats.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
