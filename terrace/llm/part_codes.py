"""Vector codes by integer k-means over parts, with a trie over the distinct parts.

A vector is cut into parts; equal parts at one position are one row with a
weight. The distinct parts lie in lexicographic order, so neighbours share their
first components and a run of them is a trie. Each task walks its runs depth
first: a node holds the distances of its prefix to all entries, a child adds
one component to them, a leaf takes the nearest entry and adds its weight and
its weighted components to that entry. Subtrees of up to ``SUBTREE`` leaves are
walked height by height, whole nodes at a time; larger ones are split at their
children, so a task holds one path and one subtree.

A round sends back sums for each entry, a number of rows fixed by the
parameters; the next codebook is their integer mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import settings, stored, table_of

SCALE = 4096
SUBTREE = 4096
LIMB = 60
# Scaled components beyond this are no finite single-precision numbers.
LARGEST = 2.0 ** 140

KEPT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("cells", pa.binary())])
KEPT_DDL = "vec_id long, label string, dim int, cells binary"
PARTS = pa.schema([("position", pa.int32()), ("part", pa.binary()), ("weight", pa.int64())])
PARTS_DDL = "position int, part binary, weight long"
SUMS = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("axis", pa.int32()), ("high", pa.string()), ("low", pa.string())])
SUMS_DDL = "position int, entry int, axis int, high string, low string"
CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
CODED_DDL = "vec_id long, label string, code string, error long"

Codebook = list[list[list[int]]]  # position, entry, component


def ordered_bytes(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles to bytes whose order is the order of the numbers; (rows, axes) to (rows, 8 * axes)."""
    bits = (values + 0.0).view(np.int64)  # + 0.0 makes -0.0 and 0.0 one number
    flipped = np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63))
    return flipped.astype(">i8").view(np.uint8).reshape(len(values), 8 * values.shape[1])


def from_ordered(cells: list[bytes], axes: int) -> np.ndarray:
    flipped = np.frombuffer(b"".join(cells), ">i8").astype(np.int64).reshape(len(cells), axes)
    return np.where(flipped < 0, flipped ^ np.int64(-1 << 63), ~flipped).view(np.float64)


def whole_numbers(values: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries as 64-bit integers where no squared distance can leave them, else as Python's."""
    most = max([abs(float(x)) for a in (values, codebook) for x in ((a.min(), a.max()) if a.size else ())], default=0.0)
    small = values.shape[1] * (2 * most) ** 2 < 2.0 ** 62
    if small:
        return values.astype(np.int64), codebook.astype(np.int64)
    big = np.frompyfunc(int, 1, 1)
    return big(values), codebook


def leaves(points: np.ndarray, codebook: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, past the last, distances to each entry) of runs of leaves under a trie of sorted distinct rows.

    A stack entry is a node: its rows, its depth, the distances of its prefix.
    """
    axes = points.shape[1]
    new = np.ones((len(points), axes), bool)  # does the prefix up to this axis differ from the row before?
    if axes:
        new[1:] = np.logical_or.accumulate(points[1:] != points[:-1], axis=1)
    stack = [(0, len(points), 0, np.zeros(len(codebook), points.dtype))] if len(points) else []
    while stack:
        first, last, depth, held = stack.pop()
        if last - first <= SUBTREE or depth == axes:
            rows = np.zeros(1, np.int64)  # first row of every node of this height
            totals = held[None, :]
            for axis in range(depth, axes):
                starts = new[first:last, axis].copy()
                starts[0] = True
                children = np.flatnonzero(starts)
                parent = np.searchsorted(rows, children, "right") - 1
                gap = points[first + children, axis][:, None] - codebook[None, :, axis]
                rows, totals = children, totals[parent] + gap * gap
            yield first, last, totals[np.searchsorted(rows, np.arange(last - first), "right") - 1]
            continue
        starts = new[first:last, depth].copy()
        starts[0] = True
        edges = [*(first + np.flatnonzero(starts)).tolist(), last]
        for a, b in reversed(list(zip(edges, edges[1:]))):
            gap = points[a, depth] - codebook[:, depth]
            stack.append((a, b, depth + 1, held + gap * gap))


def nearest(points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and its squared distance, of sorted distinct rows."""
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
    for first, last, totals in leaves(points, codebook):
        best = np.argmin(totals, axis=1)
        index[first:last] = best
        distance[first:last] = totals[np.arange(len(best)), best]
    return index, distance


def kept(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, dim, cells: the scaled whole components in ordered bytes) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            dims = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
                sound = np.concatenate([[0], np.cumsum(np.abs(scaled) < LARGEST)])
            ends = np.cumsum(dims)
            good = (dims > 0) & (sound[ends] - sound[ends - dims] == dims)
            flat = ordered_bytes(np.where(np.isfinite(scaled), scaled, 0).reshape(-1, 1)).tobytes()
            cells = [flat[8 * (ends[i] - dims[i]):8 * ends[i]] for i in np.flatnonzero(good)]
            mask = pa.array(good)
            yield table_of({"vec_id": ids.filter(mask), "label": labels.filter(mask), "dim": dims[good].astype(np.int32), "cells": cells}, KEPT)

    source = vectors.filter("embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return source.mapInArrow(run, KEPT_DDL)


def distinct_parts(rows: DataFrame, positions: int, dim: int) -> DataFrame:
    """Each different part of a position once, with the rows that hold it, in lexicographic order."""
    size = 8 * dim // positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_pylist()
            for p in range(positions):
                parts, counts = np.unique(np.array([c[p * size:(p + 1) * size] for c in cells], f"V{size}"), return_counts=True)
                yield table_of({"position": [p] * len(parts), "part": [x.tobytes() for x in parts], "weight": counts}, PARTS)

    found = rows.select("cells").mapInArrow(run, PARTS_DDL).groupBy("position", "part").agg(F.sum("weight").alias("weight"))
    return found.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def entry_sums(parts: DataFrame, codebooks: Codebook) -> list:
    """(position, entry, axis, sum) over the parts nearest to each entry; axis -1 is their number."""
    axes = len(codebooks[0][0])

    def batch_sums(position: int, points: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        points, entries = whole_numbers(points, np.array(codebooks[position], object))
        index, _ = nearest(points, entries)
        heavy = points.dtype == object or float(weights.sum()) * (float(np.abs(points).max(initial=0)) + 1) >= 2.0 ** 62
        kind = object if heavy else np.int64
        for entry in np.unique(index).tolist():
            own = index == entry
            weight = weights[own].astype(kind)
            yield position, entry, -1, int(weight.sum())
            for axis, total in enumerate((points[own].astype(kind) * weight[:, None]).sum(axis=0)):
                yield position, entry, axis, int(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            position = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(position)) + 1).tolist(), len(position)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                points = from_ordered(batch.column(1).slice(a, b - a).to_pylist(), axes)
                for p, entry, axis, total in batch_sums(int(position[a]), points, batch.column(2).to_numpy()[a:b]):
                    totals[p, entry, axis] = totals.get((p, entry, axis), 0) + total
        if totals:
            keys = list(zip(*totals, strict=True))
            yield table_of({"position": keys[0], "entry": keys[1], "axis": keys[2], "high": [str(v >> LIMB) for v in totals.values()], "low": [str(v & (1 << LIMB) - 1) for v in totals.values()]}, SUMS)

    sums = parts.mapInArrow(run, SUMS_DDL).groupBy("position", "entry", "axis").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    return [(r.position, r.entry, r.axis, (int(r.high) << LIMB) + int(r.low)) for r in sums.collect()]  # positions * entries * (axes + 1) rows at most


def trained(rows: DataFrame, positions: int, entries: int, rounds: int) -> tuple[int, Codebook]:
    """The common dimension and the codebooks after all rounds; dimension 0 where no vector takes part."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "dim", "cells").limit(entries).collect()
    if not first:
        return 0, []
    dim = first[0].dim
    if dim % positions:
        raise ValueError(f"vectors of {dim} components cannot be cut into {positions} equal parts")
    if any(r.dim != dim for r in first):
        first = rows.filter(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "cells").limit(entries).collect()
    axes = dim // positions
    start = from_ordered([bytes(r.cells) for r in first], dim)
    codebooks = [[[int(x) for x in row[p * axes:(p + 1) * axes]] for row in start] for p in range(positions)]
    parts = stored(distinct_parts(rows.filter(F.col("dim") == dim), positions, dim), "parts")
    for _ in range(rounds):
        sums = {(p, e, a): total for p, e, a, total in entry_sums(parts, codebooks)}
        codebooks = [[
            [sums[p, e, a] // sums[p, e, -1] for a in range(axes)] if (p, e, -1) in sums else entry
            for e, entry in enumerate(book)] for p, book in enumerate(codebooks)]
    return dim, codebooks


def coded(rows: DataFrame, dim: int, codebooks: Codebook) -> DataFrame:
    """(vec_id, label, code, error) of each vector; a batch's parts are a trie of their own."""
    axes = dim // len(codebooks)
    size = 8 * axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_pylist()
            codes, errors = [], [0] * len(cells)
            for p, book in enumerate(codebooks):
                parts, back = np.unique(np.array([c[p * size:(p + 1) * size] for c in cells], f"V{size}"), return_inverse=True)
                points, entries = whole_numbers(from_ordered([x.tobytes() for x in parts], axes), np.array(book, object))
                index, distance = nearest(points, entries)
                codes.append(index[back])
                errors = [e + int(d) for e, d in zip(errors, distance[back].tolist(), strict=True)]
            code = ["".join(f"{int(c[i]):02x}" for c in codes) for i in range(len(cells))]
            yield table_of({"vec_id": batch.column(0), "label": batch.column(1), "code": code, "error": [e if e < 1 << 63 else None for e in errors]}, CODED)

    return rows.filter(F.col("dim") == dim).select("vec_id", "label", "cells").mapInArrow(run, CODED_DDL)


def codebooks_digest(codebooks: Codebook) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each kept row of ``vectors`` (vec_id, embedding, label).

    Left out: null and empty vectors, null or non-finite components, components
    of ``LARGEST / scale`` or more (no single-precision number is), vectors of
    another dimension than the first one's. Null vec_ids are coded and come last
    when the first entries are picked; rows of one vec_id stand in the order of
    their vectors; repeated rows count each. With fewer vectors than entries the
    codebooks are shorter. Null labels are one group. An error, or a sum of
    errors, that no long holds is null. An empty table gives no rows. Other
    columns are ignored. ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    settings(vectors.sparkSession)
    rows = stored(kept(vectors, scale), "vectors")
    dim, codebooks = trained(rows, positions, entries, rounds)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = stored(coded(rows, dim, codebooks), "codes")
    fits = F.count(F.when(F.col("error").isNull(), 1)) == 0
    sums = out.groupBy(F.col("label").alias("_label")).agg(F.when(fits, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
