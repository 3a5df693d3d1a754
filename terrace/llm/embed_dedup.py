"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector is rotated at random and kept as the signs of its coordinates, with
the inner product of vector and code as its correction factor. For a pair, code
times rotated vector over the factor is an unbiased estimate of the cosine, with
a known error bound. Signs under further rotations form table keys; vectors that
share a key of some table are compared: the bound rejects most pairs, and what it
cannot reject is computed exactly. A pair counts in the first table it shares.
Full buckets are cut into blocks that meet pair by pair, and only sums and
components leave a task, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import components, settings, stored, table_of
from terrace.llm.vectors import matrix, packed, rotation

TABLES = 62
BITS = 16
BLOCK = 512
CONFIDENCE = 4.0
BATCH_ROWS = 20_000

CODED = pa.schema([("vec_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("dim", pa.int32()), ("codes", pa.binary()), ("factor", pa.float64()), ("unit", pa.binary())])
SUMS = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PROJECTIONS: dict[int, np.ndarray] = {}


def projections(dim: int) -> np.ndarray:
    """(dim x TABLES * BITS) columns of stacked random rotations; the first rotation also makes the code."""
    if dim not in _PROJECTIONS:
        stacks = -(-TABLES * BITS // dim)
        _PROJECTIONS[dim] = np.hstack([rotation(dim, 1 + k) for k in range(stacks)])[:, :max(TABLES * BITS, dim)]
    return _PROJECTIONS[dim]


def table_codes(unit: np.ndarray) -> np.ndarray:
    """(rows x TABLES) 16-bit sign codes."""
    signs = (unit @ projections(unit.shape[1]))[:, :TABLES * BITS] > 0
    return np.packbits(signs.reshape(len(unit), TABLES, BITS), axis=2).view(np.uint16)[:, :, 0]


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, keys, dim, codes, factor, unit) of packed vectors with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims, norms, vectors_ = (batch.column(i) for i in range(5))
            for dim in np.unique(dims.to_numpy()):
                mask = pa.array(dims.to_numpy() == dim)
                unit = matrix(vectors_.filter(mask)) / norms.filter(mask).to_numpy()[:, None]
                rotated = unit @ projections(dim)[:, :dim]
                factor = np.abs(rotated).sum(axis=1) / np.sqrt(dim)
                codes = table_codes(unit)
                label = labels.filter(mask).to_numpy().view(np.uint64)
                keys = mixed(mixed(label * np.uint64(TABLES) * np.uint64(4096) + np.uint64(dim * TABLES))[:, None] + np.arange(TABLES, dtype=np.uint64) * np.uint64(1 << BITS) + codes).view(np.int64)
                yield table_of({"vec_id": ids.filter(mask), "keys": list(keys), "dim": dims.filter(mask), "codes": [c.tobytes() for c in codes], "factor": factor, "unit": [u.tobytes() for u in unit]}, CODED)

    return vectors.mapInArrow(run, "vec_id long, keys array<long>, dim int, codes binary, factor double, unit binary")


def surviving(unit_a: np.ndarray, unit_b: np.ndarray, factor_a: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (rows_a[k], rows_b[k]) the estimate cannot rule out."""
    dim = unit_a.shape[1]
    turn = projections(dim)[:, :dim]
    code = np.where(unit_a @ turn > 0, 1.0, -1.0) / np.sqrt(dim)
    rotated = unit_b @ turn
    bound = CONFIDENCE * np.sqrt(np.maximum(1 - factor_a**2, 0)) / factor_a / np.sqrt(max(dim - 1, 1))
    if len(rows_a) * 4 > len(unit_a) * len(unit_b):
        guess = (code @ rotated.T)[rows_a, rows_b]
    else:
        guess = np.einsum("ij,ij->i", code[rows_a], rotated[rows_b])
    return guess / factor_a[rows_a] + bound[rows_a] >= least


def local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id in each row's component of the links (a, b)."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def bucket_links(meeting: DataFrame, least: float) -> DataFrame:
    """(vec_id, n, root) sums over the sorted rows of ``meeting`` (key, lo, hi, place, side, ...vector)."""

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        key, lo, hi, place, side, ids = (rows[c].to_numpy() for c in ("key", "lo", "hi", "place", "side", "vec_id"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint16).reshape(-1, TABLES)
        factor = rows["factor"].to_numpy()
        units = rows["unit"].to_pylist()
        a_all, b_all = [], []

        def pairs(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """Keep the links among pairs of positions in ``members``."""
            vectors = np.frombuffer(b"".join([units[m] for m in members]), "<f8").reshape(len(members), -1)
            ok = surviving(vectors, vectors, factor[members], a, b, least)
            a, b = a[ok], b[ok]
            cosine = np.einsum("ij,ij->i", vectors[a], vectors[b])
            a, b = members[a[cosine >= least]], members[b[cosine >= least]]
            tables = np.arange(TABLES)[None, :] < place[a][:, None]
            earlier = ((codes[a] == codes[b]) & tables).any(axis=1)
            a_all.append(a[~earlier])
            b_all.append(b[~earlier])

        small = size <= 24
        for n in np.unique(size[small]):
            if n < 2:
                continue
            groups = first[size == n]
            one, two = np.triu_indices(n, 1)
            for k in range(0, len(groups), max(1, 40_000 // len(one))):
                part = groups[k:k + max(1, 40_000 // len(one))]
                members = (part[:, None] + np.arange(n)).ravel()
                base = np.arange(len(part))[:, None] * n
                a, b = (base + one).ravel(), (base + two).ravel()
                apart = (lo[members[a]] == hi[members[a]]) | (side[members[a]] != side[members[b]])
                pairs(members, a[apart], b[apart])
        for start, n in zip(first[~small], size[~small], strict=True):
            members = np.arange(start, start + n)
            if lo[start] == hi[start]:
                pairs(members, *np.triu_indices(n, 1))
            else:
                left, right = np.flatnonzero(side[members] == lo[start]), np.flatnonzero(side[members] == hi[start])
                pairs(members, np.repeat(left, len(right)), np.tile(right, len(left)))
        if not a_all or not sum(map(len, a_all)):
            return None
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        nodes, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
        root = local_roots(len(nodes), at[:len(a)], at[len(a):], nodes)
        return table_of({"vec_id": nodes, "n": np.bincount(at, minlength=len(nodes)), "root": root}, SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= BATCH_ROWS:
                key, lo, hi = (held[c].to_numpy() for c in ("key", "lo", "hi"))
                # the last group may go on in the next batch
                whole = len(key) - int(np.argmin(((key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1]))[::-1])) if (key[0], lo[0], hi[0]) != (key[-1], lo[-1], hi[-1]) else 0
                if whole:
                    out = settle(held.slice(0, whole))
                    held = held.slice(whole)
                    if out is not None:
                        yield out
        if held is not None and held.num_rows:
            out = settle(held)
            if out is not None:
                yield out

    return meeting.mapInArrow(run, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors with equal non-null labels and dimensions are linked if found with a
    cosine of ``least`` or more. Null labels, null, empty and zero vectors, and
    vectors with null or non-finite components are linked with nothing. Rows that
    repeat a vec_id stand for one vector (one of them speaks for it) and get the
    same result; a null vec_id has no component and is kept. An empty table gives
    no rows; other columns are ignored.
    """
    settings(vectors.sparkSession)
    ready = stored(coded(packed(vectors, True).filter("label is not null").dropDuplicates(["vec_id"])), "coded")
    slim = ready.select("vec_id", F.posexplode("keys").alias("place", "key"))
    sizes = slim.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = slim.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    shared = shared.withColumn("side", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    met = shared.select("vec_id", "key", "place", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("vec_id", "key", "place", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    meeting = met.join(ready.select("vec_id", "codes", "factor", "unit"), "vec_id")
    meeting = meeting.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vec_id")
    sums = stored(bucket_links(meeting, least), "sums")
    counts = sums.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    found = components(sums.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "vec_id")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
