"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors get one more coordinate that makes all norms equal, so the largest inner
product is the smallest angle. Rotations learned on a bounded sample (iterative
quantisation from several starts) turn them into sign codes. Every row is
indexed: each block of rows files its codes under every substring. A search
within Hamming radius R probes, by the pigeonhole principle, all substrings
within R / m or one less, which finds every code within R; the radius grows until
enough codes are found, and those are ranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import settings, stored, table_of
from terrace.llm.vectors import packed, rotation

CODE_BITS = 256
PART_BITS = 8
SAMPLE = 4000
BLOCK = 4096
QUERY_BLOCK = 2048
FOUND_SHARE = 0.025
STEP = 8

BLOCKS = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())])
BLOCKS_DDL = "dim int, ids binary, vectors binary, codes binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

_POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
_BY_WEIGHT = np.argsort(_POPCOUNT, kind="stable").astype(np.int64)
_UP_TO = np.cumsum(np.bincount(_POPCOUNT, minlength=9))


@dataclass
class Codec:
    """Learned rotations for one dimension, the norm all vectors are raised to, and the first radius."""

    turns: np.ndarray
    norm: float
    radius: int = CODE_BITS // 2

    def codes(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """(rows x CODE_BITS / 8) code bytes; queries are not lifted."""
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0)) if lift else np.zeros(len(x))
        return np.packbits(np.column_stack([x, rest]) @ self.turns > 0, axis=1)


def learn(sample: np.ndarray, norm: float, rounds: int = 15) -> Codec:
    """Iterative quantisation from several random rotations until there are ``CODE_BITS`` bits."""
    lifted = np.column_stack([sample, np.sqrt(np.maximum(norm**2 - np.einsum("ij,ij->i", sample, sample), 0))])
    dim = lifted.shape[1]
    turns = []
    for k in range(-(-CODE_BITS // dim)):
        turn = rotation(dim, 100 + k)
        for _ in range(rounds):
            turned = lifted @ turn
            u, _, v = np.linalg.svd(np.where(turned > 0, 1.0, -1.0).T @ lifted)
            turn = (u @ v).T
        turns.append(turn)
    codec = Codec(np.hstack(turns)[:, :CODE_BITS], norm)
    a, b = codec.codes(sample[:500], False), codec.codes(sample, True)
    apart = _POPCOUNT[a[:, None, :] ^ b[None, :, :]].sum(axis=2, dtype=np.int64)
    codec.radius = int(np.quantile(apart, FOUND_SHARE))
    return codec


class MultiIndex:
    """A block's codes, filed under the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.n, self.parts = codes.shape
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.rows = np.argsort(codes, axis=0, kind="stable").T.ravel()
        counts = np.stack([np.bincount(codes[:, t], minlength=256) for t in range(self.parts)])
        self.start = np.concatenate([[0], np.cumsum(counts.ravel())])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits."""
        small, rest = divmod(radius, self.parts)
        buckets = []
        for tables, weight in ((np.arange(rest + 1), small), (np.arange(rest + 1, self.parts), small - 1)):
            if weight >= 0 and len(tables):
                near = _BY_WEIGHT[:_UP_TO[min(weight, PART_BITS)]]
                buckets.append((tables[:, None] * 256 + (code[tables].astype(np.int64)[:, None] ^ near)).ravel())
        bucket = np.concatenate(buckets)
        first = self.start[bucket]
        size = self.start[bucket + 1] - first
        ends = np.cumsum(size)
        seen = np.zeros(self.n, bool)
        seen[self.rows[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]] = True
        rows = np.flatnonzero(seen)
        apart = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1)
        return rows[apart <= radius]

    def enough(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows within the smallest tried radius that holds ``least`` of them."""
        while True:
            rows = self.within(code, radius)
            if len(rows) >= min(least, self.n) or radius >= CODE_BITS:
                return rows
            radius += STEP


def _blocks(vectors: DataFrame, codecs: dict[int, Codec], size: int, lift: bool) -> DataFrame:
    """Packed rows as blocks of at most ``size`` vectors of one dimension, each with its codes."""

    def block(dim: int, ids: list, rows: list) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dim)
        return table_of({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [x.tobytes()], "codes": [codecs[dim].codes(x, lift).tobytes()]}, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for vec_id, dim, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                rows.append(row)
                if len(ids) == size:
                    yield block(dim, ids, rows)
                    del held[dim]
        for dim, (ids, rows) in held.items():
            yield block(dim, ids, rows)

    return vectors.select("vec_id", "dim", "vector").mapInArrow(run, BLOCKS_DDL)


def search(vectors: DataFrame, is_query: Column, k: int = 20, found_share: float = FOUND_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` largest inner products found among all other rows.

    All rows of its own dimension are candidates, itself excepted; ties go to the
    smaller vec_id. Null vec_ids, null, empty and zero vectors, and vectors with
    null or non-finite components take no part. Rows that repeat a vec_id count
    once; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    settings(spark)
    rows = stored(packed(vectors, False).dropDuplicates(["vec_id"]), "vectors")
    codecs = {}
    # a row for each dimension that occurs; few in any sane table
    for r in rows.groupBy("dim").agg(F.max("norm").alias("norm")).collect():
        picked = rows.filter(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
        codecs[r.dim] = learn(np.frombuffer(b"".join(picked["vector"].to_pylist()), "<f8").reshape(-1, r.dim), r.norm)
    blocks = stored(_blocks(rows, codecs, BLOCK, True).withColumn("shard", F.monotonically_increasing_id()), "index")
    queries = _blocks(rows.filter(is_query), codecs, QUERY_BLOCK, False)
    shards = blocks.select("shard", "dim")
    asked = queries.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "codes": "q_codes"}).join(shards, "dim")
    meeting = blocks.drop("dim").join(asked, "shard").select("dim", "ids", "vectors", "codes", "q_ids", "q_vectors", "q_codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x, codes, q_ids, q, q_codes in zip(*batch.columns, strict=True):
                dim = dim.as_py()
                ids, q_ids = (np.frombuffer(c.as_buffer(), np.int64) for c in (ids, q_ids))
                x, q = (np.frombuffer(c.as_buffer(), "<f8").reshape(-1, dim) for c in (x, q))
                codes, q_codes = (np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, CODE_BITS // 8) for c in (codes, q_codes))
                index = MultiIndex(codes)
                out: list[list[np.ndarray]] = [[], [], []]
                for j in range(len(q_ids)):
                    near = index.enough(q_codes[j], codecs[dim].radius, max(4 * (k + 1), int(found_share * index.n)))
                    near = near[ids[near] != q_ids[j]]
                    # one product after another, in the order of the components
                    score = np.einsum("ij,j->i", x[near], q[j])
                    best = np.lexsort((ids[near], -score))[:k]
                    for column, values in zip(out, (np.full(len(best), q_ids[j]), ids[near][best], score[best]), strict=True):
                        column.append(values)
                yield table_of(dict(zip(FOUND.names, map(np.concatenate, out), strict=True)), FOUND)

    found = meeting.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
