"""Vectors as packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import table_of

PACKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("vector", pa.binary())])


def packed(vectors: DataFrame, with_label: bool) -> DataFrame:
    """(vec_id, label, dim, norm, vector as little-endian doubles) of rows whose vector takes part.

    Left out: null vec_ids, null, empty and zero vectors, null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(dims)
            sound = np.concatenate([[0], np.cumsum(np.isfinite(values))])
            # components scaled by the largest, so that no square leaves the range of doubles
            norm = np.zeros(len(dims))
            good = (dims > 0) & (sound[ends] - sound[ends - dims] == dims)
            rows = []
            for i in np.flatnonzero(good):
                v = values[ends[i] - dims[i]:ends[i]]
                most = np.abs(v).max()
                norm[i] = most * np.sqrt(np.dot(v / most, v / most)) if most > 0 else 0
                good[i] = norm[i] > 0 and np.isfinite(norm[i])
                if good[i]:
                    rows.append(v.astype("<f8").tobytes())
            mask = pa.array(good)
            yield table_of({"vec_id": ids.filter(mask), "label": labels.filter(mask), "dim": dims[good].astype(np.int32), "norm": norm[good], "vector": rows}, PACKED)

    label = F.col("label").cast("long") if with_label else F.lit(None).cast("long")
    source = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return source.mapInArrow(run, "vec_id long, label long, dim int, norm double, vector binary")


def matrix(column: pa.Array) -> np.ndarray:
    """(rows x dim) doubles of packed vectors of one dimension."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
