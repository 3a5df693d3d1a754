"""Quality by co-training: a text view and a metadata view teach each other, then judge together.

Both views start from the labelled sample. In each round a view labels the pool
rows it is surest of, in the proportion of the classes, and hands them to the
other one. It teaches only while its sure calls are right on labelled rows that
neither view learns from, and the other one keeps a lesson only if its loss there
does not rise. The same rows calibrate both views and a small model over them,
which scores every document; the least accepted score is cut on yet other rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import filtered, settings, slices, table_of

LABELLED_DOCS = 6000
POOL_DOCS = 4000
ROUNDS = 4
PER_ROUND = 200
SURE = 0.95
CHUNK_BYTES = 1 << 18
FIT_ROWS = 512
BUCKETS = 64
WORD_BUCKETS = 64
CLASSES = 16
N_STATS = 8
N_TEXT = 129 + CLASSES * CLASSES + 2 * WORD_BUCKETS + N_STATS

FEATURES = pa.schema([("doc_id", pa.int64()), ("text_view", pa.list_(pa.float32())), ("meta_view", pa.list_(pa.float32()))])
OUT = pa.schema([("doc_id", pa.int64()), ("quality_score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("accepted", pa.bool_())])
OUT_DDL = "doc_id long, quality_score double, text_score double, meta_score double, accepted boolean"


def byte_classes() -> np.ndarray:
    """Upper, lower, digit, blank, line end, beyond ASCII, and ten groups of marks."""
    kind = np.full(256, 5, np.uint8)
    for code in range(128):
        c = chr(code)
        kind[code] = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c in "\r\n" else 3 if c.isspace() else 6 + code % 10
    return kind


_KIND = byte_classes()


def text_view(texts: list[bytes]) -> np.ndarray:
    """One row per text: shares of bytes, of neighbouring byte classes, of hashed words and word pairs, and word statistics."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, N_TEXT), np.float32)
    scale = np.maximum(sizes, 1)[:, None]
    out[:, :129] = np.sqrt(np.bincount(doc * 129 + np.minimum(data, 128), minlength=n * 129).reshape(n, 129) / scale)
    kind = _KIND[data]
    pairs = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    counts = np.bincount((doc[:-1] * CLASSES * CLASSES + pairs)[same], minlength=n * CLASSES * CLASSES) if len(data) > 1 else np.zeros(n * CLASSES * CLASSES)
    out[:, 129:129 + CLASSES * CLASSES] = np.sqrt(counts.reshape(n, -1) / scale)
    for i, text in enumerate(texts):
        words = text.split()
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        pair = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[1:]
        for k, h in enumerate((hashed, pair)):
            at = 129 + CLASSES * CLASSES + k * WORD_BUCKETS
            out[i, at:at + WORD_BUCKETS] = np.sqrt(np.bincount((h >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS) / max(len(h), 1))
        distinct = len(set(words))
        twins = sum(map(bytes.__eq__, words, words[1:])) if distinct < 0.9 * len(words) else 0
        lines = text.split(b"\n")
        out[i, -N_STATS:] = (
            distinct / max(len(words), 1), twins / max(len(words), 1), len(text) / max(len(words), 1) / 10,
            len(set(lines)) / len(lines), np.log1p(len(words)), np.log1p(len(lines)), not words, len(lines) / max(len(words), 1),
        )
    return out


def meta_view(columns: list[pa.Array]) -> np.ndarray:
    """One row per document, by the type of each column: numbers as logarithms, all else one-hot by hash of its whole text; null has a place of its own."""
    parts = []
    for column in columns:
        kind, part = column.type, np.zeros((len(column), BUCKETS), np.float32)
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind) or pa.types.is_boolean(kind):
            number = np.array([np.nan if v is None else float(v) for v in column.to_pylist()])
            size = np.log1p(np.abs(np.nan_to_num(number, posinf=1e300, neginf=1e300)))
            part[:, 0], part[:, 1], part[:, 2] = np.isnan(number), size / 10, (size / 10) ** 2
            part[np.arange(len(number)), np.minimum(3 + size.astype(int), BUCKETS - 1)] = 1
        else:
            for i, v in enumerate(column.to_pylist()):
                part[i, 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (BUCKETS - 1)] = 1
        parts.append(part)
    return np.hstack(parts) if parts else np.zeros((0, 0), np.float32)


@dataclass
class Linear:
    """Logistic regression with ridge, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> Linear:
        """Sums run over slices of rows, so that the driver holds no second copy of ``x``."""
        parts = [slice(a, a + FIT_ROWS) for a in range(0, len(x), FIT_ROWS)]
        mean = sum(x[s].sum(axis=0, dtype=np.float64) for s in parts) / len(x)
        scale = np.sqrt(sum(((x[s] - mean) ** 2).sum(axis=0) for s in parts) / len(x)) + 1e-3
        w = np.zeros(x.shape[1] + 1)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            slope, bend = penalty * w, np.diag(penalty)
            for s in parts:
                z = np.hstack([(x[s] - mean) / scale, np.ones((len(x[s]), 1))])
                p = sigmoid(z @ w)
                slope += z.T @ (p - y[s])
                bend += (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z
            step = np.linalg.solve(bend, slope)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Both views, their calibrations, the combination and the least accepted score."""

    metadata: list[str]
    text: Linear | None = None
    meta: Linear | None = None
    text_scale: Linear | None = None
    meta_scale: Linear | None = None
    both: Linear | None = None
    threshold: float = 0.5

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return (np.full(len(text), 0.5),) * 3
        a = self.text_scale.logit(self.text.logit(text)[:, None])
        b = self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return sigmoid(self.both.logit(np.column_stack([a, b]))), sigmoid(a), sigmoid(b)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, text view, metadata view) of bounded runs of rows; columns are doc_id, text, metadata."""
    raw = batch.column(1).cast(pa.binary())
    for i, j in slices(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), CHUNK_BYTES):
        texts = [t or b"" for t in raw.slice(i, j - i).to_pylist()]
        yield batch.column(0).slice(i, j - i), text_view(texts), meta_view([c.slice(i, j - i) for c in batch.columns[2:]])


def _source(docs: DataFrame, metadata: list[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *metadata)


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def trustworthy(y: np.ndarray, p: np.ndarray) -> bool:
    """Are the sure calls for both classes right often enough?"""
    good, bad = y[p >= SURE], y[p <= 1 - SURE]
    return bool(len(good) and len(bad) and good.mean() >= SURE and 1 - bad.mean() >= SURE)


def lesson(p: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labels) of the surest pool rows, both classes in proportion."""
    good = np.argsort(-p, kind="stable")[:round(PER_ROUND * prior)]
    bad = np.argsort(p, kind="stable")[:round(PER_ROUND * (1 - prior))]
    good, bad = good[p[good] >= SURE], bad[p[bad] <= 1 - SURE]
    share = min(len(good) / max(prior, 1e-9), len(bad) / max(1 - prior, 1e-9))
    good, bad = good[:int(share * prior)], bad[:int(share * (1 - prior))]
    if not len(good) or not len(bad):
        return np.zeros(0, int), np.zeros(0)
    return np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, metadata: list[str], rounds: int = ROUNDS) -> Model:
    """The model from labelled rows and pool rows; of five labelled rows three teach, one calibrates and guards, one cuts."""
    turn = np.arange(len(y)) % 5
    taught, guard, cut = turn < 3, turn == 3, turn == 4
    if len(set(y[taught])) < 2 or len(set(y[guard])) < 2 or not (y[cut] == 1).any():
        taught = guard = cut = np.ones(len(y), bool)  # a handful of rows: nothing to hold out
    views = {"text": (text, pool_text), "meta": (meta, pool_meta)}
    extra = {name: (np.zeros(0, int), np.zeros(0)) for name in views}
    prior = float(y[taught].mean())

    def learned(name: str, rows: np.ndarray, labels: np.ndarray) -> Linear:
        own, pool = views[name]
        return Linear.fit(np.vstack([own[taught], pool[rows]]), np.concatenate([y[taught], labels]))

    fitted = {name: learned(name, *extra[name]) for name in views}
    for _ in range(rounds if len(pool_text) else 0):
        gained = False
        for name, other in (("text", "meta"), ("meta", "text")):
            if not trustworthy(y[guard], sigmoid(fitted[name].logit(views[name][0][guard]))):
                continue
            free = np.setdiff1d(np.arange(len(pool_text)), extra[other][0])
            rows, labels = lesson(sigmoid(fitted[name].logit(views[name][1][free])), prior)
            if not len(rows):
                continue
            tried = np.concatenate([extra[other][0], free[rows]]), np.concatenate([extra[other][1], labels])
            pupil = learned(other, *tried)
            held = views[other][0][guard]
            if log_loss(y[guard], sigmoid(pupil.logit(held))) <= log_loss(y[guard], sigmoid(fitted[other].logit(held))):
                fitted[other], extra[other], gained = pupil, tried, True
        if not gained:
            break
    model = Model(metadata, fitted["text"], fitted["meta"])
    a, b = model.text.logit(text[guard])[:, None], model.meta.logit(meta[guard])[:, None]
    model.text_scale, model.meta_scale = Linear.fit(a, y[guard]), Linear.fit(b, y[guard])
    model.both = Linear.fit(np.column_stack([model.text_scale.logit(a), model.meta_scale.logit(b)]), y[guard])
    # rejection is for what is surely poor: of the good rows held out for it, one in five hundred is lost
    good = np.sort(model.score(text[cut], meta[cut])[0][y[cut] == 1])
    model.threshold = float(min(0.5, good[int(len(good) * 0.002)]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: list[str] | None = None, labelled_docs: int = LABELLED_DOCS, pool_docs: int = POOL_DOCS) -> Model:
    """Fit on at most ``labelled_docs`` labelled and ``pool_docs`` other whole documents, taken by hash of doc_id.

    A document with several label rows takes their mean, half or more being good.
    Without rows of both classes the model scores everything 0.5 and accepts it.
    """
    spark = docs.sparkSession
    settings(spark)
    metadata = [c for c in ("source", "lang", "n_chars") if c in docs.columns] if metadata is None else metadata
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("mark"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().join(marks, "doc_id", "left").withColumn("h", F.xxhash64("doc_id"))
    picked = {}
    # both are bounded by their parameter
    for name, where, n in (("labelled", "mark is not null", labelled_docs), ("pool", "mark is null", pool_docs)):
        picked[name] = {r.doc_id: r.mark for r in ids.filter(where).orderBy("h", "doc_id").limit(n).collect()}
    if len(set(picked["labelled"].values())) < 2:
        return Model(metadata)
    wanted = spark.createDataFrame([(d,) for part in picked.values() for d in part], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, meta in _views(batch):
                yield table_of({"doc_id": doc, "text_view": list(text), "meta_view": list(meta)}, FEATURES)

    source = _source(docs, metadata).join(F.broadcast(wanted), "doc_id")
    rows = source.mapInArrow(run, "doc_id long, text_view array<float>, meta_view array<float>").toArrow()
    doc = rows["doc_id"].to_numpy()
    known = np.array([d in picked["labelled"] for d in doc], bool)
    order = np.argsort(doc, kind="stable")
    # each row goes straight to its place among the labelled or the pool rows, in order of doc_id
    slot = np.empty(len(doc), int)
    slot[order] = np.where(known[order], np.cumsum(known[order]), np.cumsum(~known[order])) - 1
    y = np.empty(int(known.sum()))
    y[slot[known]] = [picked["labelled"][d] for d in doc[known]]
    text, meta = (_placed(rows[name], known, slot) for name in ("text_view", "meta_view"))
    del rows
    pa.default_memory_pool().release_unused()
    return cotrain(text[True], meta[True], y, text[False], meta[False], metadata)


def _placed(views: pa.ChunkedArray, known: np.ndarray, slot: np.ndarray) -> dict[bool, np.ndarray]:
    """The rows of a view as two matrices, the labelled ones and the others, filled chunk by chunk."""
    width = len(views[0]) if len(views) else 0
    out = {side: np.empty((int((known == side).sum()), width), np.float32) for side in (True, False)}
    start = 0
    for chunk in views.chunks:
        part = chunk.flatten().to_numpy().reshape(len(chunk), width)
        here = slice(start, start + len(chunk))
        for side, matrix in out.items():
            rows = known[here] == side
            matrix[slot[here][rows]] = part[rows]
        start += len(chunk)
    return out


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score, text_score, meta_score, accepted) of every row of ``docs``.

    Null and empty texts are texts without words; null metadata has its own
    feature. Repeated rows and null doc_ids are kept; an empty table gives no
    rows; columns other than the model's are ignored. A score equal to the
    threshold is accepted.
    """
    settings(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, meta in _views(batch):
                score, a, b = model.score(text, meta)
                yield table_of({"doc_id": doc, "quality_score": score, "text_score": a, "meta_score": b, "accepted": score >= (model.threshold if model.text else 0)}, OUT)

    return _source(docs, model.metadata).mapInArrow(run, OUT_DDL)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model does not reject, all columns; all rows of an unfitted model."""

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        views = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", *model.metadata)], names=["doc_id", "text", *model.metadata])
        return np.concatenate([np.zeros(0, bool), *(model.score(text, meta)[0] >= model.threshold for _, text, meta in _views(views))])

    settings(docs.sparkSession)
    return filtered(docs, mask) if model.text else docs
