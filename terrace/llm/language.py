"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language, all over one union of n-grams: for each order a sorted
array of n-gram hashes with a row of log probabilities, one per language, and a
sorted array of context hashes with the back-off weights. A text gets the
language with the lowest cross-entropy per character; its score is a calibrated
softmax over the entropies, and a text beyond the largest entropy that its
language showed in calibration is not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import filtered, settings, slices, table_of

ORDER = 5
FIT_DOCS = 1200
CALIBRATION_DOCS = 300
# symbols x languages held at once
CHUNK_CELLS = 1 << 20
CHUNK_CHARS = CHUNK_CELLS // 4
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
OUT = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_()),
])
OUT_DDL = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"


def letters() -> np.ndarray:
    """Lower-case letter of every code point, a blank for what is no letter."""
    if not _LETTERS:
        lower = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                small = c.lower()
                lower[code] = ord(small) if len(small) == 1 else code
        _LETTERS.append(lower)
    return _LETTERS[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start, end): letters and single blanks of each text, with ``ORDER`` - 1 blanks before it."""
    gap = " " * (ORDER - 1)
    joined = "".join([gap + t for t in texts])
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    code = letters()[raw]
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    starts = ends - [len(t) for t in texts]
    blank = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    before = np.zeros(len(code), bool)
    before[(starts[:, None] - np.arange(1, ORDER)).ravel()] = True
    keep |= before
    # a blank right behind the lead is one too many
    inside = starts[starts < len(code)]
    keep[inside[blank[inside]]] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], place[starts], place[ends]


def hashes(code: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each symbol, for n = 1..ORDER (0 where it would start before the first)."""
    out = []
    wide = code.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(code), np.uint64)
    for _ in range(ORDER):
        shifted = np.zeros_like(h)
        shifted[1:] = h[:-1]
        h = (shifted ^ (shifted >> np.uint64(29))) * _STEP + wide * np.uint64(0xD6E8FEB86659FD93)
        out.append(h)
    return out


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class HashArray:
    """Sorted hashes; a lookup starts at the first one with the same leading bits."""

    keys: np.ndarray
    bits: int = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bits = max(4, int(2 * len(self.keys)).bit_length())
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is absent."""
        at = self.first[h >> np.uint64(64 - self.bits)]
        got = self.keys[at]
        behind = np.flatnonzero(got < h)
        while len(behind):
            at[behind] += 1
            got[behind] = self.keys[at[behind]]
            behind = behind[got[behind] < h[behind]]
        return np.where((got == h) & (at < len(self.keys) - 1), at, -1)


@dataclass
class Model:
    """Languages, and for each order n-grams with log probabilities and contexts with log back-off weights."""

    langs: list[str]
    grams: list[HashArray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashArray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0
    sharpness: float = 1.0
    limit: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropy per symbol, and whether a text has letters."""
        code, start, end = symbols(texts)
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        where = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        ladder = hashes(code)
        logs = np.zeros((len(where), len(self.langs)))
        open_ = np.arange(len(where))
        for n in range(ORDER, 0, -1):
            at = self.grams[n - 1].find(spread(ladder[n - 1][where[open_]]))
            hit = at >= 0
            logs[open_[hit]] += self.logs[n - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            if n > 1:
                context = self.contexts[n - 1].find(spread(ladder[n - 2][where[open_] - 1]))
                known = context >= 0
                logs[open_[known]] += self.backoff[n - 1][context[known]]
        logs[open_] += self.floor
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(logs, axis=0)])
        index = np.concatenate([[0], np.cumsum(np.cumsum(inside)[:-1] > 0)])
        n = index[end] - index[start]
        letter = np.concatenate([[0], np.cumsum(code != 32)])
        return -(sums[index[end]] - sums[index[start]]) / np.maximum(n, 1)[:, None], letter[end] > letter[start]

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """(place of the first, texts) of runs of a column whose symbols for all languages are held at once; null counts as empty."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, j in slices(sizes, min(CHUNK_CHARS, CHUNK_CELLS // max(1, len(self.langs)))):
            yield i, [t or "" for t in texts.slice(i, j - i).to_pylist()]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, accepted) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        entropy, lettered = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        share = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        over = np.maximum(0, low - self.limit[best])
        score = np.where(lettered, share * np.exp(-over), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score, np.where(lettered, low, 0.0), lettered & (over == 0)


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                own = texts[langs == lang].tolist()
                for i, j in slices([len(t) for t in own], CHUNK_CHARS):
                    code, start, end = symbols(own[i:j])
                    places = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)] or [np.zeros(0, int)])
                    _, first, n = np.unique(hashes(code)[-1][places], return_index=True, return_counts=True)
                    windows = np.lib.stride_tricks.sliding_window_view(code, ORDER)[places[first] - ORDER + 1]
                    whole = windows.astype("<u4").tobytes().decode("utf-32-le")
                    yield table_of({"lang": [lang] * len(n), "gram": [whole[k:k + ORDER] for k in range(0, len(whole), ORDER)], "n": n}, GRAMS)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from top-order counts; gram is (rows x ORDER) code points."""
    model = Model(langs)
    size = len(langs)
    per_order = {ORDER: (lang, gram, count.astype(float))}
    for n in range(ORDER - 1, 0, -1):
        _, wider, _ = per_order[n + 1]
        rows = np.column_stack([per_order[n + 1][0], wider[:, 1:]])
        unique, n_before = np.unique(rows, axis=0, return_counts=True)
        per_order[n] = (unique[:, 0], unique[:, 1:], n_before.astype(float))
    alphabet = len(np.unique(gram)) + 1
    model.floor = -float(np.log(alphabet))

    def keyed(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = (h ^ (h >> np.uint64(29))) * _STEP + (rows[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return spread(h)

    lower = None
    for n in range(1, ORDER + 1):
        which, rows, c = per_order[n]
        ones, twos = (np.bincount(which[c == k], minlength=size) for k in (1, 2))
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
        key = keyed(rows)
        keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), size))
        counts[inverse, which] = c
        context_key = keyed(rows[:, :-1])
        contexts, context_of = np.unique(context_key, return_inverse=True)
        total, types = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, (context_of, which), c)
        np.add.at(types, (context_of, which), 1)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        mine = context_of[at]
        if n == 1:
            below = np.full((len(keys), size), 1 / alphabet)
        else:
            below = lower[0][lower[1].find(keyed(rows[at][:, 1:]))]
        p = np.where(total[mine] > 0, np.maximum(counts - discount, 0) / np.maximum(total[mine], 1), 0) + weight[mine] * below
        table = HashArray(keys)
        model.grams.append(table)
        model.logs.append(np.log(p))
        model.contexts.append(HashArray(contexts))
        model.backoff.append(np.log(weight))
        lower = p, table
    return model


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, lang, text) without held-out documents or null lang.

    At most ``fit_docs`` whole documents of a language give counts, and
    ``calibration_docs`` others the score's sharpness and the entropy limits; both
    are taken by hash of doc_id, so the sample is the same at any partitioning.
    """
    spark = docs.sparkSession
    settings(spark)
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    for keys in (("lang", "part"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= fit_docs + calibration_docs)
    # bounded by the parameters times the number of languages
    picked = [(r.doc_id, r.lang, r.h) for r in chosen.select("doc_id", "lang", "h").collect()]
    langs = sorted({lang for _, lang, _ in picked})
    if not langs:
        return Model([])
    by_lang: dict[str, list] = {}
    for doc_id, lang, h in sorted(picked, key=lambda r: (r[1], r[2], r[0] if r[0] is not None else -1)):
        by_lang.setdefault(lang, []).append(doc_id)
    part = {}
    for ids in by_lang.values():
        n_calibration = min(calibration_docs, len(ids) // 5)
        part.update({d: i < n_calibration for i, d in enumerate(ids) if d is not None})
    ids = spark.createDataFrame([(d, c) for d, c in part.items()], "doc_id long, calibrate boolean")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    rows = gram_counts(sample.filter("not calibrate")).toArrow()
    if not rows.num_rows:
        return Model([])
    number = {name: i for i, name in enumerate(langs)}
    gram = np.frombuffer("".join(rows["gram"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.uint32)
    counts = rows["n"].to_numpy().copy()
    del rows
    pa.default_memory_pool().release_unused()
    model = build(langs, lang, gram, counts)
    model.limit = np.full(len(langs), np.inf)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("entropy", pa.list_(pa.float64()))])
        for batch in batches:
            for i, texts in model.runs(batch.column(1)):
                entropy, lettered = model.entropies(texts)
                yield table_of({"lang": [x if ok else None for x, ok in zip(batch.column(0).slice(i, len(texts)).to_pylist(), lettered, strict=True)], "entropy": entropy.tolist()}, schema)

    seen = sample.filter("calibrate").select("lang", "text").mapInArrow(measured, "lang string, entropy array<double>").filter("lang is not null").collect()
    if seen:
        entropy = np.array([r.entropy for r in seen])
        truth = np.array([number[r.lang] for r in seen])
        gap = entropy - entropy[np.arange(len(truth)), truth][:, None]
        grid = 2.0 ** np.arange(0, 8, 0.5)
        model.sharpness = float(min(grid, key=lambda s: float(np.log(np.exp(-s * gap).sum(axis=1)).mean())))
        for k in range(len(langs)):
            own = entropy[truth == k, k]
            if len(own) >= 5:
                # twice the range seen above the median: only texts unlike any in calibration lie beyond
                model.limit[k] = float(np.median(own) + 2 * (own.max() - np.median(own)) + 0.5)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) of every row of ``docs``, from its text alone.

    A null or empty text, or one without letters, is ``und`` with score 0 and not
    accepted; so is every text where no language was learned. Ties go to the
    language first by name. Repeated rows and null doc_ids are kept; an empty
    table gives no rows; other columns are ignored.
    """
    settings(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in model.runs(batch.column(1)):
                lang, score, entropy, accepted = model.judge(texts)
                yield table_of({"doc_id": batch.column(0).slice(i, len(texts)), "lang_pred": lang, "score": score, "cross_entropy": entropy, "accepted": accepted}, OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, OUT_DDL)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text is in a learned language, all columns; all rows where none was learned."""

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(model.judge(texts)[3] for _, texts in model.runs(batch.column("text")))])

    settings(docs.sparkSession)
    return filtered(docs, mask) if model.langs else docs
