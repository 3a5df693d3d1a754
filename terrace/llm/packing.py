"""Packing: all token ids concatenated and cut into fixed windows.

Two passes. The first tokenises every whole text and stores its ids with the
offset inside its partition; partition totals are summed to global offsets. The
second cuts at every multiple of the window, so only the last one is short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import settings, slices, stored, table_of

CHUNK_BYTES = 2 << 20
MEMO_WORDS = 1_000_000
JOINED_WORDS = 256
MARKS = ".,;:!?"
_TOKENIZERS: dict[str, WordTokenizer] = {}

TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_offset", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class WordTokenizer:
    """Ids of whole texts, one tokenizer call for each different blank-free run.

    Valid for tokenizers that lower-case, split words from punctuation and drop
    blanks, so that no token crosses a blank. A word, its capitalised form and
    the word with one mark behind it share a call where that is safe. A text that
    holds an added token goes to the tokenizer whole. The memo is emptied when it
    holds ``MEMO_WORDS``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # lower-cased words may look like an added token; whole texts go to a tokenizer that knows those
        self.model.encode_special_tokens = True
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self._encode(list(MARKS)), strict=True))

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, many in one call: a token's word number tells whose it is."""
        out: list[bytes] = []
        width = self.kind.itemsize
        for at in range(0, len(words), JOINED_WORDS):
            group = words[at:at + JOINED_WORDS]
            coded = self.model.encode(" ".join(group), add_special_tokens=False)
            counts = np.bincount(np.array(coded.word_ids, np.int64))
            if len(counts) != len(group):  # not one pre-token a word: each goes by itself
                out += self._encode(group)
                continue
            raw = np.array(coded.ids, self.kind).tobytes()
            ends = (np.cumsum(counts) * width).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = list(map(memo.get, words))
        places = [i for i, x in enumerate(found) if x is None]
        cut = []
        for i in places:
            word = words[i]
            plain = word.isascii() or max(word) <= "\xff"  # beyond, lower case and composition are the tokenizer's own matter
            mark = word[-1] if plain and word[-1] in self.marks and word[:-1].isalpha() else ""
            core = word[:-1] if mark else word
            cut.append((core.lower() if plain else core, mark))
        new = {core for core, _ in cut if core not in memo}
        letters = [core for core in new if core.isalpha() and (core.isascii() or max(core) <= "\xff")]
        memo.update(zip(letters, self._encode_letters(letters), strict=True))
        rest = list(new.difference(letters))
        memo.update(zip(rest, self._encode(rest), strict=True))
        for i, (core, mark) in zip(places, cut, strict=True):
            found[i] = memo[words[i]] = memo[core] + self.marks[mark] if mark else memo[core]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_runs(texts)
        flat, counts = self._by_runs(pc.if_else(pa.array(whole), "", texts))
        at = np.flatnonzero(whole)
        coded = [np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.kind) for i in at]
        sizes = [len(x) for x in coded]
        flat = np.insert(flat, np.repeat(np.cumsum(counts)[at], sizes), np.concatenate(coded))
        counts[at] = sizes
        return flat, counts

    def _by_runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.flatten().filter(pc.not_equal(runs.flatten(), "")).dictionary_encode()
        n_runs = np.zeros(len(texts), np.int64)
        filled = pc.not_equal(runs.flatten(), "").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(filled)])
        offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        n_runs[:] = np.diff(ends[offsets])
        packed = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        sizes = size[which]
        ends_of = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(first[which] - (ends_of - sizes), sizes)
        total = np.concatenate([[0], ends_of])[np.concatenate([[0], np.cumsum(n_runs)])]
        return flat[at], np.diff(total)


def tokenized(docs: DataFrame, tokenizer_path: str, eos: int) -> DataFrame:
    """(doc_id, part, part_offset, n, ids) of all rows: ids, then ``eos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_path)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(pc.binary_length(texts).to_pylist(), CHUNK_BYTES):
                flat, counts = tokenizer.encode(texts.slice(i, j - i))
                # the end id behind each text
                flat = np.insert(flat, np.cumsum(counts), eos)
                n = counts + 1
                ends = np.cumsum(n)
                raw = flat.tobytes()
                w = tokenizer.kind.itemsize
                packed = [raw[a * w:b * w] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield table_of({"doc_id": batch.column(0).slice(i, j - i), "part": np.full(j - i, part, np.int32), "part_offset": at + ends - n, "n": n, "ids": packed}, TOKENS)
                at += int(n.sum())

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, part int, part_offset long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, eos: int = 1) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Documents stand in table order, each with ``eos`` behind its ids. A null text
    counts as empty, so it gives the ``eos`` alone; a repeated row is packed
    again; a null doc_id is kept; an empty table gives no rows. Other columns are
    ignored. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    settings(docs.sparkSession)
    tokens = stored(tokenized(docs, tokenizer_path, eos), "tokens", "zstd")
    # one row per partition of the scan: bounded by the number of tasks
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases, at = {}, 0
    for part, total in totals:
        bases[part] = at
        at += total
    kind = WordTokenizer.of(tokenizer_path).kind.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = PIECES.append(pa.field("ids", pa.binary()))
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, part, before, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, kind).astype("<u4")
                start, first = 0, bases[part] + before
                while start < n:
                    offset = (first + start) % window
                    length = min(window - offset, n - start)
                    piece = wide[start:start + length].tobytes()
                    for name, value in zip(out, (doc, start, length, zlib.crc32(piece), n, (first + start) // window, offset, piece), strict=True):
                        out[name].append(value)
                    start += length
            yield table_of(out, schema)

    return tokens.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
