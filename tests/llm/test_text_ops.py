"""Suffix dedup, packing and byte BPE against brute force and their libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import byte_bpe, packing, suffix_dedup
from terrace.llm.queries import tokenizer_file

ROWS = [
    (5, "plain words here"), (6, None), (7, ""), (8, "plain words here"), (8, "plain words here"), (None, "no id " * 40),
    (9, "x" * 9000), (10, "é" * 300 + " 日本 <|endoftext|> İ! It's\t\n\n  done\x1c\x85."), (11, "ab" * 300), (12, "no id " * 40),
]


def removed(rows, length):
    seen, out = {}, {}
    for doc, text in sorted(set(r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i:i + length], (doc, i)) != (doc, i):
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()
    return out


def random_documents(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "era", "tion", "zé", "ouin", "x"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(9)]
    own = lambda: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40)))
    return [(d, "".join(rng.choice(passages) if rng.random() < 0.5 else own() for _ in range(rng.randint(0, 6)))) for d in range(n)]


def test_dedup_equals_brute_force(table, monkeypatch):
    rows = random_documents(80, 5) + [(100 + (d or 0), t) if d is not None else (d, t) for d, t in ROWS]
    expected = removed(rows, 100)
    for wide in (2000, 3):
        monkeypatch.setattr(suffix_dedup, "WIDE_KEY", wide)
        got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.dedup(table(rows, "doc_id long, text string")).collect()]
        assert len(got) == len(rows)
        assert {k: v for k, v in got if k is not None} == expected
        assert [v[1] for k, v in got if k is None] == [0]


def test_dedup_text_and_empty_table(spark, table):
    rows = [(1, "a" * 50 + "bc" * 60), (2, "é" + "bc" * 60 + "tail")]
    out = {r.doc_id: r for r in suffix_dedup.dedup(table(rows, "doc_id long, text string"), 100, True, ["text", "key"]).collect()}
    assert out[2].kept_text == "étail" and out[2].carried.text == rows[1][1] and out[2].carried.key == "x"
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_keeps_repeated_rows(spark, table, monkeypatch):
    passage = " ".join(f"word{i * i}" for i in range(60))
    one, other = f"{passage} one " + "a" * 120, f"other {passage} and {passage[:130]}"
    long = [(d, t) for d, t in random_documents(30, 7) if len(t.encode()) >= 100]
    rows = long * 2 + [(50, passage)] * 3 + [(51, "x " + passage)] * 2 + [(60, one), (60, other), (60, one)]
    # different texts of one doc_id are documents of their own, by hash
    ordered = [r.t for r in spark.createDataFrame([(one,), (other,)], "t string").orderBy(F.xxhash64(F.encode("t", "UTF-8"))).collect()]
    expected = removed(long + [(50, passage), (51, "x " + passage), (60, ordered[0]), (61, ordered[1])], 100)
    for wide, parts in ((2000, 1), (2000, 5), (3, 1), (3, 5)):
        monkeypatch.setattr(suffix_dedup, "WIDE_KEY", wide)
        out = suffix_dedup.dedup(table(rows, "doc_id long, text string", parts), 100, True, ["text"]).collect()
        assert len(out) == len(rows)
        for r in out:
            place = 61 if r.carried.text == ordered[1] else r.doc_id
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[place]
        assert [r.kept_text for r in out if r.doc_id == 50] == [passage] * 3


def test_previous_factors_are_longest():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(20)]
    data, ends = "".join(pieces), np.cumsum([len(p) for p in pieces])
    at, best = suffix_dedup.previous_factors(np.frombuffer(data.encode(), np.uint8), ends, 5)
    end_of = lambda i: next(int(e) for e in ends if e > i)
    starts = [i for i in range(len(data)) if end_of(i) - i >= 5]
    for i, got in zip(at, best, strict=True):
        longest = 0
        for j in (j for j in starts if j < i):
            n = 0
            while i + n < end_of(i) and j + n < end_of(j) and data[i + n] == data[j + n]:
                n += 1
            longest = max(longest, n)
        assert got == longest
    assert sorted(at) == starts


def test_packing_is_whole_and_gapless(spark, table):
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    marked = ["x <|endoftext|> y", "<|startoftext|>", "<|endoftext|><|endoftext|> Word", "é <|endoftext|", "a<|EndOfText|>b"]
    rows = ROWS + [(200 + d, t) for d, t in random_documents(30, 1)] + [(900 + i, t) for i, t in enumerate(marked)]
    out = packing.pack(table(rows, "doc_id long, text string"), tokenizer_file("word_bpe_49k.json"), 64, 1).collect()
    places, pieces = {}, {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for sequence, cuts in places.items():
        at = 0
        for offset, length in sorted(cuts):
            assert offset == at
            at += length
        assert at == 64 or sequence == max(places)
    assert sorted(places) == list(range(len(places)))
    for doc, text in dict(rows).items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        copies = sum(d == doc for d, _ in rows)
        assert sum(r.length for r in pieces[doc]) == copies * len(ids)
        for r in pieces[doc]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length].tolist()
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_byte_bpe_equals_its_library(spark, table):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.BytePairs.of(path, public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    letters = "ab \n\t'sé 日本éx1!🙂\x1c\x85.,"
    rows = ROWS + [(300 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(900 + i, "".join(rng.choice("abetn") for _ in range(300))) for i in range(40)]
    out = byte_bpe.encoded(table(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    digest = byte_bpe.digests(table([(1, None)], "doc_id long, text string"), path, public_tokenizers.PATTERN).first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.PATTERN).count() == 0


def test_decoding_joins_pairs_up_the_tree():
    class Part(bytes):
        depth = 0

        def __add__(self, other):
            out = Part(bytes(self) + bytes(other))
            out.depth = 1 + max(self.depth, other.depth)
            return out

    for n in (0, 1, 2, 3, 7, 64, 1000):
        parts = [Part(f"<{i}>".encode()) for i in range(n)]
        whole = byte_bpe.joined_up(parts)
        assert whole == b"".join(parts) and (n < 2 or whole.depth == (n - 1).bit_length())


def test_joined_halves_equal_the_whole():
    coder = byte_bpe.BytePairs.of(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"abcdethsin") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert coder.join(coder.merged(a), coder.merged(b)) == coder.merged(a + b)


def test_letter_words_share_a_tokenizer_call(monkeypatch):
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"{a}ór{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyzßé"] + ["ªb", "Élan,", "don't", "x1y", "éa", "İs", "µm"]
    alone = [np.array(tokenizer.library.encode(x, add_special_tokens=False).ids, tokenizer.kind).tobytes() for x in words]
    single = []
    encode = tokenizer._encode
    monkeypatch.setattr(tokenizer, "_encode", lambda ws: (single.extend(ws), encode(ws))[1])
    assert tokenizer._words(words) == alone
    assert set(single) == {"don't", "x1y", "éa", "İs"}
    # a tokenizer that splits runs of letters gets each word by itself
    single.clear()
    assert tokenizer._encode_letters(["ab cd", "ef"]) == encode(["ab cd", "ef"]) and single == ["ab cd", "ef"]
