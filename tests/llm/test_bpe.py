"""BPE by merge rounds against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe, queries
from tessera.llm.tokens import vocabulary

from .conftest import ODD, odd_docs


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(None))


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(vocabulary(None))


POOL = ["a", "b", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "é", " ", "　", " ", "'s",
        "'ll", "'", "'re", "'d've", "1", "23", "!", "...", "中", "🙂", "\x1c", "\x85", "<|endoftext|>",
        "<|endoftext", "|>", "Ã", "\x7f", "\x00", "՘", "꟎", "Hello", " world", "ss", "²", "́"]


def check(own, lib, texts):
    ids, off = own.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == want[i], repr(t)
    back = own.decode(ids, off).to_pylist()
    assert back == [lib.decode(w, skip_special_tokens=False) for w in want] == [t or "" for t in texts]


def test_random_texts_have_the_ids_of_the_library(own, lib):
    rng = random.Random(3)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    check(own, lib, [None, "", " ", "  ", "\n\n", "'s's", "a's b'll 're", " 's", "\n's", *texts])


def test_special_string_at_every_place(own, lib):
    text = "It's  a <test>, 中文\n12"
    for i in range(len(text) + 1):
        check(own, lib, [text[:i] + "<|endoftext|>" * k + text[i:] for k in (1, 2)])
    check(own, lib, ["<|endoft", "ext|>"])                # not across rows


def test_every_character_class(own, lib):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 997                        # a different run of characters in each text
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points[k::step])
             for k in range(0, step, 125)]
    check(own, lib, texts)


def test_long_words_and_runs(own, lib):
    rng = random.Random(5)
    words = ["a" * n for n in (255, 256, 257, 1000, 4097)]
    words += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (300, 5000, 60_000)]
    words += ["ab" * 3000, " " * 5000, "\n" * 999 + "x", "é" * 700, "x" * 300 + " " + "y" * 300]
    check(own, lib, words)
    check(own, lib, [" ".join(words)])


@pytest.mark.parametrize("piece", [1, 7, 40])
def test_pieces_of_long_texts(own, lib, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice(POOL + ["w x", " y ", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))
             for _ in range(1500)]
    check(own, lib, texts + [None, "", "one two  three <|endoftext|> four " * 20])
    for t in texts[:300]:
        check(own, lib, [t])


def test_memory_of_a_long_text(own):
    import tracemalloc
    text = pa.array(["some words of a long text, and more " * 240_000])       # 8.6 MB
    own.encode(pa.array(["some words of a long text, and more "]))
    tracemalloc.start()
    ids, _ = own.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 2_000_000 and peak < 260 << 20


def test_rounds_and_buckets_agree(own):
    rng = np.random.default_rng(0)
    size = rng.integers(1, 60, 300)
    data = rng.choice(np.frombuffer(b"aabcdeth in", np.uint8), int(size.sum()))
    sym = own.byte_id[data]
    ids, count = own.merge(sym, size)
    word = np.repeat(np.arange(len(size)), size)
    ids2, word2 = own.merge_long(sym, word)
    assert ids.tolist() == ids2.tolist()
    assert count.tolist() == np.bincount(word2, minlength=len(size)).tolist()


def test_words_seen_start_over(own, lib, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    check(own, lib, [f"word{k} and {k * 7}" for k in range(40)])
    check(own, lib, [f"other{k} and {k * 7}" for k in range(40)])


def test_decode_of_any_ids(own, lib):
    rng = random.Random(9)
    rows = [[rng.randrange(50_257) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = own.decode(np.array([i for r in rows for i in r], np.int32), off).to_pylist()
    assert got == [lib.decode(r, skip_special_tokens=False) for r in rows]
    assert own.decode(np.array([64, 50_300, -1, 65], np.int32), np.array([0, 4])).to_pylist() == ["ab"]


def test_other_vocabularies_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_odd_rows(spark, lib):
    rows = ODD + [(90, "tail <|endoftext|> x")]
    got = bpe.decode(bpe.encode(odd_docs(spark, rows))).collect()
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(odd_docs(spark, rows).limit(0))).count() == 0
    text_ids = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    assert bpe.encode(text_ids).first().doc_id == "k"


def test_query_against_the_library(spark, lib):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op12_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(
            lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
