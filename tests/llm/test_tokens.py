"""Tokenisation, the token store and packing: exact round trips."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, token_store, tokens
from tessera.llm.tokens import Encoder, vocabulary

from .conftest import ODD, odd_docs


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary(None))


@lru_cache
def library():
    """The library's tokenizer with its defaults, no setting changed."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(None))


def plain(enc, text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def test_special_string_at_every_place(enc):
    text = "It's a <|test|>, x 12\n y"
    texts = [text[:i] + "<|endoftext|>" * k + text[i:] for i in range(len(text) + 1) for k in (1, 2)]
    texts += ["a <|endoftext|> b", "<|endoft", "ext|>", "a<|endoftext|", "<|endoftext|><|endoftext"]
    ids, first = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == plain(enc, t), repr(t)
    assert plain(enc, "a <|endoftext|> b") == [64, 220, 50256, 275, 0]


def test_parts_give_the_ids_of_whole_texts(enc):
    rng = random.Random(1)
    pool = ["a", "b", " ", "  ", "\n", "\t", "é", "\u00a0", "\u3000", "\u2009", "'s", "'ll", "1",
            "23", "!", "...", "中", "🙂", "\x1c", "\x85", "<|endoftext|>", " é", "Ã", "\x7f", "\x00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", " ", " a"]
    ids, first = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == plain(enc, t), repr(t)


class Watched:
    """The library's tokenizer, noting the texts it is given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, []

    def encode_batch_fast(self, texts, **given):
        self.texts += texts
        return self.tok.encode_batch_fast(texts, **given)


def test_new_parts_are_joined_and_those_met_again_kept(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PARTS", 300)
    enc = Encoder(vocabulary(None))
    enc.tok = seen = Watched(enc.tok)
    common = " ".join(f"often{chr(97 + k)}" for k in range(20)) + ".\nA word é.\nÉt"

    def check(texts):
        seen.texts.clear()
        ids, first = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[first[i]:first[i + 1]].tolist() == plain(enc, t), repr(t)
        return "".join(seen.texts)

    assert "oftenc" in check([common])
    assert len(seen.texts) <= 3                     # 26 parts, each a text of its own before
    for k in range(20):                             # 50 new parts a round: several times too many
        rare = " ".join("rare" + chr(97 + k) + chr(97 + j // 10) + chr(97 + j % 10) for j in range(50))
        assert "rare" in check([common, rare]) and "often" not in "".join(seen.texts)
    assert len(enc.keys) < 2000


def test_cuts_at_marks_and_line_feeds(enc):
    rng = random.Random(2)
    pool = ["a", "é", "ж", "Ö", "×", "÷", "\u0301", "\u0482", "ª", "²", ".", "'", "'s", "_", "-", "\n", "\n\n",
            "\r", " ", "  ", "1", "中", "�", "<|endoftext|>", "<|", "Of", "\u0085"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts += [f"{a}{b}{c}" for a in pool for b in pool for c in pool]
    ids, first = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == plain(enc, t), repr(t)


def test_bytes_that_are_no_text_do_not_hinder_the_others(enc):
    texts = ["fine words.\nHere", "new ones, too"]
    ids, first = enc.encode(pa.array([texts[0].encode(), b"odd \xc3 \xe2\x82 bytes", texts[1].encode()], pa.binary()))
    assert ids[:first[1]].tolist() == plain(enc, texts[0])
    assert ids[first[2]:].tolist() == plain(enc, texts[1])
    assert ids[first[1]:first[2]].tolist() == plain(enc, "odd \ufffd \ufffd bytes")


@pytest.mark.parametrize("counts", [[5], [0, 3, 0], [1, 1], [1, 2, 4, 8, 16, 1 << 40],
                                    [2 ** min(k, 60) for k in range(80)], list(range(3000))])
def test_code_is_prefix_free_limited_and_exact(counts):
    counts = np.array(counts, np.int64)
    lengths = token_store.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).sum() == (counts > 0).sum() and lengths.max() <= token_store.LIMIT
    if len(used) > 1:
        assert (2 ** -used).sum() == 1
    book = token_store.Book(lengths)
    ids = np.random.default_rng(0).choice(np.flatnonzero(counts), 2000).astype(np.uint32)
    first = np.array([0, 1, 1, 700, 2000])
    data, byte, rel = book.encode(ids, first)
    rows = [(k, e - s, rel[s:e:token_store.EVERY].astype("<u4").tobytes(), data[a:b])
            for k, (s, e, a, b) in enumerate(zip(first, first[1:], byte, byte[1:]))]
    blob, n = token_store.encode_block(rows, 17)
    doc, out, at, start = token_store.decode_block(blob, book.table())
    assert n == 2000 and start == 17 and (out == ids).all() and at.tolist() == first.tolist()


def test_store_round_trip_on_odd_rows(spark, enc):
    rows = ODD + [(k, f"text {k} " * (k % 7)) for k in range(20, 200)] + [(50, "again")] * 40
    got = sorted(token_store.round_trip(odd_docs(spark, rows)).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    run = 0
    for r in got:
        assert r["start"] == run and len(r["ids"]) == 4 * r["n_tokens"]
        run += r["n_tokens"]
    want = sorted((str(i), np.array(plain(enc, t), "<u4").tobytes()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want


def test_store_of_an_empty_table(spark):
    assert token_store.round_trip(odd_docs(spark, [])).count() == 0


def _check_pieces(rows, got, enc, length=1024):
    want = sorted(zlib.crc32(np.array(plain(enc, t), "<u4").tobytes()) for _, t in rows)
    docs = {}
    for r in sorted(got, key=lambda r: r["start"]):
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    total = sum(r["length"] for r in got)
    assert total == sum(len(plain(enc, t)) for _, t in rows)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        run = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == run
            run += r["length"]
        # full, or one of the powers of two at the end
        assert run == length or (s >= total // length and run & (run - 1) == 0)
    whole = [b"".join(bytes(r["ids"]) for r in p) for p in docs.values()
             if sum(r["length"] for r in p) == p[0]["doc_tokens"]]
    assert set(map(zlib.crc32, whole)) <= set(want)
    return docs


def test_every_id_is_packed_once(spark, enc):
    rows = [r for r in ODD if r[0] not in (4, None)] + \
        [(k, " ".join(f"w{k}x{j}" for j in range(k % 90))) for k in range(20, 400)]
    docs = odd_docs(spark, rows).repartition(5)
    got = packing.pack(docs, window=4096, grain=64).collect()
    by_doc = _check_pieces(rows, got, enc)
    for (i, n), p in by_doc.items():
        run = 0
        for r in p:
            assert r["start"] == run
            run += r["length"]
        assert run == n
        text = dict(rows)[i]
        assert b"".join(bytes(r["ids"]) for r in p) == np.array(plain(enc, text), "<u4").tobytes()


def test_repeated_rows_and_empty_table(spark, enc):
    rows = ODD
    got = packing.pack(odd_docs(spark, rows)).collect()
    _check_pieces(rows, got, enc)
    assert packing.pack(odd_docs(spark, [])).count() == 0


def test_weights_of_small_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    monkeypatch.setattr(packing, "REST", 2)
    size = {"a": 60, "b": 50, "c": 20, "d": 20, "e": 20, "0": 20, "1": 20, None: 20}
    rows = [(s, k, f"{s} {k} " + "some words of a text " * 20) for s, n in size.items() for k in range(n)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, _, t) in enumerate(rows)],
                                 "doc_id long, text string, source string").repartition(3)
    for wanted in ({"c": 1.0, "d": 1.0}, {"0": 1.0, "e": 1.0}, {"1": 3.0, "a": 1.0}, {"\0": 1.0, "b": 1.0}):
        got = packing.pack(docs, length=256, window=2048, grain=64, weights=wanted).collect()
        assert sum(r["length"] for r in got) == sum(
            {r["doc_id"]: r["doc_tokens"] for r in got}.values())
        first = {}
        for r in got:
            if r["sequence_id"] < 8:
                s = rows[r["doc_id"]][0]
                first[s] = first.get(s, 0) + r["length"]
        total = sum(wanted.values())
        for s, w in wanted.items():
            assert abs(first[None if s == "\0" else s] - 2048 * w / total) <= 128


def test_windows_hold_the_target_mixture():
    totals = np.array([700_000, 200_000, 90_000, 10_000])
    plan = packing.schedule(totals, None, 8192, 64, 1024)
    rounds = np.arange(0, 100)
    served = plan.served(rounds)
    share = totals / totals.sum()
    # the deficit never exceeds a grain (and a rounding), whatever the round
    assert (np.abs(served - rounds[:, None] * 8192 * share) < 66).all()
    weighted = packing.schedule(totals, np.array([1.0, 1, 1, 1]), 8192, 64, 1024)
    assert (np.abs(np.diff(weighted.served(rounds)[:4], axis=0) - 2048) <= 64).all()
    # all tokens are served, each position once
    at = []
    for q, t in enumerate(totals):
        start, place = plan.cuts(q, 0, int(t))
        at += [np.arange(p, p + n) for p, n in zip(place, np.diff(np.append(start, t)))]
    assert (np.sort(np.concatenate(at)) == np.arange(totals.sum())).all()
