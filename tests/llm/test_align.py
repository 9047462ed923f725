"""Alignment of two tokenizers against a token-by-token restatement."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import align, queries
from tessera.llm.bpe import byte_characters
from tessera.llm.tokens import vocabulary

from .conftest import ODD, odd_docs


@pytest.fixture(scope="module")
def libs():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabulary(None))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.piece_vocabulary(None))


BYTE = {c: b for b, c in enumerate(byte_characters())}


def piece_bytes(p):
    if len(p) == 6 and p.startswith("<0x"):
        return bytes([int(p[3:5], 16)])
    return p.replace("▁", " ").encode()


def plain(libs, text):
    """(a ids, b ids, groups as text, links) of one text."""
    a, b = libs
    none = [], [], "", []
    if not text:
        return none
    want = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    tok_a = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in ids_a]
    tok_b = [piece_bytes(b.id_to_piece(i)) for i in ids_b]
    if b"".join(tok_a) != want or b"".join(tok_b) != want:
        return none

    def spans(toks):
        at, out = 0, []
        for t in toks:
            out.append((at, at + len(t)))
            at += len(t)
        return out
    sa, sb = spans(tok_a), spans(tok_b)
    links, j = [], 0
    for i, (x, y) in enumerate(sa):
        while sb[j][1] <= x:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < y:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    groups, ends = [], sorted({y for _, y in sa} & {y for _, y in sb})
    i = j = 0
    for hi in ends:
        x, y = i, j
        while i < len(sa) and sa[i][1] <= hi:
            i += 1
        while j < len(sb) and sb[j][1] <= hi:
            j += 1
        groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
    return ids_a, ids_b, ";".join(groups), links


def expected(libs, rows):
    """Result rows of (id, text) rows, counts over all of them."""
    got = [(i, plain(libs, t)) for i, t in rows]
    count = Counter(p for _, g in got for p in g[3])
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    return [(i, len(a), len(b), g.count(";") + 1 if g else 0, len(l),
             sum(count[p] == most[p[1]] for p in l), sum(count[p] for p in l), g)
            for i, (a, b, g, l) in got]


POOL = ["a", "b", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "'ll", "1", "23", "!", "...",
        "中", "🙂", "▁", "\x00", "<s>", "<|endoftext|>", "<0x41>", "the", " the", " token", "ization",
        "ing", " Hello", "́", "Ã", "\x85", "ﬁ"]


def random_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_parts_align_as_whole_texts(libs):
    al = align.Aligner(vocabulary(None), align.piece_vocabulary(None))
    texts = [None, "", " ", "a", " a", "a ", *random_texts(3000)]
    counts, groups, links = al.align(pa.array(texts, pa.string()))
    mine = [Counter() for _ in texts]
    for row, pair in links:
        for r, p in zip(row.tolist(), pair.tolist()):
            mine[r][divmod(p, al.width)] += 1
    for k, t in enumerate(texts):
        a, b, g, l = plain(libs, t)
        assert groups[k] == g, repr(t)
        assert counts[k].tolist() == [len(a), len(b), g.count(";") + 1 if g else 0, len(l)]
        assert mine[k] == Counter(l)


def test_chunks_of_a_long_text(libs, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 50)
    monkeypatch.setattr(align, "MOST_PARTS", 30)
    al = align.Aligner(vocabulary(None), align.piece_vocabulary(None))
    text = " ".join(f"word{k % 37} and, {k}" for k in range(200))
    counts, groups, _ = al.align(pa.array([text, "x▁y " + text, "z"]))
    a, b, g, l = plain(libs, text)
    assert groups[0] == g and groups[1] == "" and counts[1].tolist() == [0] * 4
    assert counts[0].tolist() == [len(a), len(b), g.count(";") + 1, len(l)]


def test_planes_hold_documents_and_multiplicities():
    rng = np.random.default_rng(2)
    want = {}
    for p in range(60):
        docs = rng.choice(9000, rng.integers(1, 200 if p % 3 else 2), replace=False)
        want |= {(p, int(d)): int(rng.integers(1, 40 if p % 5 == 0 else 2)) for d in docs}
    key = np.array(sorted(p << 16 | d for p, d in want), np.int64)
    count = np.array([want[k >> 16, k & 0xFFFF] for k in key.tolist()])
    pair, n_docs, n_links, at, at_off, data, off = align.planes(key, count)
    for p, d, l in zip(pair.tolist(), n_docs.tolist(), n_links.tolist()):
        held = [c for (q, _), c in want.items() if q == p]
        assert (d, l) == (len(held), sum(held))
    score = rng.integers(0, 10 ** 12, 60)
    got, = align.returned(align._binary(at, at_off), align._binary(data, off), [score[pair]], 9008)
    plainly = np.zeros(9008, np.int64)
    for (p, d), c in want.items():
        plainly[d] += score[p] * c
    assert (got == plainly).all()
    assert len(data) < 8 * len(want)                  # no empty bytes are kept


@pytest.mark.parametrize("docs,links", [(1 << 14, 1 << 21), (7, 1 << 21), (1 << 14, 40)])
def test_against_brute_force(spark, libs, monkeypatch, docs, links):
    """Whatever the size of the blocks; copies, nulls and clashing columns."""
    monkeypatch.setattr(align, "BLOCK_DOCS", docs)
    monkeypatch.setattr(align, "BLOCK_LINKS", links)
    rows = ODD + [(100 + k, t) for k, t in enumerate(random_texts(150, 8))] + [(99, "the the token")] * 30
    got = [tuple(r) for r in align.align(odd_docs(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(expected(libs, rows), key=repr)


def test_pair_counts_are_of_documents_and_links(spark, libs):
    rows = [(k, t) for k, t in enumerate(random_texts(60, 1))] + [(70, "the the the")] * 3
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in
           align.pair_counts(align.index(odd_docs(spark, rows).repartition(4))).collect()}
    links, docs = Counter(), Counter()
    for _, t in rows:
        held = plain(libs, t)[3]
        links.update(held)
        docs.update(set(held))
    assert got == {p: (docs[p], links[p]) for p in links}


def test_empty_table_and_text_ids(spark):
    assert align.align(odd_docs(spark).limit(0)).collect() == []
    df = spark.createDataFrame([("k", "a b"), (None, None)], "doc_id string, text string")
    assert sorted(r.n_a for r in align.align(df).collect()) == [0, 2]


def test_query_against_brute_force(spark, libs):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op11_align"](spark, sf).collect()}
    assert len(got) == len(docs)
    for w in expected(libs, docs):
        r = got[w[0]]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[1:7]
        assert r.groups_sha256 == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")
