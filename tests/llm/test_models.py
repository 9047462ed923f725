"""Classifiers: held-out accuracy on the driver tables, odd rows, no labels."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid, queries, quality, toxicity
from tessera.llm.base import Words

from .conftest import ODD, odd_docs

SF = "/root/testdata/sf0.01"


def _joined(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    docs = con.execute(f"SELECT doc_id FROM '{SF}/documents.parquet'").df()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert got["score"].between(0, 1).all()
    return con


@pytest.mark.parametrize("name, label, cut", [("op8_quality", "quality", 0.7),
                                              ("op9_toxicity", "toxic", 0.5)])
def test_held_out_accuracy(spark, name, label, cut):
    con = _joined(spark, name)
    right, n, rule = con.execute(
        f"SELECT avg((predicted = {label})::int), count(*), "
        f"bool_and((score >= {cut}) = (predicted = 1)) FROM got JOIN '{SF}/labels.parquet' "
        "USING (doc_id) WHERE held_out").fetchone()
    assert n > 50 and right > 0.93 and rule


def test_language_accuracy(spark):
    con = _joined(spark, "op5_langid")
    right = con.execute(f"SELECT avg((lang = lang_pred)::int) FROM got JOIN "
                        f"'{SF}/documents.parquet' USING (doc_id) WHERE held_out").fetchone()[0]
    assert right > 0.97


def _word(stem, k):
    return stem + "".join(chr(97 + int(c)) for c in str(k))


def _toxic_docs(spark, n=400):
    """Label 1 only where an insult meets a group, or a rare insult stands."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        w = [_word("plain", x) for x in rng.integers(0, 300, 30)]
        a, b, c = map(int, rng.random(3) < (0.4, 0.4, 0.08))
        w += ["fool"] * a + ["folk"] * b + [_word("scumm", k % 7)] * c
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int((a and b) or c), int(k % 2)))
    return odd_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_pairs_of_terms_have_a_weight_of_their_own(spark):
    docs, labels = _toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    p = [_word("plain", k) for k in range(10)]
    texts = [(1, f"fool {' '.join(p)}"), (2, f"folk {' '.join(p)}"), (3, f"folk {p[3]} {p[4]} fool"),
             (4, f"{p[7]} {_word('scumm', 9)} {p[8]}"), (5, p[9]), *ODD]
    got = toxicity.score(odd_docs(spark, texts), model)
    assert got.columns == [c for c in odd_docs(spark).columns if c != "score"] + ["score"]
    s = [r["score"] for r in got.collect()]
    assert s[0] < 0.5 and s[1] < 0.5 and s[2] > 0.5 and s[3] > 0.5 and s[4] < 0.5
    assert all(0 <= x <= 1 for x in s)
    null, empty = (next(r["score"] for r in got.collect() if r["doc_id"] == i and r["text"] == t)
                   for i, t in ((1, None), (2, "")))
    assert null == empty


@pytest.mark.parametrize("frequent", [False, True])
def test_pairs_whose_terms_tell_nothing_alone(spark, frequent):
    """Insult and group are as common in both classes; only their meeting, or a
    slur, is toxic. Words of a uniform and of a steep distribution."""
    rng = np.random.default_rng(11)
    n, words = 12_000, 20_000
    p = 1 / np.arange(1, words + 1) if frequent else np.ones(words)
    pick = rng.choice(words, (n, 60), p=p / p.sum())
    kind = rng.choice(5, n, p=[.09, .09, .37, .37, .08])
    name = np.array([_word("w", x) for x in rng.permutation(words)], object)
    rows = [(k, " ".join([*name[pick[k]], *["zorb"] * int(kind[k] in (0, 2)), *["quill"] * int(kind[k] in (0, 3)),
                          *[_word("vex", k % 7)] * int(kind[k] == 1)])) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(kind[k] < 2)) for k in range(n) if k % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.rows == 9600                              # every labelled row is used
    held = docs.where("doc_id % 5 = 0")
    hit = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(held, model).collect()}
    share = [np.mean([h for i, h in hit.items() if kind[i] in c]) for c in ((0,), (1,), (2, 3, 4))]
    assert share[0] >= 0.95 and share[1] >= 0.95 and share[2] < 0.02, share


def test_score_is_the_naive_sum():
    rng = np.random.default_rng(3)
    texts = ["alpha beta gamma", None, "", "delta alpha alpha longerword", "12 !?"]
    buckets = np.unique(toxicity._bucket(toxicity._terms(pa.array(texts))[1]))
    kept = buckets[::2]
    m = toxicity.Model(0.3, kept, rng.normal(size=len(kept)), rng.normal(size=(len(kept), 4)))
    rows, at = m.known(pa.array(texts))
    got = m.margin(rows, at, len(texts))
    for k, t in enumerate(texts):
        x = [i for i, b in enumerate(kept) if b in toxicity._bucket(toxicity._terms(pa.array([t], pa.string()))[1])]
        want = 0.3 + sum(m.w[i] for i in x) + sum(
            float(m.v[i] @ m.v[j]) for a, i in enumerate(x) for j in x[a + 1:])
        assert np.isclose(got[k], want)


def quality_walk(m, row):
    """One text through every tree, node by node."""
    z = m.base
    for f, t, v in zip(m.feature, m.threshold, m.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        z += v[node - len(f)]
    return z


def test_trees_are_walked_as_row_by_row():
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    m = quality.boost(x, (x[:, 0] * x[:, 1] > 0.3).astype(float), trees=7)
    z = rng.random((50, 3))
    for row, got in zip(z, m.margin(z)):
        assert np.isclose(got, quality_walk(m, row))


def test_unrelated_texts_all_stay_in_the_sample(spark):
    from tessera.llm.labelled import labelled_sample
    rng = np.random.default_rng(1)
    p = 1 / np.arange(1, 3001)
    rows = [(f"d{k}", " ".join(_word("w", x) for x in rng.choice(3000, 300, p=p / p.sum()))) for k in range(300)]
    rows += [(f"c{k}", rows[0][1]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)], "doc_id string, y int")
    assert labelled_sample(docs, labels, "y", 1000).count() == 301      # one of the copies with each label
    assert labelled_sample(docs, labels, "y", 50).count() <= 50


def test_models_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = odd_docs(spark)
    for op, label in ((toxicity, "toxic"), (quality, "quality")):
        s = {r["score"] for r in op.score(docs, op.fit(docs, none, label)).collect()}
        assert s == {0.5}
        assert op.score(docs.limit(0), op.fit(docs.limit(0), none, label)).count() == 0
    one = spark.createDataFrame([(9, 1, 1), (None, 0, 0), (8, None, None), (9, 1, 1)],
                                "doc_id long, toxic int, quality int")
    assert toxicity.score(docs, toxicity.fit(docs, one)).count() == len(ODD)
    assert quality.score(docs, quality.fit(docs, one)).count() == len(ODD)


def test_statistics_of_whole_texts():
    texts = [None, "", "Aa bb\ncc", "!!" * 50, "same same same\nsame", "x" * 100_000]
    x = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(x).all() and (x[0] == 0).all() and (x[1] == 0).all()
    assert np.isclose(x[2, 0], np.log1p(8)) and np.isclose(x[2, 1], 1 / 8)
    alone = quality.statistics(pa.array(texts[4:5]))
    assert np.allclose(x[4], alone[0])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.boost(x, y, trees=40)
    z = rng.random((1000, 4))
    assert (((m.margin(z) > 0) == ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.3))).mean()) > 0.97


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark, ODD + [(30, "123 456 !!"), (31, "hello there friend")])
    blank = langid.predict(docs, langid.fit(docs))
    assert {(r["lang_pred"], r["score"]) for r in blank.collect()} == {("und", 0.0)}
    rows = [(k, ("alpha beta gamma delta " if k % 2 else "öüß äöü ßßü äää ") * 20) for k in range(80)]
    from pyspark.sql import functions as F
    train = odd_docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "aa")
                                             .otherwise("bb"))
    net = langid.fit(train)
    got = {r["doc_id"]: r for r in langid.predict(docs, net).collect()}
    assert got[31]["lang_pred"] == "aa" and 0.5 <= got[31]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 30)] == ["und"] * 4
    assert langid.predict(docs.limit(0), net).count() == 0


def test_words_equal_split():
    texts = [" a  b\tc ", None, "", "\n", "Zwei WÖRTER", "x", "é\x0bü\x0cß", "\x1ca"]
    w = Words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])]
           for a, b in zip(w.first, w.first[1:])]
    import re
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]
    sliced = Words(pa.array(["zz zz", *texts], pa.string()).slice(1))
    assert (sliced.hashes() == w.hashes()).all()
