"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

from tessera.llm import exact_dedup, minhash

from .conftest import ODD, odd_docs

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_truth(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        t = SPACE.sub(" ", t or "")
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def shingles(text, words):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1))


def near_truth(rows, words, num, den):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                up[find(a)] = find(b)
    comp = {}
    for k, (i, _) in enumerate(rows):
        comp.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in comp[find(k)] if x is not None]
        c = (min(ids) if ids else None) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return Counter(out)


def family(rng, base, copies, edits, first_id):
    """Copies of a text with random words replaced or dropped."""
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at] = f"w{rng.randrange(10 ** 6)}"
            else:
                del w[at]
        out.append((first_id + k, " ".join(w)))
    return out


def test_exact_groups_on_odd_rows_and_deep_prefixes(spark):
    rng = random.Random(3)
    rows = list(ODD)
    for k, size in enumerate((1, 127, 128, 129, 4096, 4097, 140_000)):
        t = "".join(rng.choice("ab") for _ in range(size))
        rows += [(100 + 10 * k, t), (101 + 10 * k, t), (102 + 10 * k, t + "c"),
                 (103 + 10 * k, t[:-1] + "c")]
    got = exact_dedup.exact_groups(odd_docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == exact_truth(rows)
    kept = exact_dedup.deduplicate(odd_docs(spark, rows))
    assert kept.columns == odd_docs(spark).columns
    texts = [SPACE.sub(" ", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub(" ", t or "") for _, t in rows})


def test_exact_groups_do_not_depend_on_the_windows(spark):
    docs = odd_docs(spark)
    a = exact_dedup.exact_groups(docs, first_window=1, growth=16).collect()
    assert Counter(map(tuple, a)) == exact_truth(ODD)


def test_empty_tables(spark):
    none = odd_docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.deduplicate(none).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    rows = list(ODD)
    for f in range(6):      # families whose members link by their text, or by each other
        base = [f"b{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 150]))]
        rows += family(rng, base, 40, (0, 6), 1000 + 100 * f)
    chain = [f"c{k}" for k in range(60)]
    for k in range(12):
        rows.append((3000 + k, " ".join(chain)))
        chain[5 * k % 60] = f"x{k}"
    got = minhash.near_duplicates(odd_docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == near_truth(rows, 3, 85, 100)


def test_members_apart_from_their_hub_still_link(spark):
    """Two copies too far from the text they derive from, but near each other."""
    rng = random.Random(1)
    base = [f"b{k}" for k in range(100)]
    rows = family(rng, base, 30, (0, 2), 10)
    far = list(base)
    for k in range(0, 100, 8):
        far[k] = f"far{k}"
    rows += [(100, " ".join(far)), (101, " ".join(far[:-1])), (102, " ".join(far[1:]))]
    half = far[:50] + base[50:]
    rows += [(103, " ".join(half)), (104, " ".join(half[:-2]))]
    got = minhash.near_duplicates(odd_docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == near_truth(rows, 3, 85, 100)


def test_near_deduplicate_keeps_one_row_of_a_component(spark):
    base = " ".join(f"b{k}" for k in range(80))
    rows = ODD + [(20, base), (21, base + " more"), (22, base), (22, base)]
    kept = minhash.deduplicate(odd_docs(spark, rows))
    truth = near_truth(rows, 5, 80, 100)
    assert kept.columns == odd_docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(20) == 1 and not {21, 22} & set(ids)
    # rows without words stay, each of them
    assert {1, 2, 3} <= set(ids)
    assert set(ids) == {c for (i, n, c, k) in truth if k} | {None}


def test_sequential_test_keeps_similar_and_drops_unlike_signatures():
    import numpy as np
    rng = np.random.default_rng(0)
    least = minhash.least_matches(0.85)
    a = rng.integers(0, 2 ** 32, (4000, 150), dtype=np.uint32)
    for share, low, high in ((0.87, 0.999, 1), (0.3, 0, 0.001)):
        same = rng.random(a.shape) < share
        b = np.where(same, a, rng.integers(0, 2 ** 32, a.shape, dtype=np.uint32))
        assert low <= minhash.sequential(a, b, least).mean() <= high
