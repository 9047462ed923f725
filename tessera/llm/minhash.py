"""Near-duplicates by MinHash with sequential Bayesian verification.

A text's set is its distinct word shingles (64-bit hashes of the words). Texts
with equal sets collapse to one node first, so copies cost one count. Nodes
then go through:

1. Signatures of ``BANDS`` x ``ROWS`` minima; nodes that agree on a band are in
   one bucket. At similarity 0.85 a pair shares no band with a chance of about
   2e-8 (0.5563^30).
2. Each bucket names a hub, the member with the largest sum of bucket sizes (in
   a family of copies: the text the others derive from), and every member is
   paired with the hub. Pairs grow with the members, not with their square.
3. Sequential Bayesian verification compares a pair's signatures in batches;
   after each batch the Beta posterior bounds the similarity, and a pair whose
   chance to reach the threshold falls below ``MISS`` is dropped. Survivors are
   verified exactly on full sets.
4. Members not joined to their hub may still link with other members. With
   D(x) = x symmetric-difference hub, a linked pair of which one is not linked
   with the hub must share elements of D: the prefix bound below keeps the few
   that prove it, and members meet on those alone. The resulting pairs are
   verified like those of step 3. So no link between members of a bucket is lost,
   and pairs of a family that cannot be linked never meet.
5. Connected components of the links, by label propagation with pointer jumping.

Sets are recomputed from the texts of the nodes in question, and travel with the
pairs; a hub's set is sent once per pair. All groupings are map-side combined
aggregates, all joins plain equi-joins whose hot keys AQE splits.

Prefix bound of step 4. Let t be the threshold, c = (1 - t) / (1 + t). x and y are
linked iff |x ^ y| <= c (|x| + |y|), and |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|.
x is not linked with hub h iff |D(x)| > c (|x| + |h|). Hence a linked pair shares
more than (|D(y)| + c (|h| - |y|)) / 2 elements of D(y), and at least
(|D(x)| - c (|x| + |h|)) / (1 + c) of D(x). Under any common order of elements,
two sets sharing o elements share one among the first |D| - o + 1 of each, and
the first one they share leaves at least o - 1 elements after it in both: members
that meet on an element with fewer after it are no pair. The order puts elements
outside the hub first, the rare ones in a family, so that chance meetings on
removed elements, which come last, fail this test. A bit map of D (``MAP`` x 64
buckets) also travels along: an element of D(x) in a bucket that D(y) leaves empty
is not shared, which bounds the shared elements from above.

Defined cases: a text without words (null, empty, blank) has the empty set, is
linked with nothing and is its own component; fewer words than ``words`` make
one shingle; repeated rows and equal texts share a component; a null id takes
part, the component's id is the smallest non-null id (null if none); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, mix, rows_chosen, slices, staged

BANDS, ROWS = 30, 5
BATCH = 10                   # signature positions compared at a time
MISS = 1e-6                  # chance of dropping a pair at the threshold
MAP = 8                      # words of the bit map of a difference
_PERMS = BANDS * ROWS


# --- sets and signatures ------------------------------------------------------

def shingle_sets(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, offsets)."""
    w = Words(col)
    h = w.hashes()
    n = np.diff(w.first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(n)), count)
    at = w.first[:-1][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, words)[rows]
    v = np.zeros(len(rows), np.uint64)
    for k in range(words):
        in_ = size > k
        v[in_] = mix(v[in_] * np.uint64(0x9E3779B97F4A7C15) + h[at[in_] + k] + np.uint64(k + 1))
    v = mix(v ^ size.astype(np.uint64))
    o = np.lexsort((v, rows))
    rows, v = rows[o], v[o]
    new = np.ones(len(v), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (v[1:] != v[:-1])
    rows, v = rows[new], v[new]
    return v, np.searchsorted(rows, np.arange(len(n) + 1))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(85))
    return (rng.integers(0, 2 ** 64, _PERMS, dtype=np.uint64) | np.uint64(1),
            rng.integers(0, 2 ** 64, _PERMS, dtype=np.uint64))


def signatures(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(non-empty rows, permutations) minima, 32 bits each."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(some), _PERMS), np.uint32)
    if len(some):
        at = first[:-1][some]
        for k, (a, b) in enumerate(zip(*_seeds())):
            x = ((v * a + b) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(x, at)
    return out


def _digests(v: np.ndarray, first: np.ndarray) -> list:
    from hashlib import blake2b
    raw = v.tobytes()
    return [blake2b(raw[8 * s:8 * e], digest_size=16).digest() if e > s else None
            for s, e in zip(first.tolist(), first[1:].tolist())]


def sketched(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, node, sig): key names the text, node is the digest of the
    set, null if it is empty."""
    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            v, first = shingle_sets(b.column("text"), words)
            sig = iter(signatures(v, first))
            node = _digests(v, first)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("key"), pa.array(np.diff(first)),
                 pa.array(node, pa.binary()),
                 pa.array([None if x is None else next(sig).tobytes() for x in node],
                          pa.binary())], ["id", "key", "n", "node", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("key")) \
        .mapInArrow(run, "id long, key long, n long, node binary, sig binary")


# --- verification ---------------------------------------------------------------

def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For 0..permutations positions compared: the fewest matches with which
    P(similarity >= threshold) under the posterior Beta(m + 1, n - m + 1) is
    still at least ``miss``."""
    out = np.zeros(_PERMS + 1, np.int64)
    for n in range(1, _PERMS + 1):
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        p, m = 0.0, 0
        for m in range(n + 2):
            p += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if p >= miss:
                break
        out[n] = m
    return out


def sequential(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """True for the pairs of signatures that no batch rules out."""
    alive = np.arange(len(a))
    hits = np.zeros(len(a), np.int64)
    for lo in range(0, _PERMS, BATCH):
        hi = min(lo + BATCH, _PERMS)
        hits[alive] += (a[alive, lo:hi] == b[alive, lo:hi]).sum(1)
        alive = alive[hits[alive] >= least[hi]]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, _PERMS)


def _pruned(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ...) with ``alive`` after the sequential test."""
    least = least_matches(threshold)
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "sa", "sb")
    names = [*pairs.columns, "alive"]

    def run(batches):
        for x in batches:
            if x.num_rows:
                keep = sequential(_matrix(x.column("sa")), _matrix(x.column("sb")), least)
                yield pa.RecordBatch.from_arrays(
                    [*(x.column(c) for c in names[:-1]), pa.array(keep)], names)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return both.mapInArrow(run, f"{types}, alive boolean")


def _sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Staged (node, items) of the nodes whose sets are needed, from the texts
    of the rows with their representatives' ids."""
    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            v, first = shingle_sets(b.column("text"), words)
            raw = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_digests(v, first), pa.binary()),
                 pa.array([raw[8 * s:8 * e] for s, e in zip(first, first[1:])], pa.binary())],
                ["node", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(ids.select(F.col("id").alias("_id")).distinct(),
                     F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return staged(rows.mapInArrow(run, "node binary, items binary")
                  .where("node IS NOT NULL").dropDuplicates(["node"]), "minhash-sets")


def _items(x) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, ...) with exact ``linked``."""
    num, den = threshold
    names = [*pairs.columns, "linked"]
    both = _with_sets(pairs, sets)

    def run(batches):
        for x in slices(batches, "ia", 4 << 20):
            out = []
            for ia, ib in zip(x.column("ia").to_pylist(), x.column("ib").to_pylist()):
                p, q = _items(ia), _items(ib)
                inter = len(np.intersect1d(p, q, assume_unique=True))
                out.append(den * inter >= num * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays(
                [*(x.column(c) for c in names[:-1]), pa.array(out, pa.bool_())], names)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return both.mapInArrow(run, f"{types}, linked boolean")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "ia", "ib")


_MAPS = [f"m{k}" for k in range(MAP)]


def _difference_prefixes(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]):
    """For pairs (a member, b hub, apart): rows (hub, item, node, far, at, size,
    own) of step 4: an element of D, its place there, |D| and |a|. ``far`` rows
    are the long prefix of members not linked with the hub, the others the
    short prefix every member gives."""
    num, den = threshold
    c = (den - num) / (den + num)
    both = _with_sets(pairs, sets)

    def run(batches):
        for x in slices(batches, "ia", 2 << 20):
            hub, item, node, far, at, size, own, maps = [], [], [], [], [], [], [], []
            cols = (x.column(k).to_pylist() for k in ("a", "b", "apart", "ia", "ib"))
            for a, b, ap, ia, ib in zip(*cols):
                p, q = _items(ia), _items(ib)
                plus = np.setdiff1d(p, q, assume_unique=True)
                d = np.concatenate([plus, mix(np.setdiff1d(q, p, assume_unique=True))])
                # a hair below the bounds, for rounding
                most = (len(d) + c * (len(q) - len(p))) / 2 - 1e-9
                short = len(d) - max(math.floor(most) + 1, 1) + 1
                least = (len(d) - c * (len(p) + len(q))) / (1 + c) - 1e-9
                long = len(d) - max(math.ceil(least), 1) + 1
                for take, is_far in ((short, False), (long if ap else 0, True)):
                    take = min(max(take, 0), len(d))
                    hub += [b] * take
                    item.append(d[:take])
                    node += [a] * take
                    far += [is_far] * take
                    at += range(take)
                    size += [len(d)] * take
                    own += [len(p)] * take
                    bits = np.zeros(64 * MAP, np.uint8)
                    bits[(d * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)] = 1
                    maps.append(np.repeat(np.packbits(bits).view(np.int64)[None], take, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hub, pa.binary()),
                 pa.array(np.concatenate([*item, np.zeros(0, np.uint64)]).view(np.int64)),
                 pa.array(node, pa.binary()), pa.array(far, pa.bool_()), pa.array(at, pa.int32()),
                 pa.array(size, pa.int32()), pa.array(own, pa.int32()),
                 *(pa.array(m) for m in np.concatenate([*maps, np.zeros((0, MAP), np.int64)]).T)],
                ["hub", "item", "node", "far", "at", "size", "own", *_MAPS])

    return both.mapInArrow(run, "hub binary, item long, node binary, far boolean, at int, "
                           "size int, own int, " + ", ".join(f"{m} long" for m in _MAPS))


# --- components -------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of staged undirected edges (a, b); the label
    is the component's smallest node. Each round takes the smallest label of
    the neighbours and then the label of the label; a path of n nodes needs
    about log n rounds."""
    both = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
                  .unionAll(edges.select("b", "a")).distinct(), "component-edges")
    labels = staged(both.groupBy("node").agg(F.min("to").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), F.col("label").alias("l")),
                         "to").groupBy("node").agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.least("label", "l").alias("next"),
                                                F.col("label").alias("old"))
        # the old label's node may have moved on as well: take its new label
        hop = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        # and hand the smaller label to the old label's node
        push = step.groupBy(F.col("old").alias("node")).agg(F.min("next").alias("pushed"))
        new = staged(step.join(hop, "next", "left").join(push, "node", "left").select(
            "node", F.least("next", "further", "pushed").alias("label"),
            "old"), "component-labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


# --- the operator -----------------------------------------------------------------

def near_duplicates(docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (85, 100),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept.

    Texts are linked at ``threshold`` (numerator, denominator) of Jaccard
    similarity over shingles of ``words`` words."""
    out = _grouped(docs, words, threshold, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100),
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with its smallest id,
    and every row without words; all columns kept."""
    out = staged(_grouped(docs, words, threshold, id_col, text_col), "minhash-grouped")
    one = out.where("label IS NOT NULL").groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("r"))
    chosen = one.select("r.id", "r.key").unionAll(
        out.where("label IS NULL").select("id", "key")).distinct()
    rows = out.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.join(rows.select(F.col("id").alias("_i"), F.col("key").alias("_x"), "n"),
                         F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_x")))
    return rows_chosen(docs, chosen, F.xxhash64(text_col), id_col)


def _grouped(docs: DataFrame, words: int, threshold: tuple[int, int], id_col: str,
             text_col: str) -> DataFrame:
    """(id, key, n, label, component_id) of every row; label null if it has no
    words."""
    t = threshold[0] / threshold[1]
    rows = staged(sketched(docs, words, id_col, text_col), "minhash-rows")
    nodes = staged(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("id"), F.first("sig").alias("sig")), "minhash-nodes")

    width = 4 * ROWS
    keys = nodes.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.substr(F.col("sig"), i * width + 1, F.lit(width)))).alias("band", "key"))
    keys = keys.select("node", F.xxhash64("band", "key").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = staged(keys.join(shared, "key"), "minhash-members")
    mass = members.groupBy("node").agg(F.sum("c").alias("mass"))
    hubs = members.join(mass, "node").groupBy("key").agg(
        F.max(F.struct("mass", "node"))["node"].alias("b"))
    pairs = staged(members.join(hubs, "key").where("node <> b")
                   .select(F.col("node").alias("a"), "b").distinct(), "minhash-pairs")

    # Hubs with one partner need no step 4: the sequential test may drop them.
    tested = _pruned(pairs, nodes, t)
    tested = staged(tested.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")), "b")
                    .select("a", "b", "alive", "size").where("alive OR size > 1"),
                    "minhash-tested")
    ends = tested.select(F.col("a").alias("node")).unionAll(tested.select("b")).distinct()
    sets = _sets(docs, nodes.join(ends, "node", "left_semi").select("id"), words, id_col, text_col)
    first = staged(_verified(tested.where("alive").select("a", "b"), sets, threshold)
                   .where("linked").select("a", "b"), "minhash-links")

    label = components(first).select(F.col("node").alias("l_node"), "label")

    def labelled(df, col, name):
        return df.join(label, F.col(col) == F.col("l_node"), "left").withColumn(
            name, F.coalesce("label", col)).drop("l_node", "label")

    hubbed = labelled(labelled(tested.where("size > 1").select("a", "b"), "a", "la"), "b", "lb") \
        .withColumn("apart", F.col("la") != F.col("lb"))
    hubbed = staged(hubbed, "minhash-hubbed")
    open_hubs = hubbed.groupBy("b").agg(F.max("apart").alias("open")).where("open").select("b")
    marks = staged(_difference_prefixes(
        hubbed.join(open_hubs, "b", "left_semi").select("a", "b", "apart"), sets, threshold),
        "minhash-marks")
    marks = labelled(marks, "node", "label_of")
    met = marks.groupBy("hub", "item").agg(
        F.min("label_of").alias("lo"), F.max("label_of").alias("hi"), F.max("far").alias("f")) \
        .where("lo <> hi AND f").select("hub", "item")
    marks = staged(marks.join(met, ["hub", "item"], "left_semi"), "minhash-meeting")
    far, near = (marks.where(F.col("far") == side).select(
        "hub", "item", F.col("node").alias(n), F.col("label_of").alias("l" + n),
        (F.col("size") - F.col("at")).alias("after" + n), F.col("size").alias("size" + n),
        F.col("own").alias("own" + n), *(F.col(m).alias(m + n) for m in _MAPS)) for side, n in ((True, "x"), (False, "y")))
    c = (threshold[1] - threshold[0]) / (threshold[1] + threshold[0])
    need = f"(sizex + sizey - {c!r} * (ownx + owny) - 1e-6)"        # twice the shared elements
    only_x = " + ".join(f"bit_count({m}x & ~{m}y)" for m in _MAPS)
    only_y = " + ".join(f"bit_count({m}y & ~{m}x)" for m in _MAPS)
    more = staged(far.join(near, ["hub", "item"]).where("lx <> ly").where(
        f"2 * least(afterx, aftery, sizex - ({only_x}), sizey - ({only_y})) >= {need}").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
        "minhash-pairs")
    alive = _pruned(more, nodes, t).where("alive").select("a", "b")
    second = staged(_verified(alive, sets, threshold).where("linked").select("a", "b"),
                    "minhash-links")

    final = components(staged(first.unionAll(second), "minhash-links"))
    named = nodes.select("node", "id").join(final, "node", "left").select(
        "node", "id", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = staged(named.join(smallest, "label").select(
        F.col("node").alias("c_node"), "label", "component_id"), "minhash-components")
    out = rows.join(named, F.col("node") == F.col("c_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "key", "n", "label", component.alias("component_id"))
