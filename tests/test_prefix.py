import random

from pyspark.sql import functions as F

from tessera.operators.prefix import running_last, running_sum


def test_running_sum_and_last_hot_key(spark):
    rnd = random.Random(5)
    rows = []
    for k, n in (("hot", 20000), ("a", 7), ("b", 1)):
        pos = sorted(rnd.sample(range(0, 200000), n))
        for p in pos:
            rows.append((k, p, rnd.random() < 0.3, rnd.choice([None, None, p])))
    df = spark.createDataFrame(rows, "k string, p long, flag boolean, v long")
    s = running_sum(df, ["k"], "p", F.when(F.col("flag"), 1).otherwise(0), "rs", block=1000)
    s = running_last(s, ["k"], "p", F.col("v"), "rl", block=1000)
    got = {(r.k, r.p): (r.rs, r.rl) for r in s.collect()}
    want, acc, last = {}, {}, {}
    for k, p, flag, v in sorted(rows, key=lambda r: (r[0], r[1])):
        acc[k] = acc.get(k, 0) + (1 if flag else 0)
        if v is not None:
            last[k] = v
        want[(k, p)] = (acc[k], last.get(k))
    assert got == want


def test_running_sum_hot_key_spread(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")        # observe the partitioning, not AQE's merge
    try:
        df = spark.range(0, 30000).select(F.lit("hot").alias("k"), F.col("id").alias("p"))
        out = running_sum(df, ["k"], "p", F.lit(1), "rs", block=1000)
        per_part = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.agg(F.max("rs")).first()[0] == 30000
    finally:
        spark.conf.set(key, old)
    assert len(per_part) >= 4 and max(per_part) < 0.5 * 30000
