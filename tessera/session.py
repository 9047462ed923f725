"""Spark session helpers.

Cluster settings (executors, memory, checkpoint folder) come from the
submitting environment; the helpers below only fill in what is unset, which
is the local/test case.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Timestamps are interpreted in
# UTC so ISO strings and event-time windows do not depend on the host zone.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers (pandas-UDF
    operators pickle their helpers by module reference): the package is
    zipped once per process and added with ``addPyFile``, which Spark
    distributes to every executor -- the in-code equivalent of
    ``--py-files``. Skipped when the cluster already ships it."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED or spark.conf.get("spark.tessera.shipped", "false") == "true":
        return
    import os
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_defaults(spark: SparkSession) -> None:
    """Apply the package defaults that are runtime-settable, keeping any
    value the cluster already set, and ship the package to the workers."""
    ship_package(spark)
    for k, v in _DEFAULTS.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    # the zone is set (to the JVM's) even where nobody set it; any other value,
    # given at the start or at run time, is kept
    key = "spark.sql.session.timeZone"
    given = spark.sparkContext.getConf().contains(key)
    if not given and spark.conf.get(key) == spark._jvm.java.util.TimeZone.getDefault().getID():
        spark.conf.set(key, "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only when it is unset -- local runs and tests -- a fresh
    scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
