"""Session construction and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# The session settings every job in this package assumes.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tablelens", extra: dict | None = None) -> SparkSession:
    """Session for tests, benchmarks and local runs.  On a cluster the
    platform's session is used as is; only ``spark.checkpoint.dir`` is read."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Only a local-mode session without the setting (a
    test or a laptop run) gets its own folder; a cluster session without it is
    an error, because a machine-local folder is not visible to executors.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
    root = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    sc.setCheckpointDir(root)  # what checkpoint() uses; later calls read it back
    try:
        spark.conf.set("spark.checkpoint.dir", root)
    except Exception:  # noqa: BLE001 - core configs may be read-only at runtime
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    spark = spark or df.sparkSession
    checkpoint_root(spark)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """``df`` as a table written to the shared folder and read back: computed once
    (a checkpoint computes it twice), and later steps don't depend on the
    executors that made it."""
    path = f"{scratch_path(df.sparkSession, name)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Compute-heavy per-row work (distances, regexes) should use every
    core: when the input has fewer partitions than the cluster's default
    parallelism (e.g. one large parquet row group), repartition it
    round-robin.  On inputs that already have enough partitions this is a
    no-op, so it adds no shuffle at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablelens`` importable in Python workers (Arrow UDFs,
    ``mapInPandas`` / ``applyInPandas``): zip the package once per
    SparkContext and add it with ``addPyFile``, the standard way to ship
    Python code to executors.  A no-op when already done."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    folder = tempfile.mkdtemp(prefix="tablelens-py-")
    target = os.path.join(folder, "tablelens.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(key)
