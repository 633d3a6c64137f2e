"""Spark session helpers.

On a cluster the session is created by the platform and already carries its
own settings; ``ensure_checkpoint_dir`` only fills in a checkpoint directory
when the cluster has not named one (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Shuffle partitions per core for local runs; on a cluster AQE coalesces
# small partitions and splits skewed ones at runtime.
_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app_name: str = "revcast",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("REVCAST_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Local runs and tests only: no cluster-wide directory was named.
    local = tempfile.mkdtemp(prefix="revcast-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory.

    Used where a long lineage (iterative fits, many cutoffs) would otherwise
    be recomputed after an executor loss. Never a local checkpoint: those
    blocks die with the executor that held them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on executors (once per application).

    Python functions used by ``applyInPandas``/``mapInPandas`` are unpickled
    on the executors, which must be able to import ``revcast``. A source
    checkout is zipped on the driver and added with ``addPyFile`` (what
    ``--py-files`` does; Spark serves the file to every executor). An
    installed package is left alone.
    """
    import hashlib
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    if "site-packages" in pkg or "dist-packages" in pkg:
        # installed as a library on the cluster image: executors import it already
        _SHIPPED.add(app)
        return
    files = []
    for root, _dirs, names in os.walk(pkg):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(root, n))
    h = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            h.update(f.encode())
            h.update(fh.read())
    path = os.path.join(tempfile.gettempdir(), f"revcast-{h.hexdigest()[:12]}.zip")
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.join("revcast", os.path.relpath(f, pkg)))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED.add(app)
