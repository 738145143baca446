"""SparkSession construction and the shared checkpoint folder."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces
# partitions from runtime statistics, splits skewed join partitions, and the
# session time zone is pinned so date arithmetic is identical everywhere.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # batch jobs: skip capturing the Python call site on every DataFrame/Column call (two JVM
    # round trips per call while a plan is built); errors still carry the Catalyst context
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "ledgerlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The cluster names it and this reads it from the session.  On a real cluster an absent setting is
    an error, because a folder of one machine would be invisible to the others.  A single-process
    ``local[N]`` session (tests, laptops) gets a scratch folder of its own, deleted when Python exits.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared checkpoint folder: two runs never meet in a path."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def cut_lineage(df, name: str | None = None):
    """Materialise ``df`` as a Parquet table in the run's shared folder and return a scan of it.

    Unlike ``localCheckpoint`` the data survives executor loss, and unlike an
    RDD checkpoint the result is columnar: later readers get column pruning and
    filter pushdown.  The plan behind the returned frame is a plain file scan,
    which also keeps downstream plans (and their analysis time) small."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/tables/{name or 'stage'}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python (once for each application; not needed where they share the driver's files)."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster") or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    file = Path(tempfile.mkdtemp(prefix="ledgerlake-py-")) / "ledgerlake_lib.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(file))                           # Spark's own file server hands it out
    _SHIPPED.add(sc.applicationId)


def release_stages(spark: SparkSession) -> None:
    """Delete the tables this run materialised (call when no frame that reads them is needed any more)."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    os.environ.setdefault("TZ", "UTC")
