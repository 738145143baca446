"""Helpers shared by the training-data operators."""
from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import ledgerlake
from ledgerlake.session import cut_lineage

# ASCII white space of the contracts: space and \x09-\x0D.  bytes.split() without arguments splits on exactly these.
WORD_GAP = "[\\x20\\x09-\\x0D]+"

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare_python(spark: SparkSession) -> None:
    """What the Python tasks need: this package on every executor (shipped once for each application), and Arrow
    batches of a few MB, which bound what a worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(ledgerlake.__file__).parent
        file = Path(tempfile.mkdtemp(prefix="ledgerlake-py-")) / "ledgerlake.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(file))                       # Spark's own file server hands it to the executors
        _SHIPPED.add(sc.applicationId)


_MEMOS = []


def worker_memo(make):
    """``lru_cache`` for what a worker process keeps from task to task, until ``release_memos``."""
    held = lru_cache(maxsize=2)(make)
    _MEMOS.append(held)
    return held


def release_memos() -> None:
    """Let go of what other operators' tasks left in this worker process (it serves one task after the other, of all
    operators); whoever needs it again makes it again."""
    for held in _MEMOS:
        held.cache_clear()
    pa.default_memory_pool().release_unused()


def output_schema(df: DataFrame) -> StructType:
    """The columns of ``df``, all nullable: the schema of a Python task that returns them."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema])


BROADCAST_ROWS, SALTS = 20_000, 32


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to a written table with one row per key.  Up to BROADCAST_ROWS rows (counted) it is broadcast; beyond,
    ``small`` is repeated for each of SALTS salts, so that a key that a third of ``big`` holds is split over as many tasks."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn("salt_", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return spread.join(salted, [*keys, "salt_"], how).drop("salt_")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for the nodes of ``edges``.

    Alternating large-star / small-star steps.  Every step is a partial-aggregated ``min`` per node and
    an equi-join on the node, so no task ever holds the neighbours of a node together and a hub is
    split by adaptive execution like any other skewed join key.  Each round is written to the shared folder;
    the rounds end when the edge set no longer changes, which then is one star per component.
    Null ends and self loops are ignored; an empty ``edges`` gives an empty result."""
    cur = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    cur, mark = cut_lineage(cur, "links"), None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u")
        small = (hooked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        cur = cut_lineage(small, "links")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
