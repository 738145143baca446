"""Point lookups on a clustered table: right rows, and few of the table's rows read."""
from pyspark.sql import functions as F

from ledgerlake.sources import clustered


def test_a_batch_of_ids_reads_few_row_groups(spark, tmp_path):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 3).alias("k"), F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
    path = clustered.write_clustered(df.orderBy(F.rand(7)), f"{tmp_path}/t", "k", files=8)
    near = [3 * i for i in range(1000, 1100)]                    # 100 neighbours: one range
    ids = spark.createDataFrame([(i,) for i in near + near[:5] + [1, 10 ** 9, None]], "id long")
    got = clustered.lookup(spark, path, "k", ids)
    assert sorted(r.k for r in got.collect()) == near
    assert clustered.scanned_rows(got) < n / 50
    wide = [3 * i for i in range(0, n, n // 100)]                # 100 ids spread over the table: a page or so each
    got = clustered.lookup(spark, path, "k", spark.createDataFrame([(i,) for i in wide], "id long"))
    assert sorted(r.k for r in got.collect()) == wide
    assert clustered.scanned_rows(got) < n * 0.6
    assert "PushedFilters" in got._jdf.queryExecution().toString() and "EqualTo(k," in got._jdf.queryExecution().toString()
    # ids between the stored ones lie inside every range: only the bloom filters can tell
    none = clustered.lookup(spark, path, "k", spark.createDataFrame([(3 * i + 1,) for i in range(0, n, n // 20)], "id long"))
    assert none.count() == 0


def test_large_and_empty_batches(spark, tmp_path):
    df = spark.range(5000).withColumnRenamed("id", "k").unionByName(spark.range(10).withColumnRenamed("id", "k"))
    path = clustered.write_clustered(df, f"{tmp_path}/t", "k", files=2)
    many = spark.range(clustered.MAX_IDS + 500)
    assert clustered.lookup(spark, path, "k", many).count() == clustered.MAX_IDS + 510        # repeated rows stay repeated
    assert clustered.lookup(spark, path, "k", many.limit(0)).count() == 0
    assert clustered.lookup(spark, path, "k", spark.range(3)).count() == 6
