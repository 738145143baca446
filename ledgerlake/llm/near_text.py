"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import components, prepare_python, release_memos
from ledgerlake.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 3, 2, 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POS = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BLOCK = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text: a bit is 1 if set in over half of the shingle hashes (repeats count)."""
    words = (text or b"").lower().split()            # bytes.lower() maps A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    join, h64 = b"".join, xxhash.xxh64_intdigest
    byte_counts = np.zeros(2048, dtype=np.int64)
    for lo in range(0, n, _BLOCK):                   # very long texts: bounded arrays
        hi = min(n, lo + _BLOCK)
        spaced = [w + b" " for w in words[lo:hi + shingle - 2]]
        parts = [spaced[k:hi - lo + k] for k in range(shingle - 1)] + [words[lo + shingle - 1:hi + shingle - 1]]
        if len(words) < shingle:
            hashes = [h64(b" ".join(words), SEED)]
        else:
            hashes = [h64(join(t), SEED) for t in zip(*parts)]
        h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        byte_counts += np.bincount((h + _POS).ravel(), minlength=2048)
    ones = byte_counts.reshape(8, 256) @ _BITS       # 8 bytes x 8 bits: how many hashes set the bit
    return int.from_bytes(np.packbits((2 * ones.ravel() > n).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_hash`` and ``fp`` (the fingerprint as a signed long).
    Null and empty texts have fingerprint 0."""
    prepare_python(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                      F.encode(F.col(text_col), "UTF-8").alias("raw"))
    schema = src.select("id", "text_hash", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        release_memos()
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("raw")), dtype=np.uint64,
                              count=b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(fps, pa.int64())],
                                             names=["id", "text_hash", "fp"])
    return src.mapInArrow(run, schema)


def ball_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect exactly the pairs at
    ``max_bits`` (2) or fewer differing bits, up to transitivity.

    Every fingerprint emits its ball of radius 1 (itself and its 64 one-bit variants).  Two fingerprints
    at distance 2 or less share a variant, and all that share one are within distance 2 of each other.  So
    consecutive members of a variant's bucket are true pairs, and chain the whole bucket.  A bucket holds
    at most 65 different fingerprints whatever the copies, so nothing is skewed and no pairs are expanded.
    The distance of each emitted pair is still verified."""
    if max_bits != 2:
        raise ValueError("the ball of radius 1 meets in the middle at 2 bits")
    ball = fps.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    return (ball.select("fp", F.lag("fp").over(w).alias("a")).filter("a is not null")
            .select("a", F.col("fp").alias("b")).distinct()
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Near-duplicate classes: id, text_hash, fp and ``component`` (the smallest id reachable over links of
    ``max_bits`` or fewer differing bits), ``keep_id`` / ``keep_hash``: the class's one row that stays.

    Copies are folded into one fingerprint first (partial aggregation), so a group that holds a third
    of the corpus costs one row.  Repeated rows get the same class; null ids take part, and a class of null
    ids only has a null component.  An empty table gives an empty result."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    uniq = rows.groupBy("fp").agg(F.min("id").alias("low"),
                                  F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    comp = components(ball_links(uniq.select("fp"), max_bits))
    rooted = uniq.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("low").alias("component"), F.min("first").alias("first"))
    by_fp = rooted.select("fp", "root").join(classes, "root").select(
        "fp", "component", F.col("first.id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))
    return rows.join(by_fp, "fp").select("id", "text_hash", "fp", "component", "keep_id", "keep_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest id (then text hash; of
    rows that repeat both, one).  All columns are returned as they are, whatever their names."""
    def key(id_, hash_):                             # null-safe equality as plain equality of three columns
        return [F.col(id_).isNull().alias("k_none"), F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("k_id"),
                hash_.alias("k_hash")]
    names = ["k_none", "k_id", "k_hash"]
    keep = near_duplicates(docs, id_col, text_col).select(*key("keep_id", F.col("keep_hash"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *key(id_col, F.xxhash64(text_col)))
    w = Window.partitionBy(*names).orderBy(F.lit(0))
    return (rows.join(keep, names, "left_semi").withColumn("nth", F.row_number().over(w)).filter("nth = 1")
            .select("row.*"))


def contract(spark, docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))
