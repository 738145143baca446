"""Operator 9: boilerplate lines by their spread over distinct sites (HyperLogLog, exact near the threshold)."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import join_small
from ledgerlake.session import cut_lineage

MIN_SITES, MIN_WORDS, LG_K = 5, 1, 12
# Outer blanks of a line that are ignored: ASCII white space.
BLANKS = " \t\r\x0b\f"


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int,
               blanks: str = BLANKS) -> DataFrame:
    """(id, text_hash, at, line_hash, site) of the lines with ``min_words`` or more words, outer ``blanks`` ignored.  A line is
    known by 128 bits, as 64 would let tens of thousands of a trillion different lines meet."""
    enough = r"(\S+\s+){%d}\S" % (min_words - 1)
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.coalesce(F.concat(F.lit("="), F.col(site_col)), F.lit("")).alias("site"),
                        F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
            .filter(F.col("line").rlike(enough))
            .select("id", "text_hash", "at", F.unhex(F.md5(F.btrim("line", F.lit(blanks)))).alias("line_hash"), "site"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line_hash, n_sites, first): lines on ``min_sites`` or more distinct sites and their first occurrence.

    One HyperLogLog sketch of sites per line hash, merged by partial aggregation: a line that a third of all documents
    share reaches the shuffle as one sketch per task.  Lines whose estimate lies within six standard errors
    of the threshold are counted exactly over their distinct (line, site) pairs."""
    err = 6 * 1.04 / math.sqrt(2 ** lg_k)
    est = lines.groupBy("line_hash").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "at")).alias("first")).select(
        "line_hash", "first", F.hll_sketch_estimate("sketch").alias("est"))
    likely = cut_lineage(est.filter(F.col("est") >= math.floor(min_sites * (1 - err))), "likely_lines")
    near = likely.filter(F.col("est") <= math.ceil(min_sites * (1 + err)))
    exact = (join_small(lines, near.select("line_hash"), ["line_hash"]).select("line_hash", "site").distinct()
             .groupBy("line_hash").agg(F.count(F.lit(1)).alias("n")))
    return (likely.join(exact, "line_hash", "left").select("line_hash", F.coalesce("n", "est").alias("n_sites"), "first")
            .filter(F.col("n_sites") >= min_sites))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, blanks: str = BLANKS) -> DataFrame:
    """(row, n_lines, n_removed, text): every row of ``docs`` as a struct of all its columns, and its text without
    the lines that, without outer ``blanks``, are found on ``min_sites`` or more sites; such a line's first occurrence (smallest id, then text
    hash, then place) stays, so that nothing is lost from the corpus.

    A null site is a site of its own.  Null texts stay null with 0 lines; lines of fewer than ``min_words`` words, empty
    ones among them, always stay.  Rows that repeat id and text share what is removed.  The lines' hashes and places (not
    their texts) are written once to the shared folder; documents are shuffled once, by id and text hash."""
    lines = cut_lineage(line_table(docs, id_col, text_col, site_col, min_words, blanks), "lines")
    found = cut_lineage(boilerplate(lines, min_sites).select("line_hash", "first"), "boilerplate")
    here = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "at")
    names = ["k_none", "k_id", "k_hash"]
    drop = (join_small(lines, found, ["line_hash"]).filter(~here.eqNullSafe(F.col("first")))
            .select(F.col("id").isNull().alias("k_none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k_id"),
                    F.col("text_hash").alias("k_hash"), "at")
            .groupBy(*names).agg(F.collect_set("at").alias("gone")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).isNull().alias("k_none"),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k_id"),
                       F.xxhash64(text_col).alias("k_hash"), F.col(text_col).alias("k_text"))
    split = F.split("k_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("k_text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    return rows.join(drop, names, "left").select(
        "row", F.when(F.col("k_text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                    **limits) -> DataFrame:
    """``docs`` with the shortened texts in place, all columns kept (``n_chars``, if there is one, follows the text)."""
    got = remove_boilerplate(docs, id_col, text_col, site_col, **limits)
    row = F.col("row").withField(text_col, F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
                            .cast(docs.schema["n_chars"].dataType))
    return got.select(row.alias("row")).select("row.*")


def contract(spark, docs: DataFrame) -> DataFrame:
    return remove_boilerplate(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')),
b AS (SELECT k FROM c GROUP BY k HAVING count(DISTINCT site) >= 5),
g AS (SELECT c.*, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM c JOIN b USING (k)),
x AS (SELECT l.doc_id, l.pos, l.line, coalesce(g.nth, 1) > 1 AS gone
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM x GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
