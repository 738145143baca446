"""Operator 8: mixing sources to target weights by capped water-filling (DataFrame functions only)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import join_small
from ledgerlake.operators.ranking import global_position
from ledgerlake.session import cut_lineage

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 42


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; 0 for null."""
    flat = F.btrim(F.translate(text, "\t\n\u000b\f\r", "     "))
    return F.coalesce(F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +"))), F.lit(0)).cast("long")


def place(name: Column, seed: int) -> Column:
    """The seeded order in which a source's documents are drawn: a hex digest of name and seed."""
    return F.md5(F.concat(name, F.lit(f"|{seed}")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size, target) from (src, size).  Sources in code point order, null last, take the ``weights`` in
    turn; together they get ``share`` of all sizes by weight, but none more than ``epochs`` times its size.

    Water-filling: a level is raised until the sources above their cap no longer change; sources below it get
    level * weight, the others their cap.  Each round is one aggregate over the sources (one row back)."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    per = global_position(per.withColumn("none", F.col("src").isNull()), ["none", "src"], out="nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = cut_lineage(per.select("src", "source_size", weight.alias("w"),
                                 (F.col("source_size") * float(epochs)).alias("cap")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w")
        capped, open_w = per.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
                                 F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        nxt = (share * total - capped) / open_w if open_w else level
        if nxt <= level * (1 + 1e-12):
            break
        level = nxt
    return per.select("src", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with what the mix goes by: k_named, k_src (source), k_size (words), k_at (place in the seeded order), k_bucket
    (the place's first digits).  Rows without an id are placed by their text."""
    at = F.when(F.col(id_col).isNull(), place(F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), seed)
                ).otherwise(place(F.col(id_col).cast("string"), seed))
    src = F.col(source_col)
    return docs.select("*", src.isNotNull().alias("k_named"), F.coalesce(src.cast("string"), F.lit("")).alias("k_src"),
                       n_words(F.col(text_col)).alias("k_size"), at.alias("k_at")).withColumn(
        "k_bucket", F.conv(F.substring("k_at", 1, 3), 16, 10).cast("int"))


SOURCE = ["k_named", "k_src"]


def source_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of ``rows`` (SOURCE, k_size, k_at, k_bucket): source_size, target, whole (repetitions of every document), and
    the fractional one: all documents before the place (edge_bucket, edge_at, edge_size) are taken, edge_n of the alike
    ones there, and one more at (fill_at, fill_size), which comes nearest to what is then still missing.

    Where the edge lies is found on sums per (source, bucket), then on sums per place in the one bucket that holds
    it; alike rows are one sum.  So a source, or a repeated row, with a third of all rows is never gathered."""
    per = source_targets(rows.select(F.when(F.col("k_named"), F.col("k_src")).alias("src"), F.col("k_size").alias("size")),
                         weights, share, epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    per = per.select(F.col("src").isNotNull().alias("k_named"), F.coalesce("src", F.lit("")).alias("k_src"), "source_size",
                     "target", whole.alias("whole"), (F.floor("target").cast("long") - whole * F.col("source_size")).alias("rest"))
    before = Window.partitionBy(*SOURCE).rowsBetween(Window.unboundedPreceding, -1)

    def first_beyond(sums: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
        """Per source the first of ``sums`` (n words each, in ``order``) with which the rest is passed."""
        upto = sums.withColumn("before", F.coalesce(F.sum("n").over(before.orderBy(*order)), F.lit(0)))
        return (upto.join(per.select(*SOURCE, "rest"), SOURCE).filter(F.col("before") + F.col("n") > F.col("rest"))
                .groupBy(*SOURCE).agg(F.min_by(F.struct(*order, "before", "rest", *carried), F.struct(*order)).alias("e"))
                .select(*SOURCE, "e.*"))
    buckets = rows.groupBy(*SOURCE, "k_bucket").agg(F.sum("k_size").alias("n"))
    edge = cut_lineage(first_beyond(buckets, ["k_bucket"], []).select(
        *SOURCE, F.col("k_bucket").alias("edge_bucket"), F.col("before").alias("sofar")), "mix_edges")
    inside = join_small(rows, edge, SOURCE).filter("k_bucket = edge_bucket")
    places = inside.groupBy(*SOURCE, "k_at", "k_size").agg(F.count(F.lit(1)).alias("rows"), F.sum("k_size").alias("n"))
    # the words of the buckets before come first: a row of their sum, which fits
    places = places.unionByName(edge.select(*SOURCE, F.lit("").alias("k_at"), F.lit(0).cast("long").alias("k_size"),
                                            F.lit(0).cast("long").alias("rows"), F.col("sofar").alias("n")))
    at = first_beyond(places, ["k_at", "k_size"], [])
    fits = F.floor((F.col("rest") - F.col("before")) / F.col("k_size")).cast("long")
    at = cut_lineage(at.join(edge, SOURCE).select(
        *SOURCE, "edge_bucket", F.col("k_at").alias("edge_at"), F.col("k_size").alias("edge_size"), fits.alias("edge_n"),
        (F.col("rest") - F.col("before") - fits * F.col("k_size")).alias("gap")), "mix_edges")
    # of the documents that are left (always some at the edge), the one whose size is nearest to the gap, if it is better than none
    after = F.struct("k_bucket", "k_at", "k_size") >= F.struct(F.col("edge_bucket"), F.col("edge_at"), F.col("edge_size"))
    off = F.abs(F.col("k_size") - F.col("gap"))
    fill = (join_small(rows, at, SOURCE).filter(after).filter(off < F.col("gap")).groupBy(*SOURCE)
            .agg(F.min(F.struct(off.alias("off"), "k_at", "k_size")).alias("f"))
            .select(*SOURCE, F.col("f.k_at").alias("fill_at"), F.col("f.k_size").alias("fill_size")))
    return cut_lineage(per.join(at.drop("gap"), SOURCE, "left").join(fill, SOURCE, "left"), "mix_plan")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with the columns of ``sized``) and the plan's, and ``times``: how often the mix takes each.

    A row decides by its own place.  Only where the plan takes some of several alike rows (one or two places a source) are those
    rows written and counted off, by the task that wrote them and then within it."""
    def is_at(kind):
        return F.coalesce((F.col("k_at") == F.col(f"{kind}_at")) & (F.col("k_size") == F.col(f"{kind}_size")), F.lit(False))
    all_ = join_small(rows, plan, SOURCE)
    place_, edge = F.struct("k_bucket", "k_at", "k_size"), F.struct(F.col("edge_bucket"), F.col("edge_at"), F.col("edge_size"))
    extra = F.when(F.col("edge_at").isNull() | (place_ < edge), 1).otherwise(0)
    sure = all_.filter(~is_at("edge") & ~is_at("fill")).withColumn("times", F.col("whole") + extra)
    some = cut_lineage(all_.filter(is_at("edge") | is_at("fill")).withColumn("k_row", F.monotonically_increasing_id()), "mix_places")
    wanted = F.when(is_at("edge"), F.col("edge_n")).otherwise(0) + F.when(is_at("fill"), 1).otherwise(0)
    part, alike = F.shiftright("k_row", 33), [*SOURCE, "k_at", "k_size"]
    # rows a writing task has at a place, and how many the tasks before it have: one row for each task and place
    per = some.groupBy(*alike, part.alias("k_part")).agg(F.count(F.lit(1)).alias("k_rows"))
    per = per.withColumn("k_before", F.coalesce(F.sum("k_rows").over(
        Window.partitionBy(*alike).orderBy("k_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k_rows")
    nth = some.select("k_row", *alike, part.alias("k_part"), wanted.alias("k_wanted")).join(per, [*alike, "k_part"]).withColumn(
        "k_nth", F.col("k_before") + F.row_number().over(Window.partitionBy(*alike, "k_part").orderBy("k_row")))
    chosen = nth.filter("k_nth <= k_wanted").select("k_row", F.lit(1).alias("k_extra"))
    counted = some.join(chosen, "k_row", "left").withColumn("times", F.col("whole") + F.coalesce("k_extra", F.lit(0)))
    return sure.unionByName(counted.select(*sure.columns))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id, src, size (words), source_size, target (its source's), taken (words, repeats counted).

    Whole repetitions: every document is taken floor(target / source_size) times.  Fractional repetition: the source's documents
    in seeded order, as long as they fit into the rest of the target, and then the one document that comes nearest to what is still
    missing, if any does.  Documents are taken whole, never in part; a source misses its target by less than half a document.

    Null texts and texts without words have size 0; null sources are one source; rows without an id are placed by their text; alike
    rows (id, source and size) count each.  Reruns agree.  An empty table gives an empty result."""
    src = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.col(text_col).alias("text"))
    rows = cut_lineage(sized(src, "id", "text", "src", seed).drop("text"), "mix_sizes")
    got = take(rows, source_plan(rows, weights, share, epochs))
    return got.select("id", "src", F.col("k_size").alias("size"), "source_size", "target",
                      (F.col("times") * F.col("k_size")).alias("taken"))


def contract(spark, docs: DataFrame) -> DataFrame:
    return taken_words(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` mixed: each row, whole and with all its columns, as often as the mix takes it.  Rows without words are not taken.

    Sizes and places are written once for the plan, which has one row a source; texts are read again and not shuffled."""
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"),
                      F.col(text_col).alias("text"))
    plan = source_plan(cut_lineage(sized(src, "id", "text", "src", seed).drop("row", "id", "src", "text"), "mix_sizes"),
                       weights, share, epochs)
    rows = sized(src, "id", "text", "src", seed).drop("id", "src", "text")
    took = take(rows, plan).filter("times > 0 and k_size > 0")
    return took.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, ''))) || '|42') AS ord,
       coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS size FROM documents),
s AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY (source IS NULL), source) AS rk FROM d GROUP BY source),
w AS (SELECT source, CAST(ss AS DOUBLE) AS ss, [5.0, 2.0, 1.0][(rk - 1) % 3 + 1]::DOUBLE AS w, ss * 2.0::DOUBLE AS cap,
             (SELECT sum(ss) FROM s)::DOUBLE AS total FROM s),
-- capped sources come first by cap / weight: the level where the rest shares what the capped leave over
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
lv AS (SELECT arg_min((1.5 * total - capped) / open_w, cap / w) FILTER (WHERE (1.5 * total - capped) / open_w <= cap / w) AS level FROM o),
t AS (SELECT source, CAST(ss AS BIGINT) AS source_size, least(cap, (SELECT level FROM lv) * w) AS target FROM w),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, CAST(floor(q.target) AS BIGINT) - q.whole * q.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
f AS (SELECT *, sofar + size <= rest AS fits FROM r JOIN (SELECT doc_id, source, ord FROM d) USING (doc_id)),
g AS (SELECT *, rest - coalesce(max(sofar + size) FILTER (WHERE fits) OVER (PARTITION BY source), 0) AS gap FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fits, abs(size - gap) >= gap, abs(size - gap), ord) AS nth FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN fits OR (nth = 1 AND abs(size - gap) < gap) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM n
"""
