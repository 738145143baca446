"""Mergeable sketches kept per day: quantiles (KLL) and distinct entities with set algebra (theta).

A day's sketches are built once from that day's rows (partial aggregation; a sketch is bounded, so a hot day or module costs no
more than any other) and stored, one row a day.  Any window is then the merge of its days' rows: a report over a
year reads some hundreds of small rows instead of the year's ledger, and a new day adds its own rows only.

* Quantiles: the rank of an answer lies within ``rank_error(k)`` of the wanted one with 99 % confidence; below some
  ``k`` values a sketch is exact.  ``exact_quantile`` stays the default everywhere; sketches are the cheap second path.
* Distinct counts: exact while a union holds fewer than ``2 ** lg`` entities, else with a relative standard deviation of
  about ``1 / sqrt(2 ** lg)`` of the union.

Null days, values and entities are left out; a window without rows is not returned.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import group_value_ranks

QUANTILE_K = 400
SET_LG = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Normalised one-sided rank error of a KLL sketch at 99 % confidence (the family's published fit)."""
    return 2.296 / k ** 0.9723


def in_windows(df: DataFrame, day: str, windows: dict[int, tuple]) -> DataFrame:
    """Each row once per window that holds its day, ``span`` its key; a bound of None is open."""
    d = F.col(day)

    def holds(bounds):
        lo, hi = bounds
        return reduce(Column.__and__, [d >= F.lit(lo).cast("date")] * (lo is not None)
                      + [d <= F.lit(hi).cast("date")] * (hi is not None), d.isNotNull())
    keys = F.array_compact(F.array(*[F.when(holds(b), F.lit(w)) for w, b in windows.items()]))
    return df.withColumn("span", F.explode(keys))


# ---------------------------------------------------------------- quantiles
def daily_quantiles(df: DataFrame, day: str, value: str, k: int = QUANTILE_K) -> DataFrame:
    """(day, n, sketch): one KLL sketch per day."""
    x = F.col(value).cast("double")
    return (df.filter(F.col(day).isNotNull() & x.isNotNull()).groupBy(F.col(day).alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch")))


def window_quantiles(daily: DataFrame, windows: dict[int, tuple], ps: list[float]) -> DataFrame:
    """(span, p, n, quantile) from stored days alone; a quantile is one of the values."""
    per = (in_windows(daily, "day", windows).groupBy("span")
           .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")))
    p = F.array(*[F.lit(float(x)) for x in ps])                  # constant ranks: one reading of the sketch for all
    pairs = F.explode(F.arrays_zip(p.alias("p"), F.kll_sketch_get_quantile_double("sketch", p).alias("quantile")))
    return per.select("span", "n", pairs.alias("r")).select("span", F.col("r.p").alias("p"), "n", F.col("r.quantile").alias("quantile"))


def window_value_ranks(df: DataFrame, day: str, value: str, windows: dict[int, tuple]) -> DataFrame:
    """(span, _x, _eq, _less, _n): ranks of the distinct values of each window, all windows in one pass over value counts."""
    x = in_windows(df.select(day, F.col(value).cast("double").alias("_x")), day, windows)
    return group_value_ranks(x, "span", "_x")


def exact_window_quantiles(ranks: DataFrame, ps: list[float]) -> DataFrame:
    """(span, p, exact): linear interpolation as ``exact_quantile``."""
    r = ranks.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    h = (F.col("_n") - 1) * F.col("p")

    def at(i):
        return F.max(F.when((F.col("_less") <= i) & (i < F.col("_less") + F.col("_eq")), F.col("_x")))
    got = r.groupBy("span", "p").agg(at(F.floor(h)).alias("a"), at(F.ceil(h)).alias("b"), F.max(h).alias("h"))
    t, diff = F.col("h") - F.floor("h"), F.col("b") - F.col("a")
    return got.select("span", "p", F.when(t >= 0.5, F.col("b") - diff * (F.lit(1.0) - t))
                      .otherwise(F.col("a") + diff * t).alias("exact"))


def measured_rank_error(answers: DataFrame, ranks: DataFrame) -> DataFrame:
    """Answers with ``rank_error``: how far p lies outside the ranks that the answered value really covers (0 inside; ties
    cover a range).  Null if the value does not occur, which a sketch never gives."""
    r = ranks.select("span", F.col("_x").alias("quantile"), (F.col("_less") / F.col("_n")).alias("_lo"),
                     ((F.col("_less") + F.col("_eq")) / F.col("_n")).alias("_hi"))
    off = F.greatest(F.col("_lo") - F.col("p"), F.col("p") - F.col("_hi"), F.lit(0.0))
    return (answers.join(r, ["span", "quantile"], "left")
            .withColumn("rank_error", F.when(F.col("_lo").isNotNull(), off)).drop("_lo", "_hi"))


# ---------------------------------------------------------------- distinct entities
def daily_entities(df: DataFrame, keys: list[str], day: str, entity: str, lg: int = SET_LG) -> DataFrame:
    """(keys, day, sketch): one theta sketch of the entities per key and day."""
    return (df.filter(F.col(day).isNotNull() & F.col(entity).isNotNull()).groupBy(*keys, F.col(day).alias("day"))
            .agg(F.theta_sketch_agg(entity, lg).alias("sketch")))


def window_entities(daily: DataFrame, key: str, windows: dict[int, tuple], lg: int = SET_LG) -> DataFrame:
    """(span, key, sketch): the days of each window united."""
    return in_windows(daily, "day", windows).groupBy("span", key).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def _of(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def sketch_set_counts(sets: DataFrame, key: str) -> DataFrame:
    """(span, left_key, right_key, shared, only_left, only_right, either) for every pair of keys of a window, from their
    sketches.  Rows are keys x windows, a few dozen; the pairs meet on the window."""
    a = sets.select("span", F.col(key).alias("left_key"), F.col("sketch").alias("a"))
    b = sets.select("span", F.col(key).alias("right_key"), F.col("sketch").alias("b"))
    j = a.join(b, "span").filter("left_key < right_key")
    x, y = F.col("a"), F.col("b")
    return j.select("span", "left_key", "right_key", _of(F.theta_intersection(x, y)).alias("shared"),
                    _of(F.theta_difference(x, y)).alias("only_left"), _of(F.theta_difference(y, x)).alias("only_right"),
                    _of(F.theta_union(x, y)).alias("either"))


def exact_set_counts(df: DataFrame, key: str, day: str, entity: str, values: list[str],
                     windows: dict[int, tuple]) -> DataFrame:
    """The same columns counted exactly: one row per window and entity with a flag for each key value (partially
    aggregated), then one partially aggregated count per pair.  Pairs with an empty side are left out."""
    flags = (in_windows(df.filter(F.col(entity).isNotNull()), day, windows).groupBy("span", entity)
             .agg(*[F.max(F.col(key) == v).alias(f"_in{i}") for i, v in enumerate(values)]))
    pairs = list(combinations(range(len(values)), 2))
    counts = flags.groupBy("span").agg(*[F.count_if(c).alias(f"_{n}{i}_{j}") for i, j in pairs for n, c in (
        ("b", F.col(f"_in{i}") & F.col(f"_in{j}")), ("l", F.col(f"_in{i}") & ~F.col(f"_in{j}")),
        ("r", ~F.col(f"_in{i}") & F.col(f"_in{j}")))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(values[i]).alias("left_key"), F.lit(values[j]).alias("right_key"), F.col(f"_b{i}_{j}").alias("shared"),
        F.col(f"_l{i}_{j}").alias("only_left"), F.col(f"_r{i}_{j}").alias("only_right"),
        (F.col(f"_b{i}_{j}") + F.col(f"_l{i}_{j}") + F.col(f"_r{i}_{j}")).alias("either")) for i, j in pairs]))
    return (counts.select("span", rows.alias("r")).select("span", "r.*")
            .filter("shared + only_left > 0 AND shared + only_right > 0"))


def set_counts_hold(exact: Column, estimate: Column, union: Column, lg: int = SET_LG, deviations: float = 5.0) -> Column:
    """Whether an estimate lies within its stated error: equal below the capacity, else within the deviations of the union."""
    room = F.when(union < 2 ** lg, F.lit(0.0)).otherwise(F.lit(deviations / 2 ** (lg / 2)) * union + 1)
    return F.abs(exact - estimate) <= room
