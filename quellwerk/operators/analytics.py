"""Aggregations of the influence and search layers: one pass per table, not one job per column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value): the named columns as rows, booleans as 0 and 1."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, null where a side does not vary."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def correlation_p(r: float | None, n: int | None) -> float | None:
    """The two-sided p-value of Pearson's r over n pairs, by Student's t with n - 2 degrees of
    freedom; null below three pairs."""
    if r is None or n is None or n < 3:
        return None
    a, b, x = (n - 2) / 2, 0.5, max(0.0, 1 - r * r)
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """correlation_p for the few rows of a ranking."""
    return pd.Series([correlation_p(None if pd.isna(a) else a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first k rows, of each group if by is given."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


#: Windows that a group's distinct values are dealt to, and how many of them one coarse step spans.
WINDOWS, STEP = 256, 16


def mean(value: str) -> Column:
    """The mean of a column's values but for NaN, row by row as SQL's avg adds them: a sum over counted
    values rounds otherwise, which shows where a mean lies midway between two rounded ones."""
    x = F.col(value).cast("double")
    return F.avg(F.when(~F.isnan(x), x))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., quantiles, n, sum, low, high): exact quantiles by linear interpolation, the number of values,
    their sum (to be divided for a mean of whole numbers only) and the smallest and largest, of the
    groups that have a value.

    Values are first counted, so ties cost nothing; the distinct ones are dealt to windows by cuts
    from a sketch, and each window ranks its own from the total of those before. No task holds a
    group's values, unlike the percentile aggregate."""
    by = by or []
    # Null keys are a group: a key travels beside a flag, so that joins can compare it.
    keys = [f"_k{i}" for i in range(len(by))]
    plain = df.select(*[F.struct(F.col(b).isNull().alias("n"), F.col(b).alias("v")).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    counted = plain.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    hashed = counted.withColumn("_g", F.xxhash64(*[F.to_json(k) for k in keys]) if keys else F.lit(0).cast("long"))
    cuts = hashed.groupBy("_g").agg(F.percentile_approx("_v", F.array(*[F.lit(i / WINDOWS) for i in range(1, WINDOWS)]), F.lit(10_000)).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.array(*[F.get("_cuts", F.lit(i - 1)) for i in range(STEP, WINDOWS, STEP)]))
    below = lambda cut: F.size(F.filter(cut, lambda c: c < F.col("_v")))
    # The number of cuts below a value, counted in two steps.
    dealt = hashed.join(cuts, "_g").withColumn("_i", below("_coarse"))
    dealt = dealt.withColumn("_w", F.col("_i") * STEP + below(F.slice("_cuts", F.col("_i") * STEP + 1, F.lit(STEP - 1)))).drop("_cuts", "_coarse", "_i")
    sums = dealt.groupBy("_g", "_w").agg(F.sum("_n").alias("_s"))
    earlier = Window.partitionBy("_g").orderBy("_w")
    starts = sums.select("_g", "_w", (F.sum("_s").over(earlier) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy("_g")).alias("_all"))
    inner = Window.partitionBy("_g", "_w").orderBy("_v")
    placed = dealt.join(starts, ["_g", "_w"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inner)).withColumn("_first", F.col("_last") - F.col("_n"))
    found = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("_all") - 1)
        holds = lambda place: (F.col("_first") <= place) & (place < F.col("_last"))
        found += [F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_part{i}")]
    ends = placed.groupBy("_g", *keys).agg(*found, F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("sum"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(shares))]
    return ends.select(*[F.col(f"{k}.v").alias(b) for b, k in zip(by, keys, strict=True)], F.array(*between).alias("quantiles"), "n", "sum", "low", "high")


def with_quantiles(rows: DataFrame, found: DataFrame, by: list[str], names: list[str], more: list[str] | None = None) -> DataFrame:
    """rows, one per group, with the quantiles, and more of what was found, as columns; null keys match."""
    right = found.select(*[F.col(b).alias(f"_q_{b}") for b in by], *(more or []), *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_q_{b}"))
    return rows.join(right, same, "left").drop(*[f"_q_{b}" for b in by])


def correlation_rank(df: DataFrame, target: str, columns: list[str], top: int = 25, min_n: int = 30, by: list[str] | None = None, p: bool = False) -> DataFrame:
    """Correlations of columns with target by falling size, with their p-values if
    wanted; pairs with a null side are left out, as are features of fewer than min_n pairs or
    without variation."""
    by = by or []
    long = unpivot(df, columns, [*by, target]).filter(f"value is not null and {target} is not null")
    r = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("value"), F.col(target).cast("double")).alias("r"))
    r = r.filter((F.col("n") >= min_n) & F.col("r").isNotNull() & ~F.isnan("r"))
    found = top_k(r, top, [F.abs(F.round("r", 9)).desc(), F.col("feature")], by)
    return found.withColumn("p", p_value("r", "n")) if p else found


def boolean_lift(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Mean of target where a flag holds and where not."""
    long = unpivot(df, columns, [target]).filter("value is not null")
    yes, no = F.when(F.col("value") == 1, F.col(target)), F.when(F.col("value") == 0, F.col(target))
    out = long.groupBy("feature").agg(F.avg(yes).alias("mean_true"), F.avg(no).alias("mean_false"), F.count(yes).alias("n_true"), F.count(no).alias("n_false"))
    out = out.filter("n_true > 0 and n_false > 0").withColumn("delta", F.col("mean_true") - F.col("mean_false"))
    return out.withColumn("lift", F.when(F.col("mean_false") > 0, F.col("delta") / F.col("mean_false")).otherwise(float("inf")))


def category_mean(df: DataFrame, column: str, target: str, min_n: int = 20) -> DataFrame:
    """Mean and median per category; null is 'unknown'; small categories are left out."""
    named = df.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("category"), F.col(target).alias("_t"))
    stats = named.groupBy("category").agg(mean("_t").alias("mean"))
    found = with_quantiles(stats, quantiles(named, "_t", [0.5], ["category"]), ["category"], ["median"], ["n"])
    return found.filter(F.col("n") >= min_n).select("category", "n", "mean", "median")


def binned(df: DataFrame, column: str, target: str, edges: list[float], right_closed: bool = False) -> DataFrame:
    """Target by bins; left-closed with an open last bin, or right-closed."""
    x, out = F.col(column), None
    bounds = [*zip(edges, edges[1:], strict=False), (edges[-1], None)]
    for k, (lo, hi) in enumerate(bounds):
        inside = (x > lo if right_closed else x >= lo) & (F.lit(True) if hi is None else (x <= hi if right_closed else x < hi))
        row = F.struct(F.lit(k).alias("bin"), F.lit(f"{lo}-{'+' if hi is None else hi}").alias("label"))
        out = F.when(inside, row) if out is None else out.when(inside, row)
    named = df.withColumn("_b", out).filter("_b is not null").select("_b.bin", "_b.label", F.col(target).alias("_t"))
    stats = named.groupBy("bin", "label").agg(F.count("_t").alias("n"), F.avg("_t").alias("mean"))
    return with_quantiles(stats, quantiles(named, "_t", [0.5], ["bin"]), ["bin"], ["median"])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row of statistics per column, zeros if there is nothing."""
    names = ["p10", "p25", "median", "p75", "p90"]
    fixed, long = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string"), unpivot(df, columns, [])
    found = fixed.join(long.groupBy("feature").agg(mean("value").alias("mean")), "feature", "left")
    found = with_quantiles(found, quantiles(long, "value", [0.1, 0.25, 0.5, 0.75, 0.9], ["feature"]), ["feature"], names, ["n", "low", "high"])
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return found.select("feature", F.coalesce("n", F.lit(0)).alias("n"), *[zero(c, c) for c in ("mean", *names)], zero("low", "min"), zero("high", "max"))


def split_by_quantile(df: DataFrame, score: str, share: float, by: list[str] | None = None) -> DataFrame:
    """df with is_top and is_bottom; both hold where the quantiles meet. One row of cuts per group
    is broadcast by the planner if small."""
    by = by or []
    cuts = quantiles(df, score, [1 - share, share], by).select(*[F.col(b).alias(f"_q_{b}") for b in by], F.col("quantiles").alias("_cuts"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_q_{b}"))
    joined = df.join(cuts, same) if by else df.crossJoin(F.broadcast(cuts))
    return joined.withColumn("is_top", F.col(score) >= F.col("_cuts")[0]).withColumn("is_bottom", F.col(score) <= F.col("_cuts")[1]).drop("_cuts", *[f"_q_{b}" for b in by])


def top_bottom(df: DataFrame, score: str, columns: list[str], share: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """Means of columns in the top and bottom shares of score."""
    by = by or []
    long = unpivot(split_by_quantile(df, score, share, by), columns, [*by, "is_top", "is_bottom"])
    out = long.groupBy(*by, "feature").agg(F.avg(F.when(F.col("is_top"), F.col("value"))).alias("top_mean"), F.avg(F.when(F.col("is_bottom"), F.col("value"))).alias("bottom_mean"))
    return out.withColumn("delta", F.col("top_mean") - F.col("bottom_mean")).withColumn("ratio", F.try_divide("top_mean", "bottom_mean"))


def distribution_compare(df: DataFrame, score: str, column: str, share: float = 0.2, top: int = 8) -> DataFrame:
    """Shares of a column's values in the top and the bottom; values of one side only last."""
    split = split_by_quantile(df, score, share).withColumn("k", F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
    counted = split.groupBy("k").agg(F.count_if("is_top").alias("t"), F.count_if("is_bottom").alias("b"))
    whole = Window.partitionBy()
    shares = counted.select("k", F.try_divide("t", F.sum("t").over(whole)).alias("top_share"), F.try_divide("b", F.sum("b").over(whole)).alias("bottom_share"), ((F.col("t") > 0) & (F.col("b") > 0)).alias("_both"))
    return top_k(shares, top, [F.col("_both").desc(), F.round(F.col("top_share") + F.col("bottom_share"), 9).desc(), F.col("k")]).drop("_both")


def type_profile(df: DataFrame, type_col: str, columns: list[str], first: str, second: str) -> DataFrame:
    """Means of columns, or shares where they are flags, per type side by side, and the
    difference of two types, the largest first."""
    a, b = (F.avg(F.when(F.col(type_col) == t, F.col("value"))) for t in (first, second))
    out = unpivot(df, columns, [type_col]).groupBy("feature").agg(a.alias("first_mean"), b.alias("second_mean"), (a - b).alias("delta"))
    return out.orderBy(F.abs(F.round("delta", 9)).desc_nulls_last(), "feature")


def slice_drivers(df: DataFrame, by: str, score: str, columns: list[str], min_rows: int = 50, top: int = 5) -> DataFrame:
    """Per group of at least min_rows rows its size, mean and median score, and the top features
    by how far the means of its top and bottom fifth lie apart."""
    given = df.filter(F.col(by).isNotNull())
    sizes = given.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean")).filter(F.col("rows") >= min_rows)
    sizes = with_quantiles(sizes, quantiles(given, score, [0.5], [by]), [by], ["median"])
    apart = top_k(top_bottom(df, score, columns, by=[by]).filter("delta is not null"), top, [F.abs(F.round("delta", 9)).desc(), F.col("feature")], [by])
    return sizes.join(apart, by).select(by, "rows", "mean", "median", "feature", "delta", "ratio")


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """The share of rows that each flag holds for, the largest first."""
    return unpivot(df, flags, []).groupBy("feature").agg(F.avg("value").alias("share")).orderBy(F.round("share", 9).desc(), "feature")


def score_stats(df: DataFrame, by: str, score: str) -> DataFrame:
    """Number, mean, median and ninth decile of the score per group."""
    stats = df.groupBy(by).agg(mean(score).alias("mean"))
    found = with_quantiles(stats, quantiles(df, score, [0.5, 0.9], [by]), [by], ["median", "p90"], ["n"])
    return found.filter("n > 0").select(by, "n", "mean", "median", "p90")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent per value, the most frequent first; null is 'unknown'."""
    counted = value_counts(df, column, "unknown")
    return counted.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), "value")


def share_within(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Percent of each key within its group; null keys are left out."""
    counted = df.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def value_counts(df: DataFrame, column: str, unknown: str | None = None) -> DataFrame:
    """Rows per value, null kept, or named."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(unknown)) if unknown else F.col(column)
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def counts_for(df: DataFrame, column: str, wanted: list[str], counted: str) -> DataFrame:
    """Counts for a fixed list, zero where there is none, in its order."""
    fixed = df.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], "ordinal int, category string")
    return fixed.join(df.groupBy(F.col(column).alias("category")).agg(F.count(counted).alias("n")), "category", "left").select("ordinal", "category", F.coalesce("n", F.lit(0)).alias("n"))


def missing_ids(df: DataFrame, by: str, number: str) -> DataFrame:
    """The numbers from 1 to each group's largest that do not occur."""
    whole = df.groupBy(by).agg(F.max(number).alias("_m")).filter("_m >= 1").select(by, F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias(number))
    return whole.join(df.select(by, F.col(number).cast("int").alias(number)).distinct(), [by, number], "left_anti")


def correlation_words(r: Column) -> Column:
    """T37."""
    size = F.abs(r)
    return F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("very weak")
