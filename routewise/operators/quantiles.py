"""Exact quantiles (linear interpolation, as pandas/NumPy default) per group.

``percentile``/``median`` keep a value->count map per group in one task,
which is fine for a small group but not for a column of billions of
distinct values or a group holding a third of all rows. Here:

1. ``groupBy(group, value).count()`` - map-side combined;
2. per group, ~``n_buckets`` value ranges from ``percentile_approx``;
3. running counts inside each (group, range) window partition, plus the
   totals of the lower ranges of the same group;
4. the rows whose cumulative interval holds the two positions around
   ``(N - 1) q`` give the interpolated value.

Every step is a partitioned aggregate or window; nothing goes through the
driver and a hot group is spread over ``n_buckets`` tasks.

``quantiles_by_group`` serves several columns in two passes over the rows
without ranking all values: it ranks only those near the quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewise.operators.rank import grouped_prefix_sums
from routewise.session import cut_lineage


def value_counts(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """(group, value, _n): map-side-combined counts of non-NULL values."""
    return (df.filter(F.col(value_col).isNotNull())
            .groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_n")))


def grouped_positions(counts: DataFrame, group_col: str, value_col: str,
                      n_buckets: int = 32, accuracy: int = 10000) -> DataFrame:
    """(group, value, n, cum_before, total) from ``value_counts`` output:
    one row per distinct value with the count of smaller values."""
    # group totals come from the per-range table (<= n_buckets rows per
    # group), never from a window over a whole (possibly hot) group
    cum = grouped_prefix_sums(counts, group_col, value_col, ["_n"], n_buckets, accuracy,
                              with_totals=True)
    return cum.select(group_col, value_col, F.col("_n").alias("n"),
                      (F.col("cum__n") - F.col("_n")).alias("cum_before"),
                      F.col("total__n").alias("total"))


def grouped_quantile(df: DataFrame, group_col: str, value_col: str, q: float = 0.5,
                     out_col: str | None = None, n_buckets: int = 32,
                     counts: DataFrame | None = None) -> DataFrame:
    """Exact q-quantile of ``value_col`` per group (NULLs ignored)."""
    out_col = out_col or f"q_{value_col}"
    counts = counts if counts is not None else value_counts(df, group_col, value_col)
    pos = grouped_positions(counts, group_col, value_col, n_buckets)
    h = (F.col("total") - 1) * F.lit(q)
    lo, hi = F.floor(h), F.ceil(h)
    covers = lambda p: (F.col("cum_before") <= p) & (p < F.col("cum_before") + F.col("n"))
    picked = pos.filter(covers(lo) | covers(hi)).select(
        group_col, h.alias("_h"), lo.alias("_lo"),
        F.when(covers(lo), F.col(value_col)).alias("_vlo"),
        F.when(covers(hi), F.col(value_col)).alias("_vhi"))
    agg = picked.groupBy(group_col).agg(
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"),
        F.max("_vlo").alias("_vlo"), F.max("_vhi").alias("_vhi"))
    val = F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))
    return agg.select(group_col, val.alias(out_col))


#: Rank error of the approximate bounds is one in so many values; groups of no
#: more values are ranked whole.
ACCURACY = 10_000
#: Groups whose bounds are broadcast (a few numbers each).
FEW_GROUPS = 200_000


def quantiles_by_group(df: DataFrame, group_cols: list[str], cols: list[str], q: float = 0.5,
                       accuracy: int = ACCURACY) -> DataFrame:
    """Exact q-quantiles of several columns per group (one row a group, NULLs
    skipped, NULL where a group has no value): columns ``group_cols`` and ``cols``.

    One aggregate finds for each group and column an interval around the
    quantile: two approximate percentiles whose rank error cannot move them past
    it. The rows are then read once more: values below the interval are only
    counted, those above it are left out, and those inside (a share of
    4 / accuracy, or all of a group of at most ``accuracy`` values) are combined by
    value and ranked. So a group holding a third of all rows leaves one part in
    2,500 of them to rank, and all columns share both passes.
    """
    at = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    values = [F.col(c).cast("double") for c in cols]
    near = [F.percentile_approx(v, at, accuracy) for v in values]
    bounds = df.groupBy(*group_cols).agg(
        F.array(*[F.count(v) for v in values]).alias("_n"),
        F.array(*[b[0] for b in near]).alias("_low"), F.array(*[b[1] for b in near]).alias("_high"))
    rows = df.select(*group_cols, F.array(*values).alias("_values"))
    if group_cols:
        bounds = cut_lineage(bounds)  # read twice; one row a group
        few = bounds.count() <= FEW_GROUPS
        rows = rows.join(F.broadcast(bounds) if few else bounds, group_cols)
    else:
        row = bounds.first()  # three numbers a column
        rows = rows.select("_values", *[F.lit(row[c]).cast(t).alias(c) for c, t in (
            ("_n", "array<bigint>"), ("_low", "array<double>"), ("_high", "array<double>"))])

    # one row for each value: below the interval it is counted under null
    v, n = F.col("_v"), F.get("_n", F.col("_i"))
    whole = n <= accuracy
    counts = rows.select(*group_cols, "_n", "_low", "_high", F.posexplode("_values").alias("_i", "_v")) \
        .where(v.isNotNull() & (whole | (v <= F.get("_high", F.col("_i"))))) \
        .select(*group_cols, "_i", F.when(whole | (v >= F.get("_low", F.col("_i"))), v).alias("_v"), n.alias("_n")) \
        .groupBy(*group_cols, "_i", "_v", "_n").agg(F.count(F.lit(1)).alias("_rows"))
    if group_cols:
        counts = counts.repartition(*group_cols)
    w = Window.partitionBy(*group_cols, "_i").orderBy(F.col("_v").asc_nulls_first())  # null: all below
    ranked = counts.withColumn("_to", F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = (F.col("_n") - 1) * F.lit(q)

    def covering(p):
        return F.when((F.col("_to") - F.col("_rows") <= p) & (p < F.col("_to")), F.col("_v"))

    found = ranked.groupBy(*group_cols, "_i").agg(
        F.max(h - F.floor(h)).alias("_f"), F.max(covering(F.floor(h))).alias("_lo"), F.max(covering(F.ceil(h))).alias("_hi"))
    result = F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))
    wide = found.groupBy(*group_cols).agg(*[F.max(F.when(F.col("_i") == i, result)).alias(c) for i, c in enumerate(cols)])
    return bounds.select(*group_cols).join(wide, group_cols, "left") if group_cols else wide


def exact_medians(df: DataFrame, cols: list[str], n_buckets: int = 32) -> dict:
    """Exact median of each column (NULLs skipped; all-NULL -> None): one scalar
    per column, a bounded result."""
    row = quantiles_by_group(df, [], list(cols)).first()
    return {c: row[c] for c in cols}


def sketch_size(rank_error: float) -> int:
    """KLL parameter whose rank error (99 % of the time, one side) is at most
    ``rank_error``: the published fit 2.296 / k^0.9723 solved for k."""
    if not 0 < rank_error < 1:
        raise ValueError("the rank error is a share between 0 and 1")
    return min(65535, max(8, math.ceil((2.296 / rank_error) ** (1 / 0.9723))))


def sketches(df: DataFrame, group_cols: list[str], cols: list[str], rank_error: float = 0.01) -> DataFrame:
    """One mergeable KLL sketch per group and column (NULL without values): a few
    KB each whatever the number of rows, built in one aggregate. Sketches can be
    stored and added up later by ``merged_sketches``."""
    k = sketch_size(rank_error)
    return df.groupBy(*group_cols).agg(*[
        F.when(F.count(c) > 0, F.kll_sketch_agg_double(F.col(c).cast("double"), k)).alias(c) for c in cols])


def merged_sketches(stored: DataFrame, group_cols: list[str], cols: list[str]) -> DataFrame:
    """Sketches of the union of what the stored ones have seen."""
    return stored.groupBy(*group_cols).agg(*[
        F.when(F.count(c) > 0, F.kll_merge_agg_double(c)).alias(c) for c in cols])


def sketch_quantiles(stored: DataFrame, group_cols: list[str], cols: list[str], q: float = 0.5) -> DataFrame:
    """Approximate q-quantile of each sketch: a value that was seen."""
    return stored.select(*group_cols, *[
        F.when(F.col(c).isNotNull(), F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(c) for c in cols])


def medians_row(df: DataFrame, cols: list[str], n_buckets: int = 32, rank_error: float | None = None) -> DataFrame:
    """The medians as one wide row (column names kept): exact ones, or with a
    ``rank_error`` those of KLL sketches, for one pass without ranking."""
    if rank_error is not None:
        row = sketch_quantiles(sketches(df, [], cols, rank_error), [], cols).first()
        med = {c: row[c] for c in cols}
    else:
        med = exact_medians(df, cols, n_buckets)
    schema = ", ".join(f"`{c}` double" for c in cols)
    return df.sparkSession.createDataFrame(
        [tuple(None if med[c] is None else float(med[c]) for c in cols)], schema)
