"""Exact chronological train/test cut without a global sort.

The reference sorts all rows by purchase time and takes the first
floor(f * n) as train. Here the cut is found from histograms:

1. rows per day (one small aggregate, <= number of days to the driver)
   -> the day that holds the boundary and how many of its rows are train;
2. rows per second inside that one day (<= 86,400 values)
   -> the boundary second;
3. exact positions only among the rows of that one second, ordered by the
   full key (timestamp, tie columns), from a range partitioning of those
   rows (so even a coarse timestamp shared by a third of the rows is
   ranked by many tasks).

Every other row is labelled by comparing its timestamp with the boundary.
No row-level exchange and no single-partition window over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.session import cut_lineage, save_table


def _boundary(hist: list[tuple], need: int):
    """(bucket, rows of that bucket that go to train) for a sorted histogram."""
    seen = 0
    for key, cnt in hist:
        if seen + cnt >= need:
            return key, need - seen
        seen += cnt
    return None, 0


def chronological_split(df: DataFrame, ts_col: str = "order_purchase_timestamp",
                        tie_cols: tuple[str, ...] = ("order_id", "review_score"),
                        train_frac: float = 0.8, label_col: str = "is_train",
                        materialize: bool = True) -> DataFrame:
    """Adds ``label_col`` (1 = train, 0 = test): the first floor(f * n) rows
    in (ts, *tie_cols) order are train. NULL timestamps sort last.

    ``materialize``: the input is read by two histogram jobs and both label
    branches, and the parts feed many later statistics, so it is written
    once as Parquet to the shared checkpoint folder (executor-loss safe, and
    later scans read only the columns they need).
    """
    if materialize:
        df = save_table(df)
    ts = F.col(ts_col)
    day = F.to_date(ts)
    days = [(r[0], r[1]) for r in
            df.groupBy(day.alias("d")).count().orderBy(F.asc_nulls_last("d")).collect()]
    n = sum(c for _, c in days)
    need = int(n * train_frac)
    if need <= 0:
        return df.withColumn(label_col, F.lit(0))
    b_day, need_day = _boundary(days, need)
    if b_day is None:  # the boundary lies among the NULL timestamps, ordered by the ties
        last = exact_positions(df.filter(ts.isNull()), list(tie_cols))
        return df.filter(ts.isNotNull()).withColumn(label_col, F.lit(1)).unionByName(
            last.withColumn(label_col, (F.col("_pos") < need_day).cast("int")).drop("_pos"))
    # whole seconds since the day's midnight, on the wall clock of the column
    sec = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    secs = [(r[0], r[1]) for r in
            df.filter(day == F.lit(b_day)).groupBy(sec.alias("s")).count().orderBy("s").collect()]
    b_sec, need_sec = _boundary(secs, need_day)
    b_sec_lit = F.lit(b_sec)
    in_b_sec = (day == F.lit(b_day)) & (sec == b_sec_lit)
    outside = df.filter(~in_b_sec | ts.isNull()).withColumn(
        label_col,
        F.when(ts.isNull(), 0)
        .when(day < F.lit(b_day), 1).when(day > F.lit(b_day), 0)
        .when(sec < b_sec_lit, 1).otherwise(0))
    ranked = exact_positions(df.filter(in_b_sec), [ts_col, *tie_cols])
    inside = (ranked.withColumn(label_col, (F.col("_pos") < need_sec).cast("int"))
              .drop("_pos"))
    return outside.unionByName(inside)


def exact_positions(df: DataFrame, keys: list[str], n_parts: int | None = None) -> DataFrame:
    """0-based position of every row in ``keys`` order, for keys of any
    orderable type, without a single-partition window.

    Rows are range-partitioned on the full key (a hot prefix such as one
    timestamp is split by the later keys), sorted inside each partition and
    numbered there; the rows per partition (one number per partition) give
    each partition's offset. The numbered rows are checkpointed first so
    both passes see the same numbering.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut_lineage(
        df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().alias("_mid")))
    counts = sorted((r["_part"], r["count"]) for r in numbered.groupBy("_part").count().collect())
    offsets, run = [], 0
    for part, cnt in counts:
        offsets.append((part, run))
        run += cnt
    off = spark.createDataFrame(offsets, "_part int, _off long")  # one row per partition
    local = F.col("_mid") - F.shiftleft(F.col("_part").cast("long"), 33)
    return (numbered.join(F.broadcast(off), "_part")
            .withColumn("_pos", F.col("_off") + local)
            .drop("_part", "_mid", "_off"))


def train_test(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    labelled = chronological_split(df, **kw)
    label = kw.get("label_col", "is_train")
    return (labelled.filter(F.col(label) == 1).drop(label),
            labelled.filter(F.col(label) == 0).drop(label))


def split_summary(labelled: DataFrame, ts_col: str = "order_purchase_timestamp",
                  label_col: str = "is_train", target: str = "satisfied",
                  drift_threshold: float = 0.03) -> DataFrame:
    """One row: size, time range and target rate of each part, the drift
    (test rate - train rate) and whether it exceeds the threshold."""
    tr, te = F.col(label_col) == 1, F.col(label_col) == 0
    out = labelled.agg(
        F.count(F.when(tr, 1)).alias("train_rows"), F.count(F.when(te, 1)).alias("test_rows"),
        F.min(F.when(tr, F.col(ts_col))).alias("train_start"),
        F.max(F.when(tr, F.col(ts_col))).alias("train_end"),
        F.min(F.when(te, F.col(ts_col))).alias("test_start"),
        F.max(F.when(te, F.col(ts_col))).alias("test_end"),
        F.avg(F.when(tr, F.col(target))).alias("train_rate"),
        F.avg(F.when(te, F.col(target))).alias("test_rate"))
    drift = F.col("test_rate") - F.col("train_rate")
    return out.select("*", drift.alias("drift"),
                      (F.abs(drift) > drift_threshold).cast("int").alias("drift_flag"))
