"""Satisfaction prediction (RQ2): features, train-only imputation and
scaling, oversampling, models, evaluation and importance.

Discipline: every statistic (seller stats, medians, scaler moments,
oversampling) is fitted on the training part and only applied to test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewise.operators.quantiles import medians_row
from routewise.plans.prepare import CATEGORY_PREFIX
from routewise.plans.sellers import fill_with

# The model's feature columns.
FEATURE_COLUMNS = [
    "distance_km", "actual_delivery_days", "delivery_delay_days", "carrier_handling_days",
    "total_order_value", "freight_ratio", "num_items", "payment_installments",
    "pay_credit_card", "pay_boleto", "pay_debit_card", "product_weight_g", "same_state",
    "purchase_month", "purchase_dow", "purchase_hour", "seller_order_count",
    "seller_avg_review", "seller_late_rate", "seller_avg_distance",
]
LABEL = "satisfied"


def feature_columns(df: DataFrame) -> list[str]:
    """The 20 named features plus the ``cat_`` dummies present in ``df``."""
    return FEATURE_COLUMNS + [c for c in df.columns if c.startswith(CATEGORY_PREFIX)]


def as_features(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Numeric feature columns as doubles (+ label and kept columns)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols],
                     F.col(LABEL).cast("int").alias(LABEL))


def impute_medians(train: DataFrame, test: DataFrame, cols: list[str], rank_error: float | None = None):
    """Fill NULL features with the *training* medians, in both parts: exact ones,
    or approximate ones where a ``rank_error`` is given."""
    meds = medians_row(train, cols, rank_error=rank_error)
    return fill_with(train, meds, cols), fill_with(test, meds, cols), meds


def scaler_stats(train: DataFrame, cols: list[str]):
    """Mean and population standard deviation of each column (one row)."""
    return train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()


def standardize(df: DataFrame, cols: list[str], stats) -> DataFrame:
    """(x - mean) / std with population std; a constant column maps to 0."""
    out = []
    for c in cols:
        m, s = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0
        scale = s if s > 0 else 1.0
        out.append(((F.col(c) - F.lit(m)) / F.lit(scale)).alias(c))
    return df.select(*[c for c in df.columns if c not in cols], *out)


def given_scores(test: DataFrame) -> DataFrame:
    """A fixed, deterministic scorer for checking the evaluation operators
    against an oracle: score = -(delivery delay), predict satisfied when the
    order was not late."""
    score = F.lit(0.0) - F.coalesce(F.col("delivery_delay_days"), F.lit(0.0))
    return test.select("order_id", "review_score", F.col(LABEL).alias("label"),
                       score.alias("score"), (score >= 0).cast("int").alias("prediction"))


# --------------------------------------------------------------------------
# Models
# --------------------------------------------------------------------------

import random  # noqa: E402

from pyspark.ml.classification import LogisticRegression  # noqa: E402
from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from routewise.operators import boosting  # noqa: E402
from routewise.operators.evaluate import grouped_auc  # noqa: E402
from routewise.operators.smote import dense_positions, smote_inside_folds, stratified_folds  # noqa: E402
from routewise.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402

# The boosted-tree search space (972 combinations).
REFERENCE_GRID = {
    "n_estimators": [100, 150, 200],
    "max_depth": [4, 5, 6, 7],
    "learning_rate": [0.05, 0.1, 0.15],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8, 0.9],
    "min_child_weight": [1, 3, 5],
}
# A small space with the same knobs for tests.
QUICK_GRID = {
    "n_estimators": [10, 15], "max_depth": [3, 4], "learning_rate": [0.1, 0.15],
    "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9], "min_child_weight": [1, 3],
}


def vectorize(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    """Rows per class (a 2-row aggregate)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def balanced_weights(counts: dict) -> dict:
    """n / (n_classes n_c) per class."""
    n = sum(counts.values())
    return {c: n / (len(counts) * m) for c, m in counts.items()}


def fit_logistic(train: DataFrame, cols: list[str], C: float = 1.0, max_iter: int = 1000,
                 label: str = LABEL):
    """L2 logistic regression with class-balanced weights on standardised
    features. sklearn's objective C * sum(w l) + |b|^2 / 2 equals MLlib's
    mean(w l) + regParam |b|^2 / 2 with regParam = 1 / (C * sum(w))."""
    stats = scaler_stats(train, cols)
    counts = class_counts(train, label)
    weights = balanced_weights(counts)
    wcol = F.lit(0.0)
    for c, w in weights.items():
        wcol = F.when(F.col(label) == c, F.lit(w)).otherwise(wcol)
    data = vectorize(standardize(train, cols, stats), cols).withColumn("_w", wcol)
    sum_w = sum(weights[c] * m for c, m in counts.items())
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w",
                            regParam=1.0 / (C * sum_w), elasticNetParam=0.0, maxIter=max_iter,
                            standardization=False, fitIntercept=True, tol=1e-10)
    return lr.fit(data), stats


def logistic_moments(model, stats, train: DataFrame, cols: list[str], C: float = 1.0,
                     label: str = LABEL) -> DataFrame:
    """(feature, observed, fitted): the certificate of a fit. The objective is
    convex, so the coefficients are its optimum just when, for the constant and
    for each scaled feature, the weighted mean of label * feature is that of
    probability * feature plus the penalty's share. One aggregate over the rows."""
    counts = class_counts(train, label)
    weights = balanced_weights(counts)
    total = sum(weights[c] * m for c, m in counts.items())
    w = F.lit(0.0)
    for c, v in weights.items():
        w = F.when(F.col(label) == c, F.lit(v)).otherwise(w)
    x = standardize(train, cols, stats)
    margin = F.lit(float(model.intercept))
    for c, b in zip(cols, model.coefficients):
        margin = margin + F.col(c) * F.lit(float(b))
    x = x.withColumn("_w", w).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
    names, values = ["(intercept)", *cols], [F.lit(1.0), *[F.col(c) for c in cols]]
    penalty = [0.0, *[float(b) / (C * total) for b in model.coefficients]]
    return x.agg(*[F.struct((F.sum(F.col("_w") * F.col(label) * v) / total).alias("observed"),
                            (F.sum(F.col("_w") * F.col("_p") * v) / total + F.lit(p)).alias("fitted")).alias(f"_{i}")
                   for i, (v, p) in enumerate(zip(values, penalty))]) \
        .select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{i}.observed"), F.col(f"_{i}.fitted"))
                                    for i, n in enumerate(names)])).alias("m")).select("m.*")


class LinearScorer:
    """A fixed score, the weighted sum of features, in the place of a fitted model."""

    def __init__(self, weights: dict[str, float]):
        self.cols, self.weights = list(weights), list(weights.values())

    def score(self, *features):
        total = F.lit(0.0)
        for x, w in zip(features, self.weights):
            total = total + x * F.lit(w)
        return total


def scored(model, df: DataFrame, cols: list[str], stats=None, keep=(), label: str = LABEL) -> DataFrame:
    """(keep..., label, score = P(class 1)) of a model with ``cols`` and ``score``
    (boosted trees, a fixed scorer) or of a fitted MLlib classifier."""
    x = standardize(df, cols, stats) if stats is not None else df
    if hasattr(model, "score"):
        out, score = x, model.score(*[F.col(c) for c in model.cols])
    else:
        out, score = model.transform(vectorize(x, cols)), vector_to_array("probability")[1]
    return out.select(*keep, F.col(label).alias("label"), score.alias("score"))


def predict(model, df: DataFrame, cols: list[str], stats=None, keep=("order_id", "review_score"),
            label: str = LABEL) -> DataFrame:
    """(keep..., label, prediction, score = P(class 1))."""
    out = scored(model, df, cols, stats, keep, label)
    return out.select(*keep, "label", (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


def sample_grid(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct points of the full grid (without replacement)."""
    keys = sorted(grid)
    sizes = [len(grid[k]) for k in keys]
    total = 1
    for s in sizes:
        total *= s
    picks = random.Random(seed).sample(range(total), min(n_iter, total))
    out = []
    for p in picks:
        point = {}
        for k, s in zip(keys, sizes):
            point[k] = grid[k][p % s]
            p //= s
        out.append(point)
    return out


def tune_boosted(train: DataFrame, cols: list[str], grid: dict = REFERENCE_GRID, n_iter: int = 20,
                 n_folds: int = 5, seed: int = 42, label: str = LABEL, folder: str | None = None,
                 oversample_inside: bool = False):
    """(search, model): randomised search over ``grid`` scored by F1 of class 1 on
    stratified folds, and the best point's model on all rows.

    The search is saved below ``folder`` (by default in the shared checkpoint
    folder, under the name of its data and settings), so the same search is never
    run twice and a killed one goes on. Rows are known by their content, so the
    order in which they come does not matter. ``train`` is the oversampled set, as
    in the original; with ``oversample_inside`` it is the real rows, and each fold
    left out has synthetic rows of the others only, so none looks at it."""
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("int").alias(label))
    rows = cut_lineage(rows.withColumn("_key", F.xxhash64(*cols, label, F.lit(seed))))
    points = sample_grid(grid, n_iter, seed)
    folder = folder or (f"{ensure_checkpoint_dir(train.sparkSession)}/search-"
                        f"{boosting.data_key(rows, points, n_folds, seed, oversample_inside)}")
    folded = cut_lineage(stratified_folds(rows, label, "_key", cols, n_folds))
    if oversample_inside:
        numbered = cut_lineage(folded.withColumn("_id", F.monotonically_increasing_id()))
        more = smote_inside_folds(numbered, "_id", cols, label, "fold", n_folds, seed=seed)
        folded = cut_lineage(more.select(
            *cols, label, F.xxhash64(*cols, label, F.lit(seed)).alias("_key"),
            F.coalesce("fold", F.col("for_fold") + boosting.ONLY_FOR).cast("int").alias("fold")))
    found = boosting.search(folded, cols, folder, points, "_key", label, "fold", n_folds, seed)
    return found, boosting.BoostedTrees(found.nodes, cols)


def permutation_importance(model, test: DataFrame, cols: list[str], id_col: str,
                           n_repeats: int = 10, seed: int = 42, stats=None,
                           label: str = LABEL, permutation=None) -> DataFrame:
    """Mean AUC drop when one feature is shuffled, per feature.

    Each repeat is one random permutation of all test rows, shared by the
    features: a row meets its donor once, and the feature at hand takes the
    donor's value. ``id_col`` must be unique. ``permutation`` gives the donors
    in the form of ``donors``, which is the default.
    """
    base = predict(model, test, cols, stats, keep=(id_col,), label=label)
    base_auc = grouped_auc(base.withColumn("_g", F.lit("base")), "_g").first()["auc"]
    pairs = (permutation or donors)(test, id_col, n_repeats, seed)
    met = _met_donors(test, cols, id_col, pairs, label)
    group = (F.col("_r") * len(cols) + F.col("_f")).cast("int").alias("_g")
    if hasattr(model, "permuted") and model.cols == list(cols) and stats is None:
        # heavy rows of few bytes, which adaptive execution would put into few tasks
        spread = met.repartition(3 * test.sparkSession.sparkContext.defaultParallelism)
        copies = model.permuted(spread, "_x", "_y", ["_r", "label"]).select(group, "label", "score")
    else:
        copies = scored(model, _permuted_copies(met, cols, group), cols, stats, ("_g",), "label")
    aucs = grouped_auc(copies, "_g").select((F.col("_g") % len(cols)).alias("_f"), "auc")
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_f") + 1)
    return (aucs.select(names.alias("feature"), (F.lit(base_auc) - F.col("auc")).alias("drop"))
            .groupBy("feature").agg(F.avg("drop").alias("permutation_importance"),
                                    F.stddev_pop("drop").alias("permutation_std")))


def donors(rows: DataFrame, id_col: str, n_repeats: int, seed: int) -> DataFrame:
    """(_id, _r, _donor): a random permutation of all ids for each repeat, the
    ids in the order of one hash against the ids in the order of another."""
    pairs = rows.select(F.col(id_col).alias("_id"),
                        F.explode(F.array(*[F.lit(r) for r in range(n_repeats)])).alias("_r"))

    def ordered(salt: int) -> DataFrame:
        key = F.xxhash64("_id", "_r", F.lit(seed), F.lit(salt))
        return dense_positions(pairs.withColumn("_h", key), "_r", "_h", ["_id"])

    takers = ordered(2).select("_id", "_r", "position")
    givers = ordered(3).select(F.col("_id").alias("_donor"), "_r", "position")
    return takers.join(givers, ["_r", "position"]).select("_id", "_r", "_donor")


def shifted_donors(rows: DataFrame, id_col: str, n_repeats: int, seed: int) -> DataFrame:
    """Donors by arithmetic, for ids 0 to n - 1: each repeat turns the rows by
    another number of places. Any SQL engine finds the same."""
    n = rows.count()
    r = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_repeats - 1).cast("long")))
    turn = 1 + (F.col("_r") * 7919 + seed) % max(1, n - 1)
    return rows.select(F.col(id_col).alias("_id"), r.alias("_r")).select(
        "_id", "_r", ((F.col("_id") + turn) % max(1, n)).alias("_donor"))


def _met_donors(test: DataFrame, cols: list[str], id_col: str, pairs: DataFrame, label: str) -> DataFrame:
    """(_r, label, _x, _y): every row beside its donor of each repeat, features as
    arrays. Only repeats x rows are exchanged."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = test.select(F.col(id_col).alias("_id"), F.col(label).alias("label"), x.alias("_x"))
    given = test.select(F.col(id_col).alias("_donor"), x.alias("_y"))
    return pairs.join(rows, "_id").join(given, "_donor").select("_r", "label", "_x", "_y")


def _permuted_copies(met: DataFrame, cols: list[str], group: Column) -> DataFrame:
    """(_g, label, features): every shuffled copy, made in place."""
    copies = met.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(cols))])))
    return copies.select(group, "label", *[
        F.when(F.col("_f") == i, F.col("_y")[i]).otherwise(F.col("_x")[i]).alias(c)
        for i, c in enumerate(cols)])
