"""K-Means with restarts and silhouette-based choice of k (MLlib)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewise.operators.pairwise import silhouette_scores


def kmeans_restarts(df: DataFrame, features_col: str, k: int, n_init: int = 10, seed: int = 42,
                    max_iter: int = 300, tol: float = 1e-4, parallelism: int = 4):
    """Best of ``n_init`` k-means|| fits (lowest within-cluster sum of
    squares); MLlib has no n_init, so restarts are separate fits, submitted
    concurrently (independent jobs share the cluster)."""
    def fit(i):
        model = KMeans(k=k, seed=seed + i, featuresCol=features_col, maxIter=max_iter,
                       tol=tol, initMode="k-means||").fit(df)
        return model, model.summary.trainingCost, i

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_init))) as pool:
        fits = list(pool.map(fit, range(n_init)))
    model, cost, _ = min(fits, key=lambda m: (m[1], m[2]))  # ties -> first restart
    return model, cost


def fixed_point(df: DataFrame, id_col: str, features_col: str, model, tolerance: float = 1e-9) -> DataFrame:
    """One row that certifies a fit (data with mean zero): ``n``, ``misplaced``
    (rows that are nearer to another cluster's mean than to their own's),
    ``total_ss`` (squares within clusters plus those of the cluster means, which
    is the data's own sum only if the centres are means) and ``cost_is_sum``
    (the model's cost is the sum within)."""
    x = df.select(id_col, vector_to_array(F.col(features_col)).alias("_v"))
    own = model.transform(df).select(id_col, F.col("prediction").alias("_c"))
    rows = x.join(own, id_col)
    width = len(model.clusterCenters()[0])
    means = rows.groupBy("_c").agg(F.count("*").alias("_n"), F.array(*[
        F.avg(F.col("_v")[i]) for i in range(width)]).alias("_m"))  # k rows

    def squares(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    zero = F.array(*[F.lit(0.0)] * width)
    pairs = rows.crossJoin(F.broadcast(means.withColumnRenamed("_c", "_k"))) \
        .withColumn("_d", squares(F.col("_v"), F.col("_m")))
    per = pairs.groupBy(id_col).agg(
        F.max(F.when(F.col("_c") == F.col("_k"), F.col("_d"))).alias("_own"), F.min("_d").alias("_near"))
    within = per.agg(F.count("*").alias("n"), F.sum("_own").alias("_within"),
                     F.count(F.when(F.col("_own") > F.col("_near") + tolerance, 1)).alias("misplaced"))
    between = means.agg(F.sum(F.col("_n") * squares(F.col("_m"), zero)).alias("_between"))
    cost = float(model.summary.trainingCost)
    return within.crossJoin(between).select(
        "n", "misplaced", (F.col("_within") + F.col("_between")).alias("total_ss"),
        (F.abs(F.col("_within") - cost) <= 1e-6 * F.greatest(F.lit(1.0), F.col("_within"))).alias("cost_is_sum"))


def choose_k(df: DataFrame, id_col: str, features_col: str, k_values=range(2, 7),
             n_init: int = 10, seed: int = 42, min_k: int = 3, parallelism: int = 4):
    """Silhouette (exact Euclidean) of the best fit for each k; the chosen k
    is max(min_k, first k with the highest silhouette). The labels of all k are
    scored in one pass over the distances."""
    ks = list(k_values)

    def fit(k):
        return kmeans_restarts(df, features_col, k, n_init, seed, parallelism=parallelism)[0]

    with ThreadPoolExecutor(max_workers=max(1, min(2, len(ks)))) as pool:
        models = list(pool.map(fit, ks))
    labelled = df
    for k, model in zip(ks, models):
        labelled = model.setPredictionCol(f"_k{k}").transform(labelled)
    labelled = labelled.select(id_col, vector_to_array(F.col(features_col)).alias("_v"), *[f"_k{k}" for k in ks])
    found = {r.which: r.silhouette for r in
             silhouette_scores(labelled, id_col, "_v", [f"_k{k}" for k in ks]).collect()}  # one row a k
    scores = [(k, found.get(i)) for i, k in enumerate(ks)]
    best_k = max(scores, key=lambda kv: (kv[1] if kv[1] is not None else float("-inf"), -kv[0]))[0]
    return max(min_k, best_k), scores


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def renumber_by(df: DataFrame, cluster_col: str, order_cols: list) -> DataFrame:
    """Replace arbitrary cluster ids by their rank under ``order_cols``
    computed on per-cluster means (k rows)."""
    means = df.groupBy(cluster_col).agg(*[F.avg(c).alias(f"_m_{c}") for c, _ in order_cols])
    order = [F.desc(f"_m_{c}") if desc else F.asc(f"_m_{c}") for c, desc in order_cols]
    order.append(F.asc(cluster_col))
    ranks = means.select(cluster_col, (F.row_number().over(Window.orderBy(*order)) - 1)
                         .alias("_new"))  # window over the k cluster rows
    return (df.join(F.broadcast(ranks), cluster_col)
            .drop(cluster_col).withColumnRenamed("_new", cluster_col))
