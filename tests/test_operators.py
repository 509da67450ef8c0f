"""Distributed operators against brute force / NumPy on small fixtures."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from routewise.operators.evaluate import auc, grouped_auc, roc_curve
from routewise.operators.pairwise import knn, knn_tiled, silhouette_samples
from routewise.operators.quantiles import exact_medians, grouped_quantile
from routewise.operators.rank import average_ranks, prefix_sums
from routewise.operators.smote import smote, stratified_folds
from routewise.operators.split import chronological_split
from routewise.operators.stats import mann_whitney, rank_sum_u, t_two_sided_p, normal_sf


def _rand_rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice([1, 2, 3, 4, 5]), rnd.random() < 0.3, round(rnd.gauss(0, 1), 2))
            for i in range(n)]


def test_prefix_sums_match_python(spark):
    vals = sorted(set(round(random.Random(3).uniform(-5, 5), 3) for _ in range(400)))
    df = spark.createDataFrame([(v, 1) for v in vals], "v double, w long")
    got = {r.v: r.cum_w for r in prefix_sums(df, "v", ["w"], n_buckets=7).collect()}
    assert all(got[v] == i + 1 for i, v in enumerate(vals))


def test_average_ranks_with_ties(spark):
    xs = [3, 1, 3, 2, 3, 1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x long")
    got = {r.i: r.x_rank for r in average_ranks(df, "x", n_buckets=3).collect()}
    assert [got[i] for i in range(6)] == [5.0, 1.5, 5.0, 3.0, 5.0, 1.5]


def test_mann_whitney_brute_force_and_identity(spark):
    rows = _rand_rows(300)
    df = spark.createDataFrame(rows, "i long, score long, g boolean, x double").withColumn(
        "grp", F.col("g").cast("int"))
    a = [s for _, s, g, _ in rows if g]
    b = [s for _, s, g, _ in rows if not g]
    u_brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = rank_sum_u(df, "score", "grp", 1, 0, n_buckets=3).first()
    assert r.u1 == u_brute and r.u1 + r.u2 == len(a) * len(b)
    mw = mann_whitney(df, "score", "grp").first()
    assert abs(mw.r_rb - (1 - 2 * u_brute / (len(a) * len(b)))) < 1e-12
    assert 0 <= normal_sf(mw.z) <= 1


def test_t_tail_known_values():
    # two-sided p of t = 2.228 with 10 dof is 0.05 (table value)
    assert abs(t_two_sided_p(2.228138852, 10) - 0.05) < 1e-6
    assert abs(normal_sf(1.959963985) - 0.025) < 1e-9


def test_auc_properties_and_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.6), float(rnd.randint(0, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, label int, score double")
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(auc(df).first().auc - brute) < 1e-12
    rev = auc(df.withColumn("score", -F.col("score"))).first().auc
    assert abs(rev - (1 - brute)) < 1e-12
    g = grouped_auc(df.withColumn("grp", F.lit("a")), "grp", n_buckets=4).first().auc
    assert abs(g - brute) < 1e-12
    curve = roc_curve(df).orderBy("fpr", "tpr").collect()
    assert curve[0].fpr == 0.0 and curve[-1].fpr == 1.0 and curve[-1].tpr == 1.0


def test_exact_medians_match_numpy(spark):
    rnd = np.random.default_rng(7)
    a = rnd.normal(size=501)
    b = rnd.integers(0, 5, size=501).astype(float)
    rows = [(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    med = exact_medians(df, ["a", "b"], n_buckets=5)
    assert abs(med["a"] - np.median(a)) < 1e-12
    assert med["b"] == np.median([y for x, y in rows if y is not None])


def test_grouped_quantile_hot_group(spark):
    # one group holds most rows: it is spread over the value buckets
    rows = [("hot", float(i)) for i in range(1000)] + [("cold", 1.0), ("cold", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in grouped_quantile(df, "g", "v", 0.7, "q", n_buckets=8).collect()}
    assert abs(got["hot"] - np.quantile(np.arange(1000.0), 0.7)) < 1e-9
    assert abs(got["cold"] - np.quantile([1.0, 4.0], 0.7)) < 1e-12


def test_chronological_split_equals_global_sort(spark):
    rnd = random.Random(11)
    import datetime as dt
    base = dt.datetime(2020, 1, 1)
    rows = [(i % 50, rnd.randint(1, 5), base + dt.timedelta(seconds=rnd.randint(0, 4 * 86400)))
            for i in range(997)]
    rows += [(7, 3, rows[100][2])] * 3  # exact duplicates around a shared timestamp
    df = spark.createDataFrame(rows, "order_id long, review_score long, ts timestamp_ntz")
    lab = chronological_split(df, ts_col="ts", train_frac=0.8)
    assert lab.filter("is_train = 1").count() == int(len(rows) * 0.8)
    w = Window.orderBy("ts", "order_id", "review_score")
    expect = df.withColumn("rn", F.row_number().over(w))
    cut = expect.filter(F.col("rn") <= int(len(rows) * 0.8)).agg(F.max("ts")).first()[0]
    assert lab.filter("is_train = 1").agg(F.max("ts")).first()[0] == cut
    assert lab.filter("is_train = 0").agg(F.min("ts")).first()[0] >= cut


def test_knn_multi_tile_matches_brute_force(spark):
    rnd = np.random.default_rng(3)
    pts = rnd.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = knn_tiled(df, df, "id", "v", k=3, tile_rows=16).collect()  # 4 x 4 tiles
    assert sorted(got) == sorted(knn(df, df, "id", "v", k=3, tile_rows=16).collect())  # pruned path
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in got:
        order = sorted(range(60), key=lambda j: (d[r.query_id, j], j))
        assert order[r.neighbor_rank - 1] == r.neighbor_id
    assert len(got) == 60 * 3


def test_silhouette_multi_tile_matches_numpy(spark):
    rnd = np.random.default_rng(4)
    pts = np.vstack([rnd.normal(0, 1, (20, 3)), rnd.normal(4, 1, (25, 3)), [[10, 10, 10]]])
    lab = [0] * 20 + [1] * 25 + [2]
    df = spark.createDataFrame([(i, [float(x) for x in p], lab[i]) for i, p in enumerate(pts)],
                               "id long, v array<double>, c int")
    got = {r.id: r.silhouette for r in silhouette_samples(df, "id", "v", "c", tile_rows=10).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    lab = np.array(lab)
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            assert got[i] == 0.0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_smote_balances_and_interpolates(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, float(rnd.normal()), float(rnd.normal()), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, y int")
    out = smote(df, "rid", ["a", "b"], "y", k=3, seed=1).collect()
    ys = [r.y for r in out]
    assert ys.count(0) == ys.count(1) == 60
    mins = np.array([[a, b] for _, a, b, y in rows if y == 1])
    for r in out:
        if r.synthetic:
            x = np.array([r.a, r.b])
            # lies on a segment between two minority points
            def cross(u, v):
                return u[0] * v[1] - u[1] * v[0]
            ok = any(abs(cross(mins[j] - mins[i], x - mins[i])) < 1e-9
                     and np.dot(x - mins[i], mins[j] - mins[i]) >= -1e-12
                     for i in range(len(mins)) for j in range(len(mins)) if i != j)
            assert ok


def test_stratified_folds_balanced(spark):
    rows = [(i, int(i % 3 == 0), (i * 7919) % 1009) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, y int, key long")
    out = stratified_folds(df, "y", "key", ["i"], 5)
    sizes = out.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in sizes if r.y == y]
        assert len(c) == 5 and max(c) - min(c) <= 1


def test_exact_medians_wide_path_matches_numpy(spark):
    rnd = np.random.default_rng(8)
    a = rnd.normal(size=300)
    df = spark.createDataFrame([(float(x),) for x in a], "a double")
    med = exact_medians(df, ["a"], n_buckets=4)
    assert abs(med["a"] - np.median(a)) < 1e-12


def test_knn_pruned_matches_brute_force(spark):
    from routewise.operators.pairwise import knn_pruned
    rnd = np.random.default_rng(12)
    # clustered points plus one dense blob (a hot cell) and exact duplicates
    pts = np.vstack([rnd.normal(0, 1, (80, 3)), rnd.normal(6, 0.2, (120, 3)), rnd.normal(0, 1, (1, 3)).repeat(3, 0)])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = knn_pruned(df, df, "id", "v", k=4, n_pivots=9, tile_rows=16).collect()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(pts) * 4
    for r in got:
        order = sorted(range(len(pts)), key=lambda j: (d[r.query_id, j], j))
        assert order[r.neighbor_rank - 1] == r.neighbor_id


def test_split_with_hot_boundary_second(spark):
    import datetime as dt
    t0 = dt.datetime(2021, 3, 1, 9, 30, 0)
    rows = [(i, 1 + i % 5, t0 - dt.timedelta(seconds=1 + i)) for i in range(100)]
    rows += [(1000 + i, 1 + i % 5, t0) for i in range(300)]  # 300 rows share one second
    rows += [(5000 + i, 3, t0 + dt.timedelta(hours=1 + i)) for i in range(100)]
    df = spark.createDataFrame(rows, "order_id long, review_score long, ts timestamp_ntz")
    lab = chronological_split(df, ts_col="ts", train_frac=0.5)  # cut falls inside the hot second
    got = {(r.order_id, r.review_score) for r in lab.filter("is_train = 1").collect()}
    expect = sorted(rows, key=lambda r: (r[2], r[0], r[1]))[:250]
    assert got == {(o, s) for o, s, _ in expect}


def test_geo_lookup_hot_zip_matches_pandas(spark):
    import pandas as pd
    from routewise.operators.orders import geo_lookup
    rnd = np.random.default_rng(21)
    rows = [(7, float(rnd.normal(-23, 1)), float(rnd.normal(-46, 1))) for _ in range(2000)]  # hot zip
    rows += [(z, float(rnd.normal(-10, 1)), float(rnd.normal(-40, 1))) for z in range(1, 6) for _ in range(3)]
    rows += [(9, None, None)]
    df = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double")
    got = {r[0]: (r.lat, r.lng) for r in geo_lookup(df).collect()}
    ref = pd.DataFrame(rows, columns=["z", "lat", "lng"]).groupby("z").median()
    assert set(got) == set(ref.index)
    for z, (lat, lng) in got.items():
        if z == 9:
            assert lat is None and lng is None
        else:
            assert abs(lat - ref.loc[z, "lat"]) < 1e-12 and abs(lng - ref.loc[z, "lng"]) < 1e-12


def test_exact_positions_string_keys_hot_prefix(spark):
    from routewise.operators.split import exact_positions
    rnd = random.Random(2)
    rows = [("same-day", f"o{rnd.randint(0, 10**6):07d}", rnd.randint(1, 5)) for _ in range(700)]
    rows += [(f"d{rnd.randint(0, 9)}", f"o{rnd.randint(0, 10**6):07d}", rnd.randint(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "day string, order_id string, score int")
    got = exact_positions(df, ["day", "order_id", "score"], n_parts=6).collect()
    assert sorted(r._pos for r in got) == list(range(len(rows)))
    expect = sorted(rows)
    for r in got:
        assert expect[r._pos] == (r.day, r.order_id, r.score)


def test_knn_pruned_hot_cell_both_sides(spark):
    from routewise.operators.pairwise import knn_pruned
    rnd = np.random.default_rng(13)
    pts = np.vstack([rnd.normal(0, 0.05, (150, 2)), rnd.normal(5, 1, (30, 2))])  # one very dense blob
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = knn_pruned(df, df, "id", "v", k=3, n_pivots=4, tile_rows=20).collect()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(pts) * 3
    for r in got:
        order = sorted(range(len(pts)), key=lambda j: (d[r.query_id, j], j))
        assert order[r.neighbor_rank - 1] == r.neighbor_id


def test_u_exact_distribution_small_samples():
    import itertools
    from routewise.operators.stats import u_exact_sf
    # brute force over all arrangements of 3 + 4 distinct values
    a_size, b_size = 3, 4
    counts = {}
    for first in itertools.combinations(range(a_size + b_size), a_size):
        u = sum(1 for x in first for y in range(a_size + b_size) if y not in first and x > y)
        counts[u] = counts.get(u, 0) + 1
    total = sum(counts.values())
    for u in range(0, a_size * b_size + 2):
        expect = sum(c for k, c in counts.items() if k >= u) / total
        assert abs(u_exact_sf(u, a_size, b_size) - expect) < 1e-12
        assert abs(u_exact_sf(u, b_size, a_size) - expect) < 1e-12


def test_spearman_matches_numpy_and_propagates_missing(spark):
    from routewise.operators.stats import spearman
    xs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    ys = [2.0, 7.0, 1.0, 8.0, 2.0, 8.0, 1.0, 8.0]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")

    def avg_rank(v):
        order = sorted(v)
        return [order.index(a) + 1 + (order.count(a) - 1) / 2 for a in v]
    expect = float(np.corrcoef(avg_rank(xs), avg_rank(ys))[0, 1])
    assert abs(spearman(df, "x", "y").first().rho - expect) < 1e-12
    with_gap = df.union(spark.createDataFrame([(None, 1.0)], "x double, y double"))
    assert spearman(with_gap, "x", "y").first().rho is None
    assert abs(spearman(with_gap, "x", "y", propagate_missing=False).first().rho - expect) < 1e-12


def test_quantiles_by_group_match_numpy(spark):
    """Small groups, groups beyond the accuracy (ranked near the quantile only),
    hot values, nulls and groups without values."""
    import numpy as np
    from routewise.operators.quantiles import quantiles_by_group

    r = np.random.default_rng(3)
    rows = [(g, float(v), None if k % 7 == 0 else float(round(v, 1))) for g, n in ((0, 1), (1, 2), (2, 90), (3, 2500))
            for k, v in enumerate(r.exponential(5, n))]
    rows += [(4, 3.0, 1.0)] * 900 + [(4, float(k), None) for k in range(300)] + [(5, None, None)] * 3
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {m.g: (m.a, m.b) for m in quantiles_by_group(df, ["g"], ["a", "b"], q, accuracy=50).collect()}
        for g in range(6):
            for i in (1, 2):
                v = [x[i] for x in rows if x[0] == g and x[i] is not None]
                want = float(np.quantile(v, q)) if v else None
                assert got[g][i - 1] == want or abs(got[g][i - 1] - want) < 1e-9, (g, i, q)
        whole = quantiles_by_group(df, [], ["a", "b"], q, accuracy=50).first()
        assert abs(whole.a - np.quantile([x[1] for x in rows if x[1] is not None], q)) < 1e-9


def test_geo_lookup_exchanges(spark):
    from routewise.operators.orders import geo_lookup
    df = spark.range(500).selectExpr("id % 9 AS geolocation_zip_code_prefix", "id * 0.5D AS geolocation_lat",
                                     "CAST(NULL AS DOUBLE) AS geolocation_lng")
    out = geo_lookup(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 3  # and one for the bounds, before
    assert all(r.lat is not None and r.lng is None for r in out.collect())


def test_sketch_quantiles_hold_their_rank_error(spark):
    from pyspark.sql import functions as F
    from routewise.operators.quantiles import medians_row, merged_sketches, sketch_quantiles, sketch_size, sketches

    assert sketch_size(0.0133) in range(195, 206) and sketch_size(0.001) > 2000
    n = 10_000_000  # the value of row k is a permutation of 0 .. n - 1
    df = spark.range(n).select(((F.col("id") * 7919 + 13) % n).cast("double").alias("v"), (F.col("id") % 4).alias("g"),
                               F.lit(None).cast("double").alias("none"))
    stored = sketches(df, ["g"], ["v", "none"], rank_error=0.005)
    whole = merged_sketches(stored, [], ["v", "none"])
    for q in (0.1, 0.5, 0.99):
        row = sketch_quantiles(whole, [], ["v", "none"], q).first()
        assert abs(row.v / n - q) <= 0.005 and row.none is None
    assert sketch_quantiles(stored, ["g"], ["v"]).count() == 4
    row = medians_row(df.where("v < 1001"), ["v", "none"], rank_error=0.01).first()
    assert abs(row.v - 500) <= 10 and row.none is None
