"""Features, regularity, distances, clusters and smoothing on hand-checked values."""

import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel import functions as fn
from tidewheel import sources
from tidewheel.operators import cluster, cohort, distance, evolve, features, ordering, regularity, tracking
from tidewheel.plans import catalogue, study


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_column_functions(spark):
    assert value(spark, fn.js_similarity(arr(0.5, 0.5, 0), arr(0.5, 0, 0.5))) == pytest.approx(0.2928932188134524)
    assert value(spark, fn.chi2_divergence(arr(0.5, 0.5, 0), arr(0.5, 0, 0.5))) == pytest.approx(1 / 3)
    assert value(spark, fn.js_similarity(arr(0, 0), arr(1, 0))) is None
    assert value(spark, fn.set_overlap(arr(1, 2, 0), arr(1, 0, 0))) == 0.5 and value(spark, fn.set_overlap(arr(0, 0), arr(1, 0))) == 0
    ints = lambda *xs: F.array(*map(F.lit, xs))
    assert value(spark, fn.fourier_magnitude(ints(0, 24, 24), 1 / 24)) == pytest.approx(2.0)
    assert value(spark, fn.fourier_magnitude(ints(0, 7), 7 / 24)) == pytest.approx(1.9659258262890686)
    assert value(spark, fn.fourier_magnitude(ints(0, 7), 1 / 7)) == pytest.approx(2.0)
    assert value(spark, fn.array_median(arr(4, 1, 3))) == 3 and value(spark, fn.array_median(arr(4, 1))) == 2.5
    assert value(spark, fn.array_median(F.array().cast("array<double>"))) is None
    assert value(spark, fn.array_avg(F.array(F.lit(1.0), F.lit(None), F.lit(2.0)))) == 1.5
    assert value(spark, fn.entropy(arr(0.5, 0.5, 0))) == pytest.approx(math.log(2))


def test_peaks(spark):
    table = spark.createDataFrame([(1, 0.5, 3), (1, 0.5, 3)], "student int, relative double, absolute long")
    for slots, want in ((7, 6.342623224492977), (24, 11.675445960483632), (14, 9.342623224492977)):
        assert regularity.peak(table, [], slots, "p").first().p == pytest.approx(want)


def test_week_similarity(spark):
    weeks = [(1, 1, [1.0, 1.0], [1, 1], [0, 1]), (1, 2, [2.0, 2.0], [1, 1], [0, 2]), (2, 1, [1.0], [1], [0])]
    df = spark.createDataFrame(weeks, "student int, woy int, hours_dow array<double>, hours_bool array<int>, dow array<int>")
    got = {r.student: r for r in regularity.week_similarity(df, [], 3).collect()}
    assert got[1].ws1 == 0.5 and got[1].ws2 == pytest.approx(0.2928932188134524) and got[1].ws3 == pytest.approx(1 / 3)
    assert (got[2].ws1, got[2].ws2, got[2].ws3) == (None, None, None)


def test_dense_series(spark):
    df = spark.createDataFrame([([2.0, 4.0, 9.0], [1, 3, 7])], "v array<double>, t array<int>")
    r = df.select(features.dense(F.col("v"), F.col("t"), 6).alias("d"), features.out_of_range(F.col("t"), 6).alias("n")).first()
    assert r.d == [0, 2, 0, 4, 0, 0] and r.n == 1


def test_series_skip_nulls_and_need_reflection(spark):
    counts = spark.createDataFrame(
        [(1, 1314, 1, 2, 1, None), (1, 1314, 1, 0, 0, 5.0), (2, 1314, 1, 0, None, 1.0), (3, 1314, 1, 1, 2, None)],
        "student int, calendar_year int, school_year int, woy int, count_reflection long, total_duration double",
    )
    got = {r.student: r for r in features.series(counts, names=("count_reflection", "total_duration")).collect()}
    assert set(got) == {1, 3}
    assert got[1].count_reflection == [0, 1] and got[1].count_reflection_woy == [0, 2] and got[1].total_duration_norm == [5]
    assert got[3].total_duration is None and got[3].total_duration_woy is None


def brute_dtw(a, b, radius):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(n):
            if abs(i - j) <= radius:
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return math.sqrt(d[n, n])


def test_dtw_equals_the_table(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 9)), rng.normal(size=(20, 9))
    last = np.full(20, np.inf)
    for r in range(5):
        got = distance.dtw(x, y, r)
        assert np.allclose(got, [brute_dtw(a, b, r) for a, b in zip(x, y, strict=True)])
        assert (got <= last + 1e-12).all() and np.allclose(got, distance.dtw(y, x, r))
        last = got
    assert np.allclose(distance.dtw(x, y, 0), np.linalg.norm(x - y, axis=1))
    a, b = np.array([[0, 1, 2, 0]], float), np.array([[1, 2, 0, 0]], float)
    assert distance.dtw(a, b, 0)[0] == pytest.approx(2.449489742783178) and distance.dtw(a, b, 1)[0] == pytest.approx(1.0)


def test_dtw_pairs_cover_all_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(15, 5))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 0, [1.0] * 5)], "g string, k int, v array<double>")
    got = {(r.i, r.j): r.d for r in distance.dtw_pairs(df, ["g"], "k", "v", 1).collect()}
    assert set(got) == {(i, j) for i in range(15) for j in range(i + 1, 15)}
    assert all(d == pytest.approx(brute_dtw(x[i], x[j], 1)) for (i, j), d in got.items())


def test_scaled_distances_and_kernels(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, None)], "k int, v double")
    pairs = distance.euclidean_pairs(df, [], "k", F.col("v"))
    got = {(r.i, r.j): r.d for r in distance.normalise(pairs, []).collect()}
    assert got == {(1, 2): 1.0, (1, 3): pytest.approx(0.1 / 3), (2, 3): pytest.approx(2.9 / 3)}
    m = distance.square(distance.gaussian(distance.normalise(pairs, []), 1.0), [], 1.0).first()
    w = np.array(m.matrix)
    assert m["keys"] == [1, 2, 3] and np.allclose(w, w.T) and np.allclose(np.diag(w), 1) and w[0, 1] == pytest.approx(math.exp(-1))
    same = distance.euclidean_pairs(spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, v double"), [], "k", F.col("v"))
    assert [r.d for r in distance.normalise(same, []).collect()] == [None]


def blobs(n=12, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(10 * i, 0.5, (n, 2)) for i in range(k)])
    return x, np.repeat(np.arange(k), n)


def same_partition(a, b):
    return len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_spectral_clustering_and_scores():
    x, truth = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    result = cluster.spectral(np.exp(-((d / 5) ** 2)), 3)
    assert same_partition(result["labels"], truth) and abs(result["eigenvalues"][0]) < 1e-8
    s = cluster.scores(result)
    assert s["s_sil_km"] > 0.9 and s["s_distortion"] >= 0
    assert cluster.silhouette(d, np.zeros(len(d), int)) == 0
    assert same_partition(cluster.k_means(x, 3)[0], truth)
    labels, centres, _ = cluster.k_means(x, 3)
    assert cluster.bic(x, labels, centres) > cluster.bic(x, *cluster.k_means(x, 2)[:2])


def test_label_orders():
    assert cluster.by_size(np.array([2, 2, 2, 0, 1, 1])).tolist() == [0, 0, 0, 2, 1, 1]
    previous = np.array([0, 0, 1, 1, 2, 2])
    assert cluster.match_previous(np.array([2, 2, 0, 0, 1, 1]), previous).tolist() == previous.tolist()


def test_forgetting_factor():
    w = np.array([[1, 0.8, 0.1, 0.2], [0.8, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.6], [0.2, 0.1, 0.6, 1]])
    past = np.full((4, 4), 0.5)
    np.fill_diagonal(past, 1)
    assert evolve.forgetting_factor(w, past, np.array([0, 0, 1, 1])) == pytest.approx(0.022099447513812157)
    assert 0 <= evolve.forgetting_factor(w, w, np.array([0, 1, 2, 3])) <= 1


def test_evolution_follows_renamed_clusters():
    x, truth = blobs(10, 3, 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    w = np.exp(-((d / 5) ** 2))
    steps = evolve.evolve([w, w, w], [3, 3, 3])
    assert all(same_partition(s.labels, truth) for s in steps)
    assert (steps[1].labels == steps[0].labels).all() and len(steps[1].alphas) == 3


def test_grid_search_spreads_cells(spark):
    x, truth = blobs(6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) / 30
    df = spark.createDataFrame([("a", d.tolist())], "g string, matrix array<array<double>>")
    rows = cluster.grid_search(df, ["g"], [1.0, 60.0], [2, 3]).collect()
    assert {(r.gamma, r.clusters) for r in rows} == {(1.0, 2), (1.0, 3), (60.0, 2), (60.0, 3)}
    best = max((r for r in rows if r.gamma == 60), key=lambda r: r.s_sil_km)
    assert best.clusters == 3 and same_partition(np.array(best.labels), truth)


def test_stacked_k_means_equals_k_means():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        x = np.array([rng.random((n, 3)), rng.integers(0, 2, (n, 3)).astype(float), np.zeros((n, 3))])
        for k in (2, 4):
            for one, (labels, centres, inertia) in zip(x, cluster.k_means_stack(x, k), strict=True):
                want = cluster.k_means(one, k)
                assert (labels == want[0]).all() and np.allclose(centres, want[1]) and inertia == pytest.approx(want[2])


def test_best_parameters(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    rows = [dict(experiment="e", experiment_date=t + dt.timedelta(days=i), clusters=k, window_size=1, gamma=1.0, s_sil_km=s)
            for i, (k, s) in enumerate([(2, 0.9), (2, 0.4), (3, 0.6), (4, None), (5, float("nan"))])]
    log = tracking.log_rows(spark, "gridsearch", rows)
    best = tracking.optimal_params(log).first()
    assert (best.clusters, best.s_sil_km) == (3, 0.6)
    with pytest.raises(ValueError, match="no columns"):
        tracking.log_rows(spark, "gridsearch", [{"nothing": 1}])


def test_cohort_rules(spark):
    events = spark.createDataFrame([(s, "edit recipe", 1314) for s in (1, 2, 3, 4)] + [(5, "log in", 1314)], "student int, event_type string, calendar_year int")
    years = spark.createDataFrame([(s, 1314, 1) for s in range(1, 6)], "student int, calendar_year int, school_year int")
    users = spark.createDataFrame([(s,) for s in range(1, 6)], "user_id int")
    grades = spark.createDataFrame([(1, 1314, 1, "a", 5.0), (2, 1314, 1, "block", 5.0), (3, 1314, 1, None, 5.0), (4, 1314, 1, "a", None), (5, 1314, 1, "a", 4.0)],
                                   "student int, calendar_year int, school_year int, school_group string, final_grade double"
                                   ).withColumns({"media1": F.lit(1.0), "media2": F.lit(2.0)})
    gender = spark.createDataFrame([], "user_id int, gender string")
    assert [r.student for r in cohort.report_cohort(events, years, users, grades, gender, [99]).collect()] == [1]


def test_tables_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, v double")
    root = str(tmp_path)
    assert {r.k: r.v for r in sources.refresh(df, root, "t").collect()} == {1: None, 2: 1.5}
    sources.append(df, root, "t")
    assert sources.stored_table(spark, root, "t").count() == 4
    sources.save_bulk(df, f"{root}/bulk")
    assert {r.k: r.v for r in sources.read_bulk(spark, f"{root}/bulk", "k int, v double").collect()} == {1: None, 2: 1.5}
    assert sources.copy_as(spark, root, "t", "u", {"v": "w"}).columns == ["k", "w"]
    sources.save_csv(df, f"{root}/csv")
    assert spark.read.csv(f"{root}/csv", header=True).count() == 2
    assert sources.query(spark, "select :x + 1 as y", x=1).first().y == 2


def test_study_on_two_clear_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, "a", (rng.normal(10 * (i % 2), 0.1, 6)).tolist()) for i in range(12)]
    rows += [(1, i, "b", (rng.normal(5 * (i % 2), 0.1, 6)).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "g long, student long, feature string, v array<double>")
    d = study.feature_distances(df, [1])
    best = study.best_cells(study.search_features(d, [4.0], [2, 3]))
    assert {(r.feature, r.clusters) for r in best.collect()} == {("a", 2), ("b", 2)}
    groups = {"both": ["a", "b"]}
    kernels = study.group_kernels(d, best, groups)
    labels = study.best_labels(study.search_groups(kernels, groups, [2]), "feature_group")
    got = {r.student: r.label for r in labels.collect()}
    assert same_partition(np.array([got[i] for i in range(12)]), np.arange(12) % 2)
    found = study.profiles(labels, ["both"], [2], starts=5).collect()
    assert len(found) == 12 and found[0].silhouette == 1.0
    one = {(r.i, r.j): r.w for r in study.product_kernels(d, [{"a": (4.0, 1), "b": (4.0, 1)}]).collect()}
    assert one == {(r.i, r.j): pytest.approx(r.w) for r in kernels.collect()}


def test_positions_are_those_of_a_sorted_list(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1.5, 2.5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    order = (F.desc_nulls_last("k"), F.asc_nulls_first("v"), F.asc("i"))
    want = [r.i for r in df.orderBy(*order).collect()]
    out = ordering.positions(df, *order)
    assert [r.i for r in out.orderBy("pos").collect()] == want and sorted(r.pos for r in out.collect()) == list(range(500))
    assert ordering.positions(df.limit(0), *order).collect() == [] and out.columns == ["k", "v", "i", "pos"]
    assert sorted(r.pos for r in ordering.positions(df, F.asc("k")).collect()) == list(range(500))


def test_pairs_are_rounded_as_all_numbers_are(spark):
    """By whole millionths instead of decimal text: the same doubles, also for large numbers, null and nan."""
    rng = np.random.default_rng(4)
    values = [*(rng.random(20000) * 10.0 ** rng.integers(-7, 5, 20000)).tolist(), 0.0, 0.5, 0.0000005, 1.0000015, 1234.5678905, 8.9e9 + 0.1, 3e12 + 0.3, -2.5000005, float("nan"), None]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, d double").coalesce(1)
    found, want = catalogue._plain_pairs(df), catalogue._plain(df)
    assert found.dtypes == want.dtypes and list(map(str, found.collect())) == list(map(str, want.collect()))
    for name in ("euclid_distance", "minmax_distance", "gaussian_affinity", "kernel_sum", "dtw_distance"):
        assert "rint(" in inspect.getsource(catalogue._plain_pairs) and "_plain_pairs(" in inspect.getsource(catalogue.QUERIES[name])


def test_series_that_occur_more_than_once_are_compared_once(spark, monkeypatch):
    """A block's different series are compared, not its pairs; the pairs are all there."""
    rng = np.random.default_rng(2)
    x = rng.poisson(2.0, (4, 5)) * 1.0
    own = rng.integers(0, 4, 60)
    df = spark.createDataFrame([(1, i, x[c].tolist()) for i, c in enumerate(own)], "g int, k int, v array<double>").coalesce(1)
    real = distance.dtw

    def few(a, b, radius):
        assert len(a) <= 4 * 4
        return real(a, b, radius)

    monkeypatch.setattr(distance, "dtw", few)
    got = {(r.i, r.j): r.d for r in distance.dtw_pairs(df, ["g"], "k", "v", 1).collect()}
    assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert all(d == pytest.approx(brute_dtw(x[own[i]], x[own[j]], 1)) for (i, j), d in got.items())

