"""The clustering study against plain numpy on the driver: grids, group kernels over time, products, defaults."""

import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel.operators import cluster, distance, evolve, narrow, tracking
from tidewheel.plans import catalogue, config, study

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def square(rows, keys):
    place, m = {k: i for i, k in enumerate(keys)}, np.zeros((len(keys), len(keys)))
    for i, j, x in rows:
        m[place[i], place[j]] = m[place[j], place[i]] = x
    return m


def partition(labels):
    return {frozenset(np.flatnonzero(labels == x).tolist()) for x in np.unique(labels)}


@pytest.fixture(scope="module")
def matrices(spark):
    """Scaled distances of each cohort, from pairs."""
    found = {}
    for r in distance.dtw_pairs(catalogue._first_series(spark, SF), ["g"], "student", "v", 2).collect():
        found.setdefault(r.g, []).append((r.i, r.j, r.d))
    out = {}
    for g, rows in found.items():
        keys = sorted({k for i, j, _ in rows for k in (i, j)})
        m = square(rows, keys)
        if m.max() > 0:
            out[g] = keys, m / m.max()
    return out


@tables
def test_spectral_labels_equal_plain_clustering(spark, matrices):
    found = {}
    for r in catalogue.QUERIES["spectral_labels"](spark, SF).collect():
        found.setdefault(r.g, {})[r.student] = r.label
    assert found.keys() == matrices.keys() and len(found) > 5
    clear = 0
    for g, (keys, m) in matrices.items():
        want = cluster.spectral(np.exp(-(m**2)), 3)
        if len(keys) > 3 and want["eigenvalues"][3] - want["eigenvalues"][2] > 1e-6:  # else the three vectors are any three of more
            clear += 1
            labels = np.array([found[g][k] for k in keys])
            spread = sum(((x - x.mean(axis=0)) ** 2).sum() for c in set(labels.tolist()) for x in [want["maps"][labels == c]])
            assert spread <= want["inertia"] + 1e-9  # equally good clusters where members are alike
    assert clear > 5


@tables
def test_cluster_scores_equal_plain_clustering(spark, matrices):
    rows = catalogue.QUERIES["cluster_scores"](spark, SF).filter("window_size = 2 and gamma in (0.3, 1.8)").collect()
    assert {(r.g, r.gamma, r.clusters) for r in rows} == set(product(matrices, (0.3, 1.8), config.CLUSTERS))
    for r in rows[::5]:
        want = cluster.scores(cluster.spectral(np.exp(-r.gamma * matrices[r.g][1] ** 2), r.clusters))
        for name, value in want.items():
            assert r[name] == pytest.approx(value, abs=2e-6, nan_ok=True)


@tables
def test_sweep_equals_plain_clustering(spark, matrices):
    sweep = catalogue.QUERIES["cluster_sweep"](spark, SF).collect()
    assert {(r.g, r.clusters) for r in sweep} == set(product(matrices, range(2, 10)))
    for r in sweep[::7]:
        want = cluster.scores(cluster.spectral(np.exp(-(matrices[r.g][1] ** 2)), r.clusters))["s_sil_km"]
        assert r.s_sil_km == pytest.approx(want, abs=2e-6)


@tables
def test_evolution_equals_plain_smoothing(spark):
    series = {}
    for r in catalogue._cohort_series(spark, SF).collect():
        series.setdefault(r.g, {})[r.student, r.t] = r.v
    labels = {(r.g, r.student, r.t): r.label for r in catalogue.QUERIES["evolutionary_labels"](spark, SF).collect()}
    alphas = {(r.g, r.t, r.round): r.alpha for r in catalogue.QUERIES["affect_alpha"](spark, SF).collect()}
    assert len(labels) == sum(map(len, series.values())) > 500
    for g, rows in list(series.items())[::6]:
        who = sorted({s for s, _ in rows})
        kernels = [evolve.series_kernel(np.array([rows[s, t] for s in who], float)) for t in range(1, 7)]
        for t, step in enumerate(evolve.evolve(kernels, [3] * 6, search=tuple(config.CLUSTERS)), 1):
            assert [labels[g, s, t] for s in who] == step.labels.tolist()
        for t, step in enumerate(evolve.evolve(kernels, [3] * 6, search=()), 1):
            assert [alphas[g, t, k] for k in range(len(step.alphas))] == pytest.approx(step.alphas, abs=1e-6)


@tables
def test_profiles_agree_with_their_modes(spark):
    rows = catalogue.QUERIES["kmodes_profiles"](spark, SF).collect()
    assert {r.clusters for r in rows} == set(config.PROFILE_CLUSTERS)
    modes = {}
    for r in rows:
        modes.setdefault((r.g, r.clusters, r.profile), set()).add(r["mode"])
    assert all(len(m) == 1 for m in modes.values()) and all(-1 <= r.silhouette <= 1 for r in rows)


def small_study(spark, seed=3):
    """Distances of two cohorts of eight persons in three periods, two features, two windows."""
    rng, rows = np.random.default_rng(seed), []
    for g in (11, 12, 13, 21, 22, 23):
        for f in ("a", "b"):
            for w in (0, 1):
                x = rng.random((8, 2)) + (np.arange(8) % 2)[:, None] * (2 if f == "a" else 0.5)
                for i in range(8):
                    for j in range(i + 1, 8):
                        rows.append((g, f, w, i, j, float(np.linalg.norm(x[i] - x[j])) / 4))
    return spark.createDataFrame(rows, "g long, feature string, window_size int, i long, j long, d double")


def test_group_kernels_evolve_as_plain_matrices_do(spark):
    d, groups = small_study(spark).cache(), {"one": ["a", "b"], "two": ["b"]}
    best = study.best_cells(study.search_features(d, gammas=[0.5, 1.5], clusters=[2, 3]))
    kernels = study.group_kernels(d, best, groups)
    log = study.search_groups(kernels, groups, clusters=[2, 3])
    got = {(r.g, r.feature_group, r.student, r.t): r.label for r in study.evolve_groups(kernels, log, groups, [2, 3]).collect()}
    cell = {(r.g, r.feature): (r.window_size, r.gamma) for r in best.collect()}
    pairs = {}
    for r in d.collect():
        pairs.setdefault((r.g, r.feature, r.window_size), []).append((r.i, r.j, r.d))
    for g in (1, 2):
        for group, names in groups.items():
            sums, first = [], None
            for t in (1, 2, 3):
                parts = [np.exp(-gamma * square(pairs[10 * g + t, f, w], range(8)) ** 2) for f in names for w, gamma in [cell[10 * g + t, f]]]
                sums.append(sum(parts))
            tried = {k: cluster.scores(cluster.spectral(sums[0], k))["s_sil_km"] for k in (2, 3)}
            first = max((2, 3), key=lambda k, tried=tried: (tried[k], -k))
            for t, step in enumerate(evolve.evolve(sums, [first] * 3, search=(2, 3)), 1):
                assert [got[g, group, s, t] for s in range(8)] == step.labels.tolist()


def test_periods_may_lack_persons(spark):
    one, rows = np.exp(-np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))), []
    for t, keys in ((1, [1, 2, 3, 4]), (2, [1, 2, 4]), (3, [2])):
        m = one[: len(keys), : len(keys)].tolist()
        rows.append((1, "x", t, keys, m, 2, 1.0))
    df = spark.createDataFrame(rows, "g long, feature_group string, t int, keys array<long>, matrix array<array<double>>, clusters int, whole double")
    out = evolve.evolve_kernels(df, search=(2,)).collect()
    assert {(r.student, r.t) for r in out} == set(product((1, 2, 3, 4), (1, 2, 3)))
    series = spark.createDataFrame([(1, 1, 1, [1.0, 2.0]), (1, 2, 1, [5.0, 1.0]), (1, 1, 2, [1.0, 0.0]), (2, 9, 1, [1.0, 1.0])], "g long, student long, t long, v array<double>")
    few = evolve.evolve_cohorts(series, clusters=3, search=(2, 3)).collect()
    assert {(r.g, r.student, r.t) for r in few} == {(1, 1, 1), (1, 2, 1), (1, 1, 2), (1, 2, 2), (2, 9, 1)}


def test_product_grid_has_every_combination(spark):
    d = small_study(spark).filter("g < 13")
    squares = distance.square(d, ["g", "feature", "window_size"], 0.0, "d")
    rows = cluster.product_search(squares, ["a", "b"], [0.7, 1.3], [0, 1], [2, 3]).collect()
    assert {(r.g, tuple(r.gammas), tuple(r.windows), r.clusters) for r in rows} == set(product((11, 12), product((0.7, 1.3), repeat=2), product((0, 1), repeat=2), (2, 3)))
    pairs = {}
    for r in d.collect():
        pairs.setdefault((r.g, r.feature, r.window_size), []).append((r.i, r.j, r.d))
    for r in rows[::9]:
        kernel = sum(np.exp(-x * square(pairs[r.g, f, w], range(8)) ** 2) for f, x, w in zip("ab", r.gammas, r.windows, strict=True))
        assert r.s_sil_km == pytest.approx(cluster.scores(cluster.spectral(kernel, r.clusters))["s_sil_km"], abs=1e-9)
    some = study.search_products(d.withColumn("d", F.col("d") * 4), ["b"]).collect()
    assert len(some) == 2 * len(config.PRODUCT_GAMMAS) * 2 * len(config.PRODUCT_CLUSTERS)  # two of the windows have distances


def test_distances_may_stay_unscaled(spark):
    rows = spark.createDataFrame([(1, s, "a", [float(s), 0.0]) for s in range(4)], "g long, student long, feature string, v array<double>")
    raw = {(r.i, r.j): r.d for r in study.feature_distances(rows, [0], scaled=False).collect()}
    scaled = {(r.i, r.j): r.d for r in study.feature_distances(rows, [0]).collect()}
    assert raw[0, 3] == 3.0 and scaled[0, 3] == 1.0 and scaled[0, 1] == pytest.approx(1 / 3)


def test_untried_experiments_have_defaults(spark):
    log = spark.createDataFrame([("a", 3, 1, 0.5, 1, 0.7), ("b", 2, 1, 0.5, 1, None)], "experiment string, clusters int, window_size int, gamma double, experiment_date int, s_sil_km double")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "experiment string")
    got = {r.experiment: (r.clusters, r.window_size, r.gamma) for r in tracking.optimal_params(log, experiments=every).collect()}
    assert got == {"a": (3, 1, 0.5), "b": (2, 1, 1.0), "c": (2, 1, 1.0)}
    mine = {r.experiment: r.clusters for r in tracking.optimal_params(log, experiments=every, default={"clusters": 9}).collect()}
    assert mine == {"a": 3, "b": 9, "c": 9}
    latest = {r.experiment: (r.clusters, r.window_size) for r in tracking.latest_metadata(log, every).collect()}
    assert latest == {"a": (3, 1), "b": (2, 1), "c": (3, 2)}


def test_large_cohorts_evolve_by_their_different_series(spark):
    """Members and kinds are more than a period's different series: the results are those of whole matrices."""
    rng = np.random.default_rng(5)
    some = rng.poisson(2.0, (4, 30, 5)) * (np.arange(30) % 3 + 1)[None, :, None] * 1.0
    x = np.array([some[t][rng.integers(0, 30, 130)] for t in range(4)])
    x = np.concatenate([x, x[:, rng.integers(0, 130, 70)]], axis=1)
    rows = [(1, s, t, x[t, s].tolist()) for t in range(4) for s in range(200) if x[t, s].any()]
    series = spark.createDataFrame(rows, "g long, student long, t int, v array<double>")
    kernels = [evolve.series_kernel(m) for m in x]
    for search in ((2, 3, 4), ()):
        found = {(r.student, r.t): r for r in evolve.evolve_cohorts(series, clusters=3, search=search).collect()}
        for t, step in enumerate(evolve.evolve(kernels, [3] * 4, search=search)):
            assert [found[s, t].label for s in range(200)] == step.labels.tolist()
            assert found[0, t].clusters == step.clusters and found[0, t].alphas == pytest.approx(step.alphas, abs=1e-9)


def test_block_products_and_factors_of_kinds_are_those_of_whole_matrices():
    rng = np.random.default_rng(8)
    codes, own = [rng.permutation(np.arange(150) % 20) for _ in range(3)], np.append(np.arange(150), rng.integers(0, 150, 100))
    kernels = [evolve.series_kernel(rng.random((20, 4))) for _ in range(3)]
    cohort = evolve.Cohort(own, codes, kernels)
    whole = [w[np.ix_(c[own], c[own])] for c, w in zip(codes, kernels, strict=True)]
    factors, labels = np.array([0.2, 0.5, 0.3]), rng.integers(0, 3, 150)
    blend = sum(f * w for f, w in zip(factors, whole, strict=True))
    past = np.array([0.4, 0.6, 0.0])
    want = evolve.forgetting_factor(whole[2], 0.4 * whole[0] + 0.6 * whole[1], labels[own])
    assert cohort.forgetting_factor(2, past, labels) == pytest.approx(want, abs=1e-12)
    maps, _ = cluster.spectral_embedding(blend, 4)
    found = evolve.Leading(cohort, factors, 4).maps
    assert np.abs(np.abs(found[own]) - np.abs(maps)).max() < 1e-8
    labels, d = rng.integers(0, 3, 150), np.sqrt(((maps[:, None] - maps[None]) ** 2).sum(axis=2))
    first = np.unique(own, return_index=True)[1]
    assert cluster.point_silhouette(maps[first], labels, cohort.size) == pytest.approx(cluster.silhouette(d, labels[own]), abs=1e-9)


def test_students_alike_in_a_feature_are_one_row_of_its_matrices(spark, monkeypatch):
    """Scores from the different series and who is like whom are those of all pairs; a large cohort and a small one."""
    monkeypatch.setattr(study, "GAMMAS", [0.5, 1.5]), monkeypatch.setattr(study, "CLUSTERS", [2, 3])
    rng = np.random.default_rng(2)
    kinds = rng.poisson(2.0, (12, 4)) * 1.0
    rows = [(g, s, "a", kinds[int(rng.integers(12))].tolist()) for g, n in ((11, 90), (12, 20)) for s in range(n)]
    series = spark.createDataFrame(rows, "g long, student long, feature string, v array<double>").cache()
    named = distance.alike(series, ["g", "feature"], "student", "v").cache()
    d = study.feature_distances(named.filter("student = name").select("g", "student", "feature", "v"), [0, 1])
    assert d.count() <= 2 * 2 * 66
    keys = ["g", "feature", "window_size", "gamma", "clusters"]
    found = {tuple(r[k] for k in keys): r for r in study.score_features(d, named.select("g", "feature", "student", "name")).collect()}
    whole = study.search_features(study.feature_distances(series, [0, 1])).collect()
    assert len(found) == len(whole) == 16
    for r in whole:
        assert found[tuple(r[k] for k in keys)].s_sil_km == pytest.approx(r.s_sil_km, abs=1e-6)


def test_group_searches_of_students_that_are_alike_are_those_of_all_pairs(spark):
    """Kernel sums, group searches and smoothed labels of kinds of students, in a large cohort and a small one; a feature that one period has the same for all."""
    rng, rows, groups = np.random.default_rng(6), [], {"one": ["a", "b"], "two": ["b"]}
    kinds = {f: rng.random((5, 3)) * 0.3 + (np.arange(5) % 3)[:, None] * np.array([3.0, 1.0, 0.5]) for f in "ab"}
    for c, n in ((1, 100), (2, 24)):
        near = rng.integers(0, 3, n)
        for t in (1, 2, 3):
            for f in "ab":
                own = np.where(rng.random(n) < 0.85, near, rng.integers(0, 5, n)) if (t, f) != (2, "a") else np.zeros(n, int)
                rows += [(10 * c + t, s, f, kinds[f][own[s]].tolist()) for s in range(n)]
    series = spark.createDataFrame(rows, "g long, student long, feature string, v array<double>").cache()
    named = distance.alike(series, ["g", "feature"], "student", "v").cache()
    members = named.select("g", "feature", "student", "name")
    d = study.feature_distances(named.filter("student = name").select("g", "student", "feature", "v"), [0, 1])
    cells = [(g, f, (g + ord(f)) % 2, 0.5 + g % 3) for g in (11, 12, 13, 21, 22, 23) for f in "ab"]
    best = spark.createDataFrame(cells, "g long, feature string, window_size int, gamma double")
    found = study.group_kinds(d, members, best, groups).cache()
    pairs = study.group_kernels(study.feature_distances(series, [0, 1]), best, groups).cache()
    squares = {(r.g, r.feature_group): r for r in distance.square(pairs, ["g", "feature_group"], 0.0, "w").collect()}
    assert len(squares) == 12
    for r in found.collect():
        own, want = np.array(r.own), np.array(squares[r.g, r.feature_group].matrix)
        whole = np.array(r.matrix)[np.ix_(own, own)]
        np.fill_diagonal(whole, 0.0)
        assert r["keys"] == squares[r.g, r.feature_group]["keys"] and len(r.matrix) <= 25 and np.abs(whole - want).max() < 1e-12
    log, plain = study.search_kinds(found, [2, 3]), study.search_groups(pairs, groups, [2, 3])
    key = ["g", "feature_group", "clusters"]
    scores = {tuple(r[k] for k in key): r.s_sil_km for r in plain.collect()}
    assert {tuple(r[k] for k in key): r.s_sil_km for r in log.collect()} == pytest.approx(scores, abs=1e-6)
    key = ["g", "feature_group", "student", "t"]
    labels = {tuple(r[k] for k in key): r for r in study.evolve_kinds(found, log, [2, 3]).collect()}
    whole = {tuple(r[k] for k in key): r for r in study.evolve_groups(pairs, plain, groups, [2, 3]).collect()}
    assert labels.keys() == whole.keys() and len(labels) == 124 * 6
    for k, r in whole.items():
        assert labels[k].label == r.label and labels[k].alphas == pytest.approx(r.alphas, abs=1e-9)


def test_kernels_of_numbers_need_no_pairs(spark, monkeypatch):
    """Scores, kernel sums, group searches and smoothed labels of numbers are those of all pairs; a large cohort and a small one."""
    monkeypatch.setattr(study, "GAMMAS", [0.5, 1.7]), monkeypatch.setattr(study, "CLUSTERS", [2, 3])
    rng, rows, groups = np.random.default_rng(4), [], {"one": ["a", "b"]}
    for c, n in ((1, 130), (2, 24)):
        near = rng.integers(0, 3, n)
        for t in (1, 2, 3):
            a, b = near * 4 + rng.random(n).round(2), near + rng.random(n).round(1)
            rows += [(10 * c + t, s, f, float(x[s])) for s in range(n) for f, x in (("a", a), ("b", b))]
        rows += [(10 * c + 1, s, "same", 7.0) for s in range(n)]
    numbers = spark.createDataFrame(rows, "g long, student long, feature string, v double").cache()
    d = study.number_distances(numbers).cache()
    keys = ["g", "feature", "window_size", "gamma", "clusters"]
    plain = {tuple(r[k] for k in keys): r for r in study.search_features(d).collect()}
    found = {tuple(r[k] for k in keys): r for r in study.score_numbers(numbers).collect()}
    assert found.keys() == plain.keys() and len(found) == 2 * 3 * 2 * 4
    for k, r in plain.items():
        assert [found[k].s_sil_km, found[k].s_distortion] == pytest.approx([r.s_sil_km, r.s_distortion], abs=1e-6)
    best = spark.createDataFrame([(g, f, 1, 0.6 + g % 3) for g in (11, 12, 13, 21, 22, 23) for f in "ab"], "g long, feature string, window_size int, gamma double")
    kinds, pairs = study.number_kinds(numbers, best, groups).cache(), study.group_kernels(d, best, groups).cache()
    squares = {r.g: np.array(r.matrix) for r in distance.square(pairs, ["g"], 2.0, "w").collect()}
    for r in kinds.collect():
        f = np.array(r.matrix)[r.own]
        assert np.abs(f @ f.T - squares[r.g]).max() < 1e-12
    log, plain = study.search_kinds(kinds), study.search_groups(pairs, groups)
    labels = {(r.g, r.student, r.t): r for r in study.evolve_kinds(kinds, log).collect()}
    whole = {(r.g, r.student, r.t): r for r in study.evolve_groups(pairs, plain, groups).collect()}
    assert labels.keys() == whole.keys() and len(labels) == 154 * 3
    for k, r in whole.items():
        assert labels[k].label == r.label and labels[k].alphas == pytest.approx(r.alphas, abs=1e-8)


def test_leading_vectors_that_hardly_stand_out_are_found():
    """Smooth kernels of numbers: some of the values asked for lie as near as 1e-5 to those of the diagonal."""
    x = np.append([0.0, 1.0], np.random.default_rng(1).random(398))
    for gamma in (0.3, 1.8):
        cohort = evolve.Cohort(np.append(np.arange(400), np.arange(100)), [np.arange(400)], [evolve.Narrow(narrow.factor(x, gamma))])
        found = evolve.Leading(cohort, np.ones(1), 4)
        maps = cluster.spectral_embedding(cohort.dense(np.ones(1))[np.ix_(cohort.own, cohort.own)], 4)[0][:400, :3]
        assert np.abs(np.abs(found.maps[:, :3]) - np.abs(maps)).max() < 1e-8


def test_vectors_near_the_diagonal_need_no_square_matrix(monkeypatch):
    """Many kinds, of which some or each have several members: the leading vectors are those of the whole matrix, also where some lie within a kind."""
    monkeypatch.setattr(evolve, "SQUARE", 64)
    monkeypatch.setattr(evolve.Cohort, "dense", lambda *_: pytest.fail("a square matrix"))
    x, inside = np.append([0.0, 1.0], np.random.default_rng(3).random(198)), 0
    for own in (np.append(np.arange(200), np.arange(50)), np.arange(600) % 200):
        for gamma in (0.3, 0.7, 1.8):
            f = narrow.factor(x, gamma)
            found = evolve.Leading(evolve.Cohort(own, [np.arange(200)], [evolve.Narrow(f)]), np.ones(1), 5)
            assert np.bincount(found.own).tolist() == found.size.tolist() and np.array_equal(f[own], f[np.unique(own)][own])
            w = f[own] @ f[own].T
            np.fill_diagonal(w, 0.0)
            root = np.sqrt(w.sum(axis=0))
            whole, v = w / root[:, None] / root, found.maps[found.own] * root[:, None]
            values = (v * (whole @ v)).sum(axis=0)
            assert np.abs(v.T @ v - np.eye(5)).max() < 1e-9 and np.abs(whole @ v - v * values).max() < 1e-12
            assert values == pytest.approx(np.linalg.eigvalsh(whole)[::-1][:5], abs=1e-12)
            inside += len(found.size) > 200
    assert inside


def test_values_of_signed_roots_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(5)
    g, sign, delta = rng.random((80, 5)), np.array([1.0, 1.0, -1.0, 1.0, -1.0]), rng.random(80)
    values, vectors = evolve.secular(g, sign, delta, 7)
    whole = g @ np.diag(sign) @ g.T - np.diag(delta)
    assert values == pytest.approx(np.linalg.eigvalsh(whole)[::-1][:7], abs=1e-12)
    assert np.abs(whole @ vectors - vectors * values).max() < 1e-10


def test_a_matrix_is_dealt_out_once_for_all_widths(spark):
    """A row holds a matrix and its members; it is not repeated for each width, and scores go without the labels of all members."""
    x = np.random.default_rng(1).random((6, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = spark.createDataFrame([(1, d.tolist(), (np.arange(90) % 6).tolist())], "g long, matrix array<array<double>>, own array<int>")
    found = cluster.grid_search(rows, ["g"], [0.5, 1.5], [2, 3], labels=False)
    assert "labels" not in found.columns and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.gamma, r.clusters): r for r in cluster.grid_search(rows, ["g"], [0.5, 1.5], [2, 3]).collect()}
    assert {(r.gamma, r.clusters): r.s_sil_km for r in found.collect()} == {k: r.s_sil_km for k, r in whole.items()} and len(whole) == 4


def test_matrices_come_and_go_without_pythons_numbers():
    """A study's kinds are matrices of some million numbers, six in a row of the smoothing; a list of Python's numbers takes four times their memory and more."""
    import tracemalloc

    some = [np.arange(600.0 * 500).reshape(600, 500), np.ones((2, 3))]
    tracemalloc.start()
    column = cluster.matrix_column(some)
    back = [cluster.matrix_of(row) for row in column]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(some, back, strict=True)) and most < 2 * some[0].nbytes
    assert str(column.type) == "list<item: list<item: double>>" and column[1].as_py() == [[1.0] * 3] * 2


def test_memory_of_many_kinds_is_bounded(monkeypatch):
    """Leading vectors and k-means hold so many numbers at a time, whatever the kinds, and find the same."""
    codes, own = [np.random.default_rng(8).permutation(np.arange(300) % 40) for _ in range(2)], np.append(np.arange(300), np.arange(200))
    kernels = [evolve.series_kernel(np.random.default_rng(t).random((40, 3))) for t in range(2)]
    cohort, factors = evolve.Cohort(own, codes, kernels), np.array([0.4, 0.6])
    want = evolve.Leading(cohort, factors, 4)
    labels = want.k_means(4)
    monkeypatch.setattr(evolve, "HELD_BYTES", 1), monkeypatch.setattr(cluster, "STARTED", 1)
    held, real = [], evolve.np.hstack
    monkeypatch.setattr(evolve.np, "hstack", lambda x: held.append(sum(m.shape[1] for m in x)) or real(x))
    found = evolve.Leading(cohort, factors, 4)
    assert held and max(held) <= 4 * (4 + evolve.MORE) and np.abs(np.abs(found.maps) - np.abs(want.maps)).max() < 1e-9
    again = want.k_means(4)
    assert again[0].tolist() == labels[0].tolist() and np.array_equal(again[1], labels[1]) and again[2] == pytest.approx(labels[2], rel=1e-12)
