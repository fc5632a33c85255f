"""Clustering over tables of pairs against plain numpy over matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel.operators import cluster, distance, evolve, matching, modes, numbers, pairs, smoothing, spectrum
from tidewheel.operators.components import components
from tidewheel.plans import pair_queries

GROUPS = {1: 40, 2: 9, 3: 2, 4: 1}


def matrix(rng, n):
    x = rng.normal(size=(n, 2)) + 4 * (np.arange(n) % 3)[:, None] * np.array([1, -1])
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def pair_table(spark, matrices, column="d", **extra):
    rows = [(g, i, j, float(m[i, j])) for g, m in matrices.items() for i in range(len(m)) for j in range(i + 1, len(m))]
    df = spark.createDataFrame(rows, f"g long, i long, j long, {column} double").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def member_table(spark, labels):
    return spark.createDataFrame([(g, i, int(x)) for g, some in labels.items() for i, x in enumerate(some)], "g long, member long, label int")


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    d = {g: matrix(rng, n) for g, n in GROUPS.items()}
    labels = {g: (rng.integers(0, 3, n) if g != 2 else np.array([0, 0, 0, 0, 1, 1, 2, 3, 3])) for g, n in GROUPS.items()}
    return d, labels


def test_silhouettes_and_distortion(spark, made):
    d, labels = made
    got = {r.g: r for r in pairs.silhouettes(pair_table(spark, d), member_table(spark, labels), ["g"]).collect()}
    for g, m in d.items():
        assert got[g].s_sil_km == pytest.approx(cluster.silhouette(m, labels[g]), abs=1e-12)
        spread = sum((m[np.ix_(s, s)] ** 2).sum() / 2 / len(s) for x in np.unique(labels[g]) for s in [np.flatnonzero(labels[g] == x)])
        assert got[g].s_distortion == pytest.approx(spread, abs=1e-9)


def test_forgetting_factor_and_blocks(spark, made):
    d, labels = made
    now, before = {g: np.exp(-(m**2)) for g, m in d.items()}, {g: np.exp(-2 * m) for g, m in d.items()}
    tables = pair_table(spark, now, "w"), pair_table(spark, before, "w"), member_table(spark, labels)
    got = {r.g: r.alpha for r in pairs.forgetting_factors(*tables, ["g"]).collect()}
    assert got == pytest.approx({g: evolve.forgetting_factor(now[g], before[g], labels[g]) for g in d}, abs=1e-12)
    for r in pairs.block_moments(*tables, ["g"]).collect():
        mean, variance = evolve.block_statistics(now[r.g], labels[r.g])
        a, b = (np.flatnonzero(labels[r.g] == x) for x in (r.a, r.b))
        i, j = (a[0], a[0]) if r.diagonal else next((x, y) for x in a for y in b if x != y)
        assert (r["mean"], r.variance) == pytest.approx((mean[i, j], variance[i, j]), abs=1e-12)


def plain_density(d, eps, least):
    near = d <= eps
    core = near.sum(axis=1) >= least
    labels, name = np.zeros(len(d), int), 0
    for i in np.flatnonzero(core):
        if labels[i]:
            continue
        name, todo = name + 1, [i]
        while todo:
            p = todo.pop()
            if not labels[p]:
                labels[p] = name
                todo += np.flatnonzero(near[p] & core & (labels == 0)).tolist()
    return [int(x) if core[i] else int(min((labels[j] for j in np.flatnonzero(near[i] & core)), default=0)) for i, x in enumerate(labels)]


@pytest.mark.parametrize("eps,least", [(0.7, 3), (1.2, 4), (0.0, 1), (9.0, 50)])
def test_density_clusters(spark, made, eps, least):
    d, labels = made
    rows = pairs.density_clusters(pair_table(spark, d), member_table(spark, labels), ["g"], eps, least).collect()
    got = {(r.g, r.member): r.label for r in rows}
    assert got == {(g, i): x for g, m in d.items() for i, x in enumerate(plain_density(m, eps, least))}


def test_components_of_hubs_chains_and_odd_edges(spark):
    rng = np.random.default_rng(8)
    edges = [(1, 500, i) for i in range(300)] + [(2, i, i + 1) for i in range(200)] + [(3, int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    edges += [(1, 900, 901), (1, 901, 900), (1, 7, 7), (4, 5, 5), (1, None, 3), (2, 3, None)]
    want = {}
    for g in (1, 2, 3):
        root = {}
        some = [(a, b) for k, a, b in edges if k == g and a is not None and b is not None and a != b]

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in some:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        want |= {(g, x): find(x) for x in list(root)}
    df = spark.createDataFrame(edges, "g long, i long, j long").repartition(4)
    assert {(r.g, r.node): r.component for r in components(df, ["g"]).collect()} == want
    assert components(df.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("k", [3, 6])
def test_label_matching_equals_every_permutation(spark, k):
    rng = np.random.default_rng(k)
    now = {g: rng.integers(0, k, 12) for g in range(8)} | {8: np.zeros(12, int), 9: np.arange(12) % k}
    past = {g: (x + (rng.random(12) < 0.5)) % (k + 1) for g, x in now.items()}
    table = matching.contingency(member_table(spark, now), member_table(spark, past), ["g"])
    got = {}
    for r in matching.best_names(table, ["g"], k).collect():
        got.setdefault(r.g, {})[r.label] = r.name
        assert r.f1 == pytest.approx(cluster.weighted_f1(cluster.match_previous(now[r.g], past[r.g]), past[r.g]), abs=1e-9)
    for g, labels in now.items():
        assert [got[g][x] for x in labels.tolist()] == cluster.match_previous(labels, past[g]).tolist()


def test_label_matching_joins_no_members(spark, monkeypatch):
    """The query's labels stand in one row a member: its contingency is an aggregate of them."""
    seen, whole = [], matching.best_names
    monkeypatch.setattr(matching, "best_names", lambda table, *rest: seen.append(table) or whole(table, *rest))
    pair_queries.label_matching(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_label_matching_of_nine(spark):
    labels, shuffle = np.arange(90) % 9, np.array([4, 8, 0, 2, 6, 1, 7, 3, 5])
    table = matching.contingency(member_table(spark, {1: labels}), member_table(spark, {1: shuffle[labels]}), ["g"])
    assert {r.label: r.name for r in matching.best_names(table, ["g"], 9).collect()} == dict(enumerate(shuffle.tolist()))


def test_block_eigenvectors_equal_numpy(spark, made):
    w = {g: np.exp(-(m**2) / 8) for g, m in made[0].items()}
    w[5] = np.exp(-matrix(np.random.default_rng(9), 30))
    w[5][7] = w[5][:, 7] = 0  # a member that is like nobody
    members = member_table(spark, {g: np.zeros(len(m)) for g, m in w.items()})
    affinity = spectrum.Affinity(pair_table(spark, w, "w"), members, ["g"], block=8)
    rows = spectrum.eigenvectors(affinity, 4).collect()
    assert affinity.blocks.filter("width > 30").count() == 0 and len(rows) == sum(map(len, w.values()))
    for g, m in w.items():
        some = sorted((r for r in rows if r.g == g), key=lambda r: r.member)
        values, vectors, _ = cluster.laplacian_spectrum(m)
        k = min(4, len(m))
        assert 1 - np.array(some[0]["values"]) == pytest.approx(values[:k], abs=1e-8) and some[0].residual < 1e-6
        got = np.array([r.vector for r in some])
        for c in range(k):
            apart = min(abs(values[c] - np.delete(values, c)), default=1)
            if apart > 1e-3:  # equal eigenvalues share their vectors
                assert abs(abs(got[:, c] @ vectors[:, c]) - 1) < 1e-8


def test_spectral_clusters_equal_numpy(spark, made):
    w = {g: np.exp(-(m**2) / 8) for g, m in made[0].items() if g != 4}
    rows = spectrum.spectral_clusters(pair_table(spark, w, "w"), member_table(spark, {g: np.zeros(len(m)) for g, m in w.items()}), ["g"], 3, block=8).collect()
    for g, m in w.items():
        want = cluster.spectral(m, 3)
        some = sorted((r for r in rows if r.g == g), key=lambda r: r.member)
        assert [r.label for r in some] == want["labels"].tolist()
        assert some[0].inertia == pytest.approx(want["inertia"], abs=1e-9)


def test_evolution_over_pairs_equals_matrices(spark):
    rng = np.random.default_rng(3)
    kernels = {g: [np.exp(-(matrix(rng, n) ** 2) / 8) for _ in range(2)] for g, n in ((1, 14), (2, 9))}
    table = None
    for t in range(2):
        one = pair_table(spark, {g: m[t] for g, m in kernels.items()}, "w", t=t + 1)
        table = one if table is None else table.unionByName(one)
    members = member_table(spark, {g: np.zeros(len(m[0])) for g, m in kernels.items()}).drop("label")
    labels, factors = smoothing.evolve(table, members, ["g"], first=3, search=(2, 3), rounds=1, block=6)
    got = {(r.g, r.t, r.member): (r.label, r.clusters) for r in labels.collect()}
    alphas = {(r.g, r.t, r.round): r.alpha for r in factors.collect()}
    for g, some in kernels.items():
        for t, step in enumerate(evolve.evolve(some, [3, 3], search=(2, 3), rounds=1), 1):
            assert [got[g, t, i] for i in range(len(some[0]))] == [(x, step.clusters) for x in step.labels.tolist()]
            assert [alphas[g, t, n] for n in range(len(step.alphas))] == pytest.approx(step.alphas, abs=1e-8)


def plain_modes(x, modes_, rounds=100):
    """Labels, modes and cost from given first modes."""
    modes_ = modes_.copy()
    for _ in range(rounds):
        label = (x[:, None] != modes_[None]).sum(axis=2).argmin(axis=1)
        new = np.array([[np.bincount(c).argmax() for c in x[label == i].T] if (label == i).any() else modes_[i] for i in range(len(modes_))])
        if (new == modes_).all():
            break
        modes_ = new
    cost = (x[:, None] != modes_[None]).sum(axis=2)
    return cost.argmin(axis=1), modes_, int(cost.min(axis=1).sum())


def test_k_modes_by_counts_equal_plain_ones(spark):
    rng = np.random.default_rng(6)
    x = {1: rng.integers(0, 4, (60, 5)), 2: np.array([[1, 2, 3, 4, 0]] * 3 + [[0, 0, 0, 0, 5]])}
    rows = [(g, i, [None if v == 5 else int(v) for v in c]) for g, some in x.items() for i, c in enumerate(some)]
    codes = spark.createDataFrame(rows, "g long, student long, codes array<int>").repartition(3)
    first = {}
    for r in modes.first_modes(modes.kinds(codes, ["g"]), ["g"], [2, 3], 8, 111).orderBy("c").collect():
        first.setdefault((r.g, r.clusters, r.start), []).append(r["mode"])
    found = modes.search(codes, ["g"], [2, 3], starts=8)
    out = {(r.g, r.clusters, r.student): r for r in modes.profiles(codes, found, ["g"], "student").collect()}
    for r in found.collect():
        runs = {s: plain_modes(x[r.g], np.array(m)) for (g, k, s), m in first.items() if (g, k) == (r.g, r.clusters)}
        start = min(runs, key=lambda s: (runs[s][2], s))
        labels, want, cost = runs[start]
        assert (r.start, r.cost, r.modes) == (start, cost, want.tolist())
        shown = [out[r.g, r.clusters, i] for i in range(len(x[r.g]))]
        assert [s.profile for s in shown] == labels.tolist() and all(s["mode"] == want[s.profile].tolist() for s in shown)
        assert shown[0].silhouette == pytest.approx(cluster.profile_silhouette(x[r.g], labels), abs=1e-9)


def _customers(spark):
    rng = np.random.default_rng(5)
    rows = [(g, 100 * g + k, float(np.round(rng.normal(0, 100), 2)), k % 3) for g, n in ((1, 40), (2, 7), (3, 2), (4, 1)) for k in range(n)]
    rows += [(5, 501, 2.0, 0), (5, 502, 2.0, 1), (6, 601, None, 0), (6, 602, 1.0, 0)]  # all equal; a null
    df = spark.createDataFrame(rows, "g int, member long, v double, label int")
    return df, df.select("g", "member", "label")


def _near(got, want, keys):
    got, want = (df.toPandas().sort_values(keys, ignore_index=True) for df in (got.select(*want.columns), want))
    assert len(got) == len(want) > 0
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-12)


def test_scaled_pairs_of_numbers_take_their_ends_from_the_numbers(spark, monkeypatch):
    df, _ = _customers(spark)
    monkeypatch.setattr(distance, "NUMBERS", 5)
    plain = distance.euclidean_pairs(df, ["g"], "member", F.col("v"))
    found = distance.euclidean_pairs(df, ["g"], "member", F.col("v"), normalised=True)
    _near(found, distance.normalise(plain, ["g"]), ["g", "i", "j"])
    both = distance.kernel_sum(distance.gaussian(found, 0.7).union(distance.gaussian(found, 1.3)), ["g"])
    _near(distance.gaussian_sum(found, [0.7, 1.3]), both.select("g", "i", "j", "w"), ["g", "i", "j"])
    above = found._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
    assert "Exchange" not in above and "Aggregate" not in above  # pairs are not shuffled


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 18, 1 << 10), (6, 4, 2)])
def test_measures_over_numbers_equal_those_over_pairs(spark, monkeypatch, sizes):
    for name, n in zip(("BLOCK", "VALUES", "TILE"), sizes, strict=True):
        monkeypatch.setattr(numbers, name, n)
    df, labels = _customers(spark)
    rows = distance.numbers(df, ["g"], "member", F.col("v"))
    d = distance.euclidean_pairs(df, ["g"], "member", F.col("v"))
    _near(numbers.member_silhouettes(rows, labels, ["g"]), pairs.member_silhouettes(d, labels, ["g"]), ["g", "member"])
    _near(numbers.silhouettes(rows, labels, ["g"]), pairs.silhouettes(d, labels, ["g"]), ["g"])
    d = distance.normalise(d, ["g"]).filter("d is not null")
    for widths in ((0.7, 0.7), (0.7, 1.3)):
        now, past = (distance.gaussian(d, w) for w in widths)
        found, want = numbers.block_moments(rows, labels, ["g"], widths), pairs.block_moments(now, past, labels, ["g"])
        _near(found, want, ["g", "a", "b", "diagonal"])
        _near(pairs.factors_of(found, ["g"]), pairs.forgetting_factors(now, past, labels, ["g"]), ["g"])


def test_classes_of_members_equal_whole_matrices():
    """A cohort by classes of members that are alike, against the matrix of all its members."""
    rng = np.random.default_rng(6)
    x, own = rng.integers(0, 5, (14, 3)).astype(float), rng.integers(0, 14, 150)
    own[:14] = np.arange(14)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d /= d.max()
    for gamma, k in ((0.3, 2), (1.8, 3), (1.0, 4), (1.0, 5)):
        w = np.exp(-gamma * d**2)
        want = cluster.spectral(w[np.ix_(own, own)], k)
        ((_, _, got, scores),) = cluster.class_cells([w], own, [k])
        assert got["eigenvalues"][:8] == pytest.approx(want["eigenvalues"][:8], abs=1e-9)
        for name, value in cluster.scores(want).items():
            assert scores[name] == pytest.approx(value, abs=1e-6), (gamma, k, name)
    few = cluster.Classes(np.array([[1.0, 0.2], [0.2, 1.0]]), np.arange(100) % 2, 5)  # three of the five vectors part members that are alike
    dense = np.where(np.equal.outer(np.arange(100) % 2, np.arange(100) % 2), 1.0, 0.2)
    assert few.values[:5] == pytest.approx(cluster.laplacian_spectrum(dense)[0][:5], abs=1e-9) and few.maps.shape[1] == 5


def test_density_clusters_of_weights_equal_those_of_copies(spark):
    rng = np.random.default_rng(2)
    x, own = np.sort(rng.random(12)), np.sort(np.append(np.arange(12), rng.integers(0, 12, 20)))
    m = np.abs(np.subtract.outer(x, x))
    d = pair_table(spark, {1: m})
    sizes = spark.createDataFrame([(1, i, int(n)) for i, n in enumerate(np.bincount(own))], "g long, member long, weight int")
    got = {r.member: r.label for r in pairs.density_clusters(d, sizes, ["g"], 0.06, 4).collect()}
    assert [got[c] for c in own.tolist()] == plain_density(m[np.ix_(own, own)], 0.06, 4)


def test_only_starts_that_moved_go_on(spark, monkeypatch):
    """A start whose modes stand still is not assigned again, and few kinds are broadcast; results are those of all starts in every round."""
    rng = np.random.default_rng(4)
    codes = spark.createDataFrame([(g, s, rng.integers(0, 4, 5).tolist()) for g in (1, 2) for s in range(60)], "g long, student long, codes array<int>")
    met, plain = [], modes.new_modes
    monkeypatch.setattr(modes, "new_modes", lambda placed, now, group: (met.append(now.select(*group, "clusters", "start").distinct().count()), plain(placed, now, group))[1])
    found = {(r.g, r.clusters): (r.start, r.cost, r.modes) for r in modes.search(codes, ["g"], [2, 4], starts=9).collect()}
    assert met[0] == 36 and sorted(met, reverse=True) == met and met[-1] < 36
    some = modes.kinds(codes, ["g"]).cache()
    now = modes.first_modes(some, ["g"], [2, 4], 9, 111).localCheckpoint()
    for _ in met:
        now = plain(modes.assigned(some, now, ["g"]), now, ["g"]).localCheckpoint()
    cost = modes.assigned(some, now, ["g"]).groupBy("g", "clusters", "start").agg(F.sum(F.col("weight") * F.col("cost")).alias("cost")).collect()
    for (g, k), (start, best, _) in found.items():
        assert (best, start) == min((r.cost, r.start) for r in cost if (r.g, r.clusters) == (g, k))


def test_members_that_are_alike_are_sorted_by_hash_before_their_series(spark):
    rows = [(1, 1, [0.0, 1.0]), (1, 2, [-0.0, 1.0]), (1, 3, [float("nan"), 1.0]), (1, 4, [float("nan"), 1.0]), (1, 5, [2.0, 1.0]), (2, 6, [2.0, 1.0])]
    found = distance.alike(spark.createDataFrame(rows, "g long, k long, v array<double>"), ["g"], "k", "v")
    assert found.columns[-1] == "name" and {r.k: r.name for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    plan = found._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in plan.splitlines() if "Sort [" in x]
    assert all("_hash" in x and x.index("_hash") < x.index("v#") for x in sorts)
