"""Classifiers and the language model: brute force, held-out accuracy and edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tidewheel.llm import hidden_markov as hm
from tidewheel.llm import language_id as li
from tidewheel.llm import statistics as stats
from tidewheel.llm.hidden_markov import language_scores
from tidewheel.llm.language_id import identify
from tidewheel.llm.quality_rules import FIELDS, FamilyForests, Forest, calibrate, calibrate_families, calibrate_families_table, calibrate_table, labelled_sample, quality_verdicts, row_sample
from tidewheel.llm.rule_ensemble import RuleEnsemble, lasso_logistic, quality_scores

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string"


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def prose(rng, n, words=("the", "of", "thing", "ander", "with", "stone", "river", "there")):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(2)
    w = [rng.choice(["aa", "bb", "cc", "dd"]) + rng.choice("abcdefgh") + ("$$$" if kind == 0 else " |") for _ in range(n)]
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    # most words occur once, so that only symbols tell junk from prose
    own = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(3000)]
    rows = [(i, junk(rng, 80) if i % 5 == 0 else prose(rng, 90, own), "en") for i in range(300)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(300) if i % 7]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def brute_rules(text):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    chars = sum(len(w.decode()) for w in words)
    return [len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


TEXTS = ["", None, " \n\t", "a", "a b c a b c", "a a a a a", "é ß Ž\né ß Ž\n\n \nx", "#*$ %&|<> <#>", "x y\nx y\nx y \nx y", "日本 日本 日本 日本", "a b c d a b c e b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_rule_statistics_equal_brute_force(text):
    rules, model = stats.describe(text.encode() if text is not None else None)
    assert rules == brute_rules(text)
    assert len(model) == len(stats.MODEL_FIELDS) and all(map(math.isfinite, model))


def test_forest_isolates_outliers_and_calibration_parts_them():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (20, 3))]
    good = np.arange(520) < 500
    s = Forest.fit(x).score(x)
    t = calibrate(s, good)
    assert ((s <= t) == good).mean() > 0.98
    assert calibrate(s, np.ones(520, bool)) == 1.0


def brute_path(forest, tree, row, at=0):
    f = forest.field[tree, at]
    return forest.length[tree, at] if f < 0 else brute_path(forest, tree, row, 2 * at + (2 if row[f] > forest.value[tree, at] else 1))


def test_path_lengths_equal_a_recursive_walk():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(0, 1, 300), rng.integers(0, 3, 300), np.zeros(300), rng.random(300)])
    forest = Forest.fit(x, trees=20, sample=64)
    paths = forest.paths(x)
    assert all(paths[i, t] == brute_path(forest, t, x[i]) for i in range(0, 300, 7) for t in range(len(forest.field)))
    want = [2 ** -(sum(brute_path(forest, t, r) for t in range(20)) / 20 / forest.unit) for r in x[:20]]
    assert np.allclose(forest.score(x[:20]), want)
    assert not (forest.field == 2).any()  # a statistic that does not vary parts nothing


def test_the_forest_is_no_single_threshold(spark):
    """Two kinds of junk, each ordinary in what the other stands out by; measured on rows without a label."""
    rng = random.Random(8)
    own = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 7))) for _ in range(3000)]

    def text(kind):
        words = [rng.choice(own) for _ in range(rng.randint(60, 200))]
        if kind == 1:
            words = [w + "$" if rng.random() < 0.5 else w for w in words]
        return " ".join(w * 5 if kind == 2 else w for w in words)

    kinds = [rng.choice([0] * 8 + [1, 2]) for _ in range(900)]
    docs = spark.createDataFrame([(i, text(k), None) for i, k in enumerate(kinds)], DOCS)
    labels = spark.createDataFrame([(i, int(k == 0), 0) for i, k in enumerate(kinds) if i % 2], LABELS)
    out = {r.doc_id: r for r in quality_verdicts(docs, labels).collect()}
    unseen = [i for i in range(0, 900, 2) if not out[i].base_failed]
    good, bad = ([i for i in unseen if (kinds[i] == 0) == g] for g in (True, False))
    assert sum(out[i].kept for i in good) / len(good) > 0.98
    assert sum(not out[i].kept for i in bad) / len(bad) > 0.95
    values = np.array([stats.describe(r.text.encode())[1] for r in docs.orderBy("doc_id").collect()])[unseen]
    kept = np.array([out[i].kept for i in unseen])
    for column in values.T:
        for cut in column:
            assert not np.array_equal(column <= cut, kept) and not np.array_equal(column > cut, kept)


def test_families_take_part_only_where_they_part_the_labels():
    rng = np.random.default_rng(2)
    good = rng.random(2000) < 0.9
    kind = rng.random(2000) < 0.5
    scores = rng.uniform(0.3, 0.5, (2000, 3))
    scores[~good & kind, 0] += 0.3
    scores[~good & ~kind, 2] += 0.3
    limits = calibrate_families(scores, good)
    assert limits[1] == 1 and 0.49 < limits[0] < 0.6 and 0.49 < limits[2] < 0.6
    assert ((scores <= limits).all(axis=1) == good).mean() > 0.99
    assert (calibrate_families(scores, np.ones(2000, bool)) == 1).all()


def test_trees_grow_without_labels_and_a_share_replaces_them():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (3000, len(FIELDS)))
    y = rng.random(3000) < 0.95  # rarer than what is thinned
    none = np.zeros((0, len(FIELDS)))
    a, b = FamilyForests.fit(x, FIELDS, x, y), FamilyForests.fit(x, FIELDS, none, np.zeros(0, bool), 0.04)
    assert np.array_equal(a.scores(x[:50]), b.scores(x[:50]))
    assert 0.01 < (b.anomaly(x) > 1).mean() <= 0.04
    assert (FamilyForests.fit(x, FIELDS, none, np.zeros(0, bool)).anomaly(x) <= 1).all()


def test_row_sample_is_bounded_and_counts_copies_once(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 0, id) * 1.0D as a", "1.0D as b")
    assert len(row_sample(df, ["a", "b"], 100_000)) == 13_334
    some = row_sample(df, ["a", "b"], 1000)
    assert 800 < len(some) < 1200 and len(np.unique(some, axis=0)) == len(some)
    assert np.array_equal(some, row_sample(df.repartition(7), ["a", "b"], 1000))


def test_thresholds_come_from_all_labelled_rows(spark):
    """Those of a table equal those of arrays, ties of scores included; few ranges have many scores each."""
    rng = np.random.default_rng(12)
    good = rng.random(4000) < 0.8
    scores = np.round(rng.normal(0.4 + 0.2 * ~good[:, None] * np.array([0, 1, 0.7]), 0.08), 3).clip(0.01, 0.99)
    rows = [(*map(float, s), bool(g)) for s, g in zip(scores, good, strict=True)]
    df = spark.createDataFrame(rows, "s0 double, s1 double, s2 double, good boolean").repartition(5).cache()
    for j in range(3):
        assert calibrate_table(df, f"s{j}", 7) == pytest.approx(calibrate(scores[:, j], good), abs=1e-12)
    assert calibrate_families_table(df, 3) == pytest.approx(calibrate_families(scores, good), abs=1e-12)
    assert calibrate_table(df.filter("good"), "s0") == 1.0
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 500}" + "#" * (i % 5 == 0) for j in range(60 + i % 9))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400)], "doc_id long, quality int")
    few = {r.doc_id: r.kept for r in quality_verdicts(docs, labels, limit=50).collect()}
    assert few == {r.doc_id: r.kept for r in quality_verdicts(docs, labels).collect()} and {True, False} == set(few.values())


def test_labelled_sample_sends_copies_once(spark):
    """A third of all rows are one labelled text; another id has many different texts."""
    hot = spark.range(3000).selectExpr("1L as doc_id", "0.5D as a")
    wide = spark.range(3000).selectExpr("2L as doc_id", "id * 1.0D as a")
    rest = spark.range(3, 3003).selectExpr("id as doc_id", "id * 2.0D as a")
    labels = spark.range(3003).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    x, y = labelled_sample(hot.union(wide).union(rest), labels, ["a"], 100_000)
    assert len(x) == len(y) == 6001 and (x[:, 0] == 0.5).sum() == 1
    x, y = labelled_sample(hot.union(wide).union(rest), labels, ["a"], 600)
    assert 450 < len(x) <= 600 and 150 < (y == 1).sum() < len(y) and x.shape[1] == 1


def test_quality_verdicts_of_the_given_tables_on_held_out_labels(spark):
    """Thresholds from one half of the labels, judged on the other."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    half = "crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"
    out = {r.doc_id: r for r in quality_verdicts(docs, labels.filter(half)).collect()}
    unseen = [(out[r.doc_id].kept, r.quality) for r in labels.filter(f"not ({half})").collect() if not out[r.doc_id].base_failed]
    rates = [np.mean([k == bool(q) for k, q in unseen if q == wanted]) for wanted in (0, 1)]
    assert min(rates) > 0.97


def test_quality_verdicts_of_repeated_rows_and_ids(spark, labelled):
    docs, labels = labelled
    rng = random.Random(1)
    good, bad = prose(rng, 400, [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]), junk(rng, 80)
    more = spark.createDataFrame([(7000, good, None), (7000, "short", None), (7000, good, None), (None, good, None), (None, "short " * 60, None)], DOCS)
    out = [(r.doc_id, r.n_words, r.base_failed) for r in quality_verdicts(docs.union(more), labels).collect() if r.doc_id in (None, 7000)]
    assert sorted(out, key=str) == sorted([(7000, 400, False), (7000, 1, True), (7000, 400, False), (None, 400, False), (None, 60, True)], key=str)
    long = spark.createDataFrame([(1, "x " + good * 2000 + bad, None)], DOCS)
    assert quality_verdicts(long, labels).first().n_words > 700_000


def test_quality_verdicts(spark, labelled):
    docs, labels = labelled
    more = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, "x " * 10, None)], DOCS)
    out = quality_verdicts(docs.union(more).withColumn("kept", docs["lang"]), labels).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 300 + len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        r = by[1000 + i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_rules(t)
        assert r.base_failed and not r.kept
    wrong = [i for i in range(300) if by[i].kept != (i % 5 != 0)]
    assert wrong == []


def test_quality_verdicts_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    assert all(r.kept != r.base_failed for r in quality_verdicts(docs, labels.limit(0)).collect())
    assert all(r.kept != r.base_failed for r in quality_verdicts(docs, labels.filter("quality = 1")).collect())
    assert quality_verdicts(docs.limit(0), labels).collect() == []
    shared = [r.kept for r in quality_verdicts(docs, labels.limit(0), unlabelled_share=0.2).collect() if not r.base_failed]
    assert 0 < shared.count(False) <= 0.2 * len(shared) + 1


def test_quality_scores_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    more = spark.createDataFrame([(5000, None, None), (5001, "", None), (None, "a b", None)], DOCS)
    out = {r.doc_id: r for r in quality_scores(docs.union(more), labels).collect()}
    assert len(out) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i in range(300) if remainder(i, 3) == 1]
    assert all(out[i].held_out == (remainder(i, 3) == 1) for i in range(300)) and not out[None].held_out
    assert np.mean([out[i].predicted == (i % 5 != 0) for i in held]) > 0.97


def test_quality_scores_of_shared_ids_long_texts_and_clashing_columns(spark, labelled):
    docs, labels = labelled
    rng = random.Random(2)
    good, bad = prose(rng, 90), junk(rng, 80)
    more = spark.createDataFrame([(8000, good, None), (8000, bad, None), (8000, good, None), (8001, (good + " ") * 5000, None)], DOCS)
    named = docs.union(more).selectExpr("*", "0.5 as score", "1 as predicted", "true as held_out", "7 as quality", "0.1 as mean_word")
    out = [r for r in quality_scores(named, labels).collect() if r.doc_id in (8000, 8001)]
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 8000}) == 2
    assert sorted(r.predicted for r in out if r.doc_id == 8000) == [0, 1, 1]


def test_lasso_meets_its_conditions():
    """Where a weight is not 0 the log-loss's slope is the penalty against it, elsewhere no steeper."""
    rng = np.random.default_rng(9)
    z = (rng.random((500, 6)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1])))).astype(float)
    w, b = lasso_logistic(z, y, 0.02, steps=5000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 500
    assert np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope) <= 0.02 + 1e-6).all()
    assert (w[:2] != 0).all() and (w == 0).any()


def test_quality_scores_do_not_look_at_held_out_labels(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality", "toxic")
    a = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality_scores(docs, flipped).collect()}
    one = quality_scores(docs, labels.filter("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert quality_scores(docs.limit(0), labels).collect() == []


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    model = RuleEnsemble.fit(x, y, ["a", "b", "c"])
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    assert np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], model.score(x))
    w, _ = lasso_logistic(np.column_stack([x[:, 0] > 0, x[:, 2] > 0]).astype(float), (x[:, 0] > 0).astype(float), 0.01)
    assert w[0] > 1 and w[1] == 0


def test_language_id(spark):
    rng = random.Random(6)
    words = {"en": ["the", "thing", "of"], "de": ["und", "schön", "über"], "fr": ["été", "les", "queue"]}
    rows = [(i, prose(rng, 30, words[k]), k) for i, k in enumerate(rng.choices(list(words), k=240))]
    extra = [(900, None, "en"), (901, "", "en"), (902, "123 !? 456", "en"), (903, "und und", None), (None, "the the", "en"), (904, "schön " * 60_000, None)]
    df = spark.createDataFrame(rows + extra, DOCS).selectExpr("*", "1 as score", "'x' as lang_pred")
    out = {r.doc_id: r for r in identify(df).collect()}
    assert len(out) == 246
    assert all(out[i].lang_pred == k and 0 < out[i].score <= 1 and out[i].held_out == (remainder(i, 5) == 0) for i, _, k in rows)
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[903].lang_pred == out[904].lang_pred == "de" and out[None].lang_pred == "en"
    assert {r.lang_pred for r in identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert identify(df.limit(0)).collect() == []


def brute_posteriors(rows, text):
    """Log totals by plain counting, one n-gram at a time."""
    counts, docs = {}, Counter()
    for i, t, k in rows:
        if remainder(i, 5) != 0:
            docs[k] += 1
            c = counts.setdefault(k, Counter())
            for g in li.grams(t.encode()):
                c.update(g.tolist())
    out = {}
    for k, c in counts.items():
        n = sum(c.values()) + 0.1 * li.BUCKETS
        own = Counter(b for g in li.grams(text.encode()) for b in g.tolist())
        out[k] = math.log(docs[k] / docs.total()) + sum(x * math.log((c[b] + 0.1) / n) for b, x in own.items())
    return out


@pytest.mark.parametrize("cells", [li.MATRIX_CELLS, 2 * li.BUCKETS])
def test_language_posteriors_equal_plain_counting(spark, monkeypatch, cells):
    rng = random.Random(12)
    words = {"aa": ["the", "of"], "bb": ["thing", "of"], "cc": ["und", "of"], "dd": ["thing", "und"], "ee": ["the", "und"]}
    rows = [(i, prose(rng, 3, words[k]), k) for i, k in enumerate(rng.choices(list(words), k=60))]
    monkeypatch.setattr(li, "ENTRIES", 40)
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, DOCS), cells=cells).collect()}
    for i, t, _ in rows:
        want = brute_posteriors(rows, t)
        top = max(want.values())
        assert out[i].lang_pred == min(k for k, v in want.items() if v > top - 1e-9)
        assert math.isclose(out[i].score, 1 / sum(math.exp(v - top) for v in want.values()), rel_tol=1e-9)


def test_many_languages_ties_and_repeated_ids(spark):
    rows = [(i, f"text{i} " * 3, f"l{i:04}") for i in range(1500)] + [(1, "text7 " * 3, None), (1, "text8 " * 3, None), (1, "text8 " * 3, None)]
    out = identify(spark.createDataFrame(rows, DOCS).repartition(4), cells=400 * li.BUCKETS).collect()
    assert len(out) == 1503
    assert all(r.lang_pred == f"l{r.doc_id:04}" for r in out if remainder(r.doc_id, 5) and r.doc_id > 999)
    tied = [(i, "same words", k) for i in range(40) if remainder(i, 5) for k in ("zz", "mm")]
    assert {(r.lang_pred, round(r.score, 9)) for r in identify(spark.createDataFrame(tied, DOCS)).collect()} == {("mm", 0.5)}


@pytest.mark.parametrize("text", ["½", "²³", "①", "Ⅷ", "123 _ -", "\u0301", "", "\n"])
def test_texts_without_letters_are_undetermined(text):
    assert not li.has_letter(text.encode())
    assert all(li.has_letter((text + c).encode()) for c in "aÉß日ªʰ")


def tiny_model(states=3, symbols=4):
    rng = np.random.default_rng(8)

    def rows(*shape):
        m = rng.random(shape)
        return m / m.sum(axis=-1, keepdims=True)

    return hm.Model(rows(states), rows(states, states), rows(states, symbols).T.copy())


def brute_probability(model, seq):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
    return total


SEQS = [np.array(s) for s in ([0], [1, 2], [3, 3, 0, 1], [2, 0, 1, 3, 1, 0], [], [1, 1, 1])]


def test_forward_recursion_equals_all_paths():
    m = tiny_model()
    got = hm.log_likelihoods(m, SEQS)
    want = [math.log10(brute_probability(m, s)) if len(s) else 0.0 for s in SEQS]
    assert np.allclose(got, want)


@pytest.mark.parametrize("segment", [4096, 1, 2, 3])
def test_expected_counts_equal_all_paths(monkeypatch, segment):
    m, states = tiny_model(), 3
    monkeypatch.setattr(hm, "PLACES", 8)
    monkeypatch.setattr(hm, "SEGMENT", segment)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((4, states))
    for s in SEQS:
        if not len(s):
            continue
        whole = brute_probability(m, s)
        for path in itertools.product(range(states), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            start[path[0]] += p / whole
            for t, x in enumerate(s):
                emit[x, path[t]] += p / whole
                if t:
                    move[path[t - 1], path[t]] += p / whole
    for got, want in zip(hm.expected_counts(m, SEQS), (start, move, emit), strict=True):
        assert np.allclose(got, want)


def brute_base(rows):
    words = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = Counter()
    for i, w in words:
        if i is not None and remainder(i, 7) != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in words}


@pytest.mark.parametrize(("head", "symbols"), [(4, 3), (100_000, 50)])
def test_language_scores_equal_brute_force(spark, head, symbols):
    rng = random.Random(2)
    # two kinds of texts that a latent state can tell apart, and a long tail of rare words
    kinds = [[f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) if rng.random() < 0.8 else f"r{rng.randrange(400)}" for _ in range(40)), "x") for i in range(150)]
    rows += [(500, None, "x"), (501, "", "x"), (502, "A0 a0 É", "x"), (None, "a0 b0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    out = {r.doc_id: r for r in language_scores(df, head=head, symbols=symbols, states=2, rounds=4).collect()}
    want = brute_base([(i, t) for i, t, _ in rows])
    assert out.keys() == want.keys()
    for i, (n, known, total, base) in want.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score)
        assert r.held_out == (i is not None and remainder(i, 7) == 2)
    if symbols > 20:
        held = [r for r in out.values() if r.held_out and r.n_tokens > 10]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_words_texts_and_repeated_ids(spark):
    long = ["x" * 70_000, "X" * 70_000, "y" * 65, "é" * 40, "z" * 64]
    rows = [(i, " ".join([long[i % 5], "a", f"b{i % 3}"]), "s") for i in range(80)]
    rows += [(7, "a b0 " * 400_000, "s"), (7, "a", "s"), (7, "a", "s"), (None, long[0] + " " + long[2] + "y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    out = language_scores(df, head=4, symbols=3, states=2, rounds=1).collect()
    words = [(i, [*t.encode().lower().split(), b"\n"]) for i, t, _ in rows]
    c = Counter(w for i, ws in words if i is not None and remainder(i, 7) != 2 for w in ws)
    n, v = c.total(), len(c)
    want = [(str(i), len(ws), sum(c[x] > 0 for x in ws), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws)) for i, ws in words]
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_language_scores_of_little(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    out = language_scores(df, states=2, symbols=5, head=10, rounds=2).collect()
    assert len(out) == 3 and all(math.isfinite(r.score) for r in out)
    assert language_scores(df.limit(0)).collect() == []
    alone = [i for i in range(50) if remainder(i, 7) == 2][:2]
    none = language_scores(spark.createDataFrame([(i, "a") for i in alone], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def test_emissions_of_all_words_sum_to_one(spark):
    """Known words, and one unseen word, share the model's probability of a one-word text's first token."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(5))) for i in range(60)]
    seen = sorted({w for i, t in rows if remainder(i, 7) != 2 for w in t.split()})
    probes = [(1000 + i, w) for i, w in enumerate([*seen, "unseen"])]
    keep = [(next(j for j in range(k * 1000, k * 1000 + 500) if remainder(j, 7) == 2), w) for k, (_, w) in enumerate(probes, 2)]
    df = spark.createDataFrame(rows + keep + [(next(j for j in range(900_000, 900_500) if remainder(j, 7) == 2), "")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in language_scores(df, head=3, symbols=2, states=1, rounds=1).collect()}
    end = max(out)  # the end alone
    assert math.isclose(sum(10 ** out[i] for i, _ in keep) / 10 ** out[end] + 10 ** out[end], 1.0, rel_tol=1e-9)
