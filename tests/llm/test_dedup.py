"""Near duplicates and repeated passages against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tidewheel.llm import near_dedup as nd
from tidewheel.llm import stages
from tidewheel.llm import text as tx
from tidewheel.llm.components import components
from tidewheel.llm.near_dedup import near_duplicates
from tidewheel.llm.substring_dedup import remove_repeats, text_key

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_near(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(rng, words, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(mutated(rng, base, vocabulary, rng.choice([0, 0.01, 0.03, 0.05, 0.06, 0.08]))))
    # one large group of copies and of near copies, with few other texts between
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts += [" ".join(base)] * 60 + [" ".join(mutated(rng, base, vocabulary, 0.04)) for _ in range(80)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(40)]
    texts += [None, "", " \t\n", "One", "one", "ONE two", "one TWO", "two one", "É", "é"]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, corpus)).collect()}
    assert got == brute_near(list(enumerate(corpus)))


def test_near_duplicates_keep_the_smallest_and_ignore_other_columns(spark):
    df = spark.createDataFrame(
        [(5, "a b c", 1, "x"), (3, "a b c", 2, "y"), (3, "a b c", 2, "y"), (None, "a b c", 3, "z"), (9, None, 4, "z")],
        "doc_id long, text string, component_id int, kept string",
    )
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("9", 9, True), ("None", None, True)]


def test_an_id_with_several_texts_has_the_links_of_each(spark):
    long = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(5, long), (5, other), (7, long + " x"), (8, other + " y"), (9, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(5, 5), (7, 5), (8, 5), (9, 9)}


def test_the_stage_compares_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    far = [f"x{i}" if i in (20, 40, 60, 80) else w for i, w in enumerate(words)]  # 0.85 by two words, 0.66 by five
    near = [*words, "tail"]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([words, far, near])], "doc_id long, text string")
    assert {r.doc_id for r in near_duplicates(df).filter("kept").collect()} == {0}
    assert sorted(r.doc_id for r in stages.near_dedup(spark, df, "").collect()) == [0, 1]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    assert [r.kept for r in near_duplicates(frame(spark, [None, ""])).collect()] == [True, True]


def test_pairs_under_the_signature_distance_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 256, nd.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(nd.SYMBOLS, 2 * nd.CHUNKS - 1, replace=False)
        b[at] ^= 1
        x, y = a.reshape(nd.CHUNKS, -1), b.reshape(nd.CHUNKS, -1)
        assert ((x != y).sum(axis=1) <= 1).any()


def test_odd_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 50, 800):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[: n // 2], rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        bits = np.bitwise_count(nd.odd_sketch(x) ^ nd.odd_sketch(y)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_sketches_of_any_size_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((900, 1100), (5000, 5600), (70_000, 70_000)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[: int(0.9 * n)], rng.integers(0, 1 << 63, max(0, m - int(0.9 * n)), dtype=np.uint64)])
        a, b = (nd.odd_sketch(v, nd.sketch_longs(len(v))) for v in (x, y))
        few = min(len(a), len(b))
        differ = np.bitwise_count(nd.folded(a, few) ^ nd.folded(b, few)).sum()
        d = len(np.setxor1d(x, y))
        assert 0.4 * d < differ <= d
        link = 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        assert nd._may_link(np.int64(len(x)), nd.folded(a, few), np.int64(len(y)), nd.folded(b, few), 80) or not link


def test_a_large_family_under_the_threshold_is_no_component(spark, monkeypatch):
    """Members share most of their shingles, too few to link, but for some pairs; blocks and parts are small."""
    monkeypatch.setattr(nd, "BLOCK", 32)
    monkeypatch.setattr(nd, "PAIRS", 8)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(400):
        words = [rng.choice(["u", "v"]) + str(rng.randrange(9999)) if rng.random() < 0.085 else w for w in base]
        texts.append(" ".join(words))
        if i % 40 == 0:
            texts.append(" ".join(words[:-1] + ["last"]))
    want = brute_near(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 100


def test_near_duplicates_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(400_000)]
    texts = [" ".join(words), " ".join(words[:-20_000] + ["x"]), " ".join(words[200_000:] + ["y"] * 10)]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}

def test_components_of_chains_stars_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(900, 901), (902, 903), (901, 902), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + loose, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | dict.fromkeys(range(900, 904), 900)
    assert got == want


def brute_repeats(rows, span):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[i : i + span]) for _, w in words for i in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if seen[tuple(w[s : s + span])] > 1:
                gone[s : s + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("span", "seed"), [(6, 3), (5, 5), (4, 1)])
def test_repeats_equal_brute_force(spark, span, seed):
    rng = random.Random(span)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    passage = " ".join(str(i) for i in range(30))
    texts += [passage, passage + " x", "y " + passage, texts[0], texts[0], None, "", "é É é É é É é É é É é É"]
    rows = list(enumerate(texts))
    got = remove_repeats(frame(spark, texts), span=span, seed=seed, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, span)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed
        assert all(x.end - x.start >= span for x in r.repeats)


def test_repeats_at_the_production_length(spark):
    a = [f"a{i}" for i in range(200)]
    texts = [" ".join(a), " ".join(["x"] + a[50:85] + ["y"]), " ".join(["x"] + a[100:134] + ["z"]), " ".join(a[:10] * 8)]
    got = remove_repeats(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(list(enumerate(texts)), 35)


def test_repeats_with_null_ids_repeated_rows_and_clashing_columns(spark):
    t = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(None, t, 1), (1, t, 2), (1, t, 2), (2, "b", 3)], "doc_id long, text string, n_words int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [("1", 40, 40), ("1", 40, 40), ("2", 1, 0), ("None", 40, 40)]
    assert remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="seed"):
        remove_repeats(df, span=5, seed=6)


def test_null_ids_and_shared_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [texts[0], texts[1].replace(" ", "\n  "), texts[2], texts[2] + " z", None, "", "q " * 300_000]
    rows = [(None if i % 3 else i % 5, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, repeats int").repartition(4)
    for with_text in (False, True):
        got = remove_repeats(df, span=6, seed=3, with_text=with_text).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 6)


def test_text_keys_equal_those_of_spark(spark):
    texts = [bytes([i % 251] * i) for i in range(70)] + ["é日".encode() * 999, None]
    df = spark.createDataFrame([(t,) for t in texts], "t binary").selectExpr("t", "xxhash64(t) as k")
    assert all(text_key(bytes(r.t) if r.t is not None else None) == r.k for r in df.collect())


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_gram_hashes_tell_grams_apart(xs, k):
    words = [str(x).encode() for x in xs]
    g = tx.gram_hashes(tx.hash_words(words), k)
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(g) == len(grams)
    assert len(set(g.tolist())) == len(set(grams))


def test_words_follow_the_contract():
    assert tx.space_words("A\x0bb\x0cc d e \x85".encode(), lower=True) == ["a".encode(), b"b", "c d e".encode(), "\x85".encode()]
    assert tx.alnum_words("Ab-9é_Ž x".encode()) == [b"ab", "9é".encode(), "Ž".encode(), b"x"]
    assert tx.space_words(None) == tx.alnum_words(None) == []
