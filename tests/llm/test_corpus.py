"""Decontamination, mixing and the pipeline against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tidewheel.llm import mixing
from tidewheel.llm import queries as q
from tidewheel.llm import stages
from tidewheel.llm.decontaminate import contamination, cut_words, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(docs, items, width):
    windows = {}
    for item, t in items:
        w = WORD.findall(ascii_lower(t))
        k = min(width, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, owners = WORD.findall(ascii_lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    owners |= found
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(owners), digest, bool(hit))
    return out


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 4, 9, 10, 11, 25])) ) + "!") for i in range(2, 14)]
    items = [x for x in items if len(x[1]) > 3] + [(90, None), (91, "!!"), (92, "Unique WORD9 é"), (93, "unique word9-É"), (None, "q r s"), (95, "unique word9 é")]
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for i in range(40)]
    docs += [(100, None), (101, "..."), (102, "so UNIQUE,word9\né yes"), (103, "q r s"), (104, "unique word9 É")]
    return docs, items


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_contamination_equals_brute_force(spark, contaminated, block):
    docs, items = contaminated
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, bench, block_windows=block).collect()}
    assert got == brute_hits(docs, [x for x in items if x[0] is not None], 10)


def test_contamination_of_nothing(spark, contaminated):
    docs, items = contaminated
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not any(r.contaminated for r in contamination(df, bench.limit(0)).collect())
    assert contamination(df.limit(0), bench).collect() == []
    two = spark.createDataFrame([(None, "Unique word9 é"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted(r.contaminated for r in contamination(two, bench).collect()) == [False, False, True]


def test_spans_are_cut_from_the_text(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Zero, ONE two; three... four"), (2, "one two"), (3, None), (4, "one two three")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_spans(df, bench).collect()}
    assert got == {1: "Zero, ... four", 2: "one two", 3: None, 4: ""}
    assert cut_words(b"a b c d", [{"start": 0, "length": 2}, {"start": 1, "length": 2}]) == b" d"


@pytest.mark.parametrize("block", [1_000_000, 2, 1])
def test_spans_do_not_depend_on_the_blocks(spark, block):
    bench = spark.createDataFrame([(1, "b c"), (2, "c d"), (3, "x y"), (4, "d x")], "item_id long, text string")
    texts = ["a b c d e f", "b c d x y", "x d x y b", None, "", "q " * 200_000 + "b c"]
    df = spark.createDataFrame([(7, t, 1) for t in texts] + [(None, "b c a", 1)], "doc_id long, text string, hits int").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in without_spans(df, bench, block_windows=block).collect() if r.text is not None)
    assert got == sorted([("7", "a  e f"), ("7", ""), ("7", "x  b"), ("7", ""), ("7", "q " * 200_000), ("None", " a")])


def mixed(spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.6 else rng.choice(["s1", "s2", None])
        text = None if i % 97 == 0 else " ".join(rng.choice(["red", "green", "blue"]) for _ in range(rng.randint(0, 30)))
        rows.append((None if i % 151 == 5 else i, text, rng.choice(["en", "en", "de"]), source, i))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").repartition(4)


def test_raked_margins_meet_their_targets(spark):
    cells, _ = mixing.mix(mixed(spark), targets={"lang": {"en": 3, "de": 1}})
    rows = cells.collect()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9
    share = {k: sum(r.weight for r in rows if r.lang == k) for k in ("en", "de")}
    assert abs(share["en"] - 0.75) < 1e-3
    tokens = {s: sum(r.tokens for r in rows if r.source == s) for s in ("big", "s1", "s2", "")}
    whole = sum(t**0.5 for t in tokens.values())
    for s, t in tokens.items():
        assert abs(sum(r.weight for r in rows if r.source == s) - t**0.5 / whole) < 1e-3
    assert all(0 <= r.probability <= 1 for r in rows)
    expected = sum(r.probability * r.tokens for r in rows)
    assert abs(expected - 0.5 * sum(r.tokens for r in rows)) < 1e-6 * expected


def test_margins_that_miss_their_targets_are_told(spark):
    cells, _ = mixing.mix(mixed(spark))
    assert 0 <= cells.first().margin_error < 1e-6
    tied = spark.createDataFrame([(1, "red red", "en", "a"), (2, "red red", "de", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="misses its target by 0.4"):
        cells, _ = mixing.mix(tied, targets={"lang": {"en": 1, "de": 9}})
    assert [r.margin_error for r in cells.collect()] == [pytest.approx(0.4)] * 2


def test_mixing_equals_its_sql(spark, tmp_path):
    mixed(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = q.op8_mixing(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(q.ORACLES["op8_mixing"]).fetchdf()
    key = ["doc_id", "source", "lang", "topic", "n_tokens", "probability"]
    a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert a.columns.tolist() == b.columns.tolist() and len(a) == 600
    for c in a.columns:
        assert (a[c].fillna(-1) == b[c].fillna(-1)).all(), c


def topical(spark):
    rng = random.Random(11)
    names = ["Harbour", "orchard", "engine", "éclair", "violin", "glacier", "desert", "market"]
    rows = []
    for i in range(300):
        own = names[i % 8] if i % 11 else ""
        words = ["and", "the", "so"] * 4 + [f"{own},", own.upper() if own != "éclair" else own, own] + [rng.choice(names)] + [f"w{rng.randrange(4000)}"] * 5
        rng.shuffle(words)
        words[3] += "\n" + words[4] + "  "
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), f"s{i % 3}"))
    rows += [(1, None, None, None), (1, "", "en", "s1"), (None, "harbour " * 100_000 + "engine", "en", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_topics_come_from_the_whole_text(spark, tmp_path):
    docs = topical(spark)
    rows = docs.collect()
    pieces = [(r.text or "").replace("\n", " ").split(" ") for r in rows]
    seen = Counter(w for p in pieces for w in set(p) if w)
    keys = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode())) if 10 * n <= len(rows)][: mixing.TOPICS]
    assert mixing.topic_words(docs) == keys

    def brute(text):
        c = Counter(w for w in (text or "").replace("\n", " ").split(" ") if w in keys)
        return max(keys, key=lambda k: (c[k], -keys.index(k))) if c else ""

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = q.op8_mixing(spark, str(tmp_path)).toPandas()
    want = {r.doc_id: brute(r.text) for r in rows if r.doc_id != 1 or r.text}
    assert {r.doc_id: r.topic for r in mixing.mix(docs)[1].select("doc_id", mixing.F.col("__tw_topic").alias("topic")).collect() if r.doc_id != 1} == {
        i: t for i, t in want.items() if i != 1
    }
    assert len(set(want.values())) > 4
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(q.ORACLES["op8_mixing"]).fetchdf()
    key = ["doc_id", "source", "lang", "topic", "n_tokens", "probability"]
    a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True).fillna(-1) for x in (got, sql))
    assert a.equals(b) or all((a[c] == b[c]).all() for c in a)


@pytest.mark.filterwarnings("ignore:after 3 sweeps")
def test_many_cells_are_raked_as_few_are(spark):
    few, many = (
        {(r.source, r.lang, r.topic): (r.weight, r.probability, r.margin_error) for r in mixing.mix(topical(spark), fraction=0.7, sweeps=3, small_cells=n)[0].collect()}
        for n in (mixing.SMALL_CELLS, 0)
    )
    assert few.keys() == many.keys() and len(few) > 10
    for k, values in few.items():
        assert many[k] == pytest.approx(values, abs=1e-9)


def test_mixing_runs_inside_the_jvm(spark):
    plan = mixing.mix(mixed(spark))[1]._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_edges(spark):
    df = mixed(spark)
    assert mixing.mix(df.limit(0))[1].collect() == []
    empty = df.limit(5).withColumn("text", df["text"].substr(1, 0))
    assert [r["__tw_sampled"] for r in mixing.mix(empty)[1].collect()] == [False] * 5
    assert all(r["__tw_sampled"] for r in mixing.mix(df, fraction=1.0)[1].filter("__tw_tokens > 0").collect())
    wide = mixing.rake(df.selectExpr("coalesce(source, '') source", "lang", "'t' topic", "1 tokens").groupBy("source", "lang", "topic").count()
                       .withColumnRenamed("count", "tokens"), one_task=False)
    assert abs(sum(r.weight for r in wide.collect()) - 1) < 1e-9


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    path = tmp_path_factory.mktemp("corpus")
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(2000)]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(80)) for i in range(60)}
    item = " ".join(f"item{c}" for c in "abcdefghijklmn")
    for i in (10, 11):
        texts[i] = texts[i] + " " + item
    texts[20] = texts[3]
    texts[21] = texts[4] + " tail"
    texts |= {30: "too short", 31: None, 32: " ".join(w + "$$$" for w in texts[32].split()), 33: "again and again " * 40}
    for i in range(40, 60):
        texts[i] = " ".join(w + "$$$" for w in texts[i].split())
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in texts.items()] + [(5, texts[5], "en", "s2", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(not (30 <= i <= 33 or i >= 40)), 0) for i in range(60) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_pipeline_stage_by_stage(spark, corpus_dir):
    import corpus_pipeline as cp

    docs, kept = spark.read.parquet(f"{corpus_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, corpus_dir), name)
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    good = [i for i in range(60) if not (30 <= i <= 33 or i >= 40)]
    assert kept[0] == sorted([*good, 5])
    assert kept[1] == [i for i in good if i not in (20, 21)]
    assert kept[2] == [i for i in kept[1] if i not in (10, 11)]
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.6 * len(kept[2])
    assert kept[4] == kept[3] and [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_output"]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_pipeline_of_empty_tables(spark, corpus_dir, tmp_path):
    import corpus_pipeline as cp

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = [n for n in q.QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_stages_judge_rows_not_ids(spark, corpus_dir, tmp_path):
    """One id with a clean and a bad text, and null ids with junk, benchmark passages and copies."""
    rng = random.Random(6)
    item = spark.read.parquet(f"{corpus_dir}/benchmark.parquet").first().text
    clean = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(90)) for _ in range(8)]
    junk = " ".join(w + "$$$" for w in clean[6].split())
    rows = [
        (900, clean[0]), (900, junk), (900, clean[1] + " " + item), (901, clean[2]), (901, clean[3]), (902, clean[2] + " tail"),
        (None, junk), (None, clean[4] + " " + item), (None, clean[5]), (None, clean[5]), (None, None), (None, ""), (903, clean[7]), (903, clean[7]), (None, clean[7]),
    ]
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    more = spark.createDataFrame([(i, t, None, None, 0, "y") for i, t in rows], docs.schema)
    long = spark.createDataFrame([(904, " ".join(f"{rng.choice(clean[0].split())}{i}" for i in range(300_000)), "en", "s1", 0, "y")], docs.schema)
    docs = docs.union(more).union(long)

    def texts(df):
        return sorted((str(r.doc_id), (r.text or "")[:40]) for r in df.filter("kept = 'y'").collect())

    def named(*rows):
        return sorted((str(i), (t or "")[:40]) for i, t in rows)

    last = (904, long.first().text)
    out = stages.quality_rules(spark, docs, corpus_dir)
    good = [r for r in rows if r[1] and r[1] != junk] + [last]
    assert texts(out) == named(*good) and out.columns == docs.columns
    out = stages.near_dedup(spark, more.union(long), corpus_dir)
    assert texts(out) == named((900, clean[0]), (900, junk), rows[2], (901, clean[2]), (901, clean[3]), rows[7], (None, clean[5]), rows[10], rows[11], (903, clean[7]), last)
    out = stages.decontamination(spark, docs, corpus_dir)
    assert texts(out) == named(*(r for r in [*rows, last] if item not in (r[1] or "")))
    assert stages.token_output(spark, more, corpus_dir).count() == len(rows)
    assert stages.mixing(spark, more, corpus_dir).columns == docs.columns


def test_texts_with_one_hash_keep_their_own_verdicts(spark, corpus_dir, monkeypatch):
    """All texts fall on one 64-bit hash; the stages still part junk and passages from clean texts."""
    monkeypatch.setattr(stages, "_by_text", lambda docs: docs.withColumn(stages.ROW, F.lit(1).cast("long")))
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    extra = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(77).cast("long"))
    out = {r.doc_id for r in stages.decontamination(spark, docs.union(extra), corpus_dir).collect()}
    assert out == {*range(60), 77} - {10, 11}
    out = {r.doc_id for r in stages.quality_rules(spark, docs.union(extra), corpus_dir).collect()}
    assert {30, 31, 33, 77}.isdisjoint(out) and {0, 1, 2, 10, 29} <= out


def test_a_scan_for_one_block_of_windows_is_one_python_step(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    found = contamination(docs, bench, digest=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    row = found.first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 2, 1, True)
