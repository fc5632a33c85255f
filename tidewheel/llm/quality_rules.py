"""Quality rules: fixed rules on text statistics, then isolation forests over the same statistics.

Each tree splits a small random sample at random values of random statistics until rows stand alone; rows that few splits
isolate are anomalies. The statistics come in families, each with a forest and a threshold of its own, so that what is rare in
one family (a text with many digits) is not added to what is rare in another. Trees grow without labels on a bounded sample of
all rows that pass the fixed rules and all count alike (only where more than a tenth of the sample is labelled bad, these rows are
thinned); all labelled rows set the thresholds. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics as st
from . import text as tx
from .runtime import DIGEST, Stored, input_texts, map_texts

#: Labelled rows up to which thresholds are found on the driver; of more, all are scored and ranked by Spark.
LABELLED = 20_000
#: Ranges of scores that are added up apart.
RANGES = 64
#: Rows that trees grow on, chosen by a hash of their statistics among all rows that pass the fixed rules; equal rows count once.
GROWN = 20_000
#: Trees of a family, and rows of a tree: few, as of many rows junk is no longer rare enough to stand alone soon.
TREES, SAMPLE = 200, 64
FIELDS = st.MODEL_FIELDS
#: Signs that prose seldom has, the make of words, the kinds of letters, what is repeated, the length of text and lines.
FAMILIES = (
    ("symbol_share", "bang_share"),
    ("mean_word", "symbol_share", "top_word_share"),
    ("upper_share", "digit_share", "stop_share", "bracket_share", "high_share"),
    ("dup_line_share", "repeat_share", "distinct_share"),
    ("log_words", "words_per_line"),
)
#: Most rows labelled bad to one of the others among the rows that trees grow on: what is to be isolated must be rare there.
RARE = 0.1
#: A family takes part if its threshold adds this much to the mean of both classes' hit rates.
GAIN = 1e-3


def _path_unit(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows, the unit of path lengths."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Complete binary trees in arrays: split field or -1 at a leaf, split value, path length at a leaf."""

    field: np.ndarray
    value: np.ndarray
    length: np.ndarray
    unit: float

    @classmethod
    def fit(cls, x: np.ndarray, *, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
        rng = np.random.Generator(np.random.PCG64(seed))
        size = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        nodes = (1 << depth + 1) - 1
        field = np.full((trees, nodes), -1, np.int64)
        value, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
            while todo:
                at, level, rows = todo.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level == depth or len(rows) < 2 or not len(open_):
                    length[t, at] = level + _path_unit(len(rows))
                    continue
                f = rng.choice(open_)
                cut = rng.uniform(low[f], high[f])
                field[t, at], value[t, at] = f, cut
                left = rows[:, f] <= cut
                todo += [(2 * at + 1, level + 1, rows[left]), (2 * at + 2, level + 1, rows[~left])]
        return cls(field, value, length, max(_path_unit(size), 1e-9))

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Path length of each row in each tree."""
        out, every = np.empty((len(x), len(self.field))), np.arange(len(x))
        for t, (field, value, length) in enumerate(zip(self.field, self.value, self.length, strict=True)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = field[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = 2 * at + 1 + (x[every, np.maximum(f, 0)] > value[at])
                at = np.where(inner, step, at)
            out[:, t] = length[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0..1: 2 ** -(mean path length / unit)."""
        return 2.0 ** -(self.paths(x).mean(axis=1) / self.unit)


def calibrate(score: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best mean of both classes' hit rates; all are kept if a class is missing.

    Among equally good ones it is the middle of the widest gap between scores, so neither class lies close to it.
    """
    if good.all() or not good.any():
        return 1.0
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order].astype(float)
    kept_good = np.cumsum(g) / g.sum()
    gone_bad = 1 - np.cumsum(1 - g) / (1 - g).sum()
    value = kept_good + gone_bad
    gap = np.append(np.diff(s), 0.0)
    value[gap <= 0] = -1
    best = np.flatnonzero(value >= value.max() - 1e-3)
    i = best[np.argmax(gap[best])]
    return float(s[i] + gap[i] / 2) if gap[i] > 0 else 1.0


def calibrate_families(scores: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A threshold for each column of ``scores``; a row is rejected if any score exceeds its own.

    Families take their turn, that which parts the classes best by itself first; each looks at the rows that those before it have
    left, and rejects nothing (threshold 1) unless that adds at least ``GAIN`` to the mean of both classes' hit rates.
    """
    limits = np.ones(scores.shape[1])
    if good.all() or not good.any():
        return limits

    def value(gone: np.ndarray) -> float:
        return ((~gone[good]).mean() + gone[~good].mean()) / 2

    alone = [value(scores[:, j] > calibrate(scores[:, j], good)) for j in range(scores.shape[1])]
    gone = np.zeros(len(good), bool)
    for j in np.argsort(-np.array(alone), kind="stable"):
        limit = calibrate(scores[~gone, j], good[~gone])
        more = gone | (scores[:, j] > limit)
        if value(more) >= value(gone) + GAIN:
            limits[j], gone = limit, more
    return limits


def thinned(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> np.ndarray:
    """``x`` with at most ``RARE`` rows that are rows of ``bad`` to one that is not, if it has others."""
    known = {row.tobytes() for row in np.ascontiguousarray(bad)}
    is_bad = np.array([row.tobytes() in known for row in np.ascontiguousarray(x)], bool)
    some = np.flatnonzero(is_bad)
    most = max(1, int(RARE * (len(x) - len(some))))
    if len(some) <= most or len(some) == len(x):
        return x
    kept = np.random.Generator(np.random.PCG64(seed)).choice(some, most, replace=False)
    return x[np.sort(np.r_[np.flatnonzero(~is_bad), kept])]


@dataclass
class FamilyForests:
    """A forest and a threshold for each family of statistics."""

    forests: list[Forest]
    columns: list[list[int]]
    limits: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, fields: list[str], known: np.ndarray, good: np.ndarray, share: float = 0.0) -> FamilyForests:
        """Forests over ``x``; thresholds from the labelled rows ``known``, or without both classes so that each of ``n`` families
        rejects at most ``share / n`` of ``x``."""
        model = cls.grown(x, fields, known[~good])
        if len(known) and good.any() and not good.all():
            model.limits = calibrate_families(model.scores(known), good)
        else:
            model.reject(thinned(x, known[~good]), share)
        return model

    @classmethod
    def grown(cls, x: np.ndarray, fields: list[str], bad: np.ndarray) -> FamilyForests:
        """Forests without thresholds over ``x``, in which rows of ``bad`` are thinned."""
        columns, x = [[fields.index(f) for f in family] for family in FAMILIES], thinned(x, bad)
        return cls([Forest.fit(x[:, c], seed=7 + i) for i, c in enumerate(columns)], columns, np.ones(len(columns)))

    def reject(self, x: np.ndarray, share: float) -> None:
        if share > 0:
            self.limits = np.quantile(self.scores(x), 1 - share / len(self.columns), axis=0, method="higher")

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([f.score(x[:, c]) for f, c in zip(self.forests, self.columns, strict=True)])

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The largest share of a family's score in its threshold, of families that reject at all; more than 1 is rejected."""
        shares = [f.score(x[:, c]) / t for f, c, t in zip(self.forests, self.columns, self.limits, strict=True) if t < 1]
        return np.max(shares, axis=0) if shares else np.zeros(len(x))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id`` and all statistics of every text (null: as empty); with ``digest`` the text's SHA-256 in ``DIGEST`` as well."""
    own = (lambda t: {DIGEST: tx.digests(t)}) if digest else (lambda t: {})
    return map_texts(
        input_texts(docs, id_col, text_col), lambda: lambda i, t: {"doc_id": i} | st.describe_all(t) | own(t),
        f"doc_id long, {st.SCHEMA}" + (f", {DIGEST} binary" if digest else ""),
    )


def row_sample(stats: DataFrame, fields: list[str], limit: int) -> np.ndarray:
    """Values of the different rows of ``stats``, or of about ``limit`` of them chosen by a hash of the values if there are more.

    Equal rows count once, so a group of copies is neither sent whole nor normal for its size.
    """
    return _values(stats.filter(_chosen(stats, fields, limit)), fields)


def _chosen(stats: DataFrame, fields: list[str], limit: int) -> Column:
    """Whether a row is one of the about ``limit`` different ones."""
    key, slots = F.xxhash64(*fields), 1 << 24
    n = stats.agg(F.approx_count_distinct(key, 0.01)).first()[0]
    return F.lit(True) if n <= limit else F.pmod(key, F.lit(slots)) < int(slots * limit / n)


def _values(rows: DataFrame, fields: list[str]) -> np.ndarray:
    return rows.select(*fields).distinct().toPandas().sort_values(fields, ignore_index=True)[fields].to_numpy(float)


def labelled_sample(
    stats: DataFrame, labels: DataFrame, fields: list[str], limit: int, id_col: str = "doc_id", label_col: str = "quality"
) -> tuple[np.ndarray, np.ndarray]:
    """Values and labels of the labelled rows, or of ``limit`` of them chosen by a hash of the id if there are more.

    Rows of one id and the same values count once. Rows are chosen by a bound on the hash before they are sent, so no task sends
    more than its share.
    """
    table = labelled_rows(stats, labels, fields, id_col, label_col)
    n, slots = table.df.count(), 1 << 24
    chosen = table.df if n <= limit else table.df.filter(F.pmod(F.xxhash64("doc_id", *fields), F.lit(slots)) < int(slots * limit / n))
    rows = chosen.toPandas().sort_values(["doc_id", *fields], ignore_index=True).head(limit)
    table.discard()
    return rows[fields].to_numpy(float), rows["y"].to_numpy(float)


def labelled_rows(stats: DataFrame, labels: DataFrame, fields: list[str], id_col: str = "doc_id", label_col: str = "quality") -> Stored:
    """``doc_id``, values and label ``y`` of all labelled rows; rows of one id and the same values count once."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).filter(
        "doc_id is not null and y is not null"
    )
    joined = stats.select("doc_id", *fields).distinct().join(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")
    return Stored(joined, "labelled")


def calibrate_table(rows: DataFrame, score: str, ranges: int = RANGES) -> float:
    """``calibrate`` over the columns ``score`` and ``good`` of a table of any size: sums of equal scores, added up within ranges of scores.

    The driver sees a row a range.
    """
    sums = rows.groupBy(F.col(score).alias("s")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    cuts = rows.agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    at = sum((F.when(F.col("s") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    table = Stored(sums.withColumn("range", at), "scores")
    ends = table.df.groupBy("range").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("s").alias("low")).orderBy("range").collect()
    good, bad = sum(r["g"] for r in ends), sum(r["b"] for r in ends)
    if not good or not bad:
        table.discard()
        return 1.0
    base, before = [], [0, 0]
    for r, after in zip(ends, [*ends[1:], None], strict=True):
        base.append((r["range"], before[0], before[1], after and after["low"]))
        before = [before[0] + r["g"], before[1] + r["b"]]
    bases = rows.sparkSession.createDataFrame(base, "range int, g0 long, b0 long, after double")
    w = Window.partitionBy("range").orderBy("s")
    upto = [(F.col(f"{c}0") + F.sum(c).over(w)) / F.lit(float(n)) for c, n in (("g", good), ("b", bad))]
    gap = F.coalesce(F.lead("s").over(w), "after") - F.col("s")
    parted = table.df.join(F.broadcast(bases), "range").select("s", (upto[0] + (1 - upto[1])).alias("value"), gap.alias("gap")).filter("gap > 0")
    most = parted.agg(F.max("value")).first()[0]
    found = None if most is None else parted.filter(F.col("value") >= F.lit(most - 1e-3)).agg(F.max_by(F.struct("s", "gap"), F.struct("gap", -F.col("s")))).first()[0]
    table.discard()
    return 1.0 if found is None else float(found["s"] + found["gap"] / 2)


def calibrate_families_table(scores: DataFrame, n: int) -> np.ndarray:
    """``calibrate_families`` over the columns ``s0, s1, ...`` of ``n`` families and ``good`` of a table of any size."""
    limits = np.ones(n)

    def values(*gone: Column) -> list[float]:
        good = F.col("good")
        parts = [c for g in gone for c in (F.avg(F.when(good, (~g).cast("double"))), F.avg(F.when(~good, g.cast("double"))))]
        found = scores.agg(*parts).first()
        return [(found[2 * i] + found[2 * i + 1]) / 2 for i in range(len(gone))]

    alone = values(*(F.col(f"s{j}") > calibrate_table(scores, f"s{j}") for j in range(n)))
    gone, now = F.lit(False), 0.5
    for j in np.argsort(-np.array(alone), kind="stable").tolist():
        limit = calibrate_table(scores.filter(~gone), f"s{j}")
        more = gone | (F.col(f"s{j}") > limit)
        reached = values(more)[0]
        if reached >= now + GAIN:
            limits[j], gone, now = limit, more, reached
    return limits


def base_failed(max_repeat: int = 50, min_words: int = 50):
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))


def _values_and_labels(rows: DataFrame) -> np.ndarray:
    return rows.toPandas().sort_values(["doc_id", *FIELDS], ignore_index=True)[[*FIELDS, "y"]].to_numpy(float)


def _limits_of_all(forests: FamilyForests, rows: DataFrame) -> np.ndarray:
    """Thresholds from all labelled rows: their scores are a table, over which ranks and sums are taken."""
    shared, n = rows.sparkSession.sparkContext.broadcast(forests), len(FAMILIES)
    names = [f"s{j}" for j in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy() for f in FIELDS])
            found = np.concatenate([np.empty((0, n)), *(shared.value.scores(values[i : i + 2048]) for i in range(0, len(values), 2048))])
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, j].copy()) for j in range(n)), batch.column("good")], [*names, "good"])

    scored = rows.select(*FIELDS, (F.col("y") > 0).alias("good")).mapInArrow(run, ", ".join(f"{c} double" for c in names) + ", good boolean")
    table = Stored(scored, "family-scores")
    limits = calibrate_families_table(table.df, n)
    table.discard()
    return limits


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, *, limit: int = LABELLED, grown: int = GROWN, unlabelled_share: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly`` per row.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows. Rows that pass are kept
    unless a family's anomaly score exceeds its threshold (``anomaly``, the largest share of a score in its threshold, is
    more than 1); a tie with it keeps the row. With no usable labels, or labels of one kind, the forests reject about
    ``unlabelled_share`` of the rows at most, by default none.

    A null text counts as an empty one, which fails. Rows with null or repeated ids are judged each by its own text, but
    never used for learning when the id is null. Labels repeated for an id count once (the largest). A text is held whole in its
    task. Other columns are ignored. With ``digest`` a row carries the SHA-256 of its text.
    """
    stats = Stored(rule_statistics(docs, id_col, text_col, digest), "rule-stats").df
    told = ["doc_id", *st.RULE_FIELDS, *([DIGEST] if digest else [])]
    passed = stats.filter(~base_failed())
    chosen = _chosen(passed, FIELDS, grown)
    x = _values(passed.filter(chosen), FIELDS)
    if len(x) < 2:
        return stats.select(*told, base_failed().alias("base_failed"), (~base_failed()).alias("kept"), F.lit(0.0).alias("anomaly"))
    table = labelled_rows(passed, labels, FIELDS)
    n, classes = table.df.agg(F.count("*"), F.count_distinct(F.col("y") > 0)).first()
    if classes == 2 and n <= limit:
        known = _values_and_labels(table.df)
        forests = FamilyForests.fit(x, FIELDS, known[:, :-1], known[:, -1] > 0)
    else:
        bad = _values(table.df.filter("y <= 0").filter(chosen), FIELDS)  # among the rows that trees grow on
        forests = FamilyForests.grown(x, FIELDS, bad)
        if classes == 2:
            forests.limits = _limits_of_all(forests, table.df)
        else:
            forests.reject(thinned(x, bad), unlabelled_share)
    table.discard()
    shared = stats.sparkSession.sparkContext.broadcast(forests)  # families * trees * 2 * sample nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy() for f in FIELDS])
            score = np.concatenate([shared.value.anomaly(values[i : i + 2048]) for i in range(0, len(values), 2048)] or [[]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in told), pa.array(score, pa.float64())], [*told, "anomaly"]
            )

    schema = ", ".join(f"{c} {'binary' if c == DIGEST else 'long'}" for c in told) + ", anomaly double"
    scored = stats.select(*told, *(f for f in FIELDS if f not in told)).mapInArrow(run, schema)
    return scored.select(
        *told, base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") <= 1)).alias("kept"), "anomaly"
    )
