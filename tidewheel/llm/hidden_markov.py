"""A hidden Markov language model over words, trained by Baum-Welch on counts from all partitions.

Corpus counts: every distinct training word is counted. The most frequent ones (at most ``HEAD``) form
a table of bounded size that is broadcast; counts of other words reach the documents by a join on the word, with each
document's words summed up first. Frequent words, the hot keys, never enter that join. A word of more than ``LONG`` bytes is
known by a 128-bit hash, so tables of words are bounded in bytes as well.

States emit the ``SYMBOLS`` most frequent tokens and one class for all other words. Within the class a
word has the probability (c + 1) / (n + v + 1), where c is its count, and n and v are count and number of the class's
words, so the probabilities of all words, with one share for unseen ones, sum to 1. Each round of Baum-Welch
computes expected counts of transitions and emissions in every partition, summed by Spark per
symbol and per state. Texts are scored by the scaled forward recursion, many texts at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .runtime import Stored, held_out, input_texts, learns, text_blocks

HEAD, SYMBOLS, STATES, ROUNDS = 131_072, 16_384, 8, 5
LONG = 64
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
#: Token places that are scored at one time (texts times the longest text's length in a batch).
PLACES = 1 << 20
#: Token places of a text whose forward values are kept at a time for the backward pass.
SEGMENT = 1 << 16
ROWS = 10_000
END = b"\n"  # no word holds white space, so this cannot be one


def known_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words; a long one as a blank, which no word holds, and its hash."""
    words = tx.space_words(text, lower=True)
    if text is not None and len(text) > LONG and max(map(len, words), default=0) > LONG:
        return [w if len(w) <= LONG else b" " + tx.xxhash.xxh3_128_digest(w) for w in words]
    return words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
        )
        total.clear()
        return rows

    for _, texts in text_blocks(batches):
        for t in texts:
            total.update(known_words(t))
            if len(total) > FLUSH:
                yield out()
        total[END] += len(texts)
    if total:
        yield out()


def _encode(head: Callable[[], tuple[dict[bytes, int], np.ndarray]], symbols: int):
    """Per text: symbols of its tokens (``symbols``: any other word), what the head knows, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts = head()
        counts, log_counts = np.append(counts, -1), np.append(np.log10(counts + 1.0), 0.0)  # the last: beyond the head
        for ids, texts in text_blocks(batches):
            syms, n, known, logs, class_logs, words, times = [], [], [], [], [], [], []
            for t in texts:
                tokens = [*known_words(t), END]
                at = np.array([place.get(w, -1) for w in tokens], np.int64)
                s, each = np.where(at < 0, symbols, np.minimum(at, symbols)), log_counts[at]
                syms.append(s.astype("<u2").tobytes()), n.append(len(tokens)), known.append(int((counts[at] > 0).sum()))
                logs.append(float(each.sum())), class_logs.append(float(each[s == symbols].sum()))
                rest = Counter([tokens[i] for i in np.flatnonzero(at < 0)])
                words.append(list(rest)), times.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(syms, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(logs, pa.float64()), pa.array(class_logs, pa.float64()), pa.array(words, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["doc_id", "syms", "n_tokens", "known", "log_sum", "class_sum", "words", "times"],
            )

    return run


_ENCODED = (
    "doc_id long, syms binary, n_tokens long, known long, log_sum double, class_sum double, words array<binary>, times array<long>"
)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # (symbols + 1) x states; columns sum to 1

    @classmethod
    def first(cls, counts: np.ndarray, states: int, seed: int = 5) -> Model:
        """Near the corpus's own frequencies, each state pushed off at random so that rounds can part them."""
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = (counts[:, None] + 0.5) * np.exp(rng.normal(0, 1, (len(counts), states)))
        move = np.full((states, states), 0.3 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """Normalised expected counts; emissions lean on the corpus's frequencies with the weight of 50 tokens."""
        base = (prior + 0.5) / (prior + 0.5).sum()
        emit = emit + 50 * base[:, None]
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _batches(seqs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Indexes of sequences in order of length, in batches of at most ``PLACES`` padded places."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    at = 0
    while at < len(order):
        n = max(1, PLACES // max(1, len(seqs[order[at]])))
        yield order[at : at + n]
        at += n


def _grid(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time and sequence (longest first), and how many sequences reach each time."""
    lengths = np.array([len(s) for s in seqs])
    grid = np.zeros((lengths[0], len(seqs)), np.int64)
    for j, s in enumerate(seqs):
        grid[: len(s), j] = s
    return grid, np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def log_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 P(sequence) by the scaled forward recursion; an empty sequence has 0."""
    out = np.zeros(len(seqs))
    filled = [i for i, s in enumerate(seqs) if len(s)]
    for some in _batches([seqs[i] for i in filled]):
        index = np.array(filled)[some]
        grid, live = _grid([seqs[i] for i in index])
        alpha, total = np.tile(model.start, (len(index), 1)), np.zeros(len(index))
        for t in range(len(grid)):
            k = live[t]
            a = alpha[:k] @ model.move if t else alpha[:k]
            a = a * model.emit[grid[t, :k]]
            scale = a.sum(axis=1)
            alpha = a / scale[:, None]
            total[:k] += np.log10(scale)
        out[index] = total
    return out


def expected_counts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of the sequences by scaled forward and backward passes.

    The forward values of ``SEGMENT`` places are kept at a time: a first pass keeps those at the segments' begins, from which each
    segment's are made again when the backward pass reaches it.
    """
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    filled = [s for s in seqs if len(s)]
    for some in _batches(filled):
        grid, live = _grid([filled[i] for i in some])

        def step(a: np.ndarray, t: int, grid: np.ndarray = grid, live: np.ndarray = live) -> tuple[np.ndarray, np.ndarray]:
            k = live[t]
            a = (a[:k] @ model.move if t else a[:k]) * model.emit[grid[t, :k]]
            s = a.sum(axis=1, keepdims=True)
            return a / s, s

        a, begins = np.tile(model.start, (len(some), 1)), []
        for t in range(len(grid) if len(grid) > SEGMENT else 1):
            if t % SEGMENT == 0:
                begins.append(a)
            a, _ = step(a, t)
        beta, scale, held_syms, held_gamma, held = None, None, [], [], 0
        for segment in range(len(begins) - 1, -1, -1):
            first = segment * SEGMENT
            a, alphas, scales = begins[segment], [], []
            for t in range(first, min(first + SEGMENT, len(grid))):
                a, s = step(a, t)
                alphas.append(a), scales.append(s)
            for t in range(first + len(alphas) - 1, first - 1, -1):
                k, alpha = live[t], alphas[t - first]
                if beta is None:
                    beta = np.ones((k, states))
                else:
                    n = live[t + 1]
                    ahead = model.emit[grid[t + 1, :n]] * beta / scale
                    move += (alpha[:n].T @ ahead) * model.move
                    beta = np.ones((k, states))
                    beta[:n] = ahead @ model.move.T
                scale, gamma = scales[t - first], alpha * beta
                held_syms.append(grid[t, :k]), held_gamma.append(gamma)
                held += k
                if held > 1 << 17 or not t:
                    syms, gammas = np.concatenate(held_syms), np.concatenate(held_gamma)
                    for s in range(states):
                        emit[:, s] += np.bincount(syms, gammas[:, s], minlength=len(emit))
                    held_syms, held_gamma, held = [], [], 0
        start += gamma.sum(axis=0)
    return start, move, emit


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]


def baum_welch_round(encoded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows of ``encoded(syms)``: a row for each symbol and each state from each task, summed."""
    spark, states, size = encoded.sparkSession, len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        seen = False
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                seqs = _sequences(batch.column(0).slice(i, ROWS))
                for total, part in zip((start, move, emit), expected_counts(m, seqs), strict=True):
                    total += part
                seen = True
        if seen:
            rows = np.concatenate([start[None], move, emit])
            keys = np.concatenate([[-1 - states], np.arange(-states, 0), np.arange(size)])
            some = rows.any(axis=1)
            columns = [pa.array(keys[some])] + [pa.array(rows[some, s]) for s in range(states)]
            yield pa.RecordBatch.from_arrays(columns, ["key", *(f"s{s}" for s in range(states))])

    schema = "key long, " + ", ".join(f"s{s} double" for s in range(states))
    sums = encoded.select("syms").mapInArrow(run, schema).groupBy("key").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states)))
    found = sums.toPandas()  # symbols + states + 1 rows at most
    table = np.zeros((size + states + 1, states))
    table[found["key"].to_numpy(np.int64) + states + 1] = found.drop(columns="key").to_numpy(float)
    return table[0], table[1 : states + 1], table[states + 1 :]


def language_scores(
    docs: DataFrame, *, modulus: int = 7, held: int = 2, states: int = STATES, symbols: int = SYMBOLS, head: int = HEAD,
    rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Tokens are lower-cased words (cut at U+0020 and U+0009-U+000D) and one end per text; the model learns from the rows
    whose crc32(doc_id as text) mod ``modulus`` is not ``held``. ``base_score`` sums log10((c + 1) / (N + V + 1));
    ``score`` is the log10 probability of the text under the hidden Markov model.

    A null text is an empty one: an end alone. Rows with a null id are scored, never learnt from, and not held out.
    Repeated rows count each. With nothing to learn from, N = V = 0. Other columns are ignored. Each row's own words
    are scored, also where rows share an id. A text's symbols are held whole in its task, two bytes a word. Equally frequent words take
    their places in order of their bytes.
    """
    if symbols >= 1 << 16 or symbols > head:
        raise ValueError("symbols must be under 65536 and at most head")
    src = input_texts(docs, id_col, text_col)
    spark = src.sparkSession
    words = Stored(
        src.filter(learns(modulus, held)).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    ).df
    tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The head ends between two buckets of counts, so that no task has to send a whole head; counts under 90 have a bucket each.
    bucket = F.floor(F.log2("n") * 64)
    ladder = words.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect()  # 4096 rows at most
    total, floor = 0, None
    for b, k in ladder:
        total += k
        if total > head:
            break
        floor = b
    in_head = bucket >= F.lit(floor) if floor is not None else F.lit(False)
    top = words.filter(in_head).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    counts = top["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(top["word"])}, counts))  # ``head`` words at most
    made = src.mapInArrow(_encode(lambda: shared.value, symbols), _ENCODED)
    # The row's number is stored with it, so it stays the same for all that reads the table.
    encoded = Stored(made.select(F.monotonically_increasing_id().alias("row"), "*", learns(modulus, held).alias("learns")), "encoded").df

    in_class, kinds = tokens - int(counts[:symbols].sum()), vocabulary - min(symbols, len(counts))
    prior = np.append(np.pad(counts[:symbols].astype(float), (0, max(0, symbols - len(counts)))), float(in_class))
    model = Model.first(prior, states)
    for _ in range(rounds if tokens else 0):
        model = Model.of_counts(*baum_welch_round(encoded.filter("learns"), model), prior)

    # Words beyond the head: their counts reach each row by the word, and are summed for the row.
    rest = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times")
    )
    tail = words.filter(~in_head)
    gathered = (
        rest.join(tail.hint("merge"), "word").groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1.0) * F.col("times")).alias("rest_log"), F.sum("times").alias("rest_known"))
    )
    model_shared = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, classes = [np.empty(0)], [np.empty(0, np.int64)]
            for i in range(0, batch.num_rows, ROWS):
                seqs = _sequences(batch.column(2).slice(i, ROWS))
                logs.append(log_likelihoods(model_shared.value, seqs))
                classes.append(np.array([(s == symbols).sum() for s in seqs]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *batch.columns[3:], pa.array(np.concatenate(logs)), pa.array(np.concatenate(classes), pa.int64())],
                ["row", "doc_id", "n_tokens", "known", "log_sum", "class_sum", "path_log", "n_class"],
            )

    scored = encoded.select("row", "doc_id", "syms", "n_tokens", "known", "log_sum", "class_sum").mapInArrow(
        forward,
        "row long, doc_id long, n_tokens long, known long, log_sum double, class_sum double, path_log double, n_class long",
    )
    out = scored.join(gathered.hint("merge"), "row", "left").na.fill(0, ["rest_log", "rest_known"])
    base = F.col("log_sum") + F.col("rest_log") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))
    whole = F.col("path_log") + F.col("class_sum") + F.col("rest_log") - F.col("n_class") * F.log10(F.lit(float(in_class + kinds + 1)))
    return out.select(
        "doc_id", held_out(modulus, held).alias("held_out"), "n_tokens", (F.col("known") + F.col("rest_known")).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"),
    )
