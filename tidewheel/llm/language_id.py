"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket come from all learning rows, summed in tasks and then across them. The matrix of log
probabilities (buckets x languages) is broadcast. Texts are scored many at a time: their n-gram counts are one sparse
matrix, whose entries gather the matrix's rows and are summed per text. Where there are more languages than a broadcast may
hold, blocks of languages are scored one after another, and each row keeps its best language and the sum of all
likelihoods.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ROW, held_out, learns, numbered, scope, stored, text_blocks

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Languages times buckets that are broadcast at a time: 32 MB of doubles.
MATRIX_CELLS = 1 << 22
#: Entries of the sparse matrix of n-gram counts that are scored at a time.
ENTRIES = 1 << 16
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_STEP = 1 << 17


def has_letter(text: bytes | None) -> bool:
    """A character of one of Unicode's letter categories."""
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in set(text.decode("utf-8", "replace")))


def grams(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of the lower-cased text with one blank around it, in pieces."""
    points = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), "<u4").astype(np.uint32)
    for i in range(0, len(points), _STEP):
        part = points[i : i + _STEP + max(SIZES) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in SIZES:
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * np.uint32(0x9E3779B1))
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(17)).astype(np.int64)[:_STEP] % buckets


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) and (lang, -1, learning rows), once a task or whenever many languages are held."""
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(c[some], rows[lang]))],
                ["lang", "bucket", "n"],
            )
        total.clear()
        rows.clear()

    for batch in batches:
        langs, at = batch.column(2).to_pylist(), 0
        for _, texts in text_blocks(iter([batch])):
            for t in texts:
                lang, at = langs[at], at + 1
                if lang not in total:
                    if len(total) >= 64:
                        yield from out()
                    total[lang], rows[lang] = np.zeros(BUCKETS, np.int64), 0
                rows[lang] += 1
                for g in grams(t or b""):
                    total[lang] += np.bincount(g, minlength=BUCKETS)
    yield from out()


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over ``rows(doc_id, text, lang)``; bucket -1 counts the language's rows."""
    return rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Matrix:
    """Names, log priors and log probabilities (buckets x languages) of a block of languages."""

    def __init__(self, counts: DataFrame, rows: int):
        """``counts(lang, bucket, n)`` of at most ``MATRIX_CELLS / BUCKETS`` languages; ``rows``: learning rows of all languages."""
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        names = counts.sparkSession.createDataFrame(list(enumerate(self.langs)), "at int, lang string")
        found = counts.join(F.broadcast(names), "lang").select("at", F.col("bucket").cast("int"), "n").toPandas()
        table = np.zeros((BUCKETS + 1, len(self.langs)))  # its last row is bucket -1
        table[found["bucket"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy(float)
        seen = table[:-1] + 0.1
        self.prior, self.logp = np.log(table[-1] / rows), np.log(seen / seen.sum(axis=0))

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Log prior plus log likelihood, texts x languages."""
        out = np.empty((len(texts), len(self.langs)))
        cols, times, starts, first, held = [], [], [], 0, 0

        def flush(end: int) -> None:
            nonlocal first, held
            n, at = np.concatenate(times), np.concatenate(cols)
            out[first:end] = np.add.reduceat(n[:, None] * self.logp[at], starts, axis=0) + self.prior
            cols.clear(), times.clear(), starts.clear()
            first, held = end, 0

        for i, t in enumerate(texts):
            n = np.zeros(BUCKETS, np.int64)
            for g in grams(t):
                n += np.bincount(g, minlength=BUCKETS)
            some = np.flatnonzero(n)
            starts.append(held), cols.append(some), times.append(n[some].astype(float))
            held += len(some)
            if held > ENTRIES:
                flush(i + 1)
        if starts:
            flush(len(texts))
        return out


_SCORED = f"{ROW} long, lang_pred string, total double, rest double"


def _score(rows: DataFrame, block: Matrix) -> tuple[DataFrame, Broadcast]:
    """The broadcast block, and for each of ``rows(ROW, text)`` the block's best language, its total, and the sum of exp(total - best) over the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # MATRIX_CELLS doubles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in text_blocks(batches):
            told = [i for i, t in enumerate(texts) if has_letter(t)]
            names, best, rest = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            total = m.totals([texts[i] for i in told])
            for i, row in zip(told, total, strict=True):
                k = int(row.argmax())
                names[i], best[i], rest[i] = m.langs[k], row[k], np.exp(row - row[k]).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(best), pa.array(rest)], [ROW, "lang_pred", "total", "rest"]
            )

    return rows.select(ROW, "text").mapInArrow(run, _SCORED), shared


def identify(
    docs: DataFrame, *, modulus: int = 5, held: int = 0, cells: int = MATRIX_CELLS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; the score is the posterior of the predicted language.

    Learns from text and language of the rows whose crc32(doc_id as text) mod ``modulus`` is not ``held`` and whose
    language is not null. A text that is null or without a letter (Unicode's letter categories) is ``und`` with score 0, as is every
    text if nothing was learnt. Rows with a null id are scored, never learnt from, and not held out. Ties go to the
    first language by name. Repeated rows count each, and each row of an id is judged by its own text. A text is held whole in its task
    and its n-grams are counted in pieces. Beyond ``cells`` / ``BUCKETS`` languages all texts are scanned once for each block of them.
    Other columns are ignored.
    """
    src = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    )
    most = max(1, cells // BUCKETS)
    with scope():
        counts = stored(count_grams(src.filter(learns(modulus, held) & F.col("lang").isNotNull() & F.col("text").isNotNull())), "grams")
        kinds, learnt = counts.filter("bucket = -1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if kinds <= most:
            block = Matrix(counts, learnt) if kinds else None
        else:
            found = stored(_many(src, counts, kinds, learnt, most), "languages", keep=True)
    said = [held_out(modulus, held).alias("held_out"), "lang_pred", (F.when(F.col("rest") > 0, 1 / F.col("rest")).otherwise(0.0)).alias("score")]
    if kinds > most:
        return found.select("doc_id", *said)
    if not kinds:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("rest")).select("doc_id", *said)
    # With one block nothing is joined, so a row's id takes the place of its number.
    scored, _ = _score(src.select(F.col("doc_id").alias(ROW), "text"), block)
    return scored.withColumnRenamed(ROW, "doc_id").select("doc_id", *said)


def _many(src: DataFrame, counts: DataFrame, kinds: int, learnt: int, most: int) -> DataFrame:
    """``doc_id, lang_pred, rest`` over blocks of languages, each broadcast on its own and dropped after its scan."""
    rows, parts, many = numbered(src.select("doc_id", "text"), "language-texts"), [], -(-2 * kinds // most)
    todo = [(i, many) for i in range(many)]
    while todo:  # languages by the remainder of a hash; a block that is still too large is split by twice the modulus
        at, of = todo.pop()
        some = counts.filter(F.pmod(F.xxhash64("lang"), F.lit(of)) == at)
        n = some.filter("bucket = -1").count()
        if n > most:
            todo += [(at, 2 * of), (at + of, 2 * of)]
        elif n:
            scored, shared = _score(rows, Matrix(some, learnt))
            parts.append(stored(scored, "language-block"))
            shared.destroy()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    # Sums of exp(total - best) of the blocks are brought to the best of all; among equal ones the first name stands.
    best = whole.groupBy(ROW).agg(
        F.max("total").alias("top"), F.min_by("lang_pred", F.struct(-F.col("total"), F.col("lang_pred"))).alias("lang_pred"),
        F.collect_list(F.struct("total", "rest")).alias("each"),
    )
    rest = F.aggregate("each", F.lit(0.0), lambda a, x: a + F.exp(x["total"] - F.col("top")) * x["rest"])
    return rows.select(ROW, "doc_id").join(best.select(ROW, "lang_pred", rest.alias("rest")), ROW).select("doc_id", "lang_pred", "rest")
