"""Repeated passages over a corpus by seed and extend, and their removal.

Seeds: of each ``SPAN - SEED + 1`` consecutive ``SEED``-word grams the one with the least hash is an anchor
(winnowing), so equal passages of ``SPAN`` words pick the same anchor at the same offset. Anchors that occur
more than once are joined back to their texts. Extension: every anchor is extended to the left and to the
right by each split of the ``SPAN - SEED`` other words; the extended windows are matched by (anchor hash,
window hash). Matching windows that touch or overlap are merged, which gives the maximal repeats of at least
``SPAN`` words. Matching by counts needs no pairs of occurrences, however often a passage is shared.

Texts are known by their content: a 64-bit hash of their bytes, which Spark can compute beside the rows, finds them, and a 128-bit
hash of their words confirms them. So ids may be null or shared. Texts whose words are all the same are one to the seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .runtime import Stored, input_texts, keep_ids, map_texts, scope, stored, text_blocks

def anchors(h: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seed grams, and for each window of ``span`` words the place of its anchor."""
    grams = tx.gram_hashes(h, seed)
    width = span - seed + 1
    if len(grams) < width:
        return grams, np.empty(0, np.int64)
    rows = sliding_window_view(grams, width)
    step = 1 << 16
    least = [rows[i : i + step].argmin(axis=1) for i in range(0, len(rows), step)]
    return grams, np.concatenate(least) + np.arange(len(rows))


_INFO = "doc_id long, k long, n_words long, s1 long, s2 long, sha string, anchors array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def text_key(text: bytes | None) -> int:
    """``xxhash64`` of Spark over the text's bytes."""
    return 42 if text is None else _signed(tx.xxhash.xxh64_intdigest(text, 42))


def _words_hash(joined: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(tx.xxhash.xxh3_128_digest(joined), np.int64)
    return int(a), int(b)


def _describe(span: int, seed: int):
    def work(ids: list, texts: list) -> dict:
        cols: dict[str, list] = {c: [] for c in ("k", "n_words", "s1", "s2", "sha", "anchors")}
        for t in texts:
            words = tx.space_words(t)
            joined = b" ".join(words)
            grams, at = anchors(tx.hash_words(words), span, seed)
            values = (text_key(t), len(words), *_words_hash(joined), hashlib.sha256(joined).hexdigest(), grams[np.unique(at)].view(np.int64))
            for c, v in zip(cols.values(), values, strict=True):
                c.append(v)
        return {"doc_id": ids} | cols

    return work


def _emit_windows(span: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, at_row = batch.column(2), 0
            for ids, texts in text_blocks(iter([batch])):
                hs, ws = [], []
                for t in texts:
                    h = tx.hash_words(tx.space_words(t))
                    grams, at = anchors(h, span, seed)
                    known = np.asarray(seeds[at_row].values).view(np.uint64)
                    at_row += 1
                    hit = np.flatnonzero(np.isin(grams[at], known)) if len(at) else at
                    hs.append(grams[at[hit]].view(np.int64))
                    ws.append(tx.gram_hashes(h, span)[hit].view(np.int64))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, kind), pa.array(ws, kind)], ["k", "hs", "ws"])

    return run


def _emit_kept(span: int, with_text: bool):
    """Rows ``doc_id, text, s1, s2, windows`` to kept words; a row whose words have another hash met its key by chance and goes."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"] + ["kept_text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, repeated, at_row = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), 0
            for ids, texts in text_blocks(iter([batch])):
                out = []
                for i, t in zip(ids, texts, strict=True):
                    words, row = tx.space_words(t), at_row
                    at_row += 1
                    if _words_hash(b" ".join(words)) != (s1[row], s2[row]):
                        continue
                    windows = tx.gram_hashes(tx.hash_words(words), span).view(np.int64)
                    mask = tx.covered(np.flatnonzero(np.isin(windows, np.asarray(repeated[row].values))), span, len(words))
                    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    joined = b" ".join([words[j] for j in np.flatnonzero(~mask)])
                    row = (i, len(words), int(mask.sum()), hashlib.sha256(joined).hexdigest(), spans)
                    out.append(row + ((joined,) if with_text else ()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                    )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(
    docs: DataFrame, *, span: int = 35, seed: int = 18, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, repeats`` (and ``kept_text``) per row of ``docs``.

    A window is ``span`` consecutive words (cut at U+0020 and U+0009-U+000D). Words inside a window whose words
    also start anywhere else, in the same document or another, are removed; all windows are judged on the
    input. ``repeats`` holds the removed maximal ranges [start, end) of word places.

    A null or empty text has no words. Rows with a null id are documents too. Repeated rows repeat each
    other, so their windows go; if an id comes with several texts, each row is judged by its own. A text is held whole in its task.
    Other columns of ``docs`` are ignored.
    """
    if not 0 < seed <= span:
        raise ValueError("seed must lie in 1..span")
    src = input_texts(docs, id_col, text_col)
    by_key = src.select(F.xxhash64("text").alias("k"), "text", "doc_id")
    words = ["s1", "s2"]
    with scope():
        info = Stored(map_texts(src, lambda: _describe(span, seed), _INFO), "sub-info", keep=True).df
        # Texts of the same words: all their windows repeat, and one of them stands for all of them among the seeds.
        reps = info.filter(F.col("n_words") >= span).groupBy(*words).agg(
            F.min("k").alias("k"), (F.count("*") > 1).alias("many"), F.first("anchors").alias("anchors")
        )
        reps = stored(reps, "sub-reps")
        gone = stored(reps.filter("many").select(*words), "sub-copies", keep=True)
        seeds = reps.select(F.explode("anchors").alias("h"), "k", *words, "many")
        # Stored, so that both sides of the join are shuffled for it and a frequent seed's partition can be split.
        often = stored(seeds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "sub-often")
        hit = stored(seeds.join(often.hint("merge"), "h").groupBy("k", *words, "many").agg(F.collect_set("h").alias("seeds")), "sub-seeded")
        # A text with copies is read from one of its rows.
        one = keep_ids(by_key, "k", hit.filter("not many").select("k")).union(
            keep_ids(by_key, "k", hit.filter("many").select("k")).dropDuplicates(["k"])
        )
        seeded = one.join(hit.select("k", "seeds").hint("merge"), "k").select("k", "text", "seeds")
        windows = stored(seeded.mapInArrow(_emit_windows(span, seed), "k long, hs array<long>, ws array<long>"), "sub-windows")
        each = windows.select("k", F.explode(F.arrays_zip("hs", "ws")).alias("x")).select(
            F.col("x.hs").alias("h"), F.col("x.ws").alias("w"), "k"
        )
        twice = stored(each.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w"), "sub-twice")
        repeated = each.join(twice.hint("merge"), ["h", "w"]).groupBy("k").agg(F.collect_set("w").alias("windows"))
        repeated = stored(repeated.join(hit.filter("not many").select("k", *words).hint("merge"), "k"), "sub-repeats", keep=True)
        done = stored(gone.union(repeated.select(*words)), "sub-done", keep=True)

    cut = keep_ids(by_key, "k", repeated.select("k")).join(repeated.hint("merge"), "k").select("doc_id", "text", *words, "windows")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: long, end: long>>"
    out = cut.mapInArrow(_emit_kept(span, with_text), schema + (", kept_text binary" if with_text else ""))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = keep_ids(info, words, gone, ready=True).select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept_sha256"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("repeats"),
    )
    same = keep_ids(info, words, done, "left_anti", ready=True)
    if with_text:
        whole = whole.withColumn("kept_text", F.lit(b""))
        # A key of more texts than one, by chance, gives every one of its rows; only those whose words stay as they are count.
        kept = same.select("k", *words).distinct()
        same = by_key.join(kept.hint("merge"), "k").select("doc_id", "text", *words).mapInArrow(_emit_unchanged, out.schema)
    else:
        same = same.select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
            F.array().cast("array<struct<start: long, end: long>>").alias("repeats"),
        )
    text = [F.col("kept_text").cast("string").alias("kept_text")] if with_text else []
    return out.union(whole).union(same).select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *text)


def _emit_unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s1, s2, at_row = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
        for ids, texts in text_blocks(iter([batch])):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                words, row = tx.space_words(t), at_row
                at_row += 1
                joined = b" ".join(words)
                if _words_hash(joined) == (s1[row], s2[row]):
                    rows.append((i, len(words), 0, hashlib.sha256(joined).hexdigest(), [], joined))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"],
                )
