"""Benchmark decontamination: a broadcast set of test n-grams, scanned for in training token windows.

The windows of all benchmark items are hashed into sorted arrays. They are broadcast in blocks of at most
``BLOCK_WINDOWS`` windows, a bound that does not depend on the data; a larger benchmark takes more blocks, one after another,
with one scan of the documents each, and the hits of a document are put together afterwards. Every hash hit is verified
on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .runtime import DIGEST, ROW, input_texts, keep_ids, map_texts, numbered, scope, stored, text_blocks

BLOCK_WINDOWS = 1_000_000
_HITS = "doc_id long, n_words long, hits array<struct<start: int, length: int>>, items array<string>"
_DIGEST = f", {DIGEST} binary"


class TestSet:
    """The windows of some benchmark items, by window length: sorted hashes, each with its (item, place)s."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.items = items
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, (_, words) in enumerate(items):
            k = min(width, len(words))
            by.setdefault(k, []).append((tx.gram_hashes(tx.hash_words(words), k), n))
        self.by = {}
        for k, parts in by.items():
            h = np.concatenate([p for p, _ in parts])
            item = np.concatenate([np.full(len(p), n, np.int32) for p, n in parts])
            place = np.concatenate([np.arange(len(p), dtype=np.int32) for p, _ in parts])
            order = np.argsort(h, kind="stable")
            self.by[k] = (h[order], item[order], place[order])

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of each occurrence of any window, and the ids of the items that own one."""
        hits, owners, hashed = [], set(), tx.hash_words(words)
        for k, (known, item, place) in self.by.items():
            grams = tx.gram_hashes(hashed, k)
            left = np.searchsorted(known, grams)
            seen: dict[bytes, set[str]] = {}
            for i in np.flatnonzero(known[np.minimum(left, len(known) - 1)] == grams):
                window = words[i : i + k]
                key = b" ".join(window)
                if key not in seen:
                    a, b = left[i], np.searchsorted(known, grams[i], "right")
                    seen[key] = {
                        self.items[item[j]][0] for j in range(a, b)
                        if self.items[item[j]][1][place[j] : place[j] + k] == window
                    }
                if seen[key]:
                    hits.append((int(i), k))
                    owners |= seen[key]
        return hits, owners


def _test_sets(bench: DataFrame, width: int, id_col: str, text_col: str, limit: int) -> Iterator[TestSet]:
    """The benchmark row by row through the driver, in sets of at most about ``limit`` windows.

    An item of more windows than that is cut into overlapping pieces, which have the same windows.
    """
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = bench.select(bench[id_col].cast("string"), bench[text_col].cast("string").cast("binary"))
    for item, text in rows.toLocalIterator():
        words = tx.alnum_words(bytes(text) if text is not None else None)
        if item is None or not words:
            continue
        for i in range(0, max(1, len(words) - width + 1), limit):
            piece = words[i : i + limit + width - 1]
            block.append((item, piece))
            held += max(1, len(piece) - width + 1)
            if held >= limit:
                yield TestSet(block, width)
                block, held = [], 0
    if block:
        yield TestSet(block, width)


def _scan(src: DataFrame, tests: TestSet, digest: bool = False, whole: bool = False) -> tuple[DataFrame, Broadcast]:
    """Hits of every row of ``src(doc_id, text)``, with ``digest`` the text's SHA-256, and the broadcast they need.

    With ``whole`` all that is told of a row, so that no second Python process stands beside the one that scans.
    """
    shared = src.sparkSession.sparkContext.broadcast(tests)

    def make():
        found = shared.value

        def work(ids: list, texts: list) -> dict:
            n, hits, items = [], [], []
            for t in texts:
                words = tx.alnum_words(t)
                where, owners = found.search(words) if words else ([], set())
                n.append(len(words)), items.append(sorted(owners))
                hits.append([{"start": a, "length": k} for a, k in where])
            own = {DIGEST: tx.digests(texts)} if digest else {}
            return {"doc_id": ids, "n_words": n, "hits": hits, "items": items} | own | (_told(n, hits, items) if whole else {})

        return work

    return map_texts(src, make, (_SUMMARY if whole else _HITS) + _DIGEST * digest), shared


def contamination(
    docs: DataFrame, bench: DataFrame, *, width: int = 10, block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items`` per row of ``docs``.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. An item's windows are its
    runs of ``width`` words, or all its words if it has fewer. A document word inside an occurrence of a window is hit;
    ``hits`` holds the occurrences and ``items`` the sorted ids of their items.

    Null and wordless texts have no words and are clean. Items with a null id or no words are left out; repeated
    items count once. Rows with a null or repeated doc_id are scanned each on their own. A text is held whole in its task.
    Other columns are ignored. With no usable item every document is clean. With ``digest`` a row carries the SHA-256
    of its text.
    """
    src = input_texts(docs, id_col, text_col)
    tests = _test_sets(bench, width, item_col, item_text_col, block_windows)
    first, second = next(tests, None), next(tests, None)
    if second is None:
        return _scan(src, first or TestSet([], width), digest, whole=True)[0]
    with scope():
        # Several scans are put together by the rows' numbers; one block at a time is built, broadcast and dropped.
        rows = numbered(src, "texts", keep=True)
        whole = None
        for t in chain([first, second], tests):
            found, shared = _scan(rows.select(F.col(ROW).alias("doc_id"), "text"), t)
            part = stored(found if whole is None else found.filter(F.size("hits") > 0), "hits", keep=True)
            shared.destroy()
            whole = part if whole is None else whole.union(part)
    whole = whole.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    own = [F.unhex(F.sha2("text", 256)).alias(DIGEST)] if digest else []
    found = whole.withColumnRenamed("doc_id", "__tw_n").join(rows.select(ROW, "doc_id", *own), F.col("__tw_n") == F.col(ROW))
    told = ["doc_id", "n_words", "hits", "items", *([DIGEST] if digest else [])]
    return found.select(*told).mapInArrow(_summary, _SUMMARY + _DIGEST * digest)


_SUMMARY = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "hits array<struct<start: int, length: int>>, items array<string>"
)


def _told(n_words: list[int], hits: list[list[dict]], items: list[list[str]]) -> dict[str, list]:
    """What follows from the words, hits and items of some rows."""
    n_hit = []
    for n, where in zip(n_words, hits, strict=True):
        mask = np.zeros(n, bool)
        for h in where:
            mask[h["start"] : h["start"] + h["length"]] = True
        n_hit.append(int(mask.sum()))
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return {"n_hit": n_hit, "n_items": list(map(len, items)), "items_sha256": digest, "contaminated": [x > 0 for x in n_hit]}


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = _told(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(told.values(), kinds, strict=True)), *batch.columns[2:]],
            ["doc_id", "n_words", *told, *batch.schema.names[2:]],
        )


def cut_words(text: bytes, hits: list[dict]) -> bytes:
    """``text`` without the words of ``hits``; what stood between two cut words goes as well."""
    spans = tx.alnum_word_spans(text)
    out, at = [], 0
    for start, end in sorted((h["start"], h["start"] + h["length"]) for h in hits):
        a, b = spans[start][0], spans[min(end, len(spans)) - 1][1]
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return b"".join(out) + text[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, at = batch.column(2), 0
        for ids, texts in text_blocks(iter([batch])):
            cut = [cut_words(t, h) for t, h in zip(texts, hits.slice(at, len(texts)).to_pylist(), strict=True)]
            at += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "text"])


def without_spans(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object
) -> DataFrame:
    """``doc_id, text`` of every row with the benchmark's passages cut out of the text (null stays null).

    All passages are found in the input, however many blocks the benchmark takes, and then cut at once; other columns are
    dropped. Each row is cut by its own text. ``options`` are those of ``contamination``.
    """
    with scope():
        rows = numbered(input_texts(docs, id_col, text_col), "texts", keep=True)
        found = contamination(rows.select(ROW, "text"), bench, id_col=ROW, **options).filter("contaminated")
        found = stored(found.select(F.col("doc_id").alias("__tw_n"), "hits"), "passages", keep=True)
    hit = keep_ids(rows, ROW, found.select("__tw_n")).join(found.hint("merge"), F.col(ROW) == F.col("__tw_n")).select("doc_id", "text", "hits")
    rest = keep_ids(rows, ROW, found.select("__tw_n"), "left_anti").select("doc_id", "text")
    return hit.mapInArrow(_cut, "doc_id long, text binary").union(rest).select("doc_id", F.col("text").cast("string").alias("text"))
