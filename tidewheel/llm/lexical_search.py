"""Ranked lexical search over a two-level quantised index.

The index holds, of every document, the terms that a block of items asks for, in blocks of documents. Level one has one
byte a posting: the posting's impact in steps of ``STEP``, rounded up. Times the terms' weights, bytes add up to an upper
bound of a document's score, and, as rounding adds less than a step, to a lower bound too. Level two has the exact counts. A first pass
over level one finds each item's k-th largest lower bound among all documents; a second one scores every document whose
upper bound reaches it, in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .runtime import input_texts, stored, text_blocks, trim

#: Terms of items, and bytes of them, that one index serves: its vocabulary and weights are broadcast.
BLOCK_TERMS, BLOCK_TERM_BYTES = 1_000_000, 32 << 20
#: Documents and postings in a block of the index.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
#: An impact is below 1 000 000, so 255 steps cover it.
IMPACTS = 1_000_000
STEP = -(-IMPACTS // 255)
#: Lists of one item that are merged in a first round.
MERGE = 256


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The score's ``m`` of documents of ``n`` terms each."""
    return 100 - 50 + (50 * n * documents) // terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


Item = tuple[object, list[bytes]]


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items and their distinct terms through the driver, in blocks of bounded size; one with more terms is a block of its own."""
    block: list[Item] = []
    terms = size = 0
    rows = items.select(items[id_col], items[text_col].cast("string").cast("binary")).distinct()
    for item, text in rows.toLocalIterator():
        found = sorted(set(tx.alnum_words(bytes(text) if text is not None else None)))
        if not found:
            continue
        if block and (terms + len(found) > BLOCK_TERMS or size + sum(map(len, found)) > BLOCK_TERM_BYTES):
            yield block
            block, terms, size = [], 0, 0
        block.append((item, found))
        terms, size = terms + len(found), size + sum(map(len, found))
    if block:
        yield block


_POSTINGS = "terms array<int>, ends array<int>, places array<int>, tf array<int>, doc_ids array<long>, n array<long>, filled long, words long"


def _collect_postings(vocabulary):
    """Rows of ``_POSTINGS``: a block's terms in order, where each one's postings end, and each posting's document and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        docs, sizes, term, tf, n_each = [], [], [], [], []
        filled = words = 0

        def row() -> pa.RecordBatch:
            t, place = np.array(term, np.int32), np.repeat(np.arange(len(docs), dtype=np.int32), n_each)
            order = np.argsort(t, kind="stable")
            names, ends = np.unique(t[order], return_counts=True)
            lists = (names, np.cumsum(ends).astype(np.int32), place[order], np.array(tf, np.int32)[order])
            columns = [pa.array([x], pa.list_(pa.int32())) for x in lists]
            columns += [pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([filled]), pa.array([words])]
            return pa.RecordBatch.from_arrays(columns, ["terms", "ends", "places", "tf", "doc_ids", "n", "filled", "words"])

        for ids, texts in text_blocks(batches):
            for d, t in zip(ids, texts, strict=True):
                found = tx.alnum_words(t)
                if not found:
                    continue
                filled, words = filled + 1, words + len(found)
                counts = Counter(found)
                mine = known.keys() & counts.keys()
                if mine:
                    docs.append(d), sizes.append(len(found)), n_each.append(len(mine))
                    term.extend([known[w] for w in mine])
                    tf.extend([counts[w] for w in mine])
                if len(docs) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield row()
                    docs, sizes, term, tf, n_each = [], [], [], [], []
                    filled = words = 0
        if filled:
            yield row()
        trim()

    return run


def _quantise(documents: int, words: int):
    """Level one for each block of postings, beside level two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in range(batch.num_rows):
                place, tf, n = (_numbers(batch, c, r) for c in ("places", "tf", "n"))
                exact = impact(tf.astype(np.int64), length_norm(n, documents, words)[place])
                made.append((-(-exact // STEP)).astype(np.uint8).tobytes())
            kept = [batch.column(c) for c in ("terms", "ends", "places", "tf", "doc_ids", "n")]
            yield pa.RecordBatch.from_arrays([*kept[:3], pa.array(made, pa.binary()), *kept[3:]], ["terms", "ends", "places", "impacts", "tf", "doc_ids", "n"])

    return run


_INDEX = "terms array<int>, ends array<int>, places array<int>, impacts binary, tf array<int>, doc_ids array<long>, n array<long>"


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


class _Bounds:
    """Bounds of the documents of a block, by item, from level one."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.terms, self.ends, self.places = (_numbers(batch, c, row) for c in ("terms", "ends", "places"))
        self.impacts = np.frombuffer(batch.column("impacts")[row].as_py(), np.uint8)
        self.docs = int(self.places.max()) + 1 if len(self.places) else 0

    def postings(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block's lists, and weights, of the postings of ``terms``."""
        at = np.searchsorted(self.terms, terms)
        hit = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, weights = at[hit], weights[hit]
        last = self.ends[at]
        size = last - np.where(at > 0, self.ends[at - 1], 0)
        total = np.cumsum(size)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(last - total, size)
        return where, np.repeat(weights, size)

    def of(self, where: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every document's score; sums stay far below 2**53, so doubles are exact."""
        place, steps = self.places[where], self.impacts[where]
        upper = np.bincount(place, weights * steps, self.docs) * STEP
        slack = np.bincount(place, weights * (steps > 0), self.docs) * (STEP - 1)
        return upper - slack, upper


def _lower_bounds(items, k: int):
    """``item, bounds``: the k largest lower bounds of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = _Bounds(batch, r)
                if not block.docs:
                    continue
                for i, (terms, weights) in enumerate(items.value):
                    lower, _ = block.of(*block.postings(terms, weights))
                    lower = np.concatenate([lower[lower > 0], best.get(i, lower[:0])])
                    if len(lower):
                        best[i] = lower if len(lower) <= k else np.partition(lower, len(lower) - k)[-k:]
        lists = pa.array([x.astype(np.int64) for x in best.values()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), lists], ["item", "bounds"])

    return run


_FOUND = "item int, found array<struct<below: long, known: boolean, doc_id: long>>"


def _rescore(items, floors, documents: int, words: int, k: int):
    """The k best documents of each item in each task, among those whose upper bound reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = _Bounds(batch, r)
                if not block.docs:
                    continue
                tf, n, ids = _numbers(batch, "tf", r).astype(np.int64), _numbers(batch, "n", r), batch.column("doc_ids")[r].as_py()
                m = length_norm(n, documents, words)
                for i, (terms, weights) in enumerate(items.value):
                    where, w = block.postings(terms, weights)
                    _, upper = block.of(where, w)
                    alive = upper >= max(floors.value.get(i, 0), 1)
                    if not alive.any():
                        continue
                    among = alive[block.places[where]]
                    where, w = where[among], w[among]
                    place = block.places[where]
                    score = np.bincount(place, w * impact(tf[where], m[place]), block.docs).astype(np.int64)
                    at = np.flatnonzero(score > 0)
                    if len(at) > k:
                        at = at[score[at] >= np.partition(score[at], len(at) - k)[-k]]
                    best[i] = sorted([*best.get(i, []), *((-int(score[d]), ids[d] is not None, ids[d] or 0) for d in at.tolist())])[:k]
        rows = [{"item": i, "found": [{"below": b, "known": o, "doc_id": d} for b, o, d in x]} for i, x in best.items()]
        fields = pa.struct([("below", pa.int64()), ("known", pa.bool_()), ("doc_id", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int32()), ("found", pa.list_(fields))]))

    return run


def _merged(lists: DataFrame, column: str, k: int, largest: bool = False) -> DataFrame:
    """The k first (or largest) entries of all lists of an item, in two rounds so that no task holds all of them."""

    def first(c: Column) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=not largest), 1, k).alias(column)

    some = lists.groupBy("item", (F.spark_partition_id() % MERGE).alias("_part")).agg(first(F.col(column)))
    return some.groupBy("item").agg(first(F.col(column)))


def weights(block: DataFrame, documents: int) -> DataFrame:
    """``term, w`` of every term of the index by the documents that hold it."""
    dfs = F.transform("ends", lambda e, i: e - F.when(i > 0, F.col("ends")[i - 1]).otherwise(0))
    each = block.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), dfs.alias("df"))).alias("x")).select("x.term", "x.df")
    counts = each.groupBy("term").agg(F.sum("df").alias("df"))
    return counts.select("term", F.floor(1000 * F.log((2 * F.lit(float(documents)) + 2) / (2 * F.col("df") + 1))).alias("w"))


def _search_block(docs: DataFrame, block: list[Item], k: int) -> DataFrame:
    """``item, rank, doc_id, score`` of the items of a block by their numbers."""
    sc = docs.sparkSession.sparkContext
    names = {w: i for i, w in enumerate(sorted({w for _, found in block for w in found}))}
    vocabulary = sc.broadcast(names)
    postings = stored(docs.mapInArrow(_collect_postings(vocabulary), _POSTINGS), "postings")
    total = postings.agg(F.sum("filled").alias("n"), F.sum("words").alias("l")).first()
    documents, words = total["n"] or 0, total["l"] or 1
    weight = {r["term"]: r["w"] for r in weights(postings, documents).collect()}  # at most the vocabulary
    own = [np.array(sorted(t for w in found if (t := names[w]) in weight), np.int32) for _, found in block]
    items = sc.broadcast([(t, np.array([weight[x] for x in t.tolist()], float)) for t in own])
    index = stored(postings.mapInArrow(_quantise(documents, words), _INDEX), "index")
    level_one = index.select("terms", "ends", "places", "impacts")
    bounds = _merged(level_one.mapInArrow(_lower_bounds(items, k), "item int, bounds array<long>"), "bounds", k, largest=True)
    floors = sc.broadcast({r["item"]: r["floor"] for r in bounds.filter(F.size("bounds") >= k).select("item", F.col("bounds")[k - 1].alias("floor")).collect()})
    found = _merged(index.mapInArrow(_rescore(items, floors, documents, words, k), _FOUND), "found", k)
    flat = found.select("item", F.posexplode("found").alias("pos", "x"))
    return flat.select("item", (F.col("pos") + 1).alias("rank"), F.when(F.col("x.known"), F.col("x.doc_id")).alias("doc_id"), (-F.col("x.below")).alias("score"))


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` documents with the highest scores above 0, all if fewer.

    Terms are lower-cased runs of ASCII letters, digits and characters beyond ASCII; an item's terms count once each. Equal scores
    are ordered by doc_id, null ids first. Null and wordless texts have no terms: such documents are not counted, such items
    have no row. Repeated documents are ranked each on their own. Items that repeat id and text count once; those of
    one id and different texts are ranked each, under that id. Other columns are ignored. A text is held whole in its task.

    Items go in blocks of bounded size, each with an index and one scan of the texts of its own.
    """
    spark, src = docs.sparkSession, input_texts(docs, id_col, text_col)
    kind = items.schema[item_col].dataType.simpleString()
    parts = []
    for block in _item_blocks(items, item_col, item_text_col):
        names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}"))
        parts.append(_search_block(src, block, k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, parts or [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")])
