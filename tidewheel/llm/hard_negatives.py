"""Hard-negative mining behind a pivot table.

Scores are inner products of integer vectors. With one more place, ``sqrt(M - |x|^2)`` for rows (M: the largest squared length)
and 0 for queries, they become Euclidean distances: ``|q' - x'|^2 = |q|^2 + M - 2 q.x``. Every row stores its distances to a few
pivots, and by the triangle inequality the distance of a query from a row lies between the difference and the sum of theirs
from any pivot: this brackets the score without the row's vector. Rows that the brackets leave are scored exactly.

Rows lie in at most ``BLOCKS`` blocks of one range of labels and pivots each, and the blocks' own brackets, a table of bounded size, say
which blocks a query has to visit: first those that promise most, then, with the scores found there, all that can still hold
a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ROW, numbered, stored, trim

PIVOTS = 16
#: Numbers of the sample that pivots are chosen from: 16 MB.
SAMPLE_NUMBERS = 1 << 21
#: Blocks at most, and bytes of vectors in one while there are fewer.
BLOCKS, BLOCK_BYTES = 8192, 4 << 20
#: Rows and queries that are scored together, and bytes of vectors of either.
CHUNK_ROWS, CHUNK_QUERIES, CHUNK_BYTES = 4096, 512, 1 << 20
#: Bytes of queries on their way to the blocks that may be broadcast, so that the table stays where it is.
BROADCAST_BYTES = 64 << 20
#: Queries whose results a task holds at a time.
HELD = 20_000
#: Blocks that a query visits before its brackets are known.
FIRST = 2
#: Of a squared distance, for rounding.
SLACK = 1e-9
_WHOLE = float(1 << 53)


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, ``v`` in whole numbers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))  # NaN is above all in Spark
    kept = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(256.0 * c)).alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Space:
    """Numbers in a vector, the largest squared length, and pivots with their added place."""

    def __init__(self, size: int, longest: float, sample: np.ndarray):
        self.size, self.longest = size, longest
        self.exact = np.dtype(np.float64 if longest < _WHOLE else np.int64)
        self.pivots = choose_pivots(self.lifted(sample), PIVOTS) if len(sample) else np.zeros((1, size + 1))

    def together(self, most: int) -> int:
        return max(1, min(most, CHUNK_BYTES // (8 * self.size)))

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """Vectors as rows; shorter ones end in zeros."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(n), self.size), self.exact)
        row = np.repeat(np.arange(len(n)), n)
        flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x**2).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To every pivot, computed one by one: differences lose no places."""
        return np.sqrt(np.column_stack([((lifted - p) ** 2).sum(axis=1) for p in self.pivots]))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack([q.astype(float), np.zeros(len(q))]))

    def score(self, squared_length: np.ndarray, distance: np.ndarray, up: bool) -> np.ndarray:
        """The score that belongs to a distance, made larger or smaller by what rounding may have taken."""
        whole = squared_length + self.longest
        return (whole - distance**2 + (SLACK if up else -SLACK) * (whole + distance**2) + (1e-3 if up else -1e-3)) / 2


def space_of(rows: DataFrame) -> Space:
    """Pivots come from a sample of ``SAMPLE_NUMBERS`` numbers, by a hash of the rows."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    found = rows.agg(F.max(F.size("v")).alias("n"), F.max(square).alias("m")).first()
    size, longest = max(found["n"] or 0, 1), found["m"] or 0.0
    if longest >= 2.0**62:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    some = rows.orderBy(F.xxhash64("v", ROW), ROW).select("v").limit(max(PIVOTS, SAMPLE_NUMBERS // size)).toArrow()
    empty = Space(size, longest, np.zeros((0, size)))
    return Space(size, longest, empty.matrix(some["v"])) if some.num_rows else empty


def _near(shared):
    """Each row's nearest pivot and its distance from it, which the blocks are made by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = shared.value.distances(shared.value.lifted(shared.value.matrix(batch.column("v"))))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], [*batch.schema.names, "near", "far"]
            )

    return run


def _chunks(n: int, each: int) -> Iterator[slice]:
    return (slice(i, min(i + each, n)) for i in range(0, n, each))


_ROWS = f"vec_id long, label long, v array<long>, {ROW} long, near int, far double"
_CHUNK = "block int, n long, label_from long, label_to long, low array<double>, high array<double>, ids binary, rows binary, labels binary, vectors binary, pivots binary"


def _table(shared):
    """Rows of a partition as chunks of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, block = shared.value, TaskContext.get().partitionId()
        for batch in batches:
            for part in _chunks(batch.num_rows, space.together(CHUNK_ROWS)):
                b = batch.slice(part.start, part.stop - part.start)
                x = space.matrix(b.column("v"))
                d = space.distances(space.lifted(x))
                ids, rows, labels = (b.column(c).to_numpy() for c in ("vec_id", ROW, "label"))
                one = [block, len(x), int(labels.min()), int(labels.max()), d.min(axis=0).tolist(), d.max(axis=0).tolist()]
                one += [ids.tobytes(), rows.tobytes(), labels.tobytes(), x.tobytes(), d.tobytes()]
                types = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 5]
                names = ["block", "n", "label_from", "label_to", "low", "high", "ids", "rows", "labels", "vectors", "pivots"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types, strict=True)], names)

    return run


class Directory:
    """Brackets of the blocks: at most ``BLOCKS`` rows of a number for each pivot twice."""

    def __init__(self, table: DataFrame, pivots: int):
        ends = [F.min(F.get("low", F.lit(i))).alias(f"low{i}") for i in range(pivots)] + [F.max(F.get("high", F.lit(i))).alias(f"high{i}") for i in range(pivots)]
        rows = table.groupBy("block").agg(F.min("label_from").alias("first"), F.max("label_to").alias("last"), *ends).toPandas().sort_values("block")
        self.block, self.first, self.last = (rows[c].to_numpy(np.int64) for c in ("block", "first", "last"))
        self.low, self.high = (rows[[f"{end}{i}" for i in range(pivots)]].to_numpy(float) for end in ("low", "high"))


class Queries:
    """Query vectors and what they look for: in window j of query i the k highest scores from ``low[i, j]`` to ``high[i, j]``."""

    NAMES = ("anchors", "labels", "vectors", "low", "high")

    def __init__(self, space: Space, anchors: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.space, self.anchors, self.labels, self.vectors, self.low, self.high = space, anchors, labels, vectors, low, high
        self.squared = (vectors.astype(float) ** 2).sum(axis=1)[:, None]
        self.distances = space.query_distances(vectors)

    @classmethod
    def unpack(cls, space: Space, record: dict) -> Queries:
        anchors, labels, low, high = (np.frombuffer(record[c], np.int64) for c in ("anchors", "labels", "low", "high"))
        vectors = np.frombuffer(record["vectors"], space.exact).reshape(len(anchors), space.size)
        return cls(space, anchors, labels, vectors, low.reshape(len(anchors), -1), high.reshape(len(anchors), -1))

    def packed(self, which: np.ndarray) -> dict:
        return {c: getattr(self, c)[which].tobytes() for c in self.NAMES}

    def brackets(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of queries (rows) with what lies from ``low`` to ``high`` of each pivot (columns)."""
        shape = (len(self.anchors), len(low))
        least, most = np.zeros(shape), np.full(shape, np.inf)
        for i in range(low.shape[1]):
            at = self.distances[:, i : i + 1]
            np.maximum(least, low[None, :, i] - at, out=least)
            np.maximum(least, at - high[None, :, i], out=least)
            np.minimum(most, at + high[None, :, i], out=most)
        return self.space.score(self.squared, most, False), self.space.score(self.squared, least, True)


_SENT = "block int, anchors binary, labels binary, vectors binary, low binary, high binary"


def _route(shared, same: bool, first: bool):
    """The queries on their way to blocks: to those that promise most at first, then to the others that can still hold a score looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, directory = shared.value
        schema = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in Queries.NAMES)])
        for batch in batches:
            for part in _chunks(batch.num_rows, space.together(CHUNK_QUERIES)):
                b = batch.slice(part.start, part.stop - part.start)
                anchors, labels = (b.column(c).to_numpy() for c in ("anchor", "label"))
                low, high = (np.array(b.column(c).to_pylist(), np.int64).reshape(len(anchors), -1) for c in ("low", "high"))
                q = Queries(space, anchors, labels, space.matrix(b.column("v")), low, high)
                lower, upper = q.brackets(directory.low, directory.high)
                own = (directory.first <= labels[:, None]) & (labels[:, None] <= directory.last)
                may = own if same else ~(own & (directory.first == directory.last))
                promise = np.argsort(np.where(may, -upper, np.inf), axis=1, kind="stable")[:, :FIRST]
                early = np.zeros_like(may)
                np.put_along_axis(early, promise, True, axis=1)
                goes = may & (early if first else ~early) & (upper >= low.min(axis=1)[:, None]) & (lower <= high.max(axis=1)[:, None])
                sent = [q.packed(goes[:, j]) | {"block": int(directory.block[j])} for j in np.flatnonzero(goes.any(axis=0)).tolist()]
                yield pa.RecordBatch.from_pylist(sent, schema)

    return run


_FOUND = "anchor long, found array<struct<w: int, below: long, vec_id: long, row: long>>"
_FOUND_ARROW = pa.schema(
    [("anchor", pa.int64()), ("found", pa.list_(pa.struct([("w", pa.int32()), ("below", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])))]
)


def _matches(q: Queries, chunk: dict, same: bool, k: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """``anchor, window, (score below 0, vec_id, row)`` of the best rows of a chunk, by brackets first and then exactly."""
    ids, rows, labels = (np.frombuffer(chunk[c], np.int64) for c in ("ids", "rows", "labels"))
    d = np.frombuffer(chunk["pivots"]).reshape(len(ids), -1)
    lower, upper = q.brackets(d, d)
    fits = labels[None] == q.labels[:, None]
    fits = fits & (rows[None] != q.anchors[:, None]) if same else ~fits
    alive = np.zeros_like(fits)
    floors = q.low.copy()
    for j in range(q.low.shape[1]):
        low, high = q.low[:, j : j + 1], q.high[:, j : j + 1]
        sure = fits & (lower >= low) & (upper <= high)
        for i in np.flatnonzero(sure.sum(axis=1) >= k).tolist():  # the k-th largest lower bound of what is surely in the window
            floors[i, j] = max(floors[i, j], int(np.floor(np.partition(lower[i][sure[i]], -k)[-k])))
        alive |= fits & (upper >= floors[:, j : j + 1]) & (lower <= high)
    some = np.flatnonzero(alive.any(axis=0))
    if not len(some):
        return
    x = np.frombuffer(chunk["vectors"], q.space.exact).reshape(len(ids), -1)
    score = (q.vectors @ (x if len(some) == len(x) else x[some]).T).astype(np.int64)
    alive = alive[:, some]
    for j in range(q.low.shape[1]):
        hit = alive & (score >= floors[:, j : j + 1]) & (score <= q.high[:, j : j + 1])
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[i])
            if len(at) > k:
                at = at[score[i, at] >= np.partition(score[i, at], -k)[-k]]
            found = sorted((-int(score[i, c]), int(ids[some[c]]), int(rows[some[c]])) for c in at.tolist())
            yield int(q.anchors[i]), j, found[:k]


def _score(shared, same: bool, k: int):
    """``_FOUND``: of each query the best rows that this task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _ = shared.value
        best: dict[int, dict[int, list]] = {}

        def out() -> pa.RecordBatch:
            rows = [
                {"anchor": a, "found": [{"w": j, "below": s, "vec_id": v, "row": r} for j, x in w.items() for s, v, r in x]} for a, w in best.items()
            ]
            return pa.RecordBatch.from_pylist(rows, _FOUND_ARROW)

        for batch in batches:
            for r in range(batch.num_rows):
                record = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                for anchor, j, found in _matches(Queries.unpack(space, {c: record[f"q_{c}"] for c in Queries.NAMES}), record, same, k):
                    windows = best.setdefault(anchor, {})
                    windows[j] = sorted([*windows.get(j, ()), *found])[:k]
                if len(best) > HELD:
                    yield out()
                    best = {}
        yield out()
        trim()

    return run


class PivotTable:
    """Stored chunks of all rows, and their directory."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.space = space_of(rows)
        space = spark.sparkContext.broadcast(self.space)
        blocks = int(min(BLOCKS, max(1, -(-rows.count() * 8 * self.space.size // BLOCK_BYTES))))
        near = rows.mapInArrow(_near(space), _ROWS)
        order = ["label", "near", "far", ROW]
        self.chunks = stored(near.repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(_table(space), _CHUNK), "pivots")
        self.shared = spark.sparkContext.broadcast((self.space, Directory(self.chunks, len(self.space.pivots))))

    def _visit(self, queries: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        sent = stored(queries.select("anchor", "label", "v", "low", "high").mapInArrow(_route(self.shared, same, first), _SENT), "queries")
        sent = sent.select("block", *(F.col(c).alias(f"q_{c}") for c in Queries.NAMES))
        size = sent.agg(F.sum(sum(F.length(f"q_{c}") for c in Queries.NAMES))).first()[0] or 0
        chunks = self.chunks.select("block", "ids", "rows", "labels", "vectors", "pivots")
        return chunks.join(F.broadcast(sent) if size <= BROADCAST_BYTES else sent.hint("merge"), "block").mapInArrow(_score(self.shared, same, k), _FOUND)

    def search(self, queries: DataFrame, *, same: bool, k: int, windows: int) -> DataFrame:
        """``anchor, lists`` for ``queries(anchor, label, v, low, high)``: of each window the k best rows, best first."""
        first = stored(_merged(self._visit(queries, same, k, True), k, windows), "first")
        known = first.select("anchor", F.transform("lists", lambda x: -F.get(x, F.lit(k - 1))["below"]).alias("floors"))
        raised = F.zip_with("low", "floors", lambda a, b: F.greatest(a, F.coalesce(b, a)))
        again = queries.join(known, "anchor", "left").withColumn("low", F.coalesce(raised, "low"))
        more = self._visit(again, same, k, False)
        return _merged(first.select("anchor", F.flatten("lists").alias("found")).unionByName(more), k, windows)


def _merged(found: DataFrame, k: int, windows: int) -> DataFrame:
    """A query has a list from each task at most: at most ``BLOCKS`` of them, of k rows a window."""
    whole = found.groupBy("anchor").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    window = F.sequence(F.lit(0), F.lit(windows - 1))
    return whole.select("anchor", F.transform(window, lambda j: F.slice(F.filter("found", lambda x: x["w"] == j), 1, k)).alias("lists"))


def mine(
    rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the hard negatives of each anchor and positive.

    ``anchors`` is a condition on ``vec_id`` and ``label``. Vectors count in whole 256ths, rounded down; a score is an inner product, and higher ones come
    first, equal ones by smaller id. An anchor's positives are the first ``positives`` other rows of its label; a positive's negatives
    are the first ``negatives`` rows of other labels with a score of 80 to 100 hundredths of the positive's (none if that is below 0).

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Rows that repeat an id are rows of
    their own. Of vectors of different sizes the shorter one ends in zeros. Squared lengths of 2**62 (in 256ths) are an error. An
    empty table gives no row; other columns are ignored.
    """
    whole = numbered(usable(rows, id_col, label_col, vector_col), "vectors")
    table = PivotTable(whole)
    chosen = whole.filter(anchors).select(F.col(ROW).alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v")
    far = F.lit(1 << 62)
    queries = chosen.withColumn("low", F.array(-far)).withColumn("high", F.array(far))
    near = table.search(queries, same=True, k=positives, windows=1).select("anchor", F.col("lists")[0].alias("positives"))
    pairs = stored(chosen.join(near, "anchor"), "positives")
    score = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: -F.get("positives", j)["below"])
    some = score_windows(pairs.withColumn("s", score))
    found = table.search(some, same=False, k=negatives, windows=positives)
    each = pairs.join(found, "anchor").select("anchor_id", F.posexplode("positives").alias("j", "p"), "lists")
    each = each.select("anchor_id", "p", F.posexplode(F.col("lists")[F.col("j")]).alias("r", "n"))
    return each.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("r") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"),
        (-F.col("p.below")).alias("positive_score"), (-F.col("n.below")).alias("negative_score"),
    )


def score_windows(pairs: DataFrame) -> DataFrame:
    """``low`` and ``high`` for the positives' scores ``s``: from four fifths, rounded up, to the score; nothing for none or one below 0."""
    low = F.expr(f"transform(s, x -> if(x >= 0, x - x div 5, {1 << 62}))")
    high = F.expr(f"transform(s, x -> if(x >= 0, x, {-(1 << 62)}))")
    return pairs.withColumn("low", low).withColumn("high", high)
