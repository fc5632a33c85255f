"""Packing token sequences: documents of more than a third of a sequence are matched in pairs, smaller ones best-fit the gaps.

Pieces of one length are alike to a packing, so it is found on the histogram of lengths, which has as many numbers as
a sequence has places, whatever the input's size. What is found is a table of entries: of the pieces of a length, those
from this rank to that rank go to these sequences, so many to each, at this place. Spark counts the pieces, ranks
them within their lengths, and looks each one's entry up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_IDS, input_texts, kept, stored, text_blocks, trim
from .word_encoder import WordEncoder

#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 6 << 20
_RANKS = 44  # bits of a rank within a length


@dataclass
class Bins:
    """``n`` equally filled sequences from number ``first`` on; an entry is (length, pieces in each, offset, first rank)."""

    first: int
    n: int
    used: int
    entries: tuple[tuple[int, int, int, int], ...]

    def split(self, n: int) -> tuple[Bins, Bins]:
        later = tuple((size, each, at, rank + n * each) for size, each, at, rank in self.entries)
        return Bins(self.first, n, self.used, self.entries), Bins(self.first + n, self.n - n, self.used, later)


class Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        assert capacity < 1 << (63 - _RANKS) and all(0 < size <= capacity for size in counts)
        self.left, self.capacity = dict(counts), capacity
        self.rank = dict.fromkeys(counts, 0)
        self.total = 0
        self.done: list[Bins] = []
        self.open: dict[int, list[Bins]] = {}  # by gap
        self.gaps: list[int] = []

    def _keep(self, bins: Bins) -> None:
        gap = self.capacity - bins.used
        if not bins.n:
            return
        if not gap:
            self.done.append(bins)
            return
        if gap not in self.open:
            self.open[gap] = []
            insort(self.gaps, gap)
        self.open[gap].append(bins)

    def _take(self, gap: int) -> Bins:
        bins = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap], self.gaps[bisect_left(self.gaps, gap)]
        return bins

    def _new(self, n: int) -> Bins:
        self.total += n
        return Bins(self.total - n, n, 0, ())

    def _put(self, bins: Bins, size: int, each: int) -> Bins:
        entry = (size, each, bins.used, self.rank[size])
        self.rank[size] += bins.n * each
        self.left[size] -= bins.n * each
        return Bins(bins.first, bins.n, bins.used + size * each, (*bins.entries, entry))

    def match(self, large: list[int]) -> None:
        """The largest piece takes the largest other one that fits, as long as one does: at most two in a sequence."""
        for a in sorted(large, reverse=True):
            partners = [b for b in sorted(large, reverse=True) if b <= min(a, self.capacity - a)]
            for b in partners:
                n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                if n and a == b:
                    self._keep(self._put(self._new(n), a, 2))
                elif n:
                    self._keep(self._put(self._put(self._new(n), a, 1), b, 1))
                if not self.left[a]:
                    break
            self._keep(self._put(self._new(self.left[a]), a, 1))

    def fit(self, small: list[int]) -> None:
        """From the longest on, each piece goes into the smallest gap that holds it, or starts a sequence.

        The gap that is left in a sequence just used is the smallest again if it still holds one, so a sequence takes as
        many pieces of the length as go into it before the next one is touched.
        """
        for size in sorted(small, reverse=True):
            while self.left[size]:
                at = bisect_left(self.gaps, size)
                if at < len(self.gaps):
                    bins = self._take(self.gaps[at])
                else:
                    bins = self._new(-(-self.left[size] // (self.capacity // size)))
                each = (self.capacity - bins.used) // size
                whole = min(bins.n, self.left[size] // each)
                some, rest = bins.split(whole or 1)
                self._keep(rest)
                self._keep(self._put(some, size, each if whole else self.left[size]))

    def pack(self) -> list[Bins]:
        large = [size for size in self.left if 3 * size > self.capacity]
        self.match(large)
        self.fit([size for size in self.left if 3 * size <= self.capacity])
        return self.done + [b for same in self.open.values() for b in same]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Entries sorted by (length, first rank): ``key, length, rank, each, offset, sequence`` of the packing of a histogram.

    At most as many kinds of sequences as three times the distinct lengths come out, each of at most some
    square root of the capacity entries.
    """
    found = [(size, rank, each, at, b.first) for b in Packer(counts, capacity).pack() for size, each, at, rank in b.entries]
    table = np.array(sorted(found), np.int64).reshape(-1, 5).T
    names = ("length", "rank", "each", "offset", "sequence")
    return {"key": (table[0] << _RANKS) + table[1]} | dict(zip(names, table, strict=True))


def placed(entries: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their lengths and ranks."""
    e = np.searchsorted(entries["key"], (length << _RANKS) + rank, "right") - 1
    within, each = rank - entries["rank"][e], entries["each"][e]
    return entries["sequence"][e] + within // each, entries["offset"][e] + within % each * length


_PIECES = pa.schema(
    [("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)
_PIECES_SQL = "part int, nth long, doc_id long, piece int, start long, length long, ids binary"


def _encode(tokenizer: str, end_id: int, capacity: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("word encoder", tokenizer, end_id), lambda: WordEncoder(tokenizer, end_id))
        part, width = TaskContext.get().partitionId(), encoder.kind.itemsize
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this part
        for ids, texts in text_blocks(batches, block_bytes):
            strings = ["" if t is None else t.decode("utf-8", "replace") for t in texts]
            data = encoder.encode(strings)
            n = np.fromiter(map(len, data), np.int64, len(data)) // width
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(data)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            sizes, first, times = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(first - seen[sizes], times)
            seen[sizes] += times
            ends = np.cumsum(length) * width
            flat = b"".join(data)
            for a, b in _ranges(ends):
                base = int(ends[a - 1]) if a else 0
                offsets = np.concatenate([[0], ends[a:b] - base]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat[base : int(ends[b - 1])])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, np.int32)), pa.array(nth[a:b]), pa.array(ids, pa.int64()).take(pa.array(doc[a:b])),
                        pa.array(piece[a:b].astype(np.int32)), pa.array(start[a:b]), pa.array(length[a:b]), raw,
                    ],
                    schema=_PIECES,
                )
            trim()
        trim()

    return run


def _ranges(ends: np.ndarray, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive pieces of about ``limit`` bytes."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, *, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = ENCODE_BYTES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset`` of every piece of every document.

    A document is the ids of its text (null: empty) and ``end_id``; only one of more than ``capacity`` ids is cut, into pieces
    of that many, the last of what remains. ``ids`` are little-endian uint16 (uint32 for vocabularies beyond 65536), the checksum is that of
    uint32. Sequences are numbered from 0 and filled from place 0 without gaps. Rows are packed each on its own, whether
    their ids are null, repeated or not; an empty table gives no row. Other columns are ignored. A text is held whole in its task.

    Pieces are stored once; texts and ids are never shuffled, unless the counts by part and length pass ``BROADCAST_IDS`` rows.
    """
    spark = docs.sparkSession
    src = input_texts(docs, id_col, text_col)
    pieces = stored(src.mapInArrow(_encode(tokenizer, end_id, capacity, block_bytes), _PIECES_SQL), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    entries = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_IDS else bases.hint("merge")
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = entries.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = placed(found, length, rank)
            width = [len(x) // n if n else 2 for x, n in zip(_views(batch.column(4)), length.tolist(), strict=True)]
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(_views(batch.column(4)), width, strict=True)]
            columns = [*batch.columns[:5], pa.array(crc, pa.int64()), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def _views(column: pa.Array) -> Iterator[memoryview]:
    return (x.as_buffer() for x in column)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the packed sequences themselves, from the rows of ``pack``.

    ``doc_ids`` and ``lengths`` say whose pieces lie in a sequence and how long each is (for masks and positions); a sequence
    has at most ``capacity`` pieces.
    """
    row = F.struct("offset", F.coalesce("doc_id", F.lit(-1)).alias("order"), "doc_id", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    # Bytes are joined as hexadecimal text: Spark has no join of an array of binaries.
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
