"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature has ``CHUNKS * WIDTH`` symbols of 8 bits, cut into ``CHUNKS`` chunks. By pigeonhole two signatures
that differ in at most ``2 * CHUNKS - 1`` symbols agree in some chunk but for ``ERRORS = 1`` symbol, so each chunk is
indexed once for each symbol left out; documents that share an index key are candidates. Pairs beyond that
distance that happen to share a key are candidates as well: every candidate is confirmed on full shingle sets.

Skew: documents with equal sets are one node. In a bucket all members are first tried against its smallest
member alone. Only buckets whose members then lie in different components are looked at again, and there only
pairs between different components, of which the largest group is on one side only. Members of such a bucket travel in
blocks, and each pair of blocks is a row of its own, so that a large bucket is many tasks. An odd sketch (the parity
of set elements per hash slot, as many slots as the set is large) bounds the symmetric difference from below, so pairs that it excludes
surely lie under the threshold; the others are confirmed on full sets, each of which is sent once for a thousand of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .runtime import Stored, input_texts, keep_ids, map_texts, scope, stored, trim

CHUNKS, WIDTH = 12, 6
SYMBOLS = CHUNKS * WIDTH
SKETCH_LONGS = 16
#: Members of a bucket in a block, and pairs of one document that its set is sent for at a time.
BLOCK, PAIRS = 1024, 1024
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, chunks array<long>, sketch binary"


def shingles(text: bytes | None, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of the lower-cased text.

    Fewer words than ``width`` make one shingle; no words make none.
    """
    h = tx.hash_words(tx.space_words(text, lower=True))
    if not len(h):
        return h
    return np.unique(tx.gram_hashes(h, min(width, len(h)) if len(h) < width else width))


def signature(s: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` bytes: the low bits of the mixed minima under as many multiply-add permutations."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return tx.mix(low).astype(np.uint8)


def chunk_values(sig: np.ndarray) -> np.ndarray:
    """Each chunk of a signature as an integer of ``8 * WIDTH`` bits."""
    wide = sig.reshape(CHUNKS, WIDTH).astype(np.int64)
    return (wide << (8 * np.arange(WIDTH, dtype=np.int64))).sum(axis=1)


def odd_sketch(s: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """Parity of the number of elements in each of ``64 * longs`` slots, as longs.

    A slot's number is the low bits of a hash, so halves laid on each other give the smaller sketch.
    """
    slots = (tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * longs - 1)).astype(np.int64)
    odd = (np.bincount(slots, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def sketch_longs(n: int) -> int:
    """Size of the sketch of ``n`` elements: a power of 2 times ``SKETCH_LONGS``, with a slot for each element."""
    longs = SKETCH_LONGS
    while 64 * longs < n:
        longs *= 2
    return longs


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """A sketch (or rows of them) brought to fewer slots, as if it had been made with them."""
    while sketch.shape[-1] > longs:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False only where size or sketch (of equal slots) prove that 100 * intersection < percent * union.

    With d elements in one set only, intersection = (na + nb - d) / 2 and union = (na + nb + d) / 2,
    and d is at least the number of slots whose parity differs.
    """
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * np.maximum(differ, np.abs(na - nb)) <= (100 - percent) * (na + nb)


def _describe(width: int):
    def work(ids: list, texts: list) -> dict:
        n, h1, h2, chunks, sketch = [], [], [], [], []
        for t in texts:
            s = shingles(t, width)
            n.append(len(s))
            if not len(s):
                h1.append(0), h2.append(0), chunks.append([]), sketch.append(b"")
                continue
            digest = tx.xxhash.xxh3_128_digest(s.tobytes())
            a, b = np.frombuffer(digest, np.int64)
            h1.append(int(a)), h2.append(int(b))
            chunks.append(chunk_values(signature(s))), sketch.append(odd_sketch(s, sketch_longs(len(s))).tobytes())
        return {"doc_id": ids, "n_shingles": n, "h1": h1, "h2": h2, "chunks": chunks, "sketch": sketch}

    return work


def _sets_of(width: int):
    def work(ids: list, texts: list) -> dict:
        sets = [shingles(t, width).tobytes() for t in texts]
        return {"doc": ids, "digest": np.array([tx.xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64), "set": sets}

    return work


def _index_keys() -> Column:
    """The chunk values with one symbol blanked, tagged with the chunk's and the symbol's number."""
    keys = [
        F.col("chunks")[c].bitwiseAND(F.lit(((1 << 8 * WIDTH) - 1) ^ (0xFF << 8 * e))).bitwiseOR(
            F.lit((c * WIDTH + e) << 8 * WIDTH)
        )
        for c in range(CHUNKS)
        for e in range(WIDTH)
    ]
    return F.explode(F.array(*keys))


def _star_pairs(percent: int):
    """Of rows ``a, b, na, sa, nb, sb`` the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = min(len(x), len(y))
                keep.append(bool(_may_link(na[i], folded(x, n), nb[i], folded(y, n), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _block_pairs(percent: int):
    """Of rows (main, block, block) the pairs of members that may link and lie in different components.

    Members of the bucket's main component are on one side only, as pairs of two others are in the order of their components.
    """

    def side(column: pa.Array, r: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        rows = column[r].values
        doc, comp, n = (np.asarray(rows.field(f)) for f in ("doc", "comp", "n_shingles"))
        sketches = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("sketch")]
        return [doc, comp, n], np.array([len(x) for x in sketches]), sketches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                main = batch.column(0)[r].as_py()
                (da, ca, na), la, sa = side(batch.column(1), r)
                (db, cb, nb), lb, sb = side(batch.column(2), r)
                found = []
                # Sets whose sizes may link differ by little, so their sketches have at most two sizes; members go by theirs.
                for longs in np.unique(la):
                    i = np.flatnonzero(la == longs)
                    x = np.array([sa[k] for k in i])
                    for other in np.unique(lb):
                        j = np.flatnonzero(lb == other)
                        few = min(longs, other)
                        y = folded(np.array([sb[k] for k in j]), few)
                        z = folded(x, few)
                        step = max(1, (1 << 22) // (len(j) * few))
                        for at in range(0, len(i), step):
                            p = i[at : at + step]
                            ok = np.abs(na[p][:, None] - nb[j]) * (100 + percent) <= (100 - percent) * (na[p][:, None] + nb[j])
                            ok &= (ca[p][:, None] != main) & (ca[p][:, None] != cb[j]) & ((cb[j] == main) | (ca[p][:, None] < cb[j]))
                            u, v = np.nonzero(ok)
                            for k in range(0, len(u), 1 << 16):
                                a, b = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                                good = _may_link(na[p[a]], z[at + a], nb[j[b]], y[b], percent)
                                found.append((da[p[a[good]]], db[j[b[good]]]))
                if found:
                    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                    for k in range(0, len(a), 1 << 16):
                        low, high = np.minimum(a, b)[k : k + (1 << 16)], np.maximum(a, b)[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])
        trim()

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * intersection >= percent * union of their full sets.

    The set of ``b`` meets each pair by a join. The set of ``a`` comes as a row of its own before at most about ``PAIRS`` of its
    pairs, from which it is held in the task.
    """
    spark = pairs.sparkSession
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS)).cast("int").alias("parts"))
    parts = stored(parts, "near-parts")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    split = pairs.join(parts.hint("merge"), "a").select("a", "b", part)
    right = split.join(sets.toDF("b", "set").hint("merge"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "set")
    left = parts.join(sets.toDF("a", "set").hint("merge"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "set"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = left.union(right).repartition(n, "a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An id with several texts has several sets, on either side.
        own, at = [], None
        for batch in batches:
            keep, (a, part, kind) = [], (batch.column(i).to_pylist() for i in range(3))
            for i, s in enumerate(batch.column(4)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if not kind[i]:
                    own = [*own, s.copy()] if at == (a[i], part[i]) else [s.copy()]
                    at = a[i], part[i]
                    keep.append(False)
                    continue
                common = [len(np.intersect1d(x, s, assume_unique=True)) for x in own]
                keep.append(any(100 * c >= percent * (len(x) + len(s) - c) for x, c in zip(own, common, strict=True)))
            yield batch.select([0, 3]).filter(pa.array(keep, pa.bool_()))
        trim()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, percent: int = 80, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of lower-cased
    ``width``-word shingles; a component's id is its smallest doc_id, and that document is kept.

    A null or wordless text has 0 shingles, is linked with nothing and kept. A row with a null id gets a
    null component, links with nothing and is kept. Repeated rows get the same result each; if an id
    comes with several texts, it has the links of each. A text and its set are held whole in a task; of an id with
    very many texts all sets are. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    with scope():
        src = input_texts(docs, id_col, text_col)
        info = Stored(map_texts(src, lambda: _describe(width), SCHEMA), "near-info", keep=True).df
        linked = info.filter("n_shingles > 0 and doc_id is not null")
        groups = linked.groupBy("h1", "h2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("chunks").alias("chunks"),
            F.first("sketch").alias("sketch"),
        )
        reps = Stored(groups, "near-reps")

        keyed = reps.df.select(_index_keys().alias("key"), F.col("rep").alias("doc"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("hub")).filter("n > 1")
        members = Stored(keyed.join(shared.select("key", "hub").hint("merge"), "key"), "near-buckets")
        brief = reps.df.select(F.col("rep").alias("doc"), "n_shingles", "sketch")

        def links(pairs: DataFrame, name: str) -> DataFrame:
            """Confirmed links among ``pairs(a, b)``; sets are made anew, for documents in pairs only."""
            pairs = stored(pairs.select("a", "b").distinct(), f"near-{name}-pairs")
            ids = stored(pairs.select("a").union(pairs.select("b")).distinct().toDF("__tw_id"), f"near-{name}-ids")
            sets = map_texts(keep_ids(src, "doc_id", ids, ready=True), lambda: _sets_of(width), "doc long, digest long, set binary")
            # Rows of one id with the same text count once, and with several texts the id has the links of each.
            sets = stored(sets.dropDuplicates(["doc", "digest"]).drop("digest"), f"near-{name}-sets")
            return stored(_confirm(pairs, sets, percent), f"near-{name}-links")

        star = members.df.filter("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
        ends = star.join(brief.toDF("a", "na", "sa"), "a").join(brief.toDF("b", "nb", "sb"), "b")
        near_size = F.lit(100 + percent) * F.abs(F.col("na") - F.col("nb")) <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))
        star = ends.filter(near_size).select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_star_pairs(percent), "a long, b long")
        first = links(star, "star")
        comp = Stored(components(first), "near-comp")

        # Buckets that still hold several components: every pair across them, the largest on one side only.
        placed = members.df.select("key", "doc").join(
            comp.df.withColumnRenamed("node", "doc").hint("merge"), "doc", "left"
        ).select("key", "doc", F.coalesce("component", "doc").alias("comp"))
        placed = Stored(placed, "near-placed").df
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
        mixed = mixed.filter("k > 1").select("key", "main")
        mixed = Stored(mixed.join(parts.groupBy("key").agg(F.sum("n").alias("n")), "key"), "near-mixed").df
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        open_ = placed.join(mixed.select("key", "main", blocks.alias("blocks")).hint("merge"), "key").join(brief.hint("merge"), "doc")
        packed = open_.groupBy("key", "main", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block")).agg(
            F.collect_list(F.struct("doc", "comp", "n_shingles", "sketch")).alias("rows")
        )
        packed = Stored(packed, "near-open").df
        # Each pair of blocks in both orders, as the sides of a pair are not alike.
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        x = packed.select("key", "main", F.col("block").alias("i"), others.alias("j"), F.col("rows").alias("x"))
        y = packed.select("key", others.alias("i"), F.col("block").alias("j"), F.col("rows").alias("y"))
        spread = x.join(y.hint("merge"), ["key", "i", "j"]).select("main", "x", "y")
        more = links(spread.mapInArrow(_block_pairs(percent), "a long, b long"), "cross")
        # Components of the first round are stars already, so only their edges and the new links matter.
        edges = comp.df.toDF("a", "b").union(more)
        final = components(edges)

        moved = reps.df.join(final.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
            "h1", "h2", "n_shingles", "rep", "copies", F.coalesce("component", "rep").alias("component_id")
        ).filter("copies > 1 or component_id != rep").drop("copies", "rep")
        moved = stored(moved, "near-moved", keep=True)
    joined = info.select("doc_id", "n_shingles", "h1", "h2").join(
        moved.hint("merge"), ["h1", "h2", "n_shingles"], "left"
    )
    component = F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")
    ).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
