"""Leading eigenvectors of normalised affinities in blocks, and k-means over them: spectral clustering without a square matrix.

A group's members are dealt to blocks by a hash; an affinity is a table of dense blocks of about ``BLOCK`` rows and columns, of which
only one half is stored. A product with a tall matrix joins blocks and rows on the block's column and sums by its row. Orthogonal iteration
keeps a few more vectors than asked for; the driver sees only their Gram matrices, some dozen rows and columns a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import checkpointed
from .cluster import SEED, k_means

#: Members of a block; vectors beyond those asked for; bytes of sums that a task holds.
BLOCK, MORE, HELD_BYTES = 256, 8, 32 << 20
#: Members of a group that starts of k-means are tried on.
SAMPLE = 2048


def _dense(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


class Affinity:
    """Blocks of ``D^-1/2 W D^-1/2`` of each group for the pairs ``group..., i, j, w`` and the members ``group..., member``.

    The diagonal of W does not count; a member without affinity has degree 1 and a one on the diagonal, so that 1 minus the eigenvalues are those of the
    usual Laplacian. Groups are known by their key ``_g``, their columns as JSON.
    """

    def __init__(self, pairs: DataFrame, members: DataFrame, group: list[str], block: int = BLOCK):
        self.group = group
        key = F.to_json(F.struct(*group)) if group else F.lit("")
        one = pairs.select(key.alias("_g"), "i", "j", "w")
        both = one.select("_g", F.col("i").alias("member"), "w").unionByName(one.select("_g", F.col("j").alias("member"), "w"))
        degree = both.groupBy("_g", "member").agg(F.sum("w").alias("degree"))
        people = members.select(*group, key.alias("_g"), "member").distinct()
        sizes = people.groupBy("_g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("members"))
        dealt = people.join(sizes, "_g").join(degree, ["_g", "member"], "left").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
        lists = dealt.groupBy("_g", "block").agg(F.sort_array(F.collect_list(F.struct("member", F.coalesce("degree", F.lit(0.0)).alias("degree")))).alias("rows"))
        self.rows = checkpointed(lists)  # of a block's members, with their degrees
        self.people = people
        place = self.rows.select("_g", "block", F.size("rows").alias("n"), F.posexplode("rows").alias("place", "r"))
        place = place.select("_g", "block", "n", "place", "r.member", F.when(F.col("r.degree") > 0, F.sqrt("r.degree")).otherwise(1.0).alias("root"), (F.col("r.degree") == 0).alias("alone"))
        place = checkpointed(place)
        ends = [place.select("_g", F.col("member").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("block", "n", "place", "root"))) for e in "ij"]
        entry = one.join(ends[0], ["_g", "i"]).join(ends[1], ["_g", "j"]).withColumn("x", F.col("w") / F.col("root_i") / F.col("root_j"))
        turn = F.col("block_i") > F.col("block_j")
        sides = [F.when(turn, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}")).alias(n) for c, a, b, n in (
            ("block", "i", "j", "row"), ("block", "j", "i", "col"), ("n", "i", "j", "height"), ("n", "j", "i", "width"), ("place", "i", "j", "p"), ("place", "j", "i", "q"))]
        alone = place.filter("alone").select("_g", F.col("block").alias("row"), F.col("block").alias("col"), F.col("n").alias("height"), F.col("n").alias("width"), F.col("place").alias("p"), F.col("place").alias("q"), F.lit(1.0).alias("x"))
        entries = entry.select("_g", *sides, "x").unionByName(alone)
        lists = entries.groupBy("_g", "row", "col", "height", "width").agg(F.collect_list("p").alias("p"), F.collect_list("q").alias("q"), F.collect_list("x").alias("x"))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = []
                for r in range(b.num_rows):
                    height, width, row, col = (b.column(c)[r].as_py() for c in ("height", "width", "row", "col"))
                    p, q, x = (b.column(c)[r].values.to_numpy() for c in ("p", "q", "x"))
                    m = np.zeros((height, width))
                    m[p, q] = x
                    if row == col:
                        m[q, p] = x
                    data.append(m.tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_g", "row", "col", "width")), pa.array(data, pa.binary())], ["_g", "row", "col", "width", "m"])

        half = checkpointed(lists.mapInArrow(fill, "_g string, row int, col int, width int, m binary"))
        other = half.filter("row != col").select("_g", F.col("col").alias("row"), F.col("row").alias("col"), "width", "m", F.lit(True).alias("turned"))
        self.blocks = half.withColumn("turned", F.lit(False)).unionByName(other)

    def _times(self, state: DataFrame, turns: dict[str, np.ndarray]) -> DataFrame:
        """``_g, block, x, y`` with ``x`` the rows of ``state`` times their group's small matrix, and ``y`` the affinity times ``x``."""
        spark = state.sparkSession
        small = spark.sparkContext.broadcast(turns)

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = [(_dense(y, len(t)) @ t).tobytes() for y, t in zip(b.column("y").to_pylist(), (small.value[g] for g in b.column("_g").to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_g"), b.column("block"), pa.array(data, pa.binary())], ["_g", "block", "x"])

        now = checkpointed(state.select("_g", "block", "y").mapInArrow(turn, "_g string, block int, x binary"))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            held = 0

            def out() -> pa.RecordBatch:
                keys, data = list(sums), [m.tobytes() for m in sums.values()]
                return pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.string()), pa.array([r for _, r in keys], pa.int32()), pa.array(data, pa.binary())], ["_g", "block", "y"])

            for b in batches:
                for g, row, width, turned, m, x in zip(*(b.column(c).to_pylist() for c in ("_g", "row", "width", "turned", "m", "x")), strict=True):
                    p = small.value[g].shape[1]
                    a = _dense(m, width)
                    y = (a.T if turned else a) @ _dense(x, p)
                    if (g, row) in sums:
                        sums[g, row] += y
                        continue
                    sums[g, row] = y
                    held += y.nbytes
                    if held > HELD_BYTES:
                        yield out()
                        sums, held = {}, 0
            yield out()

        parts = self.blocks.join(now.withColumnRenamed("block", "col"), ["_g", "col"]).mapInArrow(products, "_g string, block int, y binary")

        def total(t: pa.Table) -> pa.Table:
            y = sum(np.frombuffer(v) for v in t.column("y").to_pylist())
            return pa.table({"_g": t.column("_g").slice(0, 1), "block": t.column("block").slice(0, 1), "y": pa.array([y.tobytes()], pa.binary())})

        found = parts.groupBy("_g", "block").applyInArrow(total, "_g string, block int, y binary")
        return checkpointed(now.join(found, ["_g", "block"], "left"))

    def _gram(self, state: DataFrame, left: str, right: str) -> dict[str, np.ndarray]:
        """Sums over a group's blocks of the transposed ``left`` times ``right``: one small matrix a group and task reaches the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                for g, n, a, c in zip(*(b.column(x).to_pylist() for x in ("_g", "n", left, right)), strict=True):
                    m = np.frombuffer(a).reshape(n, -1)
                    sums[g] = sums.get(g, 0) + m.T @ np.frombuffer(c).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["_g", "m"])

        out: dict[str, np.ndarray] = {}
        columns = dict.fromkeys(["_g", "n", left, right])
        sized = state.join(self.rows.select("_g", "block", F.size("rows").alias("n")), ["_g", "block"]).select(*columns)
        for r in sized.mapInArrow(run, "_g string, m binary").collect():
            out[r["_g"]] = out.get(r["_g"], 0) + np.frombuffer(r["m"])
        return {g: m.reshape(int(round(len(m) ** 0.5)), -1) for g, m in out.items()}

    def leading(self, k: int, *, tolerance: float = 1e-9, rounds: int = 100) -> tuple[DataFrame, dict[str, np.ndarray]]:
        """The ``k`` largest eigenvalues of each group, descending, and ``_g, block, y`` with their vectors as the columns of ``y``.

        Orthogonal iteration keeps the ``k + MORE`` eigenvalues largest in size. Where so many are more negative than the k-th is positive, as in kernels
        of a dozen members without clusters, the k-th may be missed; such small groups have whole spectra in ``cluster``.
        Rounds end when no group's residual is above ``tolerance``, or after ``rounds``.
        """
        sizes = {r["_g"]: r["n"] for r in self.rows.groupBy("_g").agg(F.sum(F.size("rows")).alias("n")).collect()}
        wide = {g: min(n, k + MORE) for g, n in sizes.items()}

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = [
                    np.random.default_rng([SEED, block]).standard_normal((n, wide[g])).tobytes()
                    for g, block, n in zip(*(b.column(c).to_pylist() for c in ("_g", "block", "n")), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column("_g"), b.column("block"), pa.array(data, pa.binary())], ["_g", "block", "y"])

        state = checkpointed(self.rows.select("_g", "block", F.size("rows").alias("n")).mapInArrow(begin, "_g string, block int, y binary"))
        turns = {g: _orthonormal(m) for g, m in self._gram(state, "y", "y").items()}
        for _ in range(rounds):
            state = self._times(state, turns)
            inner, square = self._gram(state, "x", "y"), self._gram(state, "y", "y")
            values, vectors, worst = {}, {}, 0.0
            for g, a in inner.items():
                found, c = np.linalg.eigh((a + a.T) / 2)
                some = np.argsort(-found)[: min(k, sizes[g])]
                values[g], vectors[g] = found[some], c[:, some]
                rest = np.einsum("ij,ij->j", c[:, some], square[g] @ c[:, some]) - found[some] ** 2
                worst = max(worst, float(rest.max()))
            # The difference of squares has lost half of the places: below this it is noise.
            if worst <= max(tolerance**2, 1e-15):
                break
            turns = {g: _orthonormal(m) for g, m in square.items()}
        return state, {g: (values[g], vectors[g]) for g in values}


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes vectors of this Gram matrix orthonormal; those that others make up are dropped."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > values.max() * 1e-13
    return vectors[:, kept] / np.sqrt(values[kept])


def eigenvectors(affinity: Affinity, k: int, **options: float) -> DataFrame:
    """``group..., member, degree, values, vector, residual``: for each member its places in the ``k`` leading eigenvectors.

    ``values`` are the group's eigenvalues of the normalised affinity in descending order, fewer where it has fewer members; ``residual`` is the
    largest length of affinity times vector minus value times vector.
    """
    state, found = affinity.leading(k, **options)
    small = state.sparkSession.sparkContext.broadcast(found)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for g, x, y, members in zip(*(b.column(c).to_pylist() for c in ("_g", "x", "y", "rows")), strict=True):
                values, c = small.value[g]
                v, z = _dense(x, len(c)) @ c, _dense(y, len(c)) @ c
                off = ((z - v * values) ** 2).sum(axis=0)
                rows += [{"_g": g, "block_off": off.tolist() if not i else None, "values": values.tolist(), "vector": v[i].tolist()} | m for i, m in enumerate(members)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    kind = affinity.people.schema["member"].dataType
    lists = [(c, pa.list_(pa.float64())) for c in ("values", "vector", "block_off")]
    arrow = pa.schema([("_g", pa.string()), ("member", to_arrow_type(kind)), ("degree", pa.float64()), *lists])
    joined = state.join(affinity.rows, ["_g", "block"]).select("_g", "x", "y", "rows")
    out = checkpointed(joined.mapInArrow(split, f"_g string, member {kind.simpleString()}, degree double, values array<double>, vector array<double>, block_off array<double>"))
    off = out.filter("block_off is not null").select("_g", F.posexplode("block_off").alias("n", "o")).groupBy("_g", "n").agg(F.sum("o").alias("o"))
    residual = off.groupBy("_g").agg(F.sqrt(F.max("o")).alias("residual"))
    return affinity.people.join(out.drop("block_off"), ["_g", "member"]).join(residual, "_g").drop("_g")


def spectral_clusters(pairs: DataFrame, members: DataFrame, group: list[str], k: int, *, by: str | None = None, block: int = BLOCK, rounds: int = 100) -> DataFrame:
    """``group..., member, x, label, inertia, values, residual`` of spectral clustering into ``k``: k-means over ``x``, the leading eigenvectors over the roots
    of the degrees. The column ``by`` of the group, if named, says into how many (``k`` at most) each group goes.

    Starts of k-means are tried on at most ``SAMPLE`` members of a group, chosen by a hash; from the best one on all members are
    assigned and the centres moved until no label changes. A group of fewer members than ``k`` has one cluster for each.
    """
    found = eigenvectors(Affinity(pairs, members, group, block), k)
    root = F.when(F.col("degree") > 0, F.sqrt("degree")).otherwise(1.0)
    key = F.to_json(F.struct(*group)) if group else F.lit("")
    vector = F.slice("vector", F.lit(1), F.col(by)) if by else F.col("vector")
    maps = checkpointed(found.select(*group, key.alias("_g"), "member", F.transform(vector, lambda x: x / root).alias("x"), "values", "residual"))
    order = Window.partitionBy("_g").orderBy(F.xxhash64("member"), "member")
    sample: dict[str, list] = {}
    for r in maps.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE).select("_g", "member", "x").collect():
        sample.setdefault(r["_g"], []).append((r["member"], r["x"]))
    centres = {g: k_means(np.array([x for _, x in sorted(rows)]), len(rows[0][1]))[1] for g, rows in sample.items()}
    spark = maps.sparkSession
    for _ in range(rounds):
        sums = _moved(maps, spark.sparkContext.broadcast(centres))
        new = {g: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[g]) for g, (s, n) in sums.items()}
        still = all(np.allclose(new[g], centres[g], atol=1e-12) for g in new)
        centres = new
        if still:
            break
    final = spark.sparkContext.broadcast(centres)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = [((final.value[g] - np.asarray(x)) ** 2).sum(axis=1) for g, x in zip(frame["_g"], frame["x"], strict=True)]
            yield frame.drop(columns="_g").assign(label=[int(d.argmin()) for d in near], off=[float(d.min()) for d in near])

    fields = ", ".join(f"{c} {maps.schema[c].dataType.simpleString()}" for c in [*group, "member", "x", "values", "residual"])
    out = checkpointed(maps.select(*group, "_g", "member", "x", "values", "residual").mapInPandas(label, f"{fields}, label int, off double"))
    inertia = out.groupBy(*group).agg(F.sum("off").alias("inertia"))
    return out.drop("off").join(inertia, group) if group else out.drop("off").crossJoin(F.broadcast(inertia))


def _moved(maps: DataFrame, shared) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums and sizes of each group's clusters; a row a group and task reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for g, some in frame.groupby("_g")["x"]:
                x, c = np.array(some.tolist(), float), shared.value[g]
                one = np.eye(len(c))[((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)]
                s, n = sums.get(g, (0, 0))
                sums[g] = s + one.T @ x, n + one.sum(axis=0)
        yield pd.DataFrame([(g, s.tobytes(), n.tobytes()) for g, (s, n) in sums.items()], columns=["_g", "s", "n"])

    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in maps.select("_g", "x").mapInPandas(run, "_g string, s binary, n binary").collect():
        n = np.frombuffer(r["n"])
        s, before = out.get(r["_g"], (0, 0))
        out[r["_g"]] = s + np.frombuffer(r["s"]).reshape(len(n), -1), before + n
    return out
