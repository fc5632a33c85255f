"""Gaussian kernels of numbers as products of a tall, narrow matrix with itself: spectral clustering whose memory grows with the members only.

On numbers between 0 and 1 the series of exp(2 gamma x y) ends after some twenty terms in the last digit of a double, so the product is the kernel itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import SMALL_COHORT, matrix_of, scores, spectral_cells
from .evolve import Cohort, Leading, Narrow


def factor(x: np.ndarray, gamma: float) -> np.ndarray:
    """``f`` with ``f @ f.T`` = exp(-gamma (x - y)**2) for numbers between 0 and 1."""
    y, term, n = x - 0.5, 1.0, 0
    columns = [np.exp(-gamma * y**2)]
    while term > 1e-18:
        n += 1
        columns.append(columns[-1] * y * np.sqrt(2 * gamma / n))
        term *= gamma / 2 / n
    return np.array(columns).T


def scaled(x: np.ndarray) -> np.ndarray:
    """Numbers scaled to 0..1; there must be two that differ."""
    return (x - x.min()) / (x.max() - x.min())


def search(rows: DataFrame, group: list[str], clusters: list[int], gammas: list[float] | None = None, *, labels: bool = True) -> DataFrame:
    """``cluster.grid_search`` without eigenvalues over ``rows(group..., own, x)``: with ``gammas`` ``x`` is the scaled number of each class of members, else the
    rows of a kernel's factor (gamma -1). ``own`` says the class of each member. A cell's rows are dealt out by number."""
    number = gammas is not None
    jobs = rows.withColumn("_gamma", F.explode(F.array(*(F.lit(float(g)) for g in (gammas if number else [-1.0])))))
    jobs = jobs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = "".join(f"{g} {rows.schema[g].dataType.simpleString()}, " for g in group)
    names = ["s_distortion", "s_bic", "s_sil_km"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own, gamma = b.column("own")[r].values.to_numpy(), b.column("_gamma")[r].as_py()
                f = factor(b.column("x")[r].values.to_numpy(), gamma) if number else matrix_of(b.column("x")[r])
                if len(own) > SMALL_COHORT:
                    whole = Leading(Cohort(own, [np.arange(len(f))], [Narrow(f)]), np.ones(1), min(max(clusters), len(own)))
                    found = [(k, own_label[whole.own], whole.scores(own_label, *rest)) for k in clusters for own_label, *rest in [whole.k_means(k)]]
                else:
                    found = [(k, result["labels"], scores(result)) for _, k, result in spectral_cells([f[own] @ f[own].T], clusters)]
                columns = [b.column(g).take(pa.array([r] * len(found))) for g in group] + [pa.array([gamma] * len(found)), pa.array([k for k, _, _ in found], pa.int32())]
                columns += [pa.array([s[n] for _, _, s in found]) for n in names] + [pa.array([x for _, x, _ in found], pa.list_(pa.int32()))] * labels
                yield pa.RecordBatch.from_arrays(columns, [*group, "gamma", "clusters", *names, *["labels"] * labels])

    return jobs.mapInArrow(run, f"{fields}gamma double, clusters int, s_distortion double, s_bic double, s_sil_km double" + ", labels array<int>" * labels)
