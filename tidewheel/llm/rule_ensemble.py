"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees propose rules (the conditions on the way to each of their nodes), a logistic model with an L1
penalty weighs them, and the rules with weights left are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics as st
from .quality_rules import labelled_sample, rule_statistics
from .runtime import Stored, held_out, learns

LABELLED = 20_000
Rule = tuple[tuple[int, bool, float], ...]


def _best_split(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[int, float] | None:
    best, where, total, n = 1e-9, None, r.sum(), len(r)
    for f, values in enumerate(cuts):
        if not len(values):
            continue
        slot = np.searchsorted(values, x[:, f], "left")  # x <= values[k] exactly where slot <= k
        count = np.cumsum(np.bincount(slot, minlength=len(values) + 1))[:-1]
        sums = np.cumsum(np.bincount(slot, r, minlength=len(values) + 1))[:-1]
        ok = (count >= least) & (n - count >= least)
        if ok.any():
            gain = np.full(len(values), -np.inf)
            gain[ok] = sums[ok] ** 2 / count[ok] + (total - sums[ok]) ** 2 / (n - count[ok]) - total**2 / n
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (f, float(values[k]))
    return where


def _applies(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, cut in rule:
        out &= x[:, f] > cut if over else x[:, f] <= cut
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 11) -> list[Rule]:
    """Distinct paths of trees boosted on the log-loss gradient, each grown on a random half of the rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[: max(2, len(y) // 2)]
        usable = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        todo: list[tuple[Rule, np.ndarray]] = [((), rows)]
        while todo:
            rule, here = todo.pop()
            split = _best_split(x[here], residual[here], usable, max(5, len(rows) // 200)) if len(rule) < depth else None
            if split is None:
                if rule:
                    inside = _applies(x, rule)
                    step = residual[here].sum() / max(1e-6, (np.abs(residual[here]) * (1 - np.abs(residual[here]))).sum())
                    margin[inside] += 0.3 * np.clip(step, -4, 4)
                continue
            f, cut = split
            for over in (False, True):
                deeper = (*rule, (f, over, cut))
                rules[tuple(sorted(deeper))] = None
                todo.append((deeper, here[(x[here, f] > cut) == over]))
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of mean log-loss + ``penalty`` * |weights|, by accelerated proximal gradient."""
    n, k = z.shape
    size = np.linalg.norm(z, 2) ** 2 / (4 * n) + 0.25
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        new_w = vw - z.T @ g / n / size
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - penalty / size, 0)
        new_b = vb - g.mean() / size
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


@dataclass
class RuleEnsemble:
    fields: list[str]
    rules: list[tuple[Rule, float]]
    intercept: float

    @classmethod
    def fit(
        cls, x: np.ndarray, y: np.ndarray, fields: list[str], *, trees: int = 40, depth: int = 3, penalty: float = 5e-4
    ) -> RuleEnsemble:
        """With one class, or no rows, the score is constant: the smoothed share of label 1."""
        share = (y.sum() + 1) / (len(y) + 2)
        if not len(y) or y.min() == y.max():
            return cls(fields, [], float(np.log(share / (1 - share))))
        rules = tree_rules(x, y, trees, depth)
        if not rules:
            return cls(fields, [], float(np.log(share / (1 - share))))
        z = np.column_stack([_applies(x, r) for r in rules]).astype(float)
        w, b = lasso_logistic(z, y, penalty)
        return cls(fields, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            margin[_applies(x, rule)] += w
        return 1 / (1 + np.exp(-margin))

    def column(self) -> Column:
        """The score as an expression of the columns ``fields``, grouped so that no sum nests deeply."""
        terms = []
        for rule, w in self.rules:
            hit = F.lit(True)
            for f, over, cut in rule:
                c = F.col(self.fields[f])
                hit = hit & (c > F.lit(cut) if over else c <= F.lit(cut))
            terms.append(F.when(hit, F.lit(w)).otherwise(F.lit(0.0)))
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        margin = F.lit(self.intercept) + terms[0] if terms else F.lit(self.intercept)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, modulus: int = 3, held: int = 1, limit: int = LABELLED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    The model learns from at most ``limit`` labelled rows (chosen by a hash of their id) whose
    crc32(doc_id as text) mod ``modulus`` is not ``held``; statistics and scores cover every row.

    A null text counts as an empty one. Rows with a null id are scored, never learnt from, and not held out. A label
    repeated for an id counts once (the largest); rows that share an id are scored each by its own text. With no usable labels, or
    labels of one kind, the score is the smoothed share of label 1. A text is held whole in its task. Other columns are ignored.
    """
    stats = Stored(rule_statistics(docs, id_col, text_col), "quality-stats").df
    x, y = labelled_sample(stats.filter(learns(modulus, held)), labels, st.MODEL_FIELDS, limit)
    model = RuleEnsemble.fit(x, (y > 0).astype(float), st.MODEL_FIELDS)
    scored = stats.select("doc_id", held_out(modulus, held).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
