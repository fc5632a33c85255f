"""Ranked lexical search against scores of every document by the formula."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame
from tidewheel.llm import lexical_search as ls
from tidewheel.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in TERM.findall(text or "")]


def by_hand(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    split = [(d, Counter(terms(t))) for d, t in docs]
    split = [(d, c, sum(c.values())) for d, c in split if c]
    n, words = len(split), sum(x for _, _, x in split)
    df = Counter(t for _, c, _ in split for t in c)
    rows = []
    for item, text in set(items):
        scores = []
        for d, c, size in split:
            m = 100 - 50 + (50 * size * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        rows += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scores)[:k])]
    return rows


def same(found: DataFrame, docs: list[tuple], items: list[tuple], k: int) -> None:
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(by_hand(docs, items, k), key=key)


def tables(spark, docs: list[tuple], items: list[tuple]) -> tuple[DataFrame, DataFrame]:
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item int, terms string").repartition(5)
    return left, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, n int")


ITEMS = [(1, "Alpha beta, GAMMA! delta"), (2, None), (3, "-- ,"), (1, "zeta"), (1, "zeta"), (4, "nowhere"), (None, "alpha é Été"), (5, "a " * 40 + "b c d e"), (6, "w0 w1 w2 w3")]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_scores_of_all(spark, monkeypatch, seed):
    rng = random.Random(seed)
    some = ["alpha", "Beta", "gamma", "delta", "zeta", "é", "Été", "a", "b", "c", *(f"w{i}" for i in range(30))]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "zeta"), (8, None), (9, ""), (10, " ,;")]
    docs.append((2000, "alpha " * 30_000 + "beta zeta"))
    if seed:  # many blocks of documents and of items
        monkeypatch.setattr(ls, "BLOCK_DOCS", 9), monkeypatch.setattr(ls, "BLOCK_TERMS", 6 if seed > 1 else 100), monkeypatch.setattr(ls, "MERGE", 2)
    left, right = tables(spark, docs, ITEMS)
    same(search(left, right, k=10), docs, ITEMS, 10)


def test_empty_tables(spark):
    left, right = tables(spark, [(1, "alpha"), (2, None)], ITEMS)
    assert search(left.limit(0), right).count() == 0
    assert search(left, right.limit(0)).count() == 0
    same(search(left, right), [(1, "alpha"), (2, None)], ITEMS, 50)


def test_bounds_enclose_the_score():
    tf, m = np.arange(1, 4000), np.repeat([50, 51, 99, 5000, 60_000_000], 800)[:3999]
    exact = ls.impact(tf, m)
    steps = -(-exact // ls.STEP)
    assert exact.max() < ls.IMPACTS and steps.max() <= 255
    assert (steps * ls.STEP >= exact).all() and ((steps - 1) * ls.STEP + 1 <= exact)[exact > 0].all()
