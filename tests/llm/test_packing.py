"""Best-fit packing against an item-by-item version, and its ids against the untouched tokenizer."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewheel.llm.packing import pack, placed, plan, sequences
from tidewheel.llm.queries import op13_best_fit_packing, tokenizer_path
from tidewheel.llm.word_encoder import WordEncoder

WORDS = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(WORDS, 1, cache=5)


def one_by_one(lengths: list[int], capacity: int) -> int:
    """Sequences that the method takes, one piece at a time."""
    items, gaps = sorted(lengths, reverse=True), []
    large = [x for x in items if 3 * x > capacity]
    while large:
        a = large.pop(0)
        at = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        gaps.append(capacity - a - (large.pop(at) if at is not None else 0))
    for x in (x for x in items if 3 * x <= capacity):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - x)
    return len(gaps)


def gapless(rows: list[tuple[int, int, int]], capacity: int) -> None:
    """``rows`` are (sequence, offset, length)."""
    bins: dict[int, list] = {}
    for s, at, n in rows:
        bins.setdefault(s, []).append((at, n))
    assert sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([9, 10, 30, 64, 4096]), st.lists(st.integers(1, 4096), min_size=1, max_size=200), st.booleans())
def test_plan_equals_one_by_one(capacity, raw, few):
    lengths = [1 + x % (5 if few else capacity) for x in raw]
    seen, rank = Counter(), []
    for x in lengths:
        rank.append(seen[x])
        seen[x] += 1
    sequence, offset = placed(plan(dict(seen), capacity), np.array(lengths, np.int64), np.array(rank, np.int64))
    gapless(list(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)), capacity)
    assert len(set(sequence.tolist())) == one_by_one(lengths, capacity)


def test_large_ones_are_at_most_two_in_a_sequence():
    lengths = {5: 3, 4: 5, 3: 1}
    entries = plan(lengths, 10)
    rows = [(n, r) for n, k in lengths.items() for r in range(k)]
    sequence, _ = placed(entries, *np.array(rows, np.int64).T)
    assert max(Counter(s for s, (n, _) in zip(sequence.tolist(), rows, strict=True) if 3 * n > 10).values()) == 2


TEXTS = [
    "", "  ", "Don't STOP, it's we'll 've they're I'm he'd.", "ÀÉÎ straße ĲSSEL Ɓoat Ⱥ İstanbul", "x1y22 3½ ²³ a_b-c!!  ...\t\ttab\r\nline",
    "日本語 text", "é café", "a<|endoftext|>b <|startoftext|>", "\x00 nul \x0b", "a b c", "﻿x '' 'S 'lL", "word " * 300, "Z" * 5000,
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(max_size=40), st.text("aB'sStT.1 é\nƁ", max_size=40)), max_size=12))
def test_ids_equal_the_tokenizer(tokenizer, encoder, texts):
    for some in (texts, texts[::-1]):
        whole = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(some)]
        assert whole == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in some]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    encoder = WordEncoder(path, 2)
    assert not encoder.by_word
    assert np.frombuffer(encoder.encode(["a  b\n c"])[0], encoder.kind).tolist() == [*Tokenizer.from_file(path).encode("a  b\n c").ids, 2]


def held_to_brute_force(rows: list, texts: list[tuple], tokenizer, capacity: int) -> None:
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = Counter((d, i // capacity, i, len(x[i : i + capacity]), crc(x[i : i + capacity])) for d, x in ids for i in range(0, len(x), capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    gapless([(r.sequence_id, r.offset, r.length) for r in rows], capacity)
    assert len({r.sequence_id for r in rows}) == one_by_one([r.length for r in rows], capacity)


def test_pack_edges(spark, tokenizer):
    texts = [(None, "a b c"), (1, None), (1, ""), (2, "one two three four five"), (2, "one two three four five"), (3, "x " * 95), (4, "y " * 10 + "日本"), (5, "q")] + [
        (100 + i, "w " * (i % 7)) for i in range(40)
    ]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, length int, part int").repartition(5)
    packed = pack(docs, WORDS, capacity=10).cache()
    held_to_brute_force(packed.collect(), texts, tokenizer, 10)
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in packed.collect():
        s = whole[r.sequence_id]
        assert bytes(s.ids)[2 * r.offset : 2 * (r.offset + r.length)] == bytes(r.ids)
        assert r.doc_id in s.doc_ids and len(s.ids) == 2 * sum(s.lengths)
    assert pack(docs.limit(0), WORDS).count() == 0


def test_pack_without_broadcast(spark, tokenizer, monkeypatch):
    monkeypatch.setattr("tidewheel.llm.packing.BROADCAST_IDS", 0)
    texts = [(i, "a b " * (i % 30)) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    held_to_brute_force(pack(docs, WORDS, capacity=32).collect(), texts, tokenizer, 32)


def test_query_on_the_tables(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    held_to_brute_force(op13_best_fit_packing(spark, sf).collect(), [tuple(r) for r in docs], tokenizer, 4096)
