"""Token files and archives: exact round trips, damage, and edge cases."""

import json
import random
import zlib

import numpy as np
import pytest
from tidewheel.llm import token_files, warc
from tidewheel.llm.queries import tokenizer_path
from tidewheel.llm.token_files import Encoder, TokenStore, open_part, token_table
from tokenizers import Tokenizer

ODD = [
    "", "a", "\n", "a\n\nb", "a\n\n\nb", "a b\nc", "don't we'll  x", "a\n b", "a \nb", "1 2 ab12 x-y", "É é́ ñandú,", "あ x", "a\tb",
    "<|endoftext|> hi", "x" * 5000, "a\n\nb\nc d", "\x00a b", "a\x00 b", "''s 's", " 'll", "word. word, word!? word*** 's.", "²³ x² a.b.c 3,4", "a\x85b",
    "a b", "ƁƂ ɐ", "x |y |z", "12,345.67 Ab's.", "﻿a",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), cache=50)


def direct(encoder, texts):
    return [np.array(e.ids, encoder.kind).tobytes() for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_encode_as_whole_texts(encoder):
    assert encoder.encode(ODD) == direct(encoder, ODD)
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", " ", " ", "\n", ".", ",", "'", "s", "7", "-", "|", "ll", "$$"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for i in range(0, 800, 100):  # the small cache is dropped again and again
        assert encoder.encode(texts[i : i + 100]) == direct(encoder, texts[i : i + 100])


def test_added_tokens_have_the_ids_of_a_plain_tokenizer(spark, encoder, tmp_path):
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "a <|endoftext|> b c", "<|endoftext|>", "x<|endoftext|>y", "a <|endoftext b", "a <|endoftext| > b"]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.n_tokens, r.ids_crc32) for r in token_table(df, tokenizer_path(), folder=str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x in want]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    spec = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    changes = {
        "prefix": {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}},
        "blanks": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]]}},
    }
    texts = ["Plain words, and Plain words.", "a b\nc d", *ODD]
    for name, change in changes.items():
        path = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(spec | change))
        encoder, plain = Encoder(path), Tokenizer.from_file(path)
        assert not encoder.by_piece
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert Encoder(tokenizer_path()).by_piece


def test_shared_ids_null_ids_and_long_texts_in_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [f"text {i} " * (i % 7) for i in range(120)] + ["word " * 200_000]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(4)
    got = token_table(df, tokenizer_path(), folder=str(tmp_path)).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = [(i, *(lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())))([*plain.encode(t, add_special_tokens=False).ids, 2])) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)


def test_token_files_round_trip(spark, encoder, tmp_path):
    rng = random.Random(1)
    texts = [*ODD, None, *(" ".join(rng.choice(["the", "of", "Zürich", "42"]) for _ in range(50)) for _ in range(60))]
    ids = rng.sample(range(-50, 10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").repartition(5)
    got = [tuple(r) for r in token_table(df, tokenizer_path(), folder=f"file://{tmp_path}/t").orderBy("doc_id").collect()]
    want, start = [], 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        tokens = np.append(np.frombuffer(direct(encoder, [t or ""])[0], encoder.kind), 2).astype("<u4")
        want.append((i, start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert got == want


def test_token_parts_are_flat_files_with_bases_from_prefix_sums(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string")
    store = TokenStore.write(df, str(tmp_path), tokenizer_path())
    base = 0
    for p in store.parts:
        doc, nulls, off, ids = open_part(str(tmp_path), p)
        assert p["base"] == base and len(ids) == off[-1] == p["n_ids"] and not nulls.any()
        assert (ids[off[1:] - 1] == 2).all()
        assert (np.diff(doc) > 0).all()
        base += p["n_ids"]
    assert len({p["name"] for p in store.parts}) == len(store.parts)


def test_token_files_of_nothing_nulls_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert token_table(df.limit(0), tokenizer_path(), folder=str(tmp_path / "e")).collect() == []
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_table(df, tokenizer_path(), folder=str(tmp_path / "n")).orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (2, 6, 1)]
    with pytest.raises(ValueError, match="mounted"):
        TokenStore.write(df, "hdfs://x/y", tokenizer_path())


def record(n, body=None, compress=True, **more):
    payload = f"payload {n} ".encode() * 40 if body is None else body
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{n}>", "WARC-Payload-Digest": f"sha1:{warc._sha1(payload)}"} | more
    return warc.build(headers, warc.http_block(payload), compress)


def read(data):
    found = list(warc.salvage(data))
    assert sum(x.length for x in found) == len(data)
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    return [int(x.headers["warc-record-id"][10:-1]) if isinstance(x, warc.Record) else (x.reason, x.length) for x in found]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_what_follows_damage(compress):
    parts = [record(n, compress=compress) for n in range(6)]
    assert read(b"".join(parts)) == [0, 1, 2, 3, 4, 5]
    for at in (0, 2, 40, len(parts[2]) // 2, len(parts[2]) - 3):
        broken = bytearray(parts[2])
        broken[at] ^= 0xFF
        got = read(b"".join([*parts[:2], bytes(broken), *parts[3:]]))
        assert [x for x in got if isinstance(x, int)] == [0, 1, 3, 4, 5], at
        assert sum(x[1] for x in got if not isinstance(x, int)) == len(parts[2])
    cut = read(b"".join([*parts[:3], parts[3][: len(parts[3]) // 2], parts[4], parts[5][:-5]]))
    assert [x for x in cut if isinstance(x, int)] == [0, 1, 2, 4] and len(cut) == 6
    junk = read(b"\x1f\x8b\x08junk" * 20 + parts[0] + b"WARC/1.1\r\nno: thing" + parts[1] + b"\x1f\x8b")
    assert [x for x in junk if isinstance(x, int)] == [0, 1]
    assert read(b"") == [] and read(b"nothing at all")[0][1] == 14


def test_salvage_checks_digests():
    good = record(1)
    bad = record(2, **{"WARC-Payload-Digest": "sha1:" + "0" * 40})
    assert read(good + bad + good) == [1, ("payload digest differs", len(bad)), 1]


def test_payload_may_hold_record_like_bytes():
    inner = record(9, compress=False) + record(8)
    assert read(record(1, inner) + record(2)) == [1, 2]


def test_archived_pages(spark, tmp_path):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "u", big), (7, "u", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u\r\nv", None), (8, "u", "é" * 500), (9, "u", "é" * 500),
            (None, "u", big), (10, "u", "z" * 5000), (10, "u", "z" * 5000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(df).collect())
    refers = {1: 7, 3: 7, 8: 9}
    want = sorted(
        (str(i), len((h or "").encode()), warc._sha1((h or "").encode()), "revisit" if i in refers else "response", refers.get(i)) for i, _, h in rows
    )
    assert got == want
    assert warc.archived_pages(df.limit(0)).collect() == []


def test_damaged_archive_is_read_by_spark(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df, str(tmp_path))
    name = files.first().file
    data = bytearray((tmp_path / name).read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / name).write_bytes(bytes(data))
    records, gaps = warc.read_archives(files, str(tmp_path))
    assert records.count() == 19 and gaps.count() == 1


def test_each_payload_of_a_repeated_page_is_judged_on_its_own(spark):
    a, b, c = "a" * 1200, "b" * 1300, "c" * 1400
    rows = [(1, a), (1, b), (5, a), (2, c), (2, b), (9, c), (9, b), (None, a), (1, None), (1, "")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    keeper = {a: 5, b: 9, c: 9}
    want = sorted(
        (str(i), len(h or ""), warc._sha1((h or "").encode()), *(("revisit", keeper[h]) if h and i and keeper[h] != i else ("response", None))) for i, h in rows
    )
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(df).collect())
    assert sorted(got, key=str) == sorted(want, key=str)


def test_very_long_pages_and_headers_come_back(spark):
    rows = [(1, "u" * 1_500_000, "long " * 1_000_000), (2, "u", "long " * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(df).collect()}
    assert got == {1: (5_000_000, "revisit", 2), 2: (5_000_000, "response", None)}


def test_gaps_are_logged_or_an_error(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df, str(tmp_path / "a"))
    name = files.first().file
    data = bytearray((tmp_path / "a" / name).read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "a" / name).write_bytes(bytes(data))
    assert warc.salvage_archives(files, str(tmp_path / "a"), str(tmp_path / "gaps")).count() == 19
    gap = spark.read.parquet(str(tmp_path / "gaps")).collect()
    assert len(gap) == 1 and gap[0].file == name and gap[0].length > 0
    with pytest.raises(Exception, match="Damaged"):
        warc.read_archives(files, str(tmp_path / "a"), strict=True)[0].count()
