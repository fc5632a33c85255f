"""Token ids as flat files of unsigned integers with 64-bit document offsets, written and read by memory map.

A store is a folder with, for each part ``p``, ``p.ids`` (ids of all its documents in a row, little-endian
uint16 or uint32), ``p.off`` (n + 1 little-endian int64 offsets, in ids, from the part's begin) and ``p.doc`` (n
int64 doc_ids and n flag bytes, 1 where the id is null). The first id of a part follows from prefix sums of the parts' lengths.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import input_texts, kept, new_path, text_blocks, trim

#: Distinct pieces of text whose ids a worker keeps, twice over.
CACHE_PIECES = 120_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 6 << 20
#: Bytes of text in a part.
PART_BYTES = 256 << 20
#: Characters whose classes are alike in all Unicode versions at hand: up to Latin Extended-B, no odd controls.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-ɏ]*\Z")
#: White space that does not simply join two pieces: runs of blanks, and blanks at a line's ends.
_ODD_SPACE = ("  ", "\n ", " \n", "\n\n\n")
_MARKS = ".,;:!?*$%&#|"


def _simple(t: str) -> bool:
    return bool(_PLAIN.match(t)) and not any(x in t for x in _ODD_SPACE) and t[:1] not in " \n" and t[-1:] not in " \n"


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE with the usual pattern, for which pieces encode alone."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    other = (spec.get("normalizer"), spec.get("truncation"), spec.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"),
             model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback"))
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return usual and model.get("type") == "BPE" and not any(other)


class Encoder:
    """Ids of texts under a byte-level BPE file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE merges within pieces that its pattern cuts: before single blanks, around line ends, and between a
    letter or digit and a punctuation mark. In a text of plain characters and simple white space, blank-separated pieces
    therefore encode alone as they do in place, so each distinct piece is encoded once and its ids are
    kept; any other text, and any that holds an added token of the file, is encoded whole, as is every text under a file
    that cuts or merges in another way (``cuts_at_blanks``).
    """

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_piece = cuts_at_blanks(json.loads(self.tok.to_str()))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = cache
        line_end = self.tok.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 and not any("\n" in a for a in self.added) else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces without line ends, as the lines of one text: its line ends are ids of their own."""
        if self.line_end is None:
            return self._encode(pieces)
        ids = np.array(self.tok.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(ids == self.line_end)
        data, size = ids.tobytes(), self.kind.itemsize
        first, last = np.r_[0, ends + 1] * size, np.r_[ends, len(ids)] * size
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Put every piece into the cache; marks at a piece's end are looked up apart from the word before them."""
        known, old, split, new = self.cache, self.old, [], {}
        missing = [p for p in pieces if p not in known]
        known.update((p, old[p]) for p in missing if p in old)
        for p in missing:
            if p in old:
                continue
            word = p.rstrip(_MARKS)
            if word != p and word[-1:].isalnum():
                split.append((p, word, p[len(word) :]))
                for part in split[-1][1:]:
                    if part in old:
                        known[part] = old[part]
                    elif part not in known:
                        new[part] = None
            else:
                new[p] = None
        fresh = list(new)
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            known.update(zip(some, self._encode_pieces(some), strict=True))
        known.update((p, known[word] + known[marks]) for p, word, marks in split)

    def _encode_simple(self, texts: list[str]) -> list[bytes]:
        # A blank stays with the piece after it; a line end is a piece of its own.
        cut = [t.replace("\n", " \n ").replace(" ", "\x00 ").replace("\x00 \n\x00 ", "\x00\n\x00") for t in texts]
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\x00")
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > self.most:
            self.cache, self.old = {}, self.cache
        if "" not in self.cache:
            self.cache.update({"": b"", "\n": self._encode(["\n"])[0]})
        self._learn(pieces)
        data = list(map(self.cache.__getitem__, pieces))
        size = np.fromiter(map(len, data), np.int64, len(data)) // self.kind.itemsize
        flat, first = np.frombuffer(b"".join(data), self.kind), np.cumsum(size) - size
        at = coded.indices.to_numpy()
        each = size[at]
        ends = np.cumsum(each)
        place = np.repeat((first[at] - (ends - each)).astype(np.int32), each)  # a block has under 2**31 ids
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        simple = [self.by_piece and _simple(t) and not any(a in t for a in self.added) for t in texts]
        fast = iter(self._encode_simple([t for t, s in zip(texts, simple, strict=True) if s]))
        return [next(fast) if s else self._encode([t])[0] for t, s in zip(texts, simple, strict=True)]


def _local(uri: str) -> str:
    """The path of a shared folder that every machine mounts; memory maps need one."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped, so their folder must be a mounted path, not {uri}")
    return at.path or uri


_PART = pa.schema(
    [("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string())]
)


def _write(folder: str, tokenizer: str, end_id: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("encoder", tokenizer), lambda: Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        # A name for each attempt: a task that runs twice never writes into a file that is in use.
        name = f"{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], encoder.kind).tobytes()
        lengths, docs = [], []
        with open(f"{folder}/{name}.ids", "wb") as out:
            for ids, texts in text_blocks(batches, block_bytes):
                strings = ["" if t is None else t.decode("utf-8", "replace") for t in texts]
                for data in encoder.encode(strings):
                    out.write(data)
                    out.write(end)
                    lengths.append(len(data) // encoder.kind.itemsize + 1)
                docs.extend(ids)
                trim()
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        offsets.tofile(f"{folder}/{name}.off")
        with open(f"{folder}/{name}.doc", "wb") as out:
            out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
            out.write(np.array([d is None for d in docs], np.uint8).tobytes())
        trim()
        if lengths:
            row = {"part": part, "name": name, "n_docs": len(lengths), "n_ids": int(offsets[-1]), "kind": encoder.kind.str}
            yield pa.RecordBatch.from_pylist([row], _PART)

    return run


class TokenStore:
    """A written store: its folder, and name, documents and ids of each part in order."""

    def __init__(self, folder: str, parts: list[dict]):
        self.folder = folder
        self.parts = sorted(parts, key=lambda p: p["part"])
        bases = accumulate((p["n_ids"] for p in self.parts), initial=0)
        self.parts = [p | {"base": b} for p, b in zip(self.parts, bases, strict=False)]

    @classmethod
    def write(
        cls, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text",
        block_bytes: int = ENCODE_BYTES,
    ) -> TokenStore:
        """Encode every text (null: empty) with ``end_id`` after it, in ascending order of id (null ids first).

        Texts that share an id follow each other in order of a hash of the text, and may lie in several parts. A part
        has about ``PART_BYTES`` of text, whatever the input's size; a text is held whole in its task. ``block_bytes`` of text are encoded at a time: fewer take
        less memory and more time. Other columns are ignored.
        """
        src = input_texts(docs, id_col, text_col)
        size = src.agg(F.sum(F.length("text"))).first()[0] or 0
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
        order = ["doc_id", F.xxhash64("text")]
        ordered = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
        made = ordered.mapInArrow(
            _write(_local(folder), tokenizer, end_id, block_bytes), "part int, name string, n_docs long, n_ids long, kind string"
        )
        return cls(folder, [r.asDict() for r in made.collect()])  # one small row for each part

    def read(self, spark: SparkSession) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32, part``: each document's place and checksum from the mapped files."""
        schema = "part int, name string, n_docs long, n_ids long, kind string, base long"
        rows = [tuple(p[k] for k in ("part", "name", "n_docs", "n_ids", "kind", "base")) for p in self.parts]
        parts = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "part")
        folder = _local(self.folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.to_pylist():
                    doc, nulls, off, ids = open_part(folder, p)
                    for i in range(0, len(doc), 10_000):
                        j = min(i + 10_000, len(doc))
                        crc = [zlib.crc32(ids[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc[i:j], pa.int64(), mask=nulls[i:j].astype(bool)), pa.array(off[i:j] + p["base"]),
                                pa.array(np.diff(off[i : j + 1])), pa.array(crc, pa.int64()), pa.array([p["part"]] * (j - i), pa.int32()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                        )

        return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def open_part(folder: str, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's doc_ids, null flags, offsets and ids, as memory maps."""
    at, n = f"{folder}/{part['name']}", part["n_docs"]
    doc = np.memmap(f"{at}.doc", "<i8", "r", shape=(n,))
    nulls = np.memmap(f"{at}.doc", np.uint8, "r", offset=8 * n, shape=(n,))
    return doc, nulls, np.memmap(f"{at}.off", "<i8", "r", shape=(n + 1,)), np.memmap(f"{at}.ids", part["kind"], "r")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, *, folder: str | None = None, **names: object) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per row: ``docs`` written as token files in a shared folder and read back.

    A null text is an empty one (its end alone); null ids come first and stay null; repeated rows are encoded each; an empty table
    gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    store = TokenStore.write(docs, folder or new_path(spark, "tokens"), tokenizer, end_id, **names)
    return store.read(spark).select("doc_id", "start", "n_tokens", "ids_crc32")
