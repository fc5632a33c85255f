"""Ids of texts under a tokenizer file that cuts texts at blanks and drops the blanks."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, and distinct pieces of words, whose ids a worker keeps, twice over.
CACHE_WORDS = 100_000
#: Characters whose classes, composed forms and lower cases are alike in all Unicode versions at hand.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
_END = "\x00"


def _classes() -> tuple[str, str]:
    known = {c for i in range(0x250) for c in chr(i) + chr(i).lower()}
    kinds = {kind: re.escape("".join(sorted(c for c in known if unicodedata.category(c)[0] == kind))) for kind in "LN"}
    return kinds["L"], kinds["N"]


def drops_blanks(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases texts, cuts them by a pattern that drops blanks, and merges in each piece alone."""
    norm, cut, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    norms, cuts = norm.get("normalizers") or [], cut.get("pretokenizers") or []
    if [n.get("type") for n in norms] != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"]:
        return False
    pattern = (cuts[0].get("pattern") or {}).get("Regex") or ""
    other = (spec.get("truncation"), spec.get("padding"), spec.get("post_processor"), model.get("dropout"), model.get("continuing_subword_prefix"),
             model.get("ignore_merges"), model.get("byte_fallback"), cuts[1].get("add_prefix_space", True), cuts[1].get("use_regex", True))
    blanks = norms[1].get("pattern") == {"Regex": r"\s+"} and norms[1].get("content") == " "
    drops = cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and pattern.endswith(r"|[^\s\p{L}\p{N}]+")
    no_blank = all(re.fullmatch(r"'[a-z]+|\[\\p\{L\}\]\+|\[\\p\{N\}\]\+?", p) for p in pattern.split("|")[:-1])
    return model.get("type") == "BPE" and blanks and drops and no_blank and not any(other)


class WordEncoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, and an end id after each.

    Under a file that ``drops_blanks`` the ids of a text are those of its blank-separated words in a row, and those of a word
    are those of the pieces that the file's pattern cuts. So in a text of plain characters each distinct word of a block is
    looked up once, and each new piece is merged once. Any other text, any that holds an added token, and every text under
    another file, is encoded whole.
    """

    def __init__(self, path: str, end_id: int, cache: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.most = cache
        self.by_word = drops_blanks(spec)
        if self.by_word:
            letters, numbers = _classes()
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.cut = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}
            self.alone = Tokenizer.from_str(json.dumps(spec))  # for pieces that are cut and lower-cased already

    def _known(self, cache: tuple[dict, dict]) -> tuple[dict, dict]:
        return ({}, cache[0]) if len(cache[0]) > self.most else cache

    def _ids(self, words: list[str]) -> list[bytes]:
        self.words, self.pieces = self._known(self.words), self._known(self.pieces)
        now, before = self.words
        missing = [w for w in words if w not in now]
        now.update((w, before[w]) for w in missing if w in before)
        cuts = {w: self.cut(w) for w in missing if w not in before}
        held, older = self.pieces
        new = {p for c in cuts.values() for p in c if p not in held}
        held.update((p, older[p]) for p in new if p in older)
        fresh = [p for p in new if p not in older]
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            found = self.alone.encode_batch_fast(some, add_special_tokens=False)
            held.update((p, array(self.code, e.ids).tobytes()) for p, e in zip(some, found, strict=True))
        now.update((w, b"".join([held[p] for p in c])) for w, c in cuts.items())
        return list(map(now.__getitem__, words))

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = pc.ascii_split_whitespace(pa.array([f"{t.lower()} {_END}" for t in texts], pa.large_string()))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        end = words.index(_END)
        words[end] = ""  # a name that has no ids
        data = self._ids(words)
        data[end] = self.end
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
        """The ids of each text and its end as bytes of ``kind``."""
        plain = [self.by_word and bool(_PLAIN.match(t)) and not any(a in t for a in self.added) for t in texts]
        fast = iter(self._encode_plain([t for t, p in zip(texts, plain, strict=True) if p]))
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        slow = iter([np.array(e.ids, self.kind).tobytes() + self.end for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)])
        return [next(fast if p else slow) for p in plain]
