"""Token ids of whole texts by encoding each distinct piece of text once per worker.

Both supported families of tokenizers cut a text at places that can be found without the library:
``words`` tokenizers drop white space and lower-case, ``spaced`` ones give a single space to the
word after it. There the ids of a text are the ids of its pieces, one after another, so pieces are
looked up and only new ones are encoded by the library. Texts in which a cut is not safe (runs of
white space, special strings) are given to the library whole. Any other tokenizer always is.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

from floodgrid.llm.texts import clear_others, kept_by_worker

# What plain texts consist of: printable ASCII, blanks and line feeds, and the letters of the Latin-1
# block, whose UTF-8 is 0xC3 and a byte of 0x80 to 0xBF other than those of the two signs.
_PLAIN = bytes([10, *range(32, 127), *range(0x80, 0xC0), 0xC3])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")
# The pre-tokenizers' patterns, for plain texts.
_WORD_PARTS = re.compile(rb"[a-z\x80-\xff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+")
_SPACED_PARTS = re.compile(rb" ?[A-Za-z\x80-\xff]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")
# Runs of white space, which belong to several parts.
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ")

PARTS_KEPT = 300_000
_U4 = array("I")
_LOADED: dict[tuple, object] = kept_by_worker({})


def cuts_of(path: str) -> str:
    """``words``, ``spaced`` or ``whole``: how texts may be cut for this tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in spec["added_tokens"]):
        return "whole"
    if not any(t["content"] == "<|endoftext|>" for t in spec["added_tokens"]):
        return "whole"
    if any("<|" not in t["content"] for t in spec["added_tokens"]):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
    parts = [p["type"] for p in pre.get("pretokenizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"]:
        split = pre["pretokenizers"][0]
        # Fixed value: the pattern that _WORD_PARTS follows.
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if split["pattern"].get("Regex") == known and split["behavior"] == "Removed" and split["invert"]:
            return "words"
    return "whole"


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little" and _U4.itemsize == 4:
        return array("I", ids).tobytes()
    return np.asarray(ids, "<u4").tobytes()


class _Parts(dict):
    """Values of parts; one that is missing is learned on the way."""

    def __init__(self, learn: Callable[[bytes], object]):
        self.learn = learn

    def __missing__(self, part: bytes):
        return self.learn(part)


class PieceEncoder:
    """``encode(texts)`` gives one value per text: its ids as uint32 bytes, or their number."""

    def __init__(self, path: str, counts: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_alphabet()
        self.cuts = cuts_of(path)
        self.split = (_WORD_PARTS if self.cuts == "words" else _SPACED_PARTS).findall
        self.counts = counts
        self.join: Callable[[Iterable], object] = sum if counts else b"".join
        self.recent: dict[bytes, object] = _Parts(self._learn)
        self.older: dict[bytes, object] = {}

    def _value(self, ids: list[int]):
        return len(ids) if self.counts else _packed(ids)

    def _library(self, texts: list[bytes]) -> list:
        made = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [self._value(e.ids) for e in made]

    def _learn(self, part: bytes):
        """A part's value: kept from before, or what the model gives for the part alone."""
        if len(self.recent) >= PARTS_KEPT:
            # Parts not met since the last change of tables are dropped.
            self.older, self.recent = self.recent, _Parts(self._learn)
        value = self.older.get(part)
        if value is None:
            if self.cuts == "words" and part.isascii():
                # Printable ASCII stands for itself.
                part_text = part.decode()
            elif self.cuts == "words":
                part_text = part.decode().lower().encode().decode("latin-1").translate(self.letters)
            else:
                part_text = part.decode("latin-1").translate(self.letters)
            value = self._value([t.id for t in self.model.tokenize(part_text)])
        self.recent[part] = value
        return value

    def _parts(self, text: bytes) -> list[bytes] | None:
        """The text's parts, or None if it is to be encoded whole."""
        if b"<|" in text or text.translate(None, _PLAIN) or any(s in text for s in _SIGNS) or self.cuts == "whole":
            return None
        if self.cuts == "words":
            return self.split(text.lower())
        if any(u in text for u in _RUNS) or text[:1].isspace() or text[-1:].isspace():
            return None
        return self.split(text)

    def _known(self, parts: list[bytes]):
        return self.join(map(self.recent.__getitem__, parts))

    def encode(self, texts: list[bytes]) -> list:
        cut = [self._parts(t) for t in texts]
        whole = iter(self._odd([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole) if c is None else self._known(c) for c in cut]

    def _odd(self, texts: list[bytes]) -> list:
        """Values of texts that are not plain, word by word where that is safe."""
        if self.cuts != "words":
            return self._library(texts)
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if b"<|" not in t:
                # White space is dropped, so each word stands alone; only odd words need the library.
                values = []
                for w in t.split():
                    parts = self._parts(w)
                    values.append(self._library([w])[0] if parts is None else self._known(parts))
                out[i] = self.join(values)
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self._library([texts[i] for i in rest])):
            out[i] = v
        return out


def encoder(path: str, counts: bool) -> PieceEncoder:
    """One encoder per worker process, so later tasks find the pieces of earlier ones."""
    key = (path, counts)
    if key not in _LOADED:
        clear_others(_LOADED)
        _LOADED[key] = PieceEncoder(path, counts)
    return _LOADED[key]


def groups(texts: Iterable[bytes], most: int = 1 << 20) -> Iterable[list[bytes]]:
    """Runs of texts of about ``most`` bytes, so that few are held as Python objects at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some
