"""Token ids of whole texts from a public tokenizer's file, by way of its ids for each word.

For the word tokenizers meant here nothing crosses white space: normalising and splitting treat the parts of a text
between spaces and line feeds alone, so their ids, kept per worker, make up the text's.  ``Encoder`` checks that on the
tokenizer's own description and encodes whole texts where it doesn't hold.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Words kept in each of two generations of a worker's cache (about 200 bytes each).
KEPT = 400_000
#: Latin letters that normalising leaves but for their case, and ASCII signs after them: two parts of a text.
_LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_signs() -> dict[int, str]:
    """The sign for each byte in byte-level vocabularies: itself if it prints in Latin-1, else the next one from U+0100."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids by word; ``bare`` encodes a lower-case Latin word without anything around it, faster."""

    def __init__(self, encode, bare):
        super().__init__()
        self.encode, self.bare, self.old = encode, bare, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            m = _LATIN.fullmatch(word) if self.bare else None
            if not m:
                ids = self.encode(word)
            elif (low := m[1].lower()) == word:
                ids = self.bare(word)
            else:
                ids = self[low] + self[m[2]] if m[2] else self[low]
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _by_word(config: dict) -> bool:
    """Whether texts can be encoded word by word: white space is a separator that no token includes."""
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(map(str.isspace, t["content"])) for t in config["added_tokens"])
    kinds = {"NFC", "Lowercase", "Replace"}
    steps = (config["normalizer"] or {}).get("normalizers", [config["normalizer"]])
    plain = all(s and s["type"] in kinds and (s["type"] != "Replace" or (s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ")) for s in steps)
    first = ((config["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "\\s" in str(first.get("pattern")) and "|\\s" not in str(first.get("pattern"))
    return bool(added and plain and split and not config["truncation"] and not config["post_processor"])


def _byte_level(config: dict) -> bool:
    """Whether a lower-case run of letters goes to the model as the signs of its bytes, whole."""
    rest = ((config["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[1:]
    lower = any(s["type"] == "Lowercase" for s in (config["normalizer"] or {}).get("normalizers", []))
    letters = "|[\\p{L}]+|" in str((config["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex"))
    return lower and letters and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]


class Encoder:
    """Texts to little-endian ids of ``width`` bytes each, without special tokens around them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._kind = f"<u{self.width}"
        self._words = _Words(self._encode, self._bare if _byte_level(config) else None) if _by_word(config) else None
        self._tokenize = self._tokenizer.model.tokenize
        self._ids = [i.to_bytes(self.width, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._signs = {b: s for b, s in _byte_signs().items() if b > 127}

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self._kind).tobytes()

    def _bare(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._signs)
        return b"".join([self._ids[t.id] for t in self._tokenize(word)])

    def rest(self) -> None:
        """Let go of the older words, at the end of a task."""
        if self._words is not None:
            self._words.old = {}

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._words is None:
            return self._encode(text)
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
