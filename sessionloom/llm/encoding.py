"""Whole-text encoding with a public tokenizer file: the library's ids, with words that were seen before taken from a table.

A text of plain characters is cut into pieces by the pattern that stands in the tokenizer file, and the library's model gives the ids of each new
piece. That way is taken only for files whose steps are known (see plain_pattern); every other file and text goes through the library as a
whole. The tests hold both ways equal on whole tables of documents.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .common import give_back

#: Pieces that a task remembers before it starts anew: bounds its memory to about 30 MB.
MAX_PIECES = 131_072
#: Longer pieces are encoded each time.
MAX_PIECE_CHARS = 64


def _ranges(points: list[int]) -> str:
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\u{start:04x}-\\u{p:04x}")
            start = None
    return "".join(out)


#: Characters up to U+017F: normal form C leaves them alone, and each is lowered by itself, to one of them.
_PLAIN = [0x9, 0xA, 0xB, 0xC, 0xD, *range(0x20, 0x7F), *range(0xA1, 0x180)]
_LETTERS = _ranges([p for p in _PLAIN if unicodedata.category(chr(p))[0] == "L"])
_NUMBERS = _ranges([p for p in _PLAIN if unicodedata.category(chr(p))[0] == "N"])
_ONLY_PLAIN = re.compile(f"[{_ranges(_PLAIN)}]*")
#: What a normaliser may do for the plain way: none of it changes a plain text's pieces but for the case.
_HARMLESS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def plain_pattern(spec: dict) -> re.Pattern | None:
    """The pattern of a tokenizer file that cuts lower-cased plain texts, its letter and number classes written out; None if the file has other steps."""
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, parts = normal.get("normalizers", []), cut.get("pretokenizers", [])
    split = {"type": "Split", "behavior": "Removed", "invert": True}
    known = (
        spec.get("post_processor") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and not any(t.get("normalized") for t in spec.get("added_tokens", []))
        and normal.get("type") == "Sequence" and all(s in _HARMLESS for s in steps) and _HARMLESS[2] in steps
        and cut.get("type") == "Sequence" and len(parts) == 2 and {k: v for k, v in parts[0].items() if k != "pattern"} == split
        and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    )
    regex = parts[0]["pattern"].get("Regex") if known else None
    # the letters and numbers are written into classes, so they must stand in classes, and white space can't be part of a piece
    if not regex or re.sub(r"\[[^\]]*\]", "", regex).find("\\") >= 0:
        return None
    return re.compile(regex.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


class _Pieces(dict):
    """Ids of a pre-tokenized, normalised piece: they come from the library's model, which needs no further step for one."""

    def __init__(self, tokenizer, most: int) -> None:
        self.model, self.most = tokenizer.model, most

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))
        ids = np.asarray([t.id for t in tokens], dtype="<u4").tobytes()
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, exactly as the library would; it remembers `pieces` pieces at most."""

    def __init__(self, path: str, pieces: int = MAX_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer, pieces)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        give_back()
        self.pattern = plain_pattern(spec)
        #: Texts with a special string, or with the letter whose lower case is two characters, are no plain ones.
        self.other = re.compile("|".join(["\u0130", *(re.escape(t["content"]) for t in spec.get("added_tokens", []))]))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern and _ONLY_PLAIN.fullmatch(text) and not self.other.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, pieces: int = MAX_PIECES) -> WordEncoder:
    """One encoder per worker process, file and bound."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = WordEncoder(path, pieces)
    return _encoders[path, pieces]


def drop_encoders() -> None:
    """At the end of a task: an idle worker holds none."""
    _encoders.clear()
