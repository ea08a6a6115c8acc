"""Token counts by byte-pair merging on a heap and a linked list: tokens = symbols - merges; no ids are made.

Texts are cut at the tokenizer's special strings (one token each, as the library's default has it) and then by its
pre-tokenizer pattern. Each distinct piece is merged once per worker and remembered.

Null text: empty, 0 tokens. Repeated rows count each. Texts of any length are whole; a piece of n bytes takes n log n steps.
Empty table: empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map
from .encoding import byte_alphabet

#: Remembered pieces per worker, and the longest piece that is.
MAX_PIECES = 400_000
MAX_PIECE_CHARS = 64


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: the lowest rank first, the leftmost of equals."""
    n = len(symbols)
    if n < 2:
        return n
    symbols, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] == left else -1
        if j < 0 or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = left + right, ""
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class _Pieces(dict):
    def __init__(self, ranks) -> None:
        self.ranks, self.alphabet = ranks, byte_alphabet()

    def symbols(self, piece: str) -> list[str]:
        return [self.alphabet[b] for b in piece.encode()]

    def __missing__(self, piece: str) -> int:
        n = count_symbols(self.symbols(piece), self.ranks)
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = n
        return n


class _Mapped(_Pieces):
    """The same for pieces that are written in the byte-level alphabet already."""

    def symbols(self, piece: str) -> list[str]:
        return list(piece)


#: Characters that every Unicode version since 5.2 classes alike. Other texts are cut by the library's own pre-tokenizer, whose version may differ.
_SETTLED = re.compile("[\x00-\u0523\u2010-\u205e\u20a0-\u20b8\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f320\U0001f600-\U0001f64f]*")


class TokenCounter:
    """count(text) for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.pieces, self.mapped = _Pieces(ranks), _Mapped(ranks)
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if _SETTLED.fullmatch(text):
            return sum(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return sum(self.mapped[piece] for piece, _ in self.cut(text))


_counters: dict[str, TokenCounter] = {}


def _count(batches, path: str, limit: int):
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    counter = _counters[path]
    for batch in batches:
        sizes = [0 if (t := x.as_py()) is None else (len(t.encode()), counter.count(t)) for x in batch.column(1)]
        sizes = [s or (0, 0) for s in sizes]
        tokens = pa.array([t for _, t in sizes], pa.int64())
        yield pa.record_batch([batch.column(0), pa.array([b for b, _ in sizes], pa.int64()), tokens, pa.array([t > limit for _, t in sizes], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for docs(doc_id, text). No exchange."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda b: _count(b, tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
