"""Byte-level BPE by backtracking over longest matches.

The text's pre-tokens are mapped to Latin-1, one character a byte, so that an Aho-Corasick automaton over the vocabulary
finds all tokens in one pass. The encoder takes the longest token at each place, checks whether the merges could have
left it beside the token before, and steps back to shorter tokens where they could not. That check is memoised, and a
place from which no way on was found is never tried again, so the time is linear in the text. The result is the one
that applying the merges in order gives.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids in each Python worker, and the longest that is kept.
KEPT, KEPT_CHARS = 300_000, 64


def _byte_chars() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encoder for a vocabulary whose ids stand in the order of the merges."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_chars()
        latin = str.maketrans({c: chr(b) for c, b in chars.items()})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        reached = set(chars) | {a + b for a, b in merges}
        self.ids: dict[str, int] = {t.translate(latin): i for t, i in vocab.items() if t in reached}
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = whole
            self.parts[whole] = left, right
        rank = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(rank, rank[1:], strict=False)):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: Of each token the longest shorter token that begins it.
        self.shorter: dict[int, int] = {}
        for t, i in self.ids.items():
            for n in range(len(t) - 1, 0, -1):
                if (s := self.ids.get(t[:n])) is not None:
                    self.shorter[i] = s
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the merges can leave a and b side by side: undoing them from the latest on, no merge across the seam came earlier."""
        earliest = 1 << 60
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and whole < earliest:
                return False
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                return True
            if pb_ is None or (pa_ is not None and a > b):
                earliest, a = a, pa_[1]
            else:  # merges at the left come first among equals
                earliest, b = b + 1, pb_[0]

    def encode_bytes(self, text: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters."""
        if (whole := self.ids.get(text)) is not None and len(text) < 3:
            return [whole]
        n, length, fits = len(text), self.length, self.fits
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = ids[-1] if ids else None
            while True:
                end = at + length[token]
                if not dead[end]:
                    if before is None:
                        break
                    pair = before, token
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._adjacent(before, token)
                    if ok:
                        break
                token = self.shorter.get(token, -1)
                if token < 0:
                    break
            if token >= 0:
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = self.shorter.get(token, -1)
                while token < 0:  # no shorter token here either: one more step back
                    dead[at] = 1
                    token = ids.pop()
                    at -= length[token]
                    token = self.shorter.get(token, -1)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; strings that look like them are ordinary text. Null and empty: no ids."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
                if len(self.fits) > 4_000_000:
                    self.fits.clear()
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> BytePairEncoder:
    """The encoder of a vocabulary file, made once in each Python process."""
    return BytePairEncoder(os.path.join(directory, f"{name}.json"))


def encode_texts(df: DataFrame, key: str, text: str, directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Rows (key, ids): the token ids of each row's whole text. Null and empty texts have an empty list; rows are kept as they come, repeated ones too; other columns are ignored."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory, name).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, directory: str = TOKENIZERS, name: str = "byte_bpe_50k", out: str = "n_tokens") -> DataFrame:
    """The columns `keep` of df with the number of tokens of the whole text; null and empty texts have 0."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory, name).encode
        for batch in batches:
            counts = pa.array([len(encode(x)) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*keep, out])

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{fields}, {out} bigint")
