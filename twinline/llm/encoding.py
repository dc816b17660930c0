"""Problem 7: token ids of every text by a public byte-level BPE tokenizer (monoid tree reduction).

A text is halved until its pieces are short, the pieces are encoded, and neighbours are joined up the tree. At a
seam the tokens of a growing window are decoded and encoded again: first one token each side, then twice as
many, until the window's ends are settled. An end is settled where the pre-tokenizer must cut whatever stands
around it; from there on neither side can change. These places follow from its pattern, in which no piece holds
a character before a blank, a letter beside a digit, or a letter before another sign:

* between a character that isn't white space and white space,
* between two of letter, number, other sign, except an apostrophe before a letter (contractions).

Nothing in the pattern looks back, and the only look-ahead, after white space, ends at the next character that
isn't. A run without such a place is encoded again as a whole, so the ids are always those of the whole text.
Decoding concatenates the bytes of the tokens up the tree.

An empty text and a null text have the empty list of ids. Special tokens' strings are ordinary text. Each row gives
one row, also if its id is null or repeated; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the tokenizer's pre-tokenizer, as its publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabulary files; a parameter, the files are no part of this library.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Texts up to this many characters are encoded at once; most documents are longer, and are joined of halves.
LEAF = 512

_CUT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
_FIRST_CUT, _LAST_CUT = regex.compile(_CUT), regex.compile(f"(?r){_CUT}")


@lru_cache(4)
def encoder(folder: str, name: str):
    """The tokenizer, loaded once a worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def byte_lengths(folder: str, name: str) -> np.ndarray:
    """How many bytes each token stands for."""
    enc = encoder(folder, name)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def settled(before: str, after: str) -> bool:
    """Whether pre-tokens always end between these two characters."""
    return _FIRST_CUT.search(before + after) is not None


def _last_cut(text: str) -> int:
    """Position of the last settled cut in text, 0 if there is none."""
    m = _LAST_CUT.search(text)
    return m.start() if m else 0


def _first_cut(text: str) -> int:
    m = _FIRST_CUT.search(text)
    return m.start() if m else len(text)


def join(enc, left: str, ids_left: list[int], right: str, ids_right: list[int]) -> list[int]:
    """The ids of left + right from those of the two parts."""
    if not left or not right or settled(left[-1], right[0]):
        return ids_left + ids_right
    n = 1
    while True:
        # The window's text, as far as it consists of whole characters: the seam's surroundings of n tokens each side.
        a = _tail(enc, left, ids_left, n)
        b = _head(enc, right, ids_right, n)
        i, j = _last_cut(a), _first_cut(b)
        open_left, open_right = i == 0 and len(a) < len(left), j == len(b) and len(b) < len(right)
        if not open_left and not open_right:
            break
        n *= 2
    kept_left = _without(enc, ids_left, len(a[i:].encode()), last=True)
    kept_right = _without(enc, ids_right, len(b[:j].encode()), last=False)
    return kept_left + enc.encode_ordinary(a[i:] + b[:j]) + kept_right


def _tail(enc, text: str, ids: list[int], n: int) -> str:
    size = sum(len(enc.decode_single_token_bytes(t)) for t in ids[-n:])
    raw = text[-size:].encode()[-size:]  # a character has at least one byte
    return raw.decode(errors="ignore") if n < len(ids) else text


def _head(enc, text: str, ids: list[int], n: int) -> str:
    size = sum(len(enc.decode_single_token_bytes(t)) for t in ids[:n])
    return text[:size].encode()[:size].decode(errors="ignore") if n < len(ids) else text


def _without(enc, ids: list[int], size: int, last: bool) -> list[int]:
    """ids without the last or first tokens that make up size bytes. A settled cut lies between two tokens."""
    k = 0
    while size > 0:
        k += 1
        size -= len(enc.decode_single_token_bytes(ids[-k] if last else ids[k - 1]))
    if size:
        raise AssertionError("a settled cut lies inside a token")
    return ids[: len(ids) - k] if last else ids[k:]


def encode(enc, text: str | None, leaf: int = LEAF) -> list[int]:
    """The ids of a whole text, by halves."""
    if not text:
        return []
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    return join(enc, text[:half], encode(enc, text[:half], leaf), text[half:], encode(enc, text[half:], leaf))


def decode(enc, ids: list[int]) -> bytes:
    """The bytes of the ids, by halves."""
    if len(ids) <= LEAF:
        return b"".join(enc.decode_tokens_bytes(ids))
    return decode(enc, ids[: len(ids) // 2]) + decode(enc, ids[len(ids) // 2 :])


def encode_column(df: DataFrame, id_: str, text: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, ids) of every row. The corpus streams through the workers in Arrow batches; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):  # bounds the ids held at once
                part = batch.slice(a, 1000)
                ids = [encode(enc, t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.fromiter((x for i in ids for x in i), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], [id_, "ids"])

    return df.select(F.col(id_).cast("long"), text).mapInArrow(run, f"{id_} long, ids array<int>")


def decode_column(df: DataFrame, id_: str, ids: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, text) of every row of ids; no ids and null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            texts = [decode(enc, i or []).decode(errors="replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_, "text"])

    return df.select(F.col(id_).cast("long"), ids).mapInArrow(run, f"{id_} long, text string")
