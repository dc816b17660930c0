"""Problem 9: the language of every document and of every run of blocks (prediction by partial matching).

For each language a byte context tree is grown from labelled sentences: how often each byte followed each
context of up to ORDER bytes. The statistics are then frozen. A text's exact code length under a language is the
sum over its bytes of the bits of the byte in the longest context known, with an escape (method C) paid for each
context in which it hasn't been seen, down to a uniform choice among 256. The language with the shortest code is
the text's.

The trees of all languages share their nodes: a node is a context of some language, its children are numbered
by byte, and each child holds the code length in every language. So a batch of texts is scored by ORDER + 1
lookups a byte for all languages at once, and one addition a block.

What has no language of its own is left out beforehand: fenced code and doc strings, code lines, tables, tags,
quoted text, and words with digits or signs. Blocks are parted by empty lines. Within a document a change of
language costs CHANGE_BITS, so that a short block takes its neighbours' language unless it says otherwise; the
cheapest sequence is found exactly. Blocks without language break no run.

Null, empty and blank texts and those without any natural language have no rows; nor has any text without samples.
Repeated and null ids are treated like any others, and other columns play no part. The confidence of a language is
its share of the likelihood, with bits scaled down by BITS_SCALE, as bytes are far from independent.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
CHANGE_BITS = 64.0
BITS_SCALE = 8.0
#: Bound on the labelled sentences that the trees are grown from; the first by id are taken.
MOST_SAMPLES = 20_000
LEAST_LETTERS = 40
UNIFORM = 8.0

_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|`[^`\n]*`|「[^」\n]*」|<[^<>\n]*>')
_ODD = re.compile(r"(?<![!-~])(?=[!-~]*[0-9_/@=<>{}()\[\]\\|$%&*+^~])[!-~]+")
_GAP = re.compile(r"[\W\d_]+")
#: Lines without any of these are no code.
_MAYBE_CODE = re.compile(r"[(){}\[\];=:]|^end$|^# ?language")
_CODE = re.compile(
    r"[;{}]$|^[{}\[\])]|^end$|\) do(?: \|.*\|)?$|\):$|^(?:def|class|import|from|const|let|var|return|throw|public|private|func|fn|expect|require|assert|if|for|while)\b.*[(){}=;:]"
    r"|^@\w+\(|^\w+\(/|^[\w.]+\(.*\)$|^[\w.]+ = \S|\w\.\w+\(.*\)|^(?:#|//) ?language:"
)
_FENCES = ("```", "~~~", '"""', "'''")
_LINES = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_EMPTY = re.compile(r"\n[^\S\n]*\n\s*")


def blocks_of(text: str) -> list[str]:
    """The natural language of each block, as lower-case words parted by single blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _LINES.sub("\n", text).strip()
    if not text:
        return []
    out: list[str] = []
    fenced = ""
    for block in _EMPTY.split(text):
        lines = []
        for line in block.split("\n"):
            s = line.strip()
            if s.startswith(_FENCES):
                mark = s[:3]
                if not fenced:
                    fenced = mark if s.count(mark) == 1 else ""
                elif mark == fenced:
                    fenced = ""
            elif not fenced and s[0] not in "|@" and not (_MAYBE_CODE.search(s) and _CODE.search(s)):
                lines.append(s)
        out.append(_words("\n".join(lines)))
    return out


def _words(s: str) -> str:
    return _GAP.sub(" ", _ODD.sub(" ", _QUOTED.sub(" ", s))).strip().lower()


class Trees:
    """The frozen context trees of all languages.

    step[k][node, symbol] is the node of order k + 1 that a node of order k and the next byte lead to, 0 for none;
    bits[k][node] are a node's code lengths and escape[k][node] the escapes from it, one for each language.
    """

    def __init__(self, samples: list[tuple[str, str]], order: int = ORDER) -> None:
        self.languages = sorted({lang for lang, _ in samples})
        self.order, n = order, len(self.languages)
        counts: list[dict[bytes, np.ndarray]] = [{} for _ in range(order + 2)]
        for lang, text in samples:
            k = self.languages.index(lang)
            data = b" " + b" ".join(b.encode() for b in blocks_of(text)) + b" "
            for length in range(1, order + 2):
                for gram, c in Counter(data[i - length + 1 : i + 1] for i in range(length - 1, len(data))).items():
                    counts[length].setdefault(gram, np.zeros(n, np.int64))[k] += c
        symbols = sorted(g[0] for g in counts[1])
        self.symbol = np.zeros(256, np.int64)
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        width = len(symbols) + 1
        # A context's total and number of different successors, by order.
        totals: list[dict[bytes, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order + 1)]
        for length in range(1, order + 2):
            for gram, c in counts[length].items():
                t, d = totals[length - 1].setdefault(gram[:-1], (np.zeros(n), np.zeros(n)))
                t += c
                d += c > 0
        ids: list[dict[bytes, int]] = [{b"": 0}] + [{g: i for i, g in enumerate(sorted(counts[k]), 1)} for k in range(1, order + 2)]
        self.step = [np.zeros((len(ids[k]) + (k > 0), width), np.int32) for k in range(order + 1)]
        self.bits = [np.zeros((len(ids[k]) + 1, n), np.float32) for k in range(order + 2)]
        self.escape = [np.zeros((len(ids[k]) + (k > 0), n), np.float32) for k in range(order + 1)]
        for k in range(order + 1):
            for context, (t, d) in totals[k].items():
                at = ids[k][context] if k else 0
                self.escape[k][at] = np.where(t > 0, -np.log2(np.maximum(d, 1) / np.maximum(t + d, 1)), 0)
        unseen = self.escape[0][0] + UNIFORM
        self.bits[0][0] = unseen
        for k in range(1, order + 2):
            for gram, at in ids[k].items():
                context = ids[k - 1][gram[:-1]] if k > 1 else 0
                self.step[k - 1][context, self.symbol[gram[-1]]] = at
                t, d = totals[k - 1][gram[:-1]]
                c = counts[k][gram]
                lower = self.bits[k - 1][ids[k - 1][gram[1:]]] if k > 1 else np.full(n, UNIFORM)
                self.bits[k][at] = np.where(c > 0, -np.log2(np.maximum(c, 1) / np.maximum(t + d, 1)), self.escape[k - 1][context] + lower)

        self.first = np.cumsum([0, *(len(b) for b in self.bits[:-1])]).astype(np.int32)  # of each order's nodes in rows
        self.rows = np.concatenate(self.bits)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language, of its bytes and a blank at its end."""
        data = " " + " ".join(texts) + " "
        raw = data.encode()
        sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        symbols = self.symbol[np.frombuffer(raw, np.uint8)]  # the first is context only
        starts = np.cumsum(sizes) - sizes
        found = self.step[0][0][symbols]  # node of the context that ends with each byte, of one order after the other
        known = np.where(found > 0, found + self.first[1], self.first[0])
        escapes = []
        for k in range(1, self.order + 1):
            before = np.concatenate([np.zeros(1, np.int32), found[:-1]])
            found = self.step[k][before, symbols]
            known = np.where(found > 0, found + self.first[k + 1], known)
            miss = np.flatnonzero((found == 0) & (before > 0))
            escapes.append((miss, k, before[miss]))
        out = np.zeros((len(texts), len(self.languages)))
        if texts:
            bits = self.rows[known]
            for miss, k, context in escapes:
                bits[miss] += self.escape[k][context]
            out += np.add.reduceat(bits[1:], starts, axis=0, dtype=np.float64)
        return out


def _sequence(bits: np.ndarray) -> np.ndarray:
    """The cheapest language of each block of one document, changes included."""
    best = bits.argmin(axis=1)
    if (best == best[0]).all():
        return best
    back = np.zeros(bits.shape, np.int64)
    cost = bits[0].copy()
    for i in range(1, len(bits)):
        least = cost.argmin()
        changed = cost[least] + CHANGE_BITS < cost
        back[i] = np.where(changed, least, np.arange(bits.shape[1]))
        cost = np.where(changed, cost[least] + CHANGE_BITS, cost) + bits[i]
    out = np.zeros(len(bits), np.int64)
    out[-1] = cost.argmin()
    for i in range(len(bits) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _confidence(bits: np.ndarray, at: int) -> float:
    return float(1 / np.exp2((bits[at] - bits) / BITS_SCALE).clip(max=1e30).sum())


_BATCH_BYTES = 500_000


def _languages(trees: Trees, ids: list[int | None], texts: list[str | None]) -> list[tuple]:
    """(number of the text, id, block_no, language, confidence, letters) of each text and each run of one in several languages."""
    rows: list[tuple] = []
    blocks, owner = [], []
    for i, t in enumerate(texts):
        for no, b in enumerate(blocks_of(t), 1) if t else ():
            if b:
                blocks.append(b)
                owner.append((i, no))
    if blocks and trees.languages:
        bits = trees.code_lengths(blocks)
        docs = np.array([i for i, _ in owner])
        letters = np.fromiter((len(b) - b.count(" ") for b in blocks), np.int64, len(blocks))
        ends = np.flatnonzero(np.diff(docs, append=-1)) + 1
        start = 0
        for end in ends:
            seq = _sequence(bits[start:end])
            weight = np.bincount(seq, letters[start:end], len(trees.languages))
            i, main = int(docs[start]), int(weight.argmax())
            in_main = bits[start:end][seq == main].sum(axis=0)
            rows.append((i, ids[i], 0, trees.languages[main], _confidence(in_main, main), int(weight.sum())))
            if (seq != seq[0]).any():
                runs = np.flatnonzero(np.diff(seq, prepend=-1))
                for a, b in zip(runs, [*runs[1:], len(seq)], strict=True):
                    rows.append((i, ids[i], owner[start + a][1], trees.languages[seq[a]], _confidence(bits[start + a : start + b].sum(axis=0), seq[a]), int(letters[start + a : start + b].sum())))
            start = end
    return rows


def fit(samples: DataFrame, lang: str, text: str, key: str, most: int = MOST_SAMPLES) -> Trees:
    """Trees from at most ``most`` labelled sentences, the first by key."""
    rows = samples.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).orderBy(key).limit(most).select(lang, text).collect()
    return Trees([(r[0], r[1]) for r in rows])


_FOUND = "doc_id long, block_no int, lang_code string, confidence double, n_letters long, label string"


def detect(df: DataFrame, id_: str, text: str, trees: Trees) -> DataFrame:
    """(doc_id, block_no, lang_code, confidence, n_letters): block 0 for the document, and each run of one in several languages."""
    return _found(df, id_, text, F.lit(None).cast("string"), None, trees).drop("label")


def mislabelled(df: DataFrame, id_: str, text: str, label: str, trees: Trees, least: int = LEAST_LETTERS) -> DataFrame:
    """(doc_id, block_no, lang_code) of texts with ``least`` letters: block 0 where the label is missing or wrong, and the runs of texts in several languages.

    Labels, texts and languages stay in one pass over the documents; nothing is shuffled.
    """
    found = _found(df, id_, text, named(F.col(label)), least, trees)
    return found.filter("block_no > 0 OR label IS NULL OR label <> lang_code").select("doc_id", "block_no", "lang_code")


def _found(df: DataFrame, id_: str, text: str, label: Column, least: int | None, trees: Trees) -> DataFrame:
    known = df.sparkSession.sparkContext.broadcast(trees)  # a few MB, bounded by MOST_SAMPLES

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, labels = (c.to_pylist() for c in batch.columns)
        if least is not None:
            texts = [t if t and _has_letters(t, least) else None for t in texts]
        rows = [(*r, labels[i]) for i, *r in _languages(known.value, ids, texts)]
        columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + _BATCH_BYTES, "right")))
                yield part(batch.slice(start, end - start))
                start = end

    rows = df.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"), label.alias("label"))
    return rows.mapInArrow(run, _FOUND)


_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string()]


_LETTERS = re.compile(r"[\W\d_]+")


def _has_letters(text: str, least: int) -> bool:
    """Whether text has that many letters; most show it in their first characters."""
    return len(_LETTERS.sub("", text[: 4 * least])) >= least or len(_LETTERS.sub("", text)) >= least


def named(lang: Column) -> Column:
    """The language that a stored label names: without blanks, region and case."""
    return F.lower(F.split(F.regexp_replace(lang, r"^\s+|\s+$", ""), "[-_]")[0])
