"""Problem 4: texts that differ only in spacing, case, punctuation or the order of their inline fields.

Code points stream through a skip-and-fold lookup table (0 = skip, otherwise the lower-cased letter or digit)
straight into polynomial hashes; no canonical string is built. The table also brings what it can to the consistent
form of problem 2: width, ligatures and invisible characters by code point, a letter and its accent by pair. Only a
word of mixed script is looked up as a word, and only texts with rarer sequences (several accents on a letter, parts
of Hangul syllables) are brought to their form beforehand. A pair of braces cuts a text into fields at its commas:
each is hashed on its own, and the fields' hashes are appended in the order of their hashes, so that the order they
are written in plays no part. Hashes of parts are joined by H(xy) = H(x) * B^len(y) + H(y). Spellings with equal
hashes are then compared with the first one, two pointers skipping what doesn't count.

A spelling may also lack the commas between its fields, or the braces. So a phrase with fields is laid, in any order
of its fields, against others as written, with no more fields, that have the same letters and digits in all (an
order-free sum) and begin with the text before its braces and one of its fields, whole. If they match, the two are one
phrase. So only these meet, and not all that are made of the same letters.

All work is on distinct texts, which combine before the shuffle. Texts with many rows, phrases with many spellings
and texts without letters, however many rows they have, are cut into pieces where rows are joined to them.

Null texts and texts without letters or digits have no phrase: they are left out of groups, as are rows without
an id. Braces that don't close are ordinary punctuation, and so are commas outside of braces; in nested braces the
innermost pair counts. Rows that repeat id and text are copies of themselves only; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.llm.form import SELECTORS, consistent, prototype, resolved_word
from twinline.operators.graph import connected_components
from twinline.operators.skew import salted_join
from twinline.session import cut

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 998_244_353 % PRIMES[1])
OPEN, CLOSE, COMMA = (ord(c) for c in "{},")
LATIN, GREEK, CYRILLIC, OTHER = 1, 2, 4, 8  # what a word may consist of: letters of three scripts, marks and digits
#: Code points that may be folded; beyond them no letters are assigned, and none of these ranges decomposes or is drawn alike.
CODES = 0xE0200
_ATOMS = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x18D80), (0x20000, 0x2F800), (0x2FA20, 0xE0000))


class _Tables(NamedTuple):
    symbol: np.ndarray  # folded letter or digit, a brace or comma, or 0
    length: np.ndarray  # how many code points one becomes
    first: np.ndarray  # the code point, if it becomes one, else where its sequence begins in pool
    pool: np.ndarray
    word: np.ndarray  # LATIN, GREEK, CYRILLIC, OTHER or 0
    mark: np.ndarray  # whether it is an accent that follows its letter
    rare: np.ndarray  # whether the text has to be brought to its form as a whole
    apart: np.ndarray  # whether it decomposes
    pairs: np.ndarray  # letter << 21 | accent, sorted
    joined: np.ndarray  # and the one character that they are


@lru_cache(1)
def tables() -> _Tables:
    symbol, first = np.zeros(CODES, np.uint32), np.arange(CODES, dtype=np.uint32)
    length, word = np.ones(CODES, np.uint8), np.zeros(CODES, np.uint8)
    mark, rare, apart = (np.zeros(CODES, bool) for _ in range(3))
    pool: list[int] = []
    pairs: dict[int, int] = {}
    atoms = np.zeros(CODES, bool)
    for a, b in _ATOMS:
        atoms[a:b] = True
    for code in np.flatnonzero(~atoms).tolist():
        ch = chr(code)
        parts = unicodedata.decomposition(ch).split()
        apart[code] = bool(parts) and parts[0][0] != "<"
        if apart[code] and len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in parts)
            if unicodedata.combining(chr(b)):
                pairs[a << 21 | b] = code
            else:
                rare[b] = True
        mark[code] = unicodedata.combining(ch) > 0
        becomes = unicodedata.normalize("NFC", "".join(map(prototype, unicodedata.normalize("NFD", ch))))
        becomes = SELECTORS.sub("", becomes)
        length[code] = len(becomes)
        if len(becomes) == 1:
            first[code] = ord(becomes)
        elif becomes:
            first[code] = len(pool)
            pool.extend(map(ord, becomes))
    rare[0x1100:0x1200] = True  # parts of Hangul syllables
    for code in range(0x33480):
        ch = chr(code)
        if ch.isascii() and ch.isalnum() or code > 127 and unicodedata.category(ch)[0] in "LN":
            symbol[code] = ord(ch.lower()[0])
    symbol[[OPEN, CLOSE, COMMA]] = OPEN, CLOSE, COMMA
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, CODES)))
    for bit, kind in ((OTHER, r"[\p{M}\p{Nd}]"), (LATIN, r"\p{Latin}"), (GREEK, r"\p{Greek}"), (CYRILLIC, r"\p{Cyrillic}")):
        word[[ord(c) for c in regex.findall(kind, every)]] = bit
    keys = np.array(sorted(pairs), np.uint64)
    return _Tables(symbol, length, first, np.array(pool, np.uint32), word, mark, rare, apart, keys, np.array([pairs[int(k)] for k in keys], np.uint32))


def _codes(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < CODES, codes, 0xE000)  # beyond: private use, no letter


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, one after the other, 0 where skipped, with braces and commas; and where each starts."""
    t = tables()
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    codes = _codes(texts)
    if not codes.max(initial=0) >= 128:
        return t.symbol[codes], starts
    rare = t.rare[codes]
    size = t.length[codes]
    if (size != 1).any():
        at = np.repeat(np.arange(len(codes)), size)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        several, rare, own = size[at] > 1, rare[at], codes[at]
        codes = t.first[own]
        codes[several] = t.pool[t.first[own[several]] + (np.arange(len(at)) - ends[at])[several]]
        starts = ends[starts]
    else:
        codes = t.first[codes]
    marks = np.flatnonzero(t.mark[codes])
    if len(marks):
        alone = np.zeros(len(codes) + 1, bool)  # starts of texts: an accent there has no letter
        alone[starts] = True
        marks = marks[~alone[marks]]
        before = codes[marks - 1]
        hard = t.mark[before] | t.apart[before]
        rare[marks[hard]] = True
        marks, before = marks[~hard], before[~hard]
        key = before.astype(np.uint64) << np.uint64(21) | codes[marks].astype(np.uint64)
        spot = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        hit = t.pairs[spot] == key
        codes[marks[hit] - 1] = t.joined[spot[hit]]
    kind = t.word[codes]
    if (kind & (GREEK | CYRILLIC)).any():
        inside = kind > 0
        edge = np.diff(inside.astype(np.int8), prepend=0) != 0
        edge[starts[:-1][starts[:-1] < len(codes)]] = True
        runs = np.flatnonzero(edge)
        scripts = np.bitwise_or.reduceat(kind, runs) & (LATIN | GREEK | CYRILLIC) if len(runs) else np.zeros(0, np.uint8)
        for r in np.flatnonzero((scripts & (scripts - np.uint8(1))) != 0):
            a, b = runs[r], runs[r + 1] if r + 1 < len(runs) else len(codes)
            form = resolved_word("".join(map(chr, codes[a:b])))
            if len(form) == b - a:
                codes[a:b] = [ord(c) for c in form]
            else:
                rare[a] = True
    if rare.any():
        slow = set((np.searchsorted(starts, np.flatnonzero(rare), "right") - 1).tolist())
        pieces = [_codes([consistent(x)]) if i in slow else codes[starts[i] : starts[i + 1]] for i, x in enumerate(texts)]
        codes, starts = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    return t.symbol[codes], starts


@lru_cache(2)
def _powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_power_table(b, p, least) for b, p in zip(BASES, PRIMES, strict=True))


@lru_cache(2)
def _inverse_powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_power_table(pow(b, -1, p), p, least) for b, p in zip(BASES, PRIMES, strict=True))


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += k
    return out


def field_spans(symbols: np.ndarray) -> list[tuple[int, int, int]] | None:
    """(start, end, group) of the parts of a folded text: group 0 outside of braces, else the number of the pair. None without braces."""
    spans, at, group, start, cuts = [], 0, 0, -1, []
    for i in np.flatnonzero((symbols == OPEN) | (symbols == CLOSE) | (symbols == COMMA)).tolist():
        c = symbols[i]
        if c == OPEN:
            start, cuts = i, []
        elif c == COMMA:
            cuts.append(i)
        elif start >= 0:
            group += 1
            spans.append((at, start, 0))
            spans.extend((a + 1, b, group) for a, b in zip([start, *cuts], [*cuts, i], strict=True))
            at, start = i + 1, -1
    return [*spans, (at, len(symbols), 0)] if spans else None


class _Parts(NamedTuple):
    """Folded texts cut into parts. The letters and digits of all texts are values; part k has those before bounds[k]."""

    values: np.ndarray
    bounds: np.ndarray
    size: np.ndarray
    both: np.ndarray  # hash of each part
    first: np.ndarray  # each text's first part
    groups: list[list[int] | None]  # of each text with braces, the group of each part

    def fields(self, i: int) -> list[tuple[int, int, int, int]]:
        """(group, hash, size, number) of the parts of text i."""
        a, b = self.first[i], self.first[i + 1]
        return list(zip(self.groups[i], self.both[a:b].tolist(), self.size[a:b].tolist(), range(a, b), strict=True))

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the letters and digits of each text start and end."""
        ends = self.bounds[self.first[1:] - 1]
        return np.concatenate([[0], ends[:-1]]), ends


def _parts(texts: list[str]) -> _Parts:
    symbols, starts = folded(texts)
    opens, closes = (np.concatenate([[0], np.cumsum(symbols == c)]) for c in (OPEN, CLOSE))
    may = ((opens[starts[1:]] > opens[starts[:-1]]) & (closes[starts[1:]] > closes[starts[:-1]])).tolist()
    groups: list[list[int] | None] = []
    ends: list[int] = []  # of the parts, in symbols of the whole batch
    for i, m in enumerate(may):
        spans = field_spans(symbols[starts[i] : starts[i + 1]]) if m else None
        groups.append(None if spans is None else [g for *_, g in spans])
        ends.extend([int(starts[i + 1])] if spans is None else [*(int(starts[i]) + b for _, b, _ in spans)])
    signs = (symbols == OPEN) | (symbols == CLOSE) | (symbols == COMMA)
    kept = np.flatnonzero((symbols > 0) & ~signs)
    bounds = np.searchsorted(kept, np.asarray(ends, np.int64))
    size = np.diff(bounds, prepend=0)
    values = symbols[kept].astype(np.uint64)
    place = np.repeat(bounds, size) - 1 - np.arange(len(kept))  # characters that follow in the same part
    hashes = []
    for power, prime in zip(_powers(_room(size)), PRIMES, strict=True):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[place] % np.uint64(prime), dtype=np.uint64)])
        hashes.append((running[bounds] - running[bounds - size]) % np.uint64(prime))
    both = (hashes[0] << np.uint64(31)) | hashes[1]
    first = np.concatenate([[0], np.cumsum([1 if g is None else len(g) for g in groups], dtype=np.int64)]).astype(np.int64)
    return _Parts(values, bounds, size, both, first, groups)


def _room(size: np.ndarray) -> int:
    return 1 << int(max(1024, size.max(initial=0))).bit_length()


def phrase_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text a 62-bit hash, the order-free sum, the number of fields, and of letters and digits."""
    n = len(texts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    p = _parts(texts)
    start, end = p.written()
    out, fields = p.both[p.first[:-1]].astype(np.int64), np.zeros(n, np.int64)
    mixed = (p.values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
    for i, g in enumerate(p.groups):
        if g is not None:
            parts = p.fields(i)
            out[i] = _joined([(h, s) for _, h, s, _ in _in_order(parts)])
            fields[i] = sum(1 for g, _, s, _ in parts if g and s)
    return out, (running[end] - running[start]).view(np.int64), fields, end - start


def _in_order(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Parts with the fields of each pair of braces in the order of their hashes."""
    order: list[tuple[int, int, int, int]] = []
    i = 0
    while i < len(parts):
        j = i + 1
        while parts[i][0] and j < len(parts) and parts[j][0] == parts[i][0]:
            j += 1
        order.extend(sorted(parts[i:j], key=lambda x: x[1:3]))
        i = j
    return order


def _joined(parts: list[tuple[int, int]]) -> int:
    """Hash of parts, one after the other."""
    a = b = 0
    for h, s in parts:
        a = (a * pow(BASES[0], s, PRIMES[0]) + (h >> 31)) % PRIMES[0]
        b = (b * pow(BASES[1], s, PRIMES[1]) + (h & (2**31 - 1))) % PRIMES[1]
    return (a << 31) | b


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits that count of all texts, fields in the order of their hashes, and how many each has."""
    p = _parts(texts)
    start, end = p.written()
    if all(g is None for g in p.groups):
        return p.values, end - start
    places = []
    for i, g in enumerate(p.groups):
        if g is None:
            places.append(np.arange(start[i], end[i]))
        else:
            places.extend(np.arange(p.bounds[k] - s, p.bounds[k]) for _, _, s, k in _in_order(p.fields(i)))
    return p.values[np.concatenate(places)], end - start


def same_phrases(x: list[str], y: list[str]) -> np.ndarray:
    """Whether texts are copies, pair by pair: pointers run over what counts in both, until they differ or end."""
    (xs, nx), (ys, ny) = _laid_out(x), _laid_out(y)
    out = nx == ny
    apart = xs[np.repeat(out, nx)] != ys[np.repeat(out, ny)]
    ends = np.cumsum(nx[out])
    wrong = np.concatenate([[0], np.cumsum(apart)])
    out[np.flatnonzero(out)[wrong[ends] > wrong[ends - nx[out]]]] = False
    return out


def same_phrase(x: str, y: str) -> bool:
    return bool(same_phrases([x], [y])[0])


_HASH = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "u", "fields", "size")])


@F.pandas_udf(_HASH)
def _hashed(text: pd.Series) -> pd.DataFrame:
    given = text.notna().to_numpy()
    out = np.zeros((4, len(text)), np.int64)
    out[:, given] = phrase_hashes(text[given].tolist())
    return pd.DataFrame(dict(zip(("h", "u", "fields", "size"), out, strict=True)))


@F.pandas_udf(T.BooleanType())
def _verified(x: pd.Series, y: pd.Series) -> pd.Series:
    given = x.notna().to_numpy()
    out = np.ones(len(x), bool)
    if given.any():
        out[given] = same_phrases(x[given].tolist(), y[given].tolist())
    return pd.Series(out)


def fields_match(x: str, y: str) -> bool:
    """Whether y, read as written, is x with the fields of each pair of braces in some order.

    Equal fields are counted, not told apart, and no state (place, fields left) is looked at twice, so that it takes
    steps by the number of such states: about the number of fields, times that of fields of which one begins another.
    """
    px, py = _parts([x]), _parts([y])
    want = "".join(map(chr, py.values.tolist()))
    groups: list[tuple[int, dict[str, int]]] = []
    values = "".join(map(chr, px.values.tolist()))
    for g, b, s in zip(px.groups[0] or [0], px.bounds.tolist(), px.size.tolist(), strict=True):
        if s:
            if not (groups and g and groups[-1][0] == g):
                groups.append((g, {}))
            part = values[b - s : b]
            groups[-1][1][part] = groups[-1][1].get(part, 0) + 1
    if len(values) != len(want):
        return False
    reached = {0}  # places in y after the groups so far: one at most, as all parts of a group have to be used
    for _, counts in groups:
        kinds = sorted(counts)
        todo, seen, out = [(at, tuple(counts[k] for k in kinds)) for at in reached], set(), set()
        while todo and not out:
            at, left = todo.pop()
            if not any(left):
                out.add(at)
            for i, k in enumerate(kinds):
                if left[i] and want.startswith(k, at):
                    state = at + len(k), (*left[:i], left[i] - 1, *left[i + 1 :])
                    if state not in seen:
                        seen.add(state)
                        todo.append(state)
        reached = out
    return len(want) in reached


@F.pandas_udf(T.BooleanType())
def _fields_match(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([fields_match(a, b) for a, b in zip(x, y, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def _in_full(x: pd.Series) -> pd.Series:
    """The phrase as a string, for spellings that only share a hash with the others of their group."""
    def full(text: str) -> str:
        p = _parts([text])
        values = "".join(map(chr, p.values.tolist()))
        parts = [(g, values[b - s : b]) for g, b, s in zip(p.groups[0] or [0], p.bounds.tolist(), p.size.tolist(), strict=True)]
        order = {g: i for i, (g, _) in reversed(list(enumerate(parts))) if g}
        return "".join(v for *_, v in sorted((order.get(g, i), v) for i, (g, v) in enumerate(parts)))

    return x.map(full, na_action="ignore")


def _starts(batches):
    """Keys under which a phrase with fields meets those it may match as written.

    A phrase with fields gives one for each field that may come first (head), each text one for each of its beginnings.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            ids, texts, sums, hs, fields, leads = (c.to_pylist() for c in batch.slice(k, 2000).columns)
            p = _parts(texts)
            start, end = p.written()
            n = end - start
            at = np.arange(len(p.values)) - np.repeat(start, n)
            room = _room(n)
            hashes = []
            for power, inverse, prime in zip(_powers(room), _inverse_powers(room), PRIMES, strict=True):
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(p.values * inverse[at] % np.uint64(prime), dtype=np.uint64)])
                hashes.append((running[1:] - np.repeat(running[start], n)) % np.uint64(prime) * power[at] % np.uint64(prime))
            owner = np.repeat(np.arange(len(texts)), n)
            keys, sides = [(hashes[0] << np.uint64(31) | hashes[1], at + 1, owner)], [np.zeros(len(at), bool)]
            heads = []
            for i, g in enumerate(p.groups):
                if g is not None and leads[i] and fields[i] > 1:
                    parts = p.fields(i)
                    lead = next(j for j, (g, _, s, _) in enumerate(parts) if g and s)
                    before = [(h, s) for _, h, s, _ in parts[:lead]]
                    for h, s in {(h, s) for g, h, s, _ in parts if g == parts[lead][0] and s}:
                        heads.append((_joined([*before, (h, s)]), sum(s for _, s in before) + s, i))
            if heads:
                keys.append(tuple(np.array(c, t) for c, t in zip(zip(*heads, strict=True), (np.uint64, np.int64, np.int64), strict=True)))
                sides.append(np.ones(len(heads), bool))
            h, size, owner = (np.concatenate(c) for c in zip(*keys, strict=True))
            key = (h * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) ^ np.array(sums, np.int64).view(np.uint64)[owner]
            columns = [pa.array(key.view(np.int64)), pa.array(np.concatenate(sides)), *(pa.array(np.array(c, np.int64)[owner]) for c in (ids, hs, fields))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "head", "id", "h", "fields"])


def distinct_spellings(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """(spelling, id, n, h, u, fields, size): one row per stored text, with its smallest id and its number of rows."""
    rows = df.select(id_.cast("long").alias("id"), text.alias("spelling")).filter("spelling IS NOT NULL AND id IS NOT NULL")
    texts = rows.groupBy("spelling").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return cut(texts.withColumn("x", _hashed("spelling")).select("spelling", "id", "n", "x.*"))


def open_phrases(distinct: DataFrame) -> DataFrame:
    """(h, id, spelling, rows, fields, lead_id, n, meets) of the texts that have to be looked at.

    They are those of phrases with several spellings (n), led by the one with the smallest id, and of phrases that
    share their letters with another one where one has fields (meets). The rest is told from hashes alone.
    """
    live = distinct.filter("size > 0")
    phrases = live.groupBy("h").agg(F.min("id").alias("lead_id"), F.count("*").alias("n"), F.min("u").alias("u"), F.max("fields").alias("fields"))
    classes = phrases.groupBy("u").agg(F.count("*").alias("n"), F.max("fields").alias("most"))
    met = classes.filter("n > 1 AND most > 1").select("u", "n", F.lit(True).alias("meets"))
    flagged = salted_join(phrases, met.select("u", "meets"), "u", met.select("u", "n"), F.col("h"), "left")
    needed = cut(flagged.select("h", "lead_id", "n", F.coalesce("meets", F.lit(False)).alias("meets")).filter("n > 1 OR meets"))
    rows = live.select("h", "id", "spelling", F.col("n").alias("rows"), "u", "fields")
    return cut(salted_join(rows, needed, "h", needed.select("h", "n"), F.col("id")))


def links(texts: DataFrame) -> DataFrame:
    """(h, h2, id, id2): phrases with fields, and others with no more of them that may be the same as written; and a spelling of each."""
    # A phrase without fields reads the same in all its spellings; one with fields may be written in several orders.
    reps = texts.filter("meets AND (id = lead_id OR fields > 1)")
    keyed = cut(reps.select("id", "spelling", "u", "h", "fields", (F.col("id") == F.col("lead_id")).alias("lead")).mapInArrow(_starts, "key long, head boolean, id long, h long, fields long"))
    heads = keyed.filter("head").drop("head")
    starts = keyed.filter("NOT head").select("key", F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("fields").alias("fields2"))
    return heads.join(starts, "key").filter("h <> h2 AND fields2 <= fields").select("h", "h2", "id", "id2").distinct()


def merged(texts: DataFrame) -> DataFrame:
    """(h, whole): phrases with several hashes, as some spelling doesn't part its fields."""
    found = links(texts)
    one = texts.select("id", F.col("spelling").alias("s1"))
    two = texts.select(F.col("id").alias("id2"), F.col("spelling").alias("s2"))
    sure = found.join(one, "id").join(two, "id2").filter(_fields_match("s1", "s2")).select("h", "h2")
    return connected_components(sure, "h", "h2").select(F.col("node").alias("h"), F.col("component").alias("whole"))


def spellings(texts: DataFrame) -> DataFrame:
    """(g, extra, spelling, id, n) of the texts of open_phrases(): their phrase is g and extra.

    The others of a hash are compared with its lead, and those that differ, should hashes ever collide, form groups
    by their phrase in full (extra).
    """
    leads = texts.filter("id = lead_id").join(merged(texts), "h", "left").select("h", "whole", F.col("spelling").alias("lead"))
    rows = salted_join(texts.select("h", "id", "lead_id", "spelling", "rows"), leads, "h", texts.filter("id = lead_id").select("h", "n"), F.col("id"))
    other = F.col("id") != F.col("lead_id")
    checked = rows.withColumn("same", ~other | _verified(F.when(other, F.col("spelling")), F.when(other, F.col("lead"))))
    return cut(checked.select(
        F.coalesce("whole", "h").alias("g"), F.when(F.col("same"), "").otherwise(_in_full(F.when(~F.col("same"), F.col("spelling")))).alias("extra"), "spelling", "id", F.col("rows").alias("n")
    ))


def _groups(checked: DataFrame) -> DataFrame:
    return checked.groupBy("g", "extra").agg(F.min("id").alias("first_id"), F.count("*").alias("n_spellings"), F.sum("n").alias("n_copies"))


def phrases(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """One record per phrase: first_id, its stored text, n_spellings, n_copies."""
    distinct = distinct_spellings(df, id_, text)
    texts = open_phrases(distinct)
    checked = spellings(texts)
    named = checked.select(F.col("id").alias("first_id"), F.col("spelling").alias("text"), F.col("g").alias("g2"), F.col("extra").alias("extra2"))
    many = _groups(checked).join(named, "first_id").filter("g = g2 AND extra = extra2").select("first_id", "text", "n_spellings", "n_copies")
    single = distinct.filter("size > 0").join(texts.filter("id = lead_id").select("h"), "h", "left_anti").select(F.col("id").alias("first_id"), F.col("spelling").alias("text"), F.lit(1).cast("long").alias("n_spellings"), F.col("n").alias("n_copies"))
    return many.unionByName(single)


def _print(text: Column) -> list[Column]:
    """128 bits that stand for a stored text, so that the text itself needn't be shuffled."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


def copy_pairs(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """(first_id, copy_id) for each phrase with at least two different stored texts: the smallest id with every other.

    Rows are joined to their text's phrase. What is cut into pieces are the texts with most rows of all, whether or
    not they have a phrase or another spelling.
    """
    distinct = distinct_spellings(df, id_, text)
    checked = spellings(open_phrases(distinct))
    groups = _groups(checked).filter("n_spellings > 1")
    counts = groups.select(F.xxhash64("g", "extra").alias("group"), F.col("n_spellings").alias("n"))
    whole = groups.select(F.xxhash64("g", "extra").alias("group"), F.col("g").alias("g2"), F.col("extra").alias("extra2"), "first_id")
    found = salted_join(checked.select(F.xxhash64("g", "extra").alias("group"), "g", "extra", "id", "spelling"), whole, "group", counts, F.col("id")).filter("g = g2 AND extra = extra2")
    key, key2 = _print(F.col("spelling"))
    frequent = distinct.groupBy(key).agg(F.sum("n").alias("n"))
    rows = df.filter(text.isNotNull() & id_.isNotNull()).select(id_.cast("long").alias("copy_id"), *_print(text))
    pairs = salted_join(rows, found.select(key, key2.alias("k2"), "first_id"), "key", frequent, F.col("copy_id"))
    return pairs.filter("key2 = k2 AND copy_id <> first_id").select("first_id", "copy_id")
