"""Problem 2: one consistent form for texts that look the same (confusables skeleton).

A text is decomposed, every character is replaced by its prototype, and the result is decomposed again: that is its
skeleton, equal for all spellings that look the same. Prototypes come from two places: rules over the Unicode
character database (width variants, ligatures, spaces, invisible characters; for skeletons also styled letters such
as mathematical bold ones and Roman numerals) and a table of look-alike letters. Digits and ASCII letters are their
own prototypes: 1 and l stay apart.

The consistent form of a text is the one of the spellings with its skeleton that is composed, of normal width, and
has each word in one script. A word of one script stays as it is; of a mixed one the spelling in that script is taken
which its letters without look-alike speak for. A text is a candidate if it isn't its own skeleton or mixes scripts
in a word; among candidates those differ from the form that aren't consistent.

Null has neither form nor skeleton; an empty or blank text keeps its spaces and line breaks. Texts are treated
whole, however long. Repeated rows are treated alike, each on its own; an empty table gives no rows; a column named
as the form is replaced, all others are kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters that are drawn as a Latin letter.
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝӏѵАВСЕНІЈКМОРЅТХУԚԜѴԌӀ", "aceopxyijshdqwlvABCEHIJKMOPSTXYQWVGI", strict=True))
GREEK = dict(zip("αινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aivopucjABEZHIKMNOPTYXCJ", strict=True))
# Letters of other scripts, and unusual Latin ones, that are drawn as a Latin letter. They take part in skeletons only.
ARMENIAN = dict(zip("օսհոցզյքՕՍԼՏ", "ouhngqjpOULS", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧ", "DRTiAJEWMHGZbRWSVSLCPKd", strict=True))
COPTIC = dict(zip("ⲟⲣⲥⲞⲢⲤⲎⲒⲔⲘⲚⲦ", "opcOPCHIKMNT", strict=True))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
UNUSUAL = dict(zip("ıɑɡſɩʋᴄᴏᴠᴡᴢгЬ", "iagfivcovwzrb", strict=True))
#: The Cyrillic letter for each Latin one, and those of them that are Russian.
FROM_LATIN = {v: k for k, v in reversed(CYRILLIC.items())}
RUSSIAN = {v: k for k, v in CYRILLIC.items() if k in "асеорхуАВСЕНКМОРТХУ"}
LOOKALIKES = CYRILLIC | GREEK
ALL_LOOKALIKES = LOOKALIKES | ARMENIAN | CHEROKEE | COPTIC | LISU | UNUSUAL

LINE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"
#: Not of category Cf, yet invisible: grapheme joiner, Hangul fillers, Khmer inherent vowels, Mongolian selectors.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Texts of these characters only are in consistent form; they never reach Python.
PLAIN = r"^[\t\n\x0b\f\r\x1c-\x1f -~]*$"

_WORD = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}]+")
_RUN = regex.compile(r"(?:\p{Latin}\p{M}*)+|(?:\p{Greek}\p{M}*)+|(?:\p{Cyrillic}\p{M}*)+|[\p{M}\p{Nd}]+")
_LETTER = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}]")
_MIXED = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
_LATIN, _GREEK, _CYR = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Greek}"), regex.compile(r"\p{Cyrillic}")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}]")
SELECTORS = regex.compile("[\u200d\ufe00-\ufe0f\U000e0020-\U000e007f]")


def prototype(ch: str) -> str:
    """What stands for one character before letters are compared. Joiners and selectors are left to _emoji."""
    if SELECTORS.match(ch) or ch in LINE_CHARS:
        return ch
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Cc") or ch in BLANKS or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and "LIGATURE" in unicodedata.name(ch, "")):
        return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    return ch


class _Table(dict):
    """Prototypes by code point, filled as characters are met; at most one entry a character of Unicode."""

    def __missing__(self, code: int) -> str:
        self[code] = prototype(chr(code))
        return self[code]


_PROTOTYPES = _Table()
_LATIN_FORM, _CYRILLIC, _RUSSIAN = str.maketrans(LOOKALIKES), str.maketrans(FROM_LATIN), str.maketrans(RUSSIAN)


class _Drawn(dict):
    """Prototypes of the skeleton by code point: look-alike letters, and by rule styled letters and Roman numerals."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        styled = tag == "<font>" or (tag == "<compat>" and unicodedata.category(ch) == "Nl")
        plain = unicodedata.normalize("NFKD", ch) if styled else ch
        self[code] = "".join(ALL_LOOKALIKES.get(c, c) for c in plain)
        return self[code]


_DRAWN = _Drawn()


def _emoji(text: str) -> str:
    """text without joiners and selectors that belong to no emoji."""
    out: list[str] = []
    base = ""  # the last character that is neither joiner nor selector, while it is an emoji
    for i, ch in enumerate(text):
        if ch == "\u200d":
            follows = text[i + 1 : i + 2]
            if base and out[-1] != ch and follows and _EMOJI.match(follows):
                out.append(ch)
        elif "\ufe00" <= ch <= "\ufe0f":
            keycap = bool(out) and out[-1] in "0123456789#*" and text[i + 1 : i + 2] == "\u20e3"
            if out and (keycap or (base and out[-1] == base)) and ch in "\ufe0e\ufe0f":
                out.append(ch)
        elif "\U000e0020" <= ch <= "\U000e007f":
            if base:
                out.append(ch)
        else:
            base = ch if _EMOJI.match(ch) else ""
            out.append(ch)
    return "".join(out)


def _unmistakable(run: str) -> bool:
    """Whether a run of one script is written so on purpose: by a letter without look-alike, or as an abbreviation (JS, SIM)."""
    letters = _LETTER.findall(run)
    if not _LATIN.match(run):
        return any(c not in LOOKALIKES for c in letters)
    return any(c not in FROM_LATIN for c in letters) or (len(letters) > 1 and any(c not in RUSSIAN for c in letters))


def _by_runs(word: str) -> str:
    """word with each run of look-alikes in the script that has most letters in unmistakable runs; those are kept."""
    runs = _RUN.findall(word)
    sure = [_unmistakable(r) for r in runs]
    n_latin, n_cyrillic, n_greek = (sum(len(x.findall(r)) for r, s in zip(runs, sure, strict=True) if s) for x in (_LATIN, _CYR, _GREEK))
    if n_latin > max(n_cyrillic, n_greek):
        table = _LATIN_FORM
    elif n_cyrillic > max(n_latin, n_greek):
        table = _CYRILLIC
    else:
        return word
    return "".join(r if s else r.translate(table) for r, s in zip(runs, sure, strict=True))


@lru_cache(65536)
def _word(word: str) -> str:
    """Of the spellings of a decomposed word with the same skeleton, that in one script."""
    latin, cyrillic, greek = _LATIN.findall(word), _CYR.findall(word), _GREEK.findall(word)
    if bool(latin) + bool(cyrillic) + bool(greek) < 2:
        return word
    foreign = any(c not in LOOKALIKES for c in cyrillic + greek)
    if not foreign:
        plain_russian = [c for c in cyrillic if c in RUSSIAN.values()]
        if latin and not greek and all(c in RUSSIAN for c in latin) and len(plain_russian) == len(cyrillic) and len(cyrillic) > len(latin):
            return word.translate(_RUSSIAN)
        return word.translate(_LATIN_FORM)
    if cyrillic and not greek and all(c in RUSSIAN for c in latin):
        return word.translate(_RUSSIAN)
    return _by_runs(word)


@lru_cache(65536)
def resolved_word(word: str) -> str:
    """The consistent form of one composed word."""
    return unicodedata.normalize("NFC", _word(unicodedata.normalize("NFD", word)))


def _decomposed(text: str) -> str:
    s = unicodedata.normalize("NFD", text).translate(_PROTOTYPES)
    return _emoji(s) if SELECTORS.search(s) else s


def consistent(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    s = _decomposed(text)
    if _MIXED.search(s):
        s = _WORD.sub(lambda m: _word(m[0]), s)
    return unicodedata.normalize("NFC", s)


def skeleton(text: str | None) -> str | None:
    """Equal for all texts that look the same."""
    return None if text is None else unicodedata.normalize("NFD", _decomposed(text).translate(_DRAWN))


def may_differ(text: str) -> bool:
    """Whether a text isn't its own skeleton, composed, or has letters of several scripts in a word. All others are in consistent form."""
    return unicodedata.normalize("NFC", skeleton(text)) != text or any(
        bool(_LATIN.search(w)) + bool(_GREEK.search(w)) + bool(_CYR.search(w)) > 1 for w in _WORD.findall(text)
    )


@F.pandas_udf(T.StringType())
def _consistent(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


@F.pandas_udf(T.StringType())
def _skeleton(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _may_differ(s: pd.Series) -> pd.Series:
    return pd.Series([may_differ(t) for t in s], dtype=bool)


def inconsistent(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text isn't in consistent form: candidates by their skeleton, which are then compared with their form."""
    rows = df.filter(F.col(text).isNotNull() & ~F.col(text).rlike(PLAIN)).filter(_may_differ(text))
    return with_form(rows, text, "__form").filter(F.col("__form") != F.col(text)).drop("__form")


def consistent_form(text: Column) -> Column:
    plain = text.rlike(PLAIN)
    return F.when(plain, text).otherwise(_consistent(F.when(~plain, text)))


def skeleton_of(text: Column) -> Column:
    plain = text.rlike(PLAIN)
    return F.when(plain, text).otherwise(_skeleton(F.when(~plain, text)))


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """df with the consistent form of a text column, and no other change."""
    return df.withColumn(form, consistent_form(F.col(text)))


def look_alike_groups(df: DataFrame, text: str) -> DataFrame:
    """Texts that look the same, by skeleton: n_rows, n_spellings, and the consistent form most rows have."""
    spelt = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("spelling")).agg(F.count("*").alias("n"))
    keyed = spelt.select("n", consistent_form(F.col("spelling")).alias("form"), skeleton_of(F.col("spelling")).alias("skeleton"))
    forms = keyed.groupBy("skeleton", "form").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return forms.groupBy("skeleton").agg(
        F.sum("n").alias("n_rows"), F.sum("k").alias("n_spellings"),
        F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"),
    )
