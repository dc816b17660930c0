"""Scalar functions over text columns, all of them built from native expressions but content_hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters that count as white space.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Licences by class.
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "Unlicense", "0BSD")
COPYLEFT = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-1.0", "EPL-2.0")


def strip_ends(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normalise(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends; case is kept. Null stays null."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def keyword_of(raw: Column) -> Column:
    """A step's keyword: one of the plain ones as it is, any other without trailing stars, '*' if nothing is left."""
    kw = strip_ends(raw)
    bare = strip_ends(F.regexp_replace(kw, r"\*+$", ""))
    return F.when(kw.isin("Given", "When", "Then", "And", "But", "*"), kw).when(bare == "", "*").otherwise(bare)


def length_compatible(a: Column, b: Column, least: float) -> Column:
    """Whether texts of these lengths can reach an edit similarity of ``least`` at all."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) & (lb == 0), True).when((la == 0) | (lb == 0), False).otherwise(2.0 * F.least(la, lb) / (la + lb) >= least)


@F.pandas_udf(T.StringType())
def _blake(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest(), na_action="ignore")


def content_hash(text: Column) -> Column:
    """32 hex digits of the normalised text. For grouping use the normalised text itself; it needs no Python."""
    return _blake(normalise(text))


def quoted_count(text: Column) -> Column:
    """Number of quoted values, in single or double quotes and without a backslash."""
    return F.regexp_count(text, F.lit("\"[^\"\\\\]*\"|'[^'\\\\]*'"))


# Fixed value: what counts as a parameter of a step.
PARAMETER = "\"[^\"]*\"|'[^']*'|(?U)[<>][\\w-]+[<>]|[0-9]+"


def bare_words(text: Column) -> Column:
    """Lower-case words with quoted values, placeholders and numbers replaced by 'param', parted by single blanks."""
    named = F.regexp_replace(text, PARAMETER, " PARAM ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(named), r"(?U)[^\w\s]", " "), f"[{WHITE}]+", " "))


def words_of(text: Column) -> Column:
    """The words of a text that is parted by single blanks; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 0 if either text has none."""
    wa, wb = F.array_distinct(words_of(a)), F.array_distinct(words_of(b))
    both = F.size(F.array_intersect(wa, wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(both / (F.size(wa) + F.size(wb) - both))


def license_class_of(spdx: Column) -> Column:
    """permissive, copyleft, unknown, or unlicensed where there is no licence."""
    return F.when(spdx.isNull() | (F.trim(spdx) == ""), "unlicensed").when(spdx.isin(*PERMISSIVE), "permissive").when(spdx.isin(*COPYLEFT), "copyleft").otherwise("unknown")


def slug_of(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("_"))


def split_path(path: Column) -> tuple[Column, Column]:
    """(repo_slug, file_path) of a path with the slug in front; back-slashes are slashes."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(p, "/")
    return F.when(at > 0, F.substring_index(p, "/", 1)).otherwise(p), F.when(at > 0, F.substr(p, at + 1)).otherwise("")


def snippet(text: Column, most: int = 80) -> Column:
    """text, or its first characters and three dots where it is longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def cut_at_word(text: Column, most: int = 60) -> Column:
    """text up to the last whole word within ``most`` characters."""
    head = F.regexp_extract(text, f"^(.{{0,{most - 1}}}\\S)(?=\\s)", 1)
    return F.when(F.length(text) <= most, text).when(head != "", head).otherwise(F.substring(text, 1, most))


def day_of(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)
