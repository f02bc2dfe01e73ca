"""Cutting text into pre-tokens as Java regular expressions, run inside the JVM.

A tokenizer file may normalize text and cut it by patterns of its own. These settings become column expressions
here; only Unicode normal forms, which the JVM side of Spark does not offer as a function, use Python, and only
for texts that hold a character that a normal form can change.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F

# The published byte-level split pattern. (?U) makes \s cover all Unicode white space.
PRETOKEN_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The lowest code point that each normal form can change.
_CHANGED_FROM = {"NFC": 0x300, "NFD": 0xC0, "NFKC": 0xA0, "NFKD": 0xA0}


@dataclass(frozen=True)
class Splitting:
    """How a tokenizer cuts text before encoding.

    ``specials`` are its special literals; those in ``left_blanks`` or ``right_blanks`` take the white space on
    that side with them. What lies between is normalized by ``normal`` steps and cut by ``cuts``, one after the
    other: ``(step, argument, ...)`` as in :func:`normalized` and :func:`cut_pieces`.
    """

    specials: tuple[str, ...] = ("[UNK]",)
    prefix_space: bool = False
    left_blanks: tuple[str, ...] = ()
    right_blanks: tuple[str, ...] = ()
    normal: tuple[tuple[str, ...], ...] = ()
    cuts: tuple[tuple[str, str], ...] = (("matches", PRETOKEN_PATTERN),)


def pretokens(text: Column) -> Column:
    """Text -> array of pre-tokens (training view: the special literal is ordinary text)."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), F.lit(0))


def java_literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _normal_form(parts: Column, form: str) -> Column:
    """Unicode normal form of the texts of an array."""
    changed = F.exists(parts, lambda p: p.rlike(rf"[\x{{{_CHANGED_FROM[form]:X}}}-\x{{10FFFF}}]"))

    @F.pandas_udf("array<string>")
    def convert(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [unicodedata.normalize(form, t) for t in a])

    return F.coalesce(convert(F.when(changed, parts)), parts)


def _step(kind: str, *arguments: str):
    """A normalization step other than a normal form, as a function of a text column."""
    if kind == "lower":  # letter by letter, so a final sigma is like any other
        return lambda p: F.lower(F.replace(p, F.lit("Σ"), F.lit("σ")))
    if kind == "replace":
        inserted = re.sub(r"([\\$])", r"\\\1", arguments[1])
        return lambda p: F.regexp_replace(p, arguments[0], inserted)
    if kind == "replace_text":
        return lambda p: F.replace(p, F.lit(arguments[0]), F.lit(arguments[1]))
    if kind == "strip":
        return lambda p: F.regexp_replace(p, arguments[0], "")
    if kind == "prepend":
        return lambda p: F.when(p == "", p).otherwise(F.concat(F.lit(arguments[0]), p))
    raise ValueError(f"unknown normalization {kind}")


def normalized(parts: Column, steps: tuple[tuple[str, ...], ...]) -> Column:
    """The texts of an array after the steps ``form``, ``lower``, ``replace``, ``replace_text``, ``strip``, ``prepend``."""
    for kind, *arguments in steps:
        parts = _normal_form(parts, arguments[0]) if kind == "form" else F.transform(parts, _step(kind, *arguments))
    return parts


def _cut(kind: str, pattern: str):
    """A cut as a function from a text column to an array of its pieces."""
    inner = pattern.removeprefix("(?U)")
    gap = rf"(?:(?!(?:{inner}))[\s\S])+"
    if kind == "matches":
        return lambda p: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))
    if kind == "gaps":
        # A match gives an empty last group, a gap gives itself.
        group = F.lit(_groups(inner) + 1)
        return lambda p: F.filter(F.regexp_extract_all(p, F.lit(rf"(?U)(?:{inner})|({gap})"), group), lambda x: x != "")
    if kind == "both":
        return lambda p: F.regexp_extract_all(p, F.lit(rf"(?U)(?:{inner})|{gap}"), F.lit(0))
    raise ValueError(f"unknown cut {kind}")


def _led(pattern: str):
    return lambda p: F.when((p != "") & ~F.startswith(p, F.lit(pattern)), F.concat(F.lit(pattern), p)).otherwise(p)


def cut_pieces(pieces: Column, cuts: tuple[tuple[str, str], ...]) -> Column:
    """The texts of an array cut further by each ``(kind, pattern)``; empty pieces are left out.

    ``matches`` keeps what the pattern matches, ``gaps`` what lies between, ``both`` keeps both, and
    ``lead`` puts the pattern, a text, before pieces that do not begin with it.
    """
    for kind, pattern in cuts:
        if kind == "lead":
            pieces = F.transform(pieces, _led(pattern))
        else:
            pieces = F.flatten(F.transform(pieces, _cut(kind, pattern)))
    return F.filter(pieces, lambda p: p != "")


def _groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    return len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?)", pattern))


def encoding_pretokens(text: Column, splitting: Splitting) -> Column:
    """Text -> array of pre-tokens where the literals of special tokens stand alone (encoding view).

    Texts that hold a literal are cut at it first and each part is split by itself, so white space before
    a literal counts as trailing and no pattern has to look ahead for it.
    """
    plain_cut = splitting.cuts == (("matches", PRETOKEN_PATTERN),) and not splitting.normal

    def part(value: Column) -> Column:
        if splitting.prefix_space:
            bare = (value != "") & ~F.startswith(value, F.lit(" "))
            value = F.when(bare, F.concat(F.lit(" "), value)).otherwise(value)
        return pretokens(value) if plain_cut else cut_pieces(F.array(value), splitting.cuts)

    if not splitting.specials:
        return part(normalized(F.array(text), splitting.normal)[0])
    # Of literals that begin alike the longest is cut out.
    ordered = sorted(splitting.specials, key=lambda s: (-len(s), s))
    literals = "(?U)" + "|".join(
        (r"\s*" if s in splitting.left_blanks else "") + java_literal(s) + (r"\s*" if s in splitting.right_blanks else "")
        for s in ordered
    )
    held = reduce(or_, (F.contains(text, F.lit(s)) for s in splitting.specials))
    # Almost no text holds a literal; a byte search tells, so the pattern only runs where one stands.
    parts = normalized(F.when(held, F.split(text, literals, -1)).otherwise(F.array(text)), splitting.normal)
    found = F.regexp_extract_all(text, F.lit(literals), F.lit(0))
    if splitting.left_blanks or splitting.right_blanks:
        found = F.transform(found, lambda f: F.regexp_replace(f, r"(?U)^\s+|\s+$", ""))
    mixed = F.flatten(
        F.transform(
            parts,
            lambda value, i: F.when(i == 0, part(value)).otherwise(
                F.concat(F.array(F.get(found, i - 1)), part(value))
            ),
        )
    )
    return F.when(held, mixed).otherwise(part(text if not splitting.normal else parts[0]))
