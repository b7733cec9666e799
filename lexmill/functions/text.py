"""Text and tag expressions. All are plain Columns, so they stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Fixed values that decide results.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
REVIEW_PATTERN = r"(<br\s*/><br\s*/>)|(-)|(/)"
PUNCT_PATTERN = r"""[.;:!'?,"()\[\]]"""
OTHER_LABEL = "other-tags"
INDEX_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
UMLAUTS = (("ae", "ä"), ("oe", "ö"), ("ue", "ü"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_tags(col, tags: Iterable[str]) -> Column:
    """Tags that are in the allow-list, in their order, duplicates kept."""
    allowed = list(tags)
    return F.filter(_col(col), lambda t: t.isin(allowed))


def first_tag_label(col, default: str = OTHER_LABEL) -> Column:
    return F.coalesce(F.get(_col(col), F.lit(0)), F.lit(default))


def combine_text(*cols) -> Column:
    """Parts joined without separator; one null part makes the whole null."""
    return F.concat(*[_col(c) for c in cols])


def decode_text(col) -> Column:
    return F.decode(_col(col), "UTF-8")


def decode_label(col) -> Column:
    """Digits in UTF-8 bytes to an integer."""
    return F.decode(_col(col), "UTF-8").cast("int")


def clean_review(col) -> Column:
    """A doubled line-break tag, a hyphen and a slash each become one space."""
    return F.regexp_replace(_col(col), REVIEW_PATTERN, " ")


def strip_punct(col, lower: bool = True) -> Column:
    c = F.lower(_col(col)) if lower else _col(col)
    return F.regexp_replace(c, PUNCT_PATTERN, "")


def restore_umlauts(col, lang) -> Column:
    text = _col(col)
    for plain, umlaut in UMLAUTS:
        text = F.replace(text, F.lit(plain), F.lit(umlaut))
    return F.when(_col(lang) == "de", text).otherwise(_col(col))


def scale_by(col, constant: float) -> Column:
    return _col(col).cast("float") / F.lit(float(constant))


def strip_newlines(col) -> Column:
    return F.replace(_col(col), F.lit("\n"), F.lit(""))


def word_count(col) -> Column:
    """Pieces between single spaces; empty pieces count."""
    return F.size(F.split(_col(col), " ", -1))


def words(col) -> Column:
    """Lower-cased runs of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(WORD_PATTERN), F.lit(0))


def cased_words(col) -> Column:
    return F.regexp_extract_all(_col(col), F.lit(WORD_PATTERN), F.lit(0))


def _accents() -> tuple[str, str]:
    """Characters to replace and to drop, from the decompositions of the character
    database: a letter with marks becomes the letter, a mark of its own goes."""
    bare, marked = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and all(unicodedata.combining(c) for c in whole[1:]):
            marked.append(chr(code))
            bare.append(whole[0])
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(marked) + marks, "".join(bare)


ACCENTS = _accents()


def strip_accents(col) -> Column:
    """Letters without their marks; ``translate`` drops what has no partner."""
    return F.translate(_col(col), *ACCENTS)


def index_words(col) -> Column:
    """Words for the frequency index: lower-case, filtered characters become
    spaces, split on spaces, empty pieces dropped."""
    blanked = F.translate(F.lower(_col(col)), INDEX_FILTERS, " " * len(INDEX_FILTERS))
    return F.filter(F.split(blanked, " ", -1), lambda w: w != "")


def word_ngrams(tokens, low: int, high: int) -> Column:
    """All n-grams of ``low``..``high`` tokens joined by one space."""
    t = _col(tokens)

    def grams(n: int) -> Column:
        last = F.size(t) - n
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(low, high + 1)])
