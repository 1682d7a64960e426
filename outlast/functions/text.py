"""Accent- and case-free text."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def plain(text: str | None) -> str:
    """Lower case without accents and outer blanks; anything that is not text becomes ``""``."""
    if not isinstance(text, str):
        return ""
    lowered = text.lower()
    if not lowered.isascii():
        lowered = _without_marks(lowered)
    return lowered.strip()


@F.pandas_udf(StringType())
def _plain_batch(texts: pd.Series) -> pd.Series:
    return texts.map(plain)


def normalize_text(text: Column) -> Column:
    """Materialised normal form. Unicode decomposition has no built-in, hence an Arrow-batched UDF."""
    return _plain_batch(text)


def _single_letter_folds() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one letter plus marks, and that letter."""
    accented, base = [], []
    marks = []
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if unicodedata.category(letter) == "Mn":
            marks.append(letter)
            continue
        if not unicodedata.decomposition(letter) or letter != letter.lower():
            continue
        folded = _without_marks(letter)
        if folded != letter and len(folded) == 1:
            accented.append(letter)
            base.append(folded)
    # translate() deletes the characters that have no counterpart: the bare marks at the end.
    return "".join(accented + marks), "".join(base)


_FOLDS: tuple[str, str] | None = None


def same_text(text: Column, target: str) -> Column:
    """Does ``text`` equal ``target`` up to case, accents and outer blanks? Runs on the JVM."""
    global _FOLDS
    if _FOLDS is None:
        _FOLDS = _single_letter_folds()
    folded = F.regexp_replace(F.translate(F.lower(text), *_FOLDS), r"(?U)^\s+|\s+$", "")
    return F.coalesce(folded, F.lit("")) == F.lit(plain(target))
