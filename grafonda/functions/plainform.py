"""Reduction of spellings to plain a-z0-9 forms (Arrow UDFs: Spark has no Unicode normalisation)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OTHER = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile("[\u0300-\u0314\u0316-\u0319\u031b-\u034e\u0350-\u036f]")
_BLANKS = re.compile(r"\s+")


def plain(text: str | None) -> str:
    """Decomposed (NFKD), without combining marks, lower case, đ as d, other characters as single blanks."""
    if not text:
        return ""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("đ", "d").replace("Đ", "d")
        if not text.isascii():  # marks outside the common block, letters of other scripts
            text = "".join(c for c in text if not unicodedata.combining(c))
    return _OTHER.sub(" ", text.lower().replace("đ", "d")).strip()


def title_key(title: str | None) -> str:
    """A title as compared between records: NFC, ``_`` as blank, blanks collapsed and trimmed, lower case."""
    if not title:
        return ""
    return _BLANKS.sub(" ", unicodedata.normalize("NFC", title).replace("_", " ")).strip().lower()


@F.pandas_udf(StringType())
def plain_udf(texts: pd.Series) -> pd.Series:
    return texts.map(plain)


def _normaliser(form: str):
    @F.pandas_udf(StringType())
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalise


nfc = _normaliser("NFC")
nfd = _normaliser("NFD")
nfkc = _normaliser("NFKC")
nfkd = _normaliser("NFKD")
