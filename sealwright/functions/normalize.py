"""The shadow text that rules are matched against: NFKC, hidden characters out, look-alikes folded, lower case."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that can't be seen and are removed.
HIDDEN = "\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff\u00ad\u180e"
# Cyrillic letters and the Latin ones they pass for; capitals too become lower case.
_CYRILLIC = ("аеёорсухіјѕквнмт", "aeeopcyxijskbhmt")
# Greek letters and the Latin ones of the same case.
_GREEK = ("ΑαΒΕεΖΗΙιΚκΜΝΟοΡρΤτΥΧχ", "AaBEeZHIiKkMNOoPpTtYXx")
_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
FOLD_FROM = _CYRILLIC[0] + _CYRILLIC[0].upper() + _GREEK[0] + _WIDE
FOLD_TO = _CYRILLIC[1] * 2 + _GREEK[1] + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def _normalize(text: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(text)).as_py() in (True, None):
        return text
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Spark has no NFKC of its own: Python's runs over Arrow batches, and leaves ASCII texts as they are."""
    return F.arrow_udf(_normalize, "string")(text)


def strip_hidden(text: Column) -> Column:
    return F.translate(text, HIDDEN, "")


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def shadow(text: Column, normal: bool = False) -> Column:
    """The shadow of a text. normal: the text is known to be NFKC, so that no Python step is needed."""
    return F.lower(fold_lookalikes(strip_hidden(text if normal else nfkc(text))))


def original_text(context: Column, prompt: Column, response: Column) -> Column:
    """Context, prompt and response with one space between; null if any is."""
    return F.concat(context, F.lit(" "), prompt, F.lit(" "), response)
