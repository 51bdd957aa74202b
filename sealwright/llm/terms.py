"""Terms of texts: runs of letters (and digits) as UTF-8 bytes, only A-Z lower-cased.

Every byte of a character beyond ASCII belongs to a term, so texts are cut as bytes: one table turns
capitals into small letters and whatever parts terms into spaces. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_PIECE = 4 << 20  # bytes of a text that become terms at once


def term_table(digits: bool) -> bytes:
    """What each byte becomes: A-Z small letters; a-z, bytes from 0x80 and, if asked for, 0-9 themselves; all else spaces."""
    keep = set(range(0x61, 0x7B)) | set(range(0x80, 0x100)) | (set(range(0x30, 0x3A)) if digits else set())
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


LETTERS, LETTERS_DIGITS = term_table(False), term_table(True)


def pieces_of_terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in order; very long texts come in several pieces, none of which cuts a term."""
    data = text.translate(table)
    if len(data) <= _PIECE:
        yield data.split()
        return
    a = 0
    while a < len(data):
        b = data.find(b" ", a + _PIECE)
        b = len(data) if b < 0 else b
        yield data[a:b].split()
        a = b


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column's texts as bytes; a null is an empty text."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
