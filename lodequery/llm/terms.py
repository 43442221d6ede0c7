"""Terms of texts as UTF-8 bytes, for counting and search: runs of letters (and whatever else is asked for), A-Z lower-cased.

Every byte from 0x80 on belongs to a term, so all characters beyond ASCII do. Work is on bytes: two passes in C over a text, in bounded pieces.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text whose terms are held as a list at once.
PIECE = 1 << 22


def term_table(also: bytes = b"") -> bytes:
    """For bytes.translate: letters in lower case, bytes from 0x80 on and those in ``also`` stay; all others become spaces."""
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or c in also else 0x20 for c in range(256))


def terms(text: bytes | None, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists; nothing for a null text. No term is cut."""
    text, at = (text or b"").translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + piece) if len(text) - at > piece else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as they are stored."""
    return column.cast(pa.binary()).to_pylist()
