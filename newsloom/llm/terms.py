"""Terms of whole texts, as UTF-8 bytes.

A term is a longest run of bytes that a table keeps; only A-Z are lower-cased. Every byte of a character
outside ASCII is above 127, so runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes that are cut into terms at once; a longer text is taken in pieces that end between terms.
PIECE = 1 << 20


def table(digits: bool) -> bytes:
    """What each byte becomes: itself, its small letter, or a space between terms."""
    kept = lambda c: c >= 0x80 or chr(c).isalpha() or digits and chr(c).isdigit()
    return bytes(ord(chr(c).lower()) if kept(c) and c < 0x80 else c if kept(c) else 0x20 for c in range(256))


LETTERS = table(digits=False)
WORDS = table(digits=True)


def lists(text: bytes, kept: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    clean = text.translate(kept)
    if len(clean) <= PIECE:
        yield clean.split()
        return
    start = 0
    while start < len(clean):
        end = clean.find(b" ", start + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def raw(column: pa.Array) -> list[bytes]:
    """A column's texts as bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
