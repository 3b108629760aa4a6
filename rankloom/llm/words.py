"""Words of whole texts as bytes: runs of ASCII letters and digits and of all code points beyond ASCII, A-Z lowered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of such words stay (all bytes of code points beyond ASCII are above 0x7F), A-Z are lowered, others part words.
TABLE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
BLOCK = 1 << 20


def blocks(text: bytes, most: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about `most` bytes, so that a very long text needs little memory."""
    low = text.translate(TABLE)
    start = 0
    while len(low) - start > most:
        end = low.find(b" ", start + most)
        if end < 0:
            break
        yield low[start:end].split()
        start = end
    yield low[start:].split() if start else low.split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
