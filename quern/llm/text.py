"""Text primitives on UTF-8 bytes, shared by the Python stages."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: Lower-cases A-Z and leaves every other byte.
LOWERED = bytes.maketrans(UPPER, LOWER)
#: Lower-cases A-Z and turns every byte that is no ASCII letter, digit or part of a non-ASCII character to a space.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a column as bytes; a null text is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
