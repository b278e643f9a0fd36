"""Words of letters and digits, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z in lower case, found in UTF-8 bytes."""

from __future__ import annotations

import pyarrow as pa

#: What each byte becomes: A-Z lower case, what no word holds a space; all bytes of characters beyond ASCII stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def utf8(texts: pa.Array) -> pa.Array:
    """The bytes of a column of texts."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
