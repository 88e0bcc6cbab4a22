"""Words of whole texts as UTF-8 bytes, cut with table lookups instead of a regular expression.

A word is a maximal run of digits, letters a to z (A to Z count as these) and characters
beyond ASCII. All bytes of the latter are 128 or more, so bytes can be looked at one by one.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

_KEPT = (string.digits + string.ascii_lowercase).encode()
_UPPER = string.ascii_uppercase.encode()
#: Each byte as it stands in a word, or a blank where it ends one.
TABLE = bytes(b if b in _KEPT or b >= 128 else b + 32 if b in _UPPER else 32 for b in range(256))
#: Bytes of one text that are held as single words at a time.
STRETCH = 1 << 20


def word_lists(data: bytes | None) -> Iterator[list[bytes]]:
    """The words of one text in their order, in stretches that end between words; nothing for null."""
    plain = (data or b"").translate(TABLE)
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + STRETCH)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end
