"""Terms of texts for the counting operators: runs of bytes of one class, cut by a translation table.

A class holds some ASCII characters and every other character, whose UTF-8 bytes are all above 0x7F; so a run of characters of the class
is a run of bytes, and only A-Z are lower-cased.
"""

from __future__ import annotations

#: Class `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`.
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Class `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`.
LETTERS_DIGITS = LETTERS | frozenset(b"0123456789")


def cutter(ascii_class: frozenset) -> bytes:
    """The table by which a text's bytes are lower-cased and all that stands between terms becomes a space."""
    return bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or c in ascii_class else 32 for c in range(256))


def split(raw: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a text in order, repeats included; none of null."""
    return raw.translate(table).split() if raw else []
