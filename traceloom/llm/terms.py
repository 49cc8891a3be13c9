"""Terms of a text: runs of kept bytes of its UTF-8 form, with A-Z lower-cased."""

from __future__ import annotations


def _table(digits: bool) -> bytes:
    """Letters and all bytes of characters beyond ASCII stay, digits if asked for; every other byte becomes a space."""
    return bytes(ord(chr(b).lower()) if chr(b).isascii() and (chr(b).isalpha() or (digits and chr(b).isdigit())) else b if b > 127 else 32 for b in range(256))


WORDS, WORDS_AND_DIGITS = _table(False), _table(True)


def terms(data: bytes, table: bytes) -> list[bytes]:
    return data.translate(table).split()
