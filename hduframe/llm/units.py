"""Cutting texts into units that a byte-level tokenizer encodes independently of what stands around them.

A unit is a space with what follows it up to the next space. Nearly all units of a corpus repeat, so operators keep the
result of a unit and join results; a piece of the tokenizer's pattern never reaches over a unit's end.
"""

from __future__ import annotations

import re

import regex

#: Where a cut before a space could fall inside a piece: a space with white space on both sides, or white space outside ASCII.
_UNSAFE = re.compile(
    rb"[\x09-\x0d\x20] (?:[\x09-\x0d\x20]|\Z)|[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80"
)


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Cutter:
    """``units``: a text's units, whose concatenation is the text; ``pieces``: the matches of the pattern in a unit."""

    def __init__(self, pattern: str) -> None:
        self._pieces = regex.compile(pattern).findall

    def units(self, data: bytes) -> list[bytes]:
        if not data:
            return []
        if _UNSAFE.search(data):
            return self.pieces(data)
        first, *rest = data.split(b" ")
        return ([first] if first else []) + [b" " + x for x in rest]

    def pieces(self, unit: bytes) -> list[bytes]:
        return [x.encode() for x in self._pieces(unit.decode("utf-8", "replace"))]
