"""Header cards and the index of header-data units (HDUs) of a FITS file."""

from __future__ import annotations

import gzip
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

BLOCK, CARD = 2880, 80
COMMENTARY = ("COMMENT", "HISTORY", "")
Value = str | int | float | bool | complex | None


def check_name(path: str) -> str:
    """Refuse names that file libraries would run as commands: a pipe mark at either end, also behind '!'."""
    bare = path.lstrip("!").strip()
    if not bare or bare.startswith("|") or bare.endswith("|"):
        raise ValueError(f"not a file name: {path!r}")
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def open_file(path: str) -> BinaryIO:
    """A file for reading; whole-file gzip is unpacked, as its parts can't be addressed."""
    path = check_name(path)
    with open(path, "rb") as probe:
        packed = probe.read(2) == b"\x1f\x8b"
    if packed:
        with gzip.open(path) as file:
            return io.BytesIO(file.read())
    return open(path, "rb")  # noqa: SIM115


@dataclass(frozen=True)
class Card:
    key: str
    value: Value = None
    comment: str = ""


_TEXT = re.compile(r"'((?:[^']|'')*)'\s*(?:/\s?(.*))?$")
_OTHER = re.compile(r"([^/]*?)\s*(?:/\s?(.*))?$")


def _scalar(text: str) -> Value:
    text = text.strip()
    if text in ("T", "F"):
        return text == "T"
    if text.startswith("("):
        re_, im = text.strip("()").split(",")
        return complex(float(re_), float(im))
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text.replace("D", "E").replace("d", "e"))
    except ValueError:
        return text or None


def parse_card(image: str) -> Card:
    key = image[:8].rstrip()
    if image.startswith("HIERARCH ") and "=" in image:
        key, _, rest = image[9:].partition("=")
        key = key.strip()
    elif image[8:10] == "= " and key not in COMMENTARY:
        rest = image[10:]
    elif key == "CONTINUE":
        rest = image[8:]
    else:
        return Card(key, image[8:].rstrip())
    rest = rest.strip()
    if found := _TEXT.match(rest):
        return Card(key, found[1].replace("''", "'").rstrip(), (found[2] or "").rstrip())
    found = _OTHER.match(rest)
    return Card(key, _scalar(found[1]), (found[2] or "").rstrip())


def _number(value: float) -> str:
    out = repr(float(value)).upper()
    return out if "." in out or "E" in out or "N" in out else out + ".0"


def format_card(card: Card) -> list[str]:
    """The 80-character images of a card; long strings go on in CONTINUE cards, long commentary in cards of the same key."""
    key, value = card.key.upper(), card.value
    if key in COMMENTARY:
        text = str(value or "")
        return [f"{key:<8}{text[k : k + 72]:<72}" for k in range(0, max(len(text), 1), 72)]
    head = f"{key:<8}= " if len(key) <= 8 and " " not in key else f"HIERARCH {key} = "
    tail = f" / {card.comment}" if card.comment else ""
    if isinstance(value, str):
        quoted = value.replace("'", "''")
        if len(head) + len(quoted) + 2 <= CARD:
            return [f"{head}'{quoted:<8}'{tail}"[:CARD].ljust(CARD) if len(head) + len(quoted) + 2 + len(tail) <= CARD else f"{head}'{quoted}'".ljust(CARD)]
        parts, out = [quoted[k : k + 60] for k in range(0, len(quoted), 60)], []
        for k, part in enumerate(parts):
            # a doubled quote must not be cut in two
            if part.endswith("'") and (len(part) - len(part.rstrip("'"))) % 2 and k + 1 < len(parts):
                parts[k + 1] = "'" + parts[k + 1]
                part = part[:-1]
            mark = "&" if k + 1 < len(parts) else ""
            out.append((f"{head}'{part}{mark}'" if k == 0 else f"CONTINUE  '{part}{mark}'").ljust(CARD))
        return out
    if value is None:
        text = ""
    elif isinstance(value, bool):
        text = "T" if value else "F"
    elif isinstance(value, complex):
        text = f"({_number(value.real)}, {_number(value.imag)})"
    else:
        text = str(int(value)) if isinstance(value, int) else _number(value)
    return [f"{head}{text:>20}{tail}"[:CARD].ljust(CARD)]


@dataclass
class Header:
    """Cards in order. Reading by key gives the last card of that key; COMMENT and HISTORY may repeat, other keys are replaced."""

    cards: list[Card] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Header:
        cards: list[Card] = []
        for at in range(0, len(data), CARD):
            image = data[at : at + CARD].decode("ascii", "replace")
            card = parse_card(image)
            if card.key == "END":
                break
            if card.key == "CONTINUE" and cards and isinstance(cards[-1].value, str) and cards[-1].value.endswith("&"):
                last = cards[-1]
                cards[-1] = Card(last.key, last.value[:-1] + str(card.value or ""), last.comment or card.comment)
            elif card.key or card.value:
                cards.append(card)
        return cls(cards)

    def get(self, key: str, default: Value = None) -> Value:
        key = key.upper()
        return next((c.value for c in reversed(self.cards) if c.key.upper() == key), default)

    def __getitem__(self, key: str) -> Value:
        if key not in self:
            raise KeyError(key)
        return self.get(key)

    def __contains__(self, key: str) -> bool:
        return any(c.key.upper() == key.upper() for c in self.cards)

    def keys(self) -> list[str]:
        return list(dict.fromkeys(c.key for c in self.cards))

    def items(self) -> Iterator[tuple[str, Value]]:
        return ((k, self.get(k)) for k in self.keys())

    def set(self, key: str, value: Value, comment: str = "") -> None:
        key = key.upper()
        at = next((k for k, c in enumerate(self.cards) if c.key.upper() == key), None)
        if key in COMMENTARY or at is None:
            self.cards.append(Card(key, value, comment))
        else:
            self.cards[at] = Card(key, value, comment or self.cards[at].comment)

    def remove(self, key: str) -> None:
        self.cards = [c for c in self.cards if c.key.upper() != key.upper()]

    def many(self, key: str) -> list[Value]:
        return [c.value for c in self.cards if c.key.upper() == key.upper()]

    def to_bytes(self) -> bytes:
        text = "".join(image for card in self.cards for image in format_card(card)) + "END".ljust(CARD)
        return text.encode("ascii", "replace").ljust(-(-len(text) // BLOCK) * BLOCK)


@dataclass(frozen=True)
class HDU:
    """Where a unit is in its file, and its header."""

    number: int
    header: Header
    start: int
    data_start: int
    data_length: int

    @property
    def end(self) -> int:
        return self.data_start + -(-self.data_length // BLOCK) * BLOCK

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME") or "").strip()

    @property
    def shape(self) -> tuple[int, ...]:
        """Axes in C order."""
        return tuple(int(self.header[f"NAXIS{k}"]) for k in range(int(self.header.get("NAXIS", 0)), 0, -1))

    @property
    def kind(self) -> str:
        extension = str(self.header.get("XTENSION") or "IMAGE").strip()
        if extension == "BINTABLE":
            return "COMPRESSED_IMAGE" if self.header.get("ZIMAGE") is True or "ZCMPTYPE" in self.header else "BINTABLE"
        return "TABLE" if extension == "TABLE" else "IMAGE"


def data_length(header: Header) -> int:
    axes = [int(header[f"NAXIS{k}"]) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
    if not axes:
        return 0
    size = 1
    for n in axes[1:] if header.get("GROUPS") is True and axes[0] == 0 else axes:
        size *= n
    return abs(int(header["BITPIX"])) // 8 * int(header.get("GCOUNT", 1) or 1) * (int(header.get("PCOUNT", 0) or 0) + size)


def index(path: str) -> list[HDU]:
    """All units of a file; only headers are read."""
    out: list[HDU] = []
    with open_file(path) as file:
        size = file.seek(0, os.SEEK_END)
        at = 0
        while at < size:
            file.seek(at)
            blocks = b""
            while True:
                block = file.read(BLOCK)
                if len(block) < BLOCK:
                    if out and not (blocks + block).strip(b"\0 "):
                        return out
                    raise ValueError(f"{path}: header of unit {len(out)} has no end")
                blocks += block
                if any(block[k : k + 8] == b"END     " for k in range(0, BLOCK, CARD)):
                    break
            if not out and not blocks.startswith(b"SIMPLE  ="):
                raise ValueError(f"{path}: not a FITS file")
            header = Header.parse(blocks)
            unit = HDU(len(out), header, at, at + len(blocks), data_length(header))
            out.append(unit)
            at = unit.end
    return out


def find(path: str, hdu: int | str | None = None, tables_only: bool = False) -> HDU:
    """A unit by number, by name (without case and outer blanks; the first of that name), or the one that holds data: the first
    image with pixels, else the first table, else the primary."""
    units = index(path)
    if hdu is None or hdu == "auto":
        images = [u for u in units if (u.kind == "IMAGE" and u.shape and all(u.shape)) or u.kind == "COMPRESSED_IMAGE"]
        tables = [u for u in units if u.kind in ("BINTABLE", "TABLE")]
        return (tables or units if tables_only else images or tables or units)[0]
    if isinstance(hdu, int) or str(hdu).lstrip("-").isdigit():
        number = int(hdu)
        if not 0 <= number < len(units):
            raise IndexError(f"{path}: no unit {number}")
        unit = units[number]
    else:
        wanted = str(hdu).strip().upper()
        unit = next((u for u in units if u.name.upper() == wanted and not (tables_only and u.kind not in ("BINTABLE", "TABLE"))), None)
        if unit is None:
            raise KeyError(f"{path}: no unit named {hdu!r}")
    if tables_only and unit.kind not in ("BINTABLE", "TABLE"):
        raise ValueError(f"{path}: unit {unit.number} is not a table")
    return unit


def read_range(path: str, start: int, length: int) -> bytes:
    with open_file(path) as file:
        file.seek(start)
        data = file.read(length)
    if len(data) < length:
        raise ValueError(f"{path}: {length} bytes wanted at {start}, {len(data)} found")
    return data
