"""Vocabulary files of sentence pieces, as far as the operators need them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Kinds of pieces in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Pieces with scores and kinds, and the rules of the normaliser."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    prefix: bool = True  # a space goes before the text
    squeeze: bool = True  # runs of spaces become one, those at the ends go
    charsmap: bool = False
    suffix_space: bool = False

    @staticmethod
    def read(path: str) -> PieceModel:
        with open(path, "rb") as f:  # a vocabulary file, there on every machine
            data = f.read()
        m = PieceModel()
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                m.pieces.append(part[1].decode("utf-8"))
                m.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                m.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                m.suffix_space = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                rules = dict(_fields(value))
                m.charsmap, m.prefix, m.squeeze = bool(rules.get(2)), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if m.charsmap or m.suffix_space or USER_DEFINED in m.kinds:
            raise ValueError("vocabularies with a character map, user-defined pieces or spaces as suffixes aren't supported")
        return m

    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}

    def bytes(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}

    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


class Cutter:
    """Normalises texts and cuts them where no piece can cross: before spaces and around characters outside all pieces."""

    def __init__(self, model: PieceModel):
        pieces = model.normal()
        self.model = model
        self.open = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)  # a piece crosses spaces: texts stay whole
        self.line = not any("\n" in p for p in pieces)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __call__(self, text: str | None) -> list[str]:
        """Units of the normalised text; joined they are that text. None for null or empty texts."""
        if not text:
            return []
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return []
        text = (" " + text if self.model.prefix else text).replace(" ", SPACE)
        if self.open:
            return [text]
        if SPACE * 2 in text or not self.line or "\0" in text:
            return self.runs.findall(text)
        return [x for x in text.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0") if x]
