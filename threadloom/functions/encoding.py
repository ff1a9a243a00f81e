"""Repair of UTF-8 that was read as a single-byte code page, once or several times over, in whole texts or in parts of them."""

from __future__ import annotations

import re

STEPS = 5
_CYRILLIC = re.compile("[А-яЁёІіЇїЄєҐґ]+")


class Reading:
    """How the bytes of UTF-8 look when they are read in a code page, and back."""

    def __init__(self, codec: str, alone: str, result: re.Pattern | None = None):
        """alone: a pattern of the sequences that are taken for misread without another beside them, with L2 to L4 for the
        first bytes of a sequence and T for a later one. result: what a repaired run has to match."""
        shown: dict[int, str] = {}
        for byte in range(0x80, 0x100):
            try:
                shown[byte] = bytes([byte]).decode(codec)
            except UnicodeDecodeError:
                shown[byte] = ""
        self.bytes = {character: byte for byte, character in shown.items() if character}
        if codec == "cp1252":  # Latin-1 shows these bytes as control characters, and mixtures are common
            self.bytes |= {chr(byte): byte for byte in range(0x80, 0xA0)}

        def among(low: int, high: int) -> str:
            return "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"

        parts = {"L2": among(0xC2, 0xDF), "L3": among(0xE0, 0xEF), "L4": among(0xF0, 0xF4), "T": among(0x80, 0xBF)}
        several = r"(?:{L2}{T}|{L3}{T}{{2}}|{L4}{T}{{3}}){{2,}}".format(**parts)
        self.alone = re.compile(alone.format(**parts)) if alone else None
        self.any = re.compile(several + ("|" + alone.format(**parts) if alone else ""))
        self.result = result

    def _decoded(self, run: str) -> str | None:
        try:
            text = bytes(self.bytes[c] for c in run).decode("utf-8")
        except UnicodeDecodeError:
            return None
        return text if self.result is None or self.result.fullmatch(text) else None

    def _single(self, match: re.Match) -> str:
        found = self._decoded(match.group(0))
        return match.group(0) if found is None else found

    def _run(self, match: re.Match) -> str:
        found = self._decoded(match.group(0))
        if found is None:
            return self.alone.sub(self._single, match.group(0)) if self.alone else match.group(0)
        return found

    def undone(self, text: str) -> str:
        return self.any.sub(self._run, text)


#: A capital before a closing mark is good text more often than not, and so is a root sign before a letter: those need a small letter
#: beside them or a second sequence.
READINGS = (
    Reading("cp1252", "[ÂÃ]{T}|[âï]{T}{{2}}|ð{T}{{3}}|(?<=[a-z])[ÄÅ]{T}|[ÄÅ]{T}(?=[a-z])"),
    Reading("mac_roman", "(?<=[a-z])√{T}|√{T}(?=[a-z])|‚Ä{T}"),
    Reading("cp1251", "", _CYRILLIC),
)


def cost(text: str) -> int:
    """What a text has beyond ASCII, control characters of Latin-1 four times: misread text has more of it than what was meant."""
    return sum(4 if "\x80" <= c <= "\x9f" else 1 for c in text if c > "\x7f")


def repair(text: str) -> str:
    """The text after the chain of code pages, at each step the one that leaves the least cost, until none lowers it.

    Only the sequences that can be UTF-8 are changed, so that a character that cannot be stays as it is and stops nothing. Plain ASCII,
    empty text and good text come back unchanged.
    """
    for _ in range(STEPS):
        if text.isascii():
            return text
        best = min((reading.undone(text) for reading in READINGS), key=cost)
        if cost(best) >= cost(text):
            return text
        text = best
    return text
