"""Counts of one text that quality operators share. Words are maximal runs of bytes outside ASCII white space."""

from __future__ import annotations

import re
from operator import eq

import numpy as np

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for with on as was at by this be are from or have not "
    b"der die und das ist von mit den zu ein eine nicht auf dem des im sich "
    b"le la les et des est que en un une dans pour qui pas du au par sur "
    b"el los las y del que una por con se su para al lo".split()
)
SYMBOLS = b"#*$%&|<>"
ENDINGS = re.compile(rb"[.!?\"']+[ \t\r]*(?:\n|$)")


class Stats:
    """raw: the text as UTF-8 bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.words = raw, raw.split()
        self.n_words = len(self.words)
        self.byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        b = self.byte
        self.code_points = int(len(raw) - b[0x80:0xC0].sum())
        self.blanks = int(b[0x20] + b[0x09:0x0E].sum())
        self.word_chars = self.code_points - self.blanks
        self.n_symbols = int(sum(b[c] for c in SYMBOLS))
        self.upper, self.lower, self.digits = int(b[65:91].sum()), int(b[97:123].sum()), int(b[48:58].sum())
        self.letters = self.upper + self.lower + int(b[0x80:].sum())
        self.lines = [x for x in raw.split(b"\n") if x.strip()]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def n_function_words(self) -> int:
        return len(FUNCTION_WORDS.intersection(map(bytes.lower, set(self.words))))

    @property
    def n_adjacent(self) -> int:
        return sum(map(eq, self.words, self.words[1:]))

    @property
    def n_ended_lines(self) -> int:
        return len(ENDINGS.findall(self.raw))

    @property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more, the first occurrence included."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        two = code[:-1] * len(number) + code[1:]
        if len(number) > 2_000_000:  # keeps the product below within 64 bits
            two = np.unique(two, return_inverse=True)[1]
        three = two[:-1] * len(number) + code[2:]
        order = np.argsort(three, kind="stable")
        same = three[order[1:]] == three[order[:-1]]
        hit = np.zeros(n + 2, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit = hit[:n]
        covered = hit.copy()
        covered[1:] |= hit[:-1]
        covered[2:] |= hit[:-2]
        return int(covered.sum())
