"""Byte-level BPE vocabulary files: pre-token splitting that agrees with the tokenizers library.

Texts made of the code points in SAFE are split by one compiled pattern whose classes are equal to
the library's for those code points. Any other text is split by the library's own pre-tokenizer, so
the split is the library's in every case.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
NUMBER = "0-9²³¹¼-¾"
UNSAFE = re.compile("[^\t\n\r\x20-\x7e -ɏЀ-ҁҊ-ԯ‐-‧‰-⁞]")
PIECE = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
)


def resolve(vocabulary: str) -> str:
    """A path as it is, or the place of one of the public vocabulary files by its name."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@cache
def library(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(resolve(vocabulary))


@cache
def description(vocabulary: str) -> dict:
    with open(resolve(vocabulary), encoding="utf-8") as f:
        return json.load(f)


@cache
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@cache
def specials(vocabulary: str) -> tuple[re.Pattern | None, dict[str, int]]:
    ids = {t["content"]: t["id"] for t in description(vocabulary)["added_tokens"]}
    longest = sorted(ids, key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, longest)) + ")") if ids else None), ids


@cache
def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def pieces(text: str, vocabulary: str) -> list[str]:
    """Pre-tokens of a text that holds no special string."""
    if UNSAFE.search(text) is None:
        return PIECE.findall(text)
    back = _letter_bytes()
    split = library(vocabulary).pre_tokenizer.pre_tokenize_str(text)
    return [bytes(map(back.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in split]
