"""Byte n-gram presence of whole texts, shared by the two text classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Slots of 1-, 2- and 3-byte n-grams: the first two exact, the last hashed.
SLOTS = (1 << 8) + (1 << 16) + (1 << 16)
_AT = (0, 1 << 8, (1 << 8) + (1 << 16))
#: Word n-grams of one word said n times; their slots follow the others.
REPEATS = (2, 3, 4, 6, 9)
ALL_SLOTS = SLOTS + len(REPEATS)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What may be a letter; some numbers, as superscripts and fractions are, pass too.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character has Unicode category L."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def present(text: bytes, fold: bool, seen: np.ndarray) -> np.ndarray:
    """The slots of the n-grams of 1 to 3 bytes that the text holds. seen: an all-false scratch of SLOTS."""
    x = np.frombuffer(text.translate(_FOLD) if fold else text, np.uint8)
    seen[x] = True
    if len(x) > 1:
        two = (x[:-1].astype(np.uint32) << 8) | x[1:]
        seen[two + _AT[1]] = True
        if len(x) > 2:
            three = ((two[:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)
            seen[(three >> 16) + _AT[2]] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def repeats(text: bytes) -> np.ndarray:
    """The slots of the n-grams of REPEATS that the text holds: a word n times in a row."""
    words = text.split()
    same = bytes(map(bytes.__eq__, words, words[1:]))
    return np.array([SLOTS + k for k, n in enumerate(REPEATS) if b"\1" * (n - 1) in same], np.int64)


def present_with_repeats(text: bytes, seen: np.ndarray) -> np.ndarray:
    return np.concatenate([present(text, False, seen), repeats(text)])


def batches_of(slots: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Presence rows end to end, and where each one starts."""
    rows = list(slots)
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), at
