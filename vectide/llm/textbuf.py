"""Byte buffers of letters for vectorised word features.

Texts are lower-cased and encoded; bytes of ASCII letters and of any non-ASCII character
stay, all others become 0 and part the words. Long texts are cut at white space into
parts of at most PART characters, so memory is bounded by a part, not by a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PART = 1 << 19
_KEEP = np.zeros(256, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def parts(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Group texts, long ones cut at white space, into lots of about limit characters."""
    at, lot, held = [], [], 0
    for i, text in enumerate(texts):
        start, text = 0, text or ""
        while True:
            stop = len(text)
            if stop - start > PART:
                stop = start + PART
                cut = max(text.rfind(" ", start + PART // 2, stop), text.rfind("\n", start + PART // 2, stop))
                stop = cut + 1 if cut >= 0 else stop
            at.append(i)
            lot.append(text[start:stop])
            held += stop - start
            if held >= limit:
                yield at, lot
                at, lot, held = [], [], 0
            start = stop
            if start >= len(text):
                break
    if lot:
        yield at, lot


def words(lot: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, part) of all words; bytes begin and end with a 0."""
    raw = [x.lower().encode("utf-8", "replace") for x in lot]
    buf = _KEEP[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n\n", np.uint8)]
    on = buf != 0
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    firsts = np.cumsum([1] + [len(r) + 1 for r in raw[:-1]]) if raw else np.zeros(0, int)
    return buf, starts, ends, np.searchsorted(firsts, starts, side="right") - 1


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(c.isalpha() for c in text)
