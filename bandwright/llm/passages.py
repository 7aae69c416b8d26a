"""Words of running text for passage comparison: lower case, without punctuation at their edges."""

from __future__ import annotations

import re
import string

import numpy as np

from bandwright.llm.common import SPACE, word_hashes

SPANS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = SPACE.copy()
EDGES[list(string.punctuation.encode())] = True


def plain_hashes(text: bytes) -> np.ndarray:
    """A hash for each word other than bare punctuation, in order."""
    return word_hashes(text.lower() if text.isascii() else text.decode(errors="replace").lower().encode(), EDGES)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of plain words, bare punctuation between them included."""
    places = [m.span() for m in SPANS.finditer(text) if m[0].strip(string.punctuation)]
    out, at = [], 0
    for start, stop in sorted(spans):
        out.append(text[at : max(at, places[start][0])])
        at = max(at, places[stop - 1][1])
    return "".join(out) + text[at:]
