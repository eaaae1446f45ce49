"""Words of UTF-8 and their hashes, in stretches of bounded size.

Words are what bytes.split() gives: it separates at U+0020 and U+0009 to U+000D. A long
text is worked on in stretches that cut no word, so what an operator holds besides the
text is a few numbers a word at most. Hashes are XXH3 of the bytes themselves, which has
no structure that texts could collide on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
import xxhash

_U = np.uint64
#: Bytes of a stretch; a longer word is a stretch of its own.
STRETCH_BYTES = 1 << 20
#: What separates words.
SPACES = b"\t\n\x0b\x0c\r "
_SPACE = regex.compile(rb"[\x20\x09-\x0D]")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def stretches(text: bytes, size: int = STRETCH_BYTES) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that end before a blank or at the text's end."""
    if len(text) <= size:
        if text:
            yield text
        return
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def texts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The rows of a piece, one after the other."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), _U, len(parts))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """The hash of every word; of its lower case (A-Z only), if asked for."""
    found = [hashes((part.lower() if lower else part).split()) for part in stretches(text)]
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, _U), *found])


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, _U)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(h)])
    return h


def again(h: np.ndarray) -> np.ndarray:
    """True where the same hash stood earlier."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    return out


def several(h: np.ndarray) -> np.ndarray:
    """True where the same hash stands elsewhere, earlier or later."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out
