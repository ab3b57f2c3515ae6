"""64-bit hashes of the words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Bytes of texts that are hashed at once; a longer text goes alone.
CHUNK = 1 << 20
#: Words with more bytes are hashed one by one.
LONG_WORD = 64
#: Odd numbers without a pattern, for mixing.
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_SHIFT = np.uint64(32)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: By bytes left in a word, which of the next eight belong to it.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _mixed(state: np.ndarray) -> np.ndarray:
    state *= MIX
    state ^= state >> _SHIFT
    state *= STIR
    state ^= state >> _SHIFT
    return state


def words_at(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a lower-case text begins, its bytes' number and its hash: the bytes, eight at a time, stirred into their number."""
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(data) + 1,), "<u8", joined + bytes(8), strides=(1,))
    state = sizes.astype(np.uint64)
    at = np.flatnonzero(sizes <= LONG_WORD) if len(sizes) and sizes.max() > LONG_WORD else np.arange(len(sizes))
    done = 0
    while len(at):
        left = sizes[at] - done
        block = eights[begins[at] + done] & _MASKS[np.minimum(left, 8)]
        state[at] = _mixed(state[at] ^ block)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        state[i] = xxhash.xxh3_64_intdigest(joined[begins[i] : begins[i] + sizes[i]])
    return begins, sizes, state


def ends_among(begins: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """How many words begin before each text's end, where the texts are joined by a byte each."""
    return np.searchsorted(begins, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Per text, in order, the hashes of its words; A-Z and a-z are alike, and ASCII white space parts words."""
    waiting, size = [], 0

    def out() -> Iterator[np.ndarray]:
        begins, _, hashes = words_at(b" ".join(waiting).lower())
        cuts = ends_among(begins, waiting)
        yield from (hashes[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))

    for text in texts:
        if waiting and size + len(text) > CHUNK:
            yield from out()
            waiting, size = [], 0
        waiting.append(text)
        size += len(text) + 1
    if waiting:
        yield from out()
