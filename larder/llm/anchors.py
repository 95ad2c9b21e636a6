"""Content-defined anchors over words or bytes, for a batch of documents at once.

Every window of `window` consecutive items is assigned to its anchor: the leftmost k-gram of smallest
hash inside it. Equal windows have equal anchors at equal offsets, whatever surrounds them, so windows
with different anchors need never meet. Consecutive windows of one anchor form a group; a group's items
run from the start of its first window to the end of its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
POSITION_BITS = np.uint64(28)
HEAD = 32  # bytes of a word that are hashed for all words at once
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


class Sequence:
    """Prefix sums of a polynomial over items, from which any span's hash is read off."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all_of(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def chunks(docs: list, texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of documents of about `most` bytes; a longer text is a run of its own."""
    own_docs, own, size = [], [], 0
    for d, t in zip(docs, texts):
        if own and size + len(t) > most:
            yield own_docs, own
            own_docs, own, size = [], [], 0
        own_docs.append(d)
        own.append(t)
        size += len(t)
    if own:
        yield own_docs, own


def word_items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts: a 64-bit hash of each, and the number of its text.

    A word's hash depends on its own bytes alone, whatever else is in the call. A word is read eight bytes at a time,
    each chunk mixed into what came before, so that no arithmetic relation between words carries over to their hashes;
    what follows a word's first HEAD bytes is hashed at once."""
    data = np.frombuffer(b"\n".join([*texts, b"\n" * 8]), np.uint8)
    solid = np.concatenate(([False], ~SPACES[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    h = mix64((ends - starts).astype(np.uint64) * BASE)
    open_, at = np.arange(len(starts)), starts.copy()
    for _ in range(HEAD // 8):
        left = ends[open_] - at
        chunk = np.zeros(len(open_), np.uint64)
        for j in range(8):
            byte = data[np.minimum(at + j, len(data) - 1)].astype(np.uint64)
            chunk |= np.where(left > j, byte, np.uint64(0)) << np.uint64(8 * j)
        h[open_] = mix64((h[open_] ^ chunk) * BASE)
        more = left > 8
        open_, at = open_[more], at[more] + 8
        if not len(open_):
            break
    for i, a in zip(open_.tolist(), at.tolist()):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[a : ends[i]].tobytes(), int(h[i])))
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(text_starts, starts, "right") - 1


def byte_items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, joined without separators: value and number of the text."""
    return BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by doubling."""
    n = len(x) - w + 1
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


def groups(seq: Sequence, owner: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """The groups of all windows that lie inside one text: owner, first and last (starts of its windows, counted in the
    whole sequence), anchor (hash of the k-gram) and content (hash of the group's items)."""
    n = len(owner)
    none = np.empty(0, np.int64)
    if n >> int(POSITION_BITS):
        raise ValueError("a text of 2**28 items or more doesn't fit the positions of its anchors")
    if n < window:
        return {"owner": none, "first": none, "last": none, "anchor": none, "content": none}
    grams = seq.all_of(k)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - k + 1)
    inside = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    at = (best[inside] & low).astype(np.int64)
    if not len(inside):
        return {"owner": none, "first": none, "last": none, "anchor": none, "content": none}
    turns = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = inside[np.concatenate(([0], turns))], inside[np.concatenate((turns, [len(inside)])) - 1]
    return {"owner": owner[first], "first": first, "last": last, "anchor": grams[at[np.concatenate(([0], turns))]].view(np.int64), "content": seq.spans(first, last + window).view(np.int64)}


def covered(n: int, firsts: np.ndarray, lasts: np.ndarray, window: int) -> np.ndarray:
    """Which of n items lie in a window that starts between some first and its last."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, lasts + window, -1)
    return np.cumsum(change[:-1]) > 0


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as runs of consecutive ones: first and last of each."""
    if not len(starts):
        return starts, starts
    turns = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate(([0], turns))], starts[np.concatenate((turns, [len(starts)])) - 1]
