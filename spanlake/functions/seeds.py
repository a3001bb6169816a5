"""Where short strings stand in texts without white space: small vectorised helpers for Arrow passes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

#: The white space that alignment ignores.
SPACE = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_IS_SPACE = np.isin(np.arange(0x3002, dtype=np.uint32), SPACE)
_STEP = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kept_places(codes: np.ndarray) -> np.ndarray:
    """Where the characters stand that are not white space."""
    return np.flatnonzero(~_IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)])


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` characters from each place on, made from those of half the width; the last axis runs over places."""

    def of(w: int) -> np.ndarray:
        if w == 1:
            return codes.astype(np.uint64) + np.uint64(1)
        half, by = of(w // 2), w // 2
        out = half[..., :-by] * np.uint64(pow(_STEP, by, 1 << 64)) + half[..., by:]
        return out[..., :-1] * np.uint64(_STEP) + codes[..., w - 1 :].astype(np.uint64) + np.uint64(1) if w % 2 else out

    if codes.shape[-1] < width:
        return np.zeros((*codes.shape[:-1], 0), dtype=np.uint64)
    out = of(width)
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


class Shown:
    """Texts one after the other, without white space, and where each string of `gram` characters stands there; strings never run over a text's end."""

    def __init__(self, texts: list[str], gram: int):
        self.gram = gram
        codes = code_points("".join(texts))
        self.kept = kept_places(codes)
        self.bare = codes[self.kept].tobytes().decode("utf-32-le", "surrogatepass")
        self.raw = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
        self.stops = np.searchsorted(self.kept, self.raw).tolist()
        self.each = hashes(codes[self.kept], gram)
        self.order = np.argsort(self.each, kind="stable")
        self.sorted = self.each[self.order]

    def asked(self, grams: list[str]) -> np.ndarray:
        """The hashes of strings of exactly `gram` characters."""
        return hashes(code_points("".join(grams)).reshape(len(grams), self.gram), self.gram)[:, 0]

    def at(self, wanted: np.ndarray) -> Iterator[list[int]]:
        """For each hash its places, in order."""
        low, high = (np.searchsorted(self.sorted, wanted, side=side).tolist() for side in ("left", "right"))
        return (self.order[a:b].tolist() if a < b else [] for a, b in zip(low, high, strict=True))

    def whole(self, pieces: list[str]) -> Iterator[Iterator[tuple[int, int]]]:
        """For each piece `(text, place)` of its occurrences, in order."""
        tails = self.asked([x[-self.gram :] for x in pieces]).tolist()
        return (self._verified(*x) for x in zip(pieces, self.at(self.asked([x[: self.gram] for x in pieces])), tails, strict=True))

    def _verified(self, piece: str, first: list[int], tail: int) -> Iterator[tuple[int, int]]:
        n, last = len(piece), len(self.bare) - len(piece)
        for p in first:
            if p <= last and self.each[p + n - self.gram] == tail and self.bare.startswith(piece, p):
                text = bisect_right(self.stops, p) - 1
                if p + n <= self.stops[text + 1]:
                    yield text, p

    def grams(self, grams: list[str]) -> list[np.ndarray]:
        """For each string of `gram` characters its places, in order."""
        return [np.array([p for p in at if self.bare.startswith(gram, p)], dtype=np.int64) for gram, at in zip(grams, self.at(self.asked(grams)), strict=True)]

    def span(self, text: int, s0: int, s1: int) -> tuple[int, int]:
        """The stretch of a text that holds its characters from `s0` to `s1` of all."""
        return int(self.kept[s0] - self.raw[text]), int(self.kept[s1 - 1] + 1 - self.raw[text])
