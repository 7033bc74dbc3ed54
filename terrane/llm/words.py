"""Vectorised work on the words of many texts at once: boundaries, shingles and XXH64, over plain byte arrays."""

from __future__ import annotations

import numpy as np

from .common import ranges

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, white space to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[_WHITE] = 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class Words:
    """The lower-cased words of texts, joined by single spaces in ``buf``. Word i of all is buf[start[i]:end[i]]; text
    t has words first[t] to first[t+1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        buf = _FOLD[np.insert(raw, offsets[1:], 32)]  # a space ends every text
        bounds = offsets + np.arange(len(offsets))
        space = buf == 32
        before = np.concatenate([[True], space[:-1]])
        double = space & before
        if double.any():
            keep = ~double
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            buf, space = buf[keep], space[keep]
            before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.start, bounds)
        self.buf = np.concatenate([buf, np.zeros(32, np.uint8)])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of ``n`` words (the whole text if it has fewer words, none if it has none), and how
        many runs each text has."""
        words = np.diff(self.first)
        many = np.maximum(words - (n - 1), np.minimum(words, 1))
        at = ranges(self.first[:-1], many)
        last = np.minimum(at + n - 1, np.repeat(self.first[1:], many) - 1)
        return self.start[at], self.end[last], many


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start[i]:end[i]] for every i; ``buf`` has 8 spare bytes at its end. Equal lengths go together."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    order = np.argsort(size.astype(np.uint16) if size.max() < 65536 else size, kind="stable")
    ordered = size[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(order)]])
    u64 = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows, left = order[a:b], int(ordered[a])
            at, n = start[rows], left
            if left >= 32:
                acc = [np.full(len(rows), v) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while left >= 32:
                    acc = [_round(v, u64[at + 8 * k]) for k, v in enumerate(acc)]
                    at, left = at + 32, left - 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for v in acc:
                    h = (h ^ _round(np.uint64(0), v)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed + _P5)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), u64[at]), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (u32[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at, left = at + 4, left - 4
            while left:
                h = _rotl(h ^ (buf[at].astype(np.uint64) * _P5), 11) * _P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out
