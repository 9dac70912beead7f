"""Ordered trees as balanced parentheses: one bit a parenthesis, ranks and matching by blocks.

A node is the place of its opening parenthesis, its subtree what lies up to the matching one.  The
excess of a place is the number of parentheses open after it.  Places are cut into blocks; a tree of
minima over the blocks' excesses (the maxima are not needed to find a closing parenthesis) tells which
block holds the first place with an excess below that of an opening one.
"""

from __future__ import annotations

import numpy as np

#: Parentheses of a block, and opening ones that are matched at a time.
BLOCK, TOGETHER = 256, 1 << 12


class Parentheses:
    """A balanced sequence, given as an array of 1 (open) and 0 (close)."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.size = len(bits)
        steps = bits.astype(np.int32) * 2 - 1
        excess = np.cumsum(steps, dtype=np.int32)
        blocks = -(-self.size // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: self.size] = excess
        self.ends = excess[np.minimum(np.arange(1, blocks + 1) * BLOCK, self.size) - 1]
        self.leaves = 1 << max(0, int(blocks - 1).bit_length())
        self.least = np.full(2 * self.leaves, np.iinfo(np.int32).max, dtype=np.int32)
        self.least[self.leaves : self.leaves + blocks] = padded.reshape(blocks, BLOCK).min(axis=1)
        for k in range(self.leaves - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
        self.opened = np.append(0, np.cumsum(bits, dtype=np.int64))
        pairs = np.zeros(self.size, dtype=np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.paired = np.append(0, np.cumsum(pairs))

    def _excesses(self, block: np.ndarray) -> np.ndarray:
        """Excesses inside blocks, one row for each; the largest number behind the end."""
        at = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)[None, :]
        raw = np.where(at < len(self.bits), self.bits[np.minimum(at, len(self.bits) - 1)], 0)
        steps = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int32) * 2 - 1
        before = np.where(block > 0, self.ends[np.maximum(block - 1, 0)], 0)
        out = np.cumsum(steps, axis=1, dtype=np.int32) + before[:, None]
        out[block[:, None] * BLOCK + np.arange(BLOCK)[None, :] >= self.size] = np.iinfo(np.int32).max
        return out

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First block after ``block`` whose least excess is at most ``target``; there is one."""
        node = block + self.leaves
        up = np.ones(len(node), dtype=bool)
        while up.any():  # climb until a right neighbour holds it
            right = up & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.leaves - 1)] <= target)
            node = np.where(right, node + 1, np.where(up, node // 2, node))
            up &= ~right
        while True:  # and descend to its first block
            inner = node < self.leaves
            if not inner.any():
                return node - self.leaves
            left = np.where(inner, 2 * node, node)
            node = np.where(inner & (self.least[left] > target), left + 1, left)

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those opened at ``places``."""
        out = np.zeros(len(places), dtype=np.int64)
        for i in range(0, len(places), TOGETHER):
            at = places[i : i + TOGETHER].astype(np.int64)
            block = at // BLOCK
            inside = self._excesses(block)
            target = inside[np.arange(len(at)), at % BLOCK] - 1
            hit = (inside <= target[:, None]) & (np.arange(BLOCK)[None, :] > (at % BLOCK)[:, None])
            found, close = hit.any(axis=1), block * BLOCK + hit.argmax(axis=1)
            far = np.flatnonzero(~found)
            if len(far):
                later = self._next_block(block[far], target[far])
                close[far] = later * BLOCK + (self._excesses(later) <= target[far][:, None]).argmax(axis=1)
            out[i : i + TOGETHER] = close
        return out

    def opens_before(self, places: np.ndarray) -> np.ndarray:
        """Number of opening parentheses before each place."""
        return self.opened[places]

    def pairs_before(self, places: np.ndarray) -> np.ndarray:
        """Number of leaves, that is of pairs "()", that begin before each place."""
        return self.paired[places]
