"""A run-length grammar of a sequence by recompression, and its longest common extensions.

Blocks of equal letters and pairs of letters become letters of the next level in turn. Which letters
go together depends on the letters alone, so equal stretches are cut alike but for a few letters at
their ends: two positions are compared by going up while both are ends of letters, letter by letter
at a level only until they are, and down again from the first letters that differ. All questions
about a sequence are answered together, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Splits of the alphabet that are tried per level; the one that joins most pairs is taken.
SPLITS = 4

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class Level:
    """Letters of a level, and for each boundary between them whether it is one of the next level too."""

    letters: np.ndarray
    kept: np.ndarray  # boundary i lies before letter i; as long as the letters plus one
    up: np.ndarray  # boundaries to those of the next level, where they are kept
    down: np.ndarray  # boundaries to those of the level below
    blocks: bool  # whether the next level joins blocks
    padded: np.ndarray | None = None
    low: np.ndarray | None = None  # first boundary of the block that a letter lies in
    high: np.ndarray | None = None  # last boundary of it

    def __post_init__(self) -> None:
        self.padded = np.append(self.letters, [-1, -2])


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _side(letters: np.ndarray, turn: int) -> np.ndarray:
    """Bits that tell on which side of each of ``SPLITS`` splits a letter is, one row per split."""
    with np.errstate(over="ignore"):
        mixed = (letters.astype(np.uint64) + np.uint64(turn + 1)) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _MIX[turn % 4]
        mixed ^= mixed >> np.uint64(32)
    return np.stack([(mixed >> np.uint64(7 * k)) & np.uint64(1) for k in range(SPLITS)]).astype(bool)


class Grammar:
    """The levels of a sequence of whole numbers from 0 on; its length is at least one."""

    def __init__(self, letters: np.ndarray, least: int = 1, max_levels: int = 400):
        """Joins letters until ``least`` of them are left, or no level has made the sequence shorter."""
        letters = letters.astype(np.int64)
        down = np.arange(len(letters) + 1)
        self.levels: list[Level] = []
        idle = 0
        for turn in range(max_levels):
            n, blocks = len(letters), turn % 2 == 0
            if n <= least or idle > 6:
                break
            kept = np.ones(n + 1, bool)
            if blocks:
                kept[1:n] = letters[1:] != letters[:-1]
            else:
                left = _side(letters, turn // 2)
                joined = left[:, :-1] & ~left[:, 1:]
                kept[1:n] = ~joined[int(joined.sum(axis=1).argmax())]
            starts = np.flatnonzero(kept[:n])
            if len(starts) == n:
                idle += not blocks
                continue
            idle = 0
            level = Level(letters, kept, np.cumsum(kept) - 1, down, blocks)
            sizes = np.diff(np.append(starts, n))
            if blocks:
                level.low, level.high = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
            self.levels.append(level)
            top = np.int64(letters.max()) + 1
            second = letters[np.minimum(starts + 1, n - 1)]
            more = sizes if blocks else second + 1
            # A letter of its own keeps its name apart from all joined ones.
            keys = np.where(sizes > 1, letters[starts] + top * more, letters[starts])
            down, letters = np.append(starts, n), _named(keys)
        n = len(letters)
        self.levels.append(Level(letters, np.zeros(n + 1, bool), np.arange(n + 1), down, False))

    def extensions(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many letters from boundaries ``a`` and ``b`` on agree, or with ``forward=False`` before them."""
        step = 1 if forward else -1
        a, b = a.astype(np.int64), b.astype(np.int64)
        first, here = a.copy(), np.arange(len(a))
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in self.levels:
            on, x, y = here, a, b
            going: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            halted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(on):
                same = self._same(level, x, y, step)
                halted.append((on[~same], x[~same], y[~same]))
                on, x, y = on[same], x[same], y[same]
                rise = level.kept[x] & level.kept[y]
                going.append((on[rise], x[rise], y[rise]))
                on, x, y = on[~rise], x[~rise], y[~rise]
                if len(on):
                    jump = self._jump(level, x, y, step)
                    x, y = x + step * jump, y + step * jump
            stopped.append(tuple(map(np.concatenate, zip(*halted))) if halted else (here[:0],) * 3)
            here, a, b = map(np.concatenate, zip(*going)) if going else (here[:0],) * 3
            a, b = level.up[a], level.up[b]
        on, x, y = (np.zeros(0, np.int64),) * 3
        for level, (more, at, to) in zip(reversed(self.levels), reversed(stopped)):
            same = np.flatnonzero(self._same(level, x, y, step))
            while len(same):
                jump = step * self._jump(level, x[same], y[same], step)
                x[same] += jump
                y[same] += jump
                same = same[self._same(level, x[same], y[same], step)]
            on, x, y = np.concatenate([on, more]), np.concatenate([x, at]), np.concatenate([y, to])
            if level is not self.levels[0]:
                x, y = level.down[x], level.down[y]
        found = np.zeros(len(first), np.int64)
        found[on] = x
        return np.abs(found - first)

    @staticmethod
    def _same(level: Level, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        # Two more letters, which are different, stand for what lies beyond the ends: at n and at -1.
        if step < 0:
            x, y = x - 1, y - 1
        return (level.padded[x] == level.padded[y]) & (x < len(level.letters)) & (x >= 0)

    @staticmethod
    def _jump(level: Level, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray | int:
        """Letters that agree at once where the next ones do: one, or the rest of the shorter of two blocks."""
        if not level.blocks:
            return 1
        if step > 0:
            return np.minimum(level.high[x] - x, level.high[y] - y)
        return np.minimum(x - level.low[x - 1], y - level.low[y - 1])
