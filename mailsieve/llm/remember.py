"""What a Python worker keeps between tasks, for one operator at a time.

Workers are used again by later tasks. Keeping what has been looked up saves work within an operator, but a worker that
has served several would hold all their tables. So a worker holds those of one owner only.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[Hashable, object] = {}


def kept(owner: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` has given this worker for ``owner``; anything kept for others goes first."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    _kept.clear()


class Pieces(dict):
    """What has been found for up to ``most`` pieces of texts. Frequent pieces come early, so a full table is kept as it
    is and rare pieces do not push others out; when more than a quarter of ``window`` pieces were not in a full
    table, the texts have changed and it starts afresh."""

    def __init__(self, most: int, window: int = 1_000_000):
        self.most, self.window = most, window
        self.looked = self.missed = 0

    def add(self, piece: str, found: object) -> None:
        if len(self) < self.most:
            self[piece] = found
        else:
            self.missed += 1

    def looked_up(self, number: int) -> None:
        self.looked += number
        if self.looked >= self.window:
            if 4 * self.missed > self.looked:
                self.clear()
            self.looked = self.missed = 0
