"""Remembered results within a task, bounded in number and in characters."""

from __future__ import annotations


class Memo(dict):
    """A dict of texts to results that is emptied by :meth:`trim` when it holds too many or too long texts."""

    load = 0  # also where a copy is made without __init__

    def __init__(self, room: int = 100_000, chars: int = 30_000_000) -> None:
        super().__init__()
        self.room, self.chars, self.load = room, chars, 0

    def __setitem__(self, text: str, result: object) -> None:
        self.load += len(text)
        super().__setitem__(text, result)

    def trim(self) -> bool:
        """Empties the memo if it is full; whether it did."""
        full = len(self) > self.room or self.load > self.chars
        if full:
            self.clear()
            self.load = 0
        return full
