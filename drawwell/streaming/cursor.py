"""Where the next window of a stream of samples begins. An iterator reserves its whole window, used up or not."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field


@dataclass
class Cursor:
    epoch_len: int
    sequential: int = 0
    draws: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def reserve(self, shuffle: bool, population: int) -> tuple[int, int]:
        """(start, length) of the next window."""
        with self.lock:
            if shuffle:
                start, self.draws = self.draws, self.draws + self.epoch_len
            else:
                start, self.sequential = self.sequential, (self.sequential + self.epoch_len) % population
            return start, self.epoch_len

    def reset(self) -> None:
        with self.lock:
            self.sequential = self.draws = 0
