"""Lines about a write that is under way."""

from __future__ import annotations

import sys
import time
from threading import Lock


def eta_text(seconds: float) -> str:
    """Seconds below a minute, minutes and seconds below an hour, hours and minutes from there."""
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes_left = divmod(minutes, 60)
    if hours:
        return f"{hours}h {minutes_left:02d}m"
    return f"{minutes}m {rest:02d}s" if minutes else f"{rest}s"


class Progress:
    """Says after each source how many are done, with rates and the time that the others will take at this rate."""

    def __init__(self, sources: int, shown: bool, out=None, clock=time.monotonic):
        self.sources, self.shown, self.out, self.clock = sources, shown, out or sys.stderr, clock
        self.lock, self.began = Lock(), clock()
        self.finished = self.failed = self.samples = self.bytes = 0

    def done(self, name: str, samples: int, n_bytes: int, failed: bool = False) -> None:
        with self.lock:
            self.finished += 1
            self.failed += failed
            self.samples += samples
            self.bytes += n_bytes
            took = max(self.clock() - self.began, 1e-9)
            if self.shown:
                left = eta_text(took / self.finished * (self.sources - self.finished))
                rates = f"{self.samples} samples ({self.samples / took:.0f}/s), {self.bytes / 1e6:.1f} MB ({self.bytes / 1e6 / took:.1f} MB/s)"
                said = f"{name}: {'failed' if failed else 'done'}, {self.finished} of {self.sources} sources, {rates}, {left} left"
                print(said, file=self.out, flush=True)
