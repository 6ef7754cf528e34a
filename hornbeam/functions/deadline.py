"""A time budget for work in a worker: what takes too long raises, and costs itself only."""

from __future__ import annotations

import contextlib
import signal
import threading
from collections.abc import Iterator


@contextlib.contextmanager
def within(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in the block after so many seconds of the wall clock. Workers run tasks in their main thread,
    where a signal can end any loop; elsewhere, and with None, there is no limit. An outer limit goes on afterwards."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_) -> None:
        raise TimeoutError(f"not done in {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    left, _ = signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, left)
        signal.signal(signal.SIGALRM, before)
