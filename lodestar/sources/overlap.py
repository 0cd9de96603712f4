"""Calls that overlap inside a task: a bounded number at once, at a bounded rate, answers in the order of the questions."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor


class Pace:
    """Lets ``rate`` starts a second through; starts are spread evenly, not let through in bursts. None: no bound."""

    def __init__(self, rate: float | None):
        self.gap = 1.0 / rate if rate else 0.0
        self.next, self.lock = time.monotonic(), threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


def overlapped(ask: Callable, rows: Iterable[tuple], at_once: int) -> Iterator:
    """``ask(*row)`` of all rows in their order, at most ``at_once`` of them running.

    Rows are taken up no more than twice ``at_once`` ahead of the answer that is due, so neither questions nor answers pile up. What
    ``ask`` raises is raised here when its answer is due.
    """
    if at_once < 1:
        raise ValueError("at least one call must run")
    if at_once == 1:
        yield from (ask(*row) for row in rows)
        return
    with ThreadPoolExecutor(at_once) as pool:
        due: deque = deque()
        try:
            for row in rows:
                if len(due) >= 2 * at_once:
                    yield due.popleft().result()
                due.append(pool.submit(ask, *row))
            while due:
                yield due.popleft().result()
        finally:
            for x in due:
                x.cancel()
