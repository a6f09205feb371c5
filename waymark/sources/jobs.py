"""Waiting for jobs of other services, on the driver: polling, and calls that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection


def poll[T](state: Callable[[], T], final: Collection[T], every: float = 30.0, limit: float | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    """The first state that is final; asked every so many seconds. TimeoutError after `limit` seconds of waiting."""
    waited = 0.0
    while (now := state()) not in final:
        if limit is not None and waited >= limit:
            raise TimeoutError(f"still {now} after {waited:g} s")
        sleep(every)
        waited += every
    return now


def retried[T](call: Callable[[], T], times: int = 10, wait: float = 60.0, errors: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep) -> T:
    """What the call returns; after one of the errors it is tried again, `times` calls in all. The last error is raised."""
    for left in range(times - 1, -1, -1):
        try:
            return call()
        except errors:
            if not left:
                raise
            sleep(wait)
    raise ValueError("times is 1 at least")
