"""Retries with growing waits, for calls to the outside."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps


def waits(retries: int = 3, first: float = 1.0, most: float = 10.0) -> list[float]:
    """Seconds to wait before each retry: doubled each time, at most ``most``."""
    return [min(first * 2**i, most) for i in range(retries)]


class Retrying:
    """A call that is made anew after an exception, ``retries`` times; the last exception is raised. It can be sent to executors."""

    def __init__(self, call: Callable, retries: int = 3, first: float = 1.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep):
        self.call, self.waits, self.sleep = call, waits(retries, first, most), sleep

    def __call__(self, *args: object, **named: object) -> object:
        for wait in self.waits:
            try:
                return self.call(*args, **named)
            except Exception:
                self.sleep(wait)
        return self.call(*args, **named)


def retrying(call: Callable, retries: int = 3, **how: object) -> Retrying:
    return Retrying(call, retries, **how)


def with_retries(retries: int = 3, **how: object) -> Callable[[Callable], Callable]:
    """Decorator form."""

    def decorate(call: Callable) -> Callable:
        again = Retrying(call, retries, **how)
        return wraps(call)(lambda *args, **named: again(*args, **named))

    return decorate
