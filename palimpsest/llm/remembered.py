"""What a Python worker remembers between tasks.

Spark gives one worker to one operator after another, in a pipeline to all of them. A memory that one of them has filled
would stay while the next ones fill theirs, so an operator that begins lets go of what others remember. What a task has
freed would stay with its worker, which waits beside an executor that may need it, so a task that ends gives it back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], object]] = {}


def begins(operator: str, forget: Callable[[], object] = lambda: None) -> None:
    """Forget what other operators remember here. forget: drops what this one is about to remember."""
    if operator in _forget and len(_forget) == 1:
        return
    others = [f for name, f in _forget.items() if name != operator]
    _forget.clear()
    _forget[operator] = forget
    for f in others:
        f()
    if others:
        gc.collect()  # an encoder and its memories know each other
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def giving_back(run: Callable) -> Callable:
    """A task's run(batches) that ends with give_back()."""

    def to_the_end(batches):
        yield from run(batches)
        give_back()

    return to_the_end
