"""What a Python worker remembers between tasks belongs to one operator at a time.

Spark reuses workers for stages of different operators. An operator that begins to remember words makes the
others forget theirs, so that a worker holds one memo, not the sum of all.
"""

from __future__ import annotations

from collections.abc import Callable

_holders: dict[str, Callable[[], None]] = {}


def releasing(work):
    """A task's work on batches; when it ends, memory that Arrow keeps for later goes back to the system."""

    def run(batches):
        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def claim(name: str, forget: Callable[[], None]) -> None:
    for other, clear in _holders.items():
        if other != name:
            clear()
    _holders[name] = forget
