"""Shared and exclusive locks on the driver, and a small key-value transaction."""

from __future__ import annotations

import threading
import time
from typing import Any

from tessera.errors import EngineError


class LockTimeout(EngineError):
    """A lock was not free in time."""


class LockManager:
    """Shared or exclusive, re-entrant for their owner; waits ``timeout`` seconds at most."""

    def __init__(self, timeout: float = 2.0):
        self.timeout = timeout
        self._free = threading.Condition()
        self._held: dict[str, dict[Any, str]] = {}

    def acquire(self, owner: Any, resource: str, mode: str = "X", timeout: float | None = None) -> None:
        if mode not in ("S", "X"):
            raise EngineError(f"unknown lock mode: {mode}")
        until = time.monotonic() + (self.timeout if timeout is None else timeout)
        with self._free:
            while True:
                held = self._held.setdefault(resource, {})
                others = [m for o, m in held.items() if o != owner]
                if not others or mode == "S" and "X" not in others:
                    held[owner] = "X" if held.get(owner) == "X" else mode
                    return
                left = until - time.monotonic()
                if left <= 0 or not self._free.wait(left):
                    raise LockTimeout(f"{resource} is locked")

    def release(self, owner: Any) -> None:
        """All locks of an owner."""
        with self._free:
            for held in self._held.values():
                held.pop(owner, None)
            self._free.notify_all()


class KeyValueTransaction:
    """Reads and writes of a dictionary under locks, with undo."""

    def __init__(self, store: dict, locks: LockManager):
        self.store, self.locks = store, locks
        self.undo: list[tuple[Any, bool, Any]] = []
        self.open = True

    def read(self, key: Any, for_update: bool = False) -> Any:
        self._check()
        self.locks.acquire(id(self), str(key), "X" if for_update else "S")
        return self.store.get(key)

    def write(self, key: Any, value: Any) -> None:
        self._check()
        self.locks.acquire(id(self), str(key), "X")
        self.undo.append((key, key in self.store, self.store.get(key)))
        self.store[key] = value

    def commit(self) -> None:
        self._check()
        self._end()

    def rollback(self) -> None:
        self._check()
        for key, there, old in reversed(self.undo):
            if there:
                self.store[key] = old
            else:
                self.store.pop(key, None)
        self._end()

    def _check(self) -> None:
        if not self.open:
            raise EngineError("the transaction has ended")

    def _end(self) -> None:
        self.open = False
        self.locks.release(id(self))
