"""One run at a time on a store: a lease that expires, with a number that fences off its late holders.

The files of a lease lie in the folder ``lease``: ``token=<n>`` names a holder and until when it holds, ``renewed=<n>=<ms>`` a
later time, ``released=<n>`` its end. A new holder publishes the next number, which only one caller can.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from marginalia.sources.folder import Folder

FOLDER = "lease"
SECONDS = 600.0


class LeaseHeld(RuntimeError):
    """Another run is at work."""


class LeaseLost(RuntimeError):
    """The lease has expired, was released, or is another's by now."""


class _State:
    """What the lease files say."""

    def __init__(self, folder: Folder) -> None:
        names = [name.split("=") for name in folder.names(FOLDER)]
        self.token = max((int(n[1]) for n in names if n[0] == "token"), default=0)
        self.holder, self.until = "", 0.0
        if self.token:
            told = json.loads(folder.content(f"{FOLDER}/token={self.token}"))
            renewed = [int(n[2]) / 1000 for n in names if n[0] == "renewed" and int(n[1]) == self.token]
            self.holder, self.until = told["holder"], max([told["until"], *renewed])
        self.released = ["released", str(self.token)] in names

    def held(self, now: float) -> bool:
        return self.token > 0 and not self.released and now < self.until


class Lease:
    """A lease that is held. As a context it renews itself until the block ends, then lets go."""

    def __init__(self, folder: Folder, token: int, holder: str, seconds: float, clock: Callable[[], float]) -> None:
        self.folder, self.token, self.holder, self.seconds, self.clock = folder, token, holder, seconds, clock
        self._done = threading.Event()

    def check(self) -> None:
        state = _State(self.folder)
        if state.token != self.token or not state.held(self.clock()):
            raise LeaseLost(f"{self.holder} no longer holds lease {self.token}; the latest is {state.token} of {state.holder}")

    def renew(self) -> None:
        self.check()
        self.folder.create(f"{FOLDER}/renewed={self.token}={int((self.clock() + self.seconds) * 1000)}", "")

    def release(self) -> None:
        self._done.set()
        self.folder.create(f"{FOLDER}/released={self.token}", "")

    def _keep(self) -> None:
        while not self._done.wait(self.seconds / 3):
            try:
                self.renew()
            except LeaseLost:
                return

    def __enter__(self) -> Lease:
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def acquire(
    folder: Folder,
    holder: str,
    seconds: float = SECONDS,
    wait: float = 0.0,
    clock: Callable[[], float] = time.time,
    pause: Callable[[float], None] = time.sleep,
) -> Lease:
    """Take the lease, or raise LeaseHeld when another still holds it after ``wait`` seconds."""
    deadline = clock() + wait
    while True:
        state, now = _State(folder), clock()
        if not state.held(now):
            told = json.dumps({"holder": holder, "until": now + seconds})
            if folder.create(f"{FOLDER}/token={state.token + 1}", told):
                _tidy(folder, state.token + 1)
                return Lease(folder, state.token + 1, holder, seconds, clock)
            continue
        if now >= deadline:
            raise LeaseHeld(f"{state.holder} holds lease {state.token}")
        pause(min(5.0, max(0.05, deadline - now)))


def check_free(folder: Folder, lease: Lease | None, clock: Callable[[], float] = time.time) -> int:
    """The number to fence a write with: that of ``lease``, or the latest when nobody holds one."""
    if lease is not None:
        lease.check()
        return lease.token
    state = _State(folder)
    if state.held(clock()):
        raise LeaseHeld(f"{state.holder} holds lease {state.token}")
    return state.token


def _tidy(folder: Folder, token: int) -> None:
    """Forget all but the two latest numbers."""
    for name in folder.names(FOLDER):
        parts = name.split("=")
        if len(parts) > 1 and parts[1].isdigit() and int(parts[1]) < token - 1:
            folder.remove(f"{FOLDER}/{name}")
