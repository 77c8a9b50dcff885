"""A model in a process of its own, which is ended at the deadline of a call.

Nothing inside a process can stop a model that never returns: an endless loop or a wait in native
code holds the worker and with it the job. So the model runs in a child of the Python worker. The
worker sends it a call and waits; at the deadline it kills the child and goes on with a new one. A
child that dies by itself costs only the call it died on. The model is loaded in the child, so a
restart loads it again.
"""

from __future__ import annotations

import ctypes
import multiprocessing
import signal
import time
from collections.abc import Callable, Sequence
from typing import Any

TIMEOUT = "timeout"
#: Seconds that a model may take to load, before its child is given up.
LOAD_SECONDS = 600.0
DIED = "model process died"
# Fixed value: Linux's prctl option that ends a process with its parent.
PR_SET_PDEATHSIG = 1


class NotLoaded(RuntimeError):
    """The model could not be loaded in the child."""


def _serve(pipe, load: Callable[[], Any] | None, call: Callable[..., Sequence[Any]]) -> None:
    try:
        ctypes.CDLL(None).prctl(PR_SET_PDEATHSIG, signal.SIGKILL)
    except (AttributeError, OSError):
        pass  # not on Linux: the child ends when its pipe closes
    try:
        model = load() if load else None
    except Exception as exc:
        pipe.send((False, str(exc)))
        return
    pipe.send((True, None))
    while True:
        try:
            columns = pipe.recv()
        except EOFError:
            return
        try:
            answer = (True, list(call(model, *columns)))
        except Exception as exc:
            answer = (False, str(exc))
        pipe.send(answer)


class Supervised:
    """``call(model, *columns)`` with a deadline; the child starts with the first call."""

    def __init__(self, load: Callable[[], Any] | None, call: Callable[..., Sequence[Any]]) -> None:
        self.load, self.call = load, call
        self.child = self.pipe = None
        self.started = 0

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.child = context.Process(target=_serve, args=(theirs, self.load, self.call), daemon=True)
        self.child.start()
        self.started += 1
        theirs.close()
        try:
            loaded, why = self.pipe.recv() if self.pipe.poll(LOAD_SECONDS) else (False, TIMEOUT)
        except EOFError:
            loaded, why = False, DIED
        if not loaded:
            self.end()
            raise NotLoaded(f"model not loaded: {why}")

    def end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = self.pipe = None

    def ask(self, columns: Sequence[list], seconds: float) -> tuple[list | None, str | None, int]:
        """(scores, error, milliseconds) of one call; loading a model has a deadline of its own.

        At the deadline the error is TIMEOUT and the time is the deadline.
        """
        if self.child is None:
            self._start()
        began = time.monotonic()
        try:
            self.pipe.send([list(c) for c in columns])
            if not self.pipe.poll(seconds):
                self.end()
                return None, TIMEOUT, int(seconds * 1000)
            right, answer = self.pipe.recv()
        except (EOFError, OSError):
            self.end()
            right, answer = False, DIED
        took = int((time.monotonic() - began) * 1000)
        if right and len(answer) != len(columns[0]):
            right, answer = False, f"{len(answer)} scores for {len(columns[0])} rows"
        return (answer, None, took) if right else (None, answer, took)

    def rows(self, columns: Sequence[list], seconds: float, together: int = 1) -> tuple[list, list, list]:
        """Scores, errors and latencies of rows, ``together`` in one call.

        Where a call of several rows fails, dies or takes too long, its rows are called alone; so a
        row that never returns costs one deadline of its own, and one more if it shared a call.
        """
        scores: list = []
        errors: list = []
        latencies: list = []
        n = len(columns[0])
        for start in range(0, n, together):
            part = [c[start : start + together] for c in columns]
            size = len(part[0])
            found, error, took = self.ask(part, seconds)
            if error is not None and size > 1:
                alone = self.rows(part, seconds, 1)
            else:
                alone = (found or [None] * size, [error] * size, [took // size] * size)
            for out, more in zip((scores, errors, latencies), alone):
                out += more
        return scores, errors, latencies
