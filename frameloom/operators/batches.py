"""Functions of the caller over items, with errors as rows; and named transforms."""

from __future__ import annotations

import contextlib
import importlib
import multiprocessing
import pkgutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _called(f: Callable, x, handlers: dict[type[Exception], Callable]) -> tuple:
    """ok, value, error; the first handler whose type the error is of, in the order they were given, gives the value instead."""
    try:
        return True, str(f(x)), None
    except Exception as e:  # noqa: BLE001  (whatever the caller's function raises is a result)
        said = f"{type(e).__name__}: {e}"
        for kind, handler in handlers.items():
            if isinstance(e, kind):
                try:
                    return False, str(handler(x, e)), said
                except Exception:  # noqa: BLE001  (a handler that fails changes nothing)
                    break
        return False, None, said


def mapped(items: DataFrame, key: str, item: str, f: Callable, limit_seconds: float = 300.0, handlers: dict[type[Exception], Callable] | None = None) -> DataFrame:
    """key, ok, value, error of ``f`` called for the text of every item.

    A call that raises gives ok false and the error's text, and as its value what the handler of its type, if any, makes of the item and the error.
    What a task hasn't begun ``limit_seconds`` after its start is cancelled: ok is null.
    """

    def one(x):
        return _called(f, x, handlers or {})

    def run(batches):
        began = time.monotonic()
        for batch in batches:
            found = [one(x) if time.monotonic() - began <= limit_seconds else (None, None, None) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "ok", "value", "error"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, F.col(item).cast("string")).mapInArrow(run, f"{key} {kind}, ok boolean, value string, error string")


class _Helper:
    """A process beside the worker that calls the function, and can be ended."""

    def __init__(self, f: Callable, others: list[_Helper]) -> None:
        forked = multiprocessing.get_context("fork")
        self.here, there = forked.Pipe()

        def serve() -> None:
            for of in (self, *others):  # each ends when the worker is gone, whatever the others hold
                of.here.close()
            with contextlib.suppress(EOFError):
                while True:
                    there.send((_called(f, there.recv(), {}), time.monotonic()))

        self.process = forked.Process(target=serve, daemon=True)
        self.process.start()
        there.close()

    def begin(self, x, seconds: float) -> None:
        self.until = time.monotonic() + seconds
        with contextlib.suppress(OSError):  # a process that is gone is found by ``result``
            self.here.send(x)

    def done(self, wait: float) -> bool:
        """Whether there is a result, or an end of the process, within ``wait`` seconds and the item's limit."""
        try:
            return self.here.poll(max(0.0, min(wait, self.until - time.monotonic())))
        except (EOFError, OSError):
            return True

    def result(self) -> tuple[tuple | None, bool]:
        """The result, null if it came late or the process is gone; and whether it came late."""
        try:
            found, when = self.here.recv()
        except (EOFError, OSError):
            return None, False
        return (found, False) if when <= self.until else (None, True)

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.here.close()


#: Seconds after which an item waits beside the others, and items of a task that may wait so.
PATIENCE, WAITING = 0.02, 16


def mapped_within(items: DataFrame, key: str, item: str, f: Callable, seconds: float) -> DataFrame:
    """As ``mapped``, with a deadline for every single item: one that takes longer, or takes its process down, has ok false and the error says so; the others go on.

    Calls run one by one in a helper process of the task. An item that isn't done soon keeps its helper, and the next ones go to another, so up to ``WAITING``
    limits pass side by side. A helper whose item hangs is killed.
    """

    def run(batches):
        idle: list[_Helper] = []
        waiting: list[tuple[int, _Helper]] = []

        def settle(found: list, at: int, helper: _Helper, answered: bool) -> None:
            result, late = helper.result() if answered else (None, True)
            if result is None:
                helper.end()
                result = False, None, f"TimeoutError: over {seconds:g} s" if late else "ChildProcessError: the helper ended"
            else:
                idle.append(helper)
            found[at] = result

        try:
            for batch in batches:
                found: list = [None] * batch.num_rows
                for at, x in enumerate(batch.column(1).to_pylist()):
                    if len(waiting) == WAITING:
                        first, helper = waiting.pop(0)
                        settle(found, first, helper, helper.done(seconds))
                    helper = idle.pop() if idle else _Helper(f, [h for _, h in waiting])
                    waiting.append((at, helper))
                    helper.begin(x, seconds)
                    if helper.done(PATIENCE):
                        waiting.pop()
                        settle(found, at, helper, True)
                while waiting:
                    first, helper = waiting.pop(0)
                    settle(found, first, helper, helper.done(seconds))
                columns = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "ok", "value", "error"])
        finally:
            for helper in [*idle, *(h for _, h in waiting)]:
                helper.end()

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, F.col(item).cast("string")).mapInArrow(run, f"{key} {kind}, ok boolean, value string, error string")


@dataclass(frozen=True)
class Transform:
    name: str
    description: str
    version: str
    apply: Callable[[DataFrame], DataFrame]


@dataclass
class Transforms:
    """A registry of named steps from one DataFrame to another; names are given once."""

    known: dict[str, Transform] = field(default_factory=dict)

    def register(self, name: str, description: str = "", version: str = "1"):
        def add(f: Callable[[DataFrame], DataFrame]):
            if name in self.known:
                raise ValueError(f"{name} is registered already")
            self.known[name] = Transform(name, description, version, f)
            return f

        return add

    def discover(self, module) -> None:
        """Take over the transforms of all registries in a module that this one doesn't know."""
        for other in vars(module).values():
            if isinstance(other, Transforms) and other is not self:
                self.known = other.known | self.known

    def discover_package(self, package) -> dict[str, str]:
        """Take over the transforms of the first registry of every module of a package, in order of their names; names that begin with an underscore are left out.

        Gives the modules that can't be imported or have no registry, with the reason; the others are taken all the same.
        """
        failed = {}
        for found in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
            if found.name.startswith("_"):
                continue
            try:
                module = importlib.import_module(f"{package.__name__}.{found.name}")
                registry = next((x for x in vars(module).values() if isinstance(x, Transforms)), None)
            except Exception as e:  # noqa: BLE001  (an extension that fails must not stop the others)
                failed[found.name] = f"{type(e).__name__}: {e}"
                continue
            if registry is None:
                failed[found.name] = "no transforms"
            else:
                self.known = registry.known | self.known
        return failed

    def chain(self, rows: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            rows = rows.transform(self.known[name].apply)
        return rows
