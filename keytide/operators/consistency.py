"""Reads under a consistency mode: barriers over the applied versions of a log that a stream maintains."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .. import config, model
from . import progress, reads, state


class BarrierTimeout(TimeoutError):
    pass


def wait_applied(applied: Callable[[], int], index: int, timeout: float = 10.0, poll: float = 0.001) -> int:
    """Wait until the applied mark has reached the index; returns it. 0 waits for nothing."""
    if index < 0:
        raise ValueError("an index is 0 or more")
    end = time.monotonic() + timeout
    while (now := applied() if index else 0) < index:
        if time.monotonic() >= end:
            raise BarrierTimeout(f"all versions up to {now} applied, waited for {index}")
        time.sleep(poll)
    return now


class KvReader:
    """Reads of a materialised log.

    commands: gives the applied commands as they are now. applied: how far they go; a barrier waits for its mark, as a
    greater version may come before a lesser one, and an eventual read stops at its top. Without it both are found from
    the commands. gaps: versions (column version) that will never come. drain: brings in all that is committed (a
    stream's processAllAvailable, or nothing for batch).
    """

    def __init__(self, commands: Callable[[], DataFrame], applied: Callable[[], progress.Progress] | None = None, drain: Callable[[], None] | None = None, gaps: DataFrame | None = None):
        self._commands, self._drain = commands, drain or (lambda: None)
        self._applied = applied or (lambda: progress.of_log(commands(), gaps))

    def _at(self, mode: str | None, session_index: int | None, min_version: int | None, timeout: float) -> DataFrame:
        mode = model.resolve_mode(mode)
        if mode == "strong":
            self._drain()
            return self._commands()
        if mode == "eventual":
            return state.as_of(self._commands(), self._applied().top)
        needed = session_index if mode == "read-your-writes" else min_version
        if needed is None:
            raise ValueError(f"{mode} needs {'session_index' if mode == 'read-your-writes' else 'min_version'}")
        wait_applied(lambda: self._applied().mark, needed, timeout)
        return self._commands()

    def get(self, key: str, mode: str | None = None, session_index: int | None = None, min_version: int | None = None, timeout: float = 10.0) -> DataFrame:
        if key == "":
            return reads.get(self._commands().limit(0), key)
        return reads.get(self._at(mode, session_index, min_version, timeout), key)

    def scan(self, prefix: str = "", limit: int = config.Config.scan_limit, mode: str | None = None, session_index: int | None = None, min_version: int | None = None, timeout: float = 10.0) -> DataFrame:
        return reads.scan_prefix(self._at(mode, session_index, min_version, timeout), prefix, limit)
