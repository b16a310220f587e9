"""A streaming source over a folder of append-only JSONL ledgers, under a budget of events.

Its offset is how many bytes of each ledger are consumed, so the engine's checkpoint is all that a restart needs, in the middle of a file
too. One batch passes at most ``budget`` lines, oldest ledger first; what a writer has not ended with a newline waits. The ledgers stand in a
folder that the driver sees (``path``); a batch is bounded, so reading it takes one process.

    spark.dataSource.register(Ledgers)
    spark.readStream.format("ledgers").option("path", folder).option("budget", 500).load()
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file string, end_offset long, event string"
ENDING = ".jsonl"
#: Bytes that are read at once.
CHUNK = 1 << 20


class Ledgers(DataSource):
    """Options: path; budget (lines a batch, 500); follow: all (every ledger, the default) or newest (the one that was written last)."""

    @classmethod
    def name(cls) -> str:
        return "ledgers"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> LedgerReader:
        return LedgerReader(self.options["path"], int(self.options.get("budget", 500)), self.options.get("follow", "all"))


class LedgerReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, budget: int, follow: str) -> None:
        if follow not in ("all", "newest"):
            raise ValueError("follow is all or newest")
        self.path, self.budget, self.follow = path, budget, follow

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[tuple[str, int]]:
        """(name, size) of the ledgers, oldest first, ties by name; a folder or file that has gone is passed over."""
        found = []
        try:
            names = os.listdir(self.path)
        except OSError:
            return []
        for name in names:
            if name.endswith(ENDING):
                try:
                    at = os.stat(os.path.join(self.path, name))
                except OSError:
                    continue
                found.append((at.st_mtime_ns, name, at.st_size))
        found.sort()
        return [(name, size) for _, name, size in (found[-1:] if self.follow == "newest" else found)]

    def _lines(self, name: str, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
        """(end offset, line) of each whole line from ``start`` on, up to ``end``."""
        with open(os.path.join(self.path, name), "rb") as file:
            file.seek(start)
            at = start
            while end is None or at < end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    return
                at += len(line)
                yield at, line

    @staticmethod
    def _row(name: str, end: int, line: bytes) -> tuple[str, int, str] | None:
        """An event; broken and empty lines are consumed without one."""
        try:
            text = line.decode()
            return (name, end, text.strip()) if isinstance(json.loads(text), dict) else None
        except ValueError:
            return None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows, left = dict(start), [], self.budget
        for name, size in self._files():
            at = int(end.get(name, 0))
            at = 0 if size < at else at  # cut short or replaced: from the start, repeats go by their ids later
            if size == at:
                continue
            for upto, line in self._lines(name, at):
                if line.strip():
                    if not left:
                        break
                    left -= 1
                    row = self._row(name, upto, line)
                    if row:
                        rows.append(row)
                end[name] = upto
            if not left:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a restart within a batch."""
        for name, upto in sorted(end.items()):
            at = int(start.get(name, 0))
            for to, line in self._lines(name, at if at <= int(upto) else 0, int(upto)):
                row = self._row(name, to, line) if line.strip() else None
                if row:
                    yield row

    def commit(self, end: dict) -> None:
        """Nothing to do: ledgers are kept."""
