"""The stateful part of putting files together from lines that arrive over several batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class FileAssembler(StatefulProcessor):
    """Keeps a file's lines until all have come, or none for a while, and emits its text once."""

    def __init__(self, separator: str = "\r", quiet_ms: int | None = None):
        self.separator, self.quiet_ms = separator, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line_no long, n_lines long, value string")

    def _text(self, key, held: dict, complete: bool) -> Row:
        self.lines.clear()
        value = self.separator.join(text or "" for _, (_, text) in sorted(held.items()))
        return Row(file_path=key[0], value=value, complete=complete)

    def _held(self) -> dict:
        return {number: (total, text) for number, total, text in self.lines.get()} if self.lines.exists() else {}

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, new = self._held(), []
        for row in rows:
            if row.line_no not in held:
                held[row.line_no] = (row.n_lines, row.value)
                new.append((row.line_no, row.n_lines, row.value))
        if self.quiet_ms:
            self._forget_timers()
        if len(held) >= max(total for total, _ in held.values()):
            yield self._text(key, held, True)
            return
        self.lines.appendList(new)
        if self.quiet_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held:
            yield self._text(key, held, False)

    def close(self) -> None:
        pass
