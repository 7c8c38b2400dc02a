"""Command lines acted on: what a device's second core does with the messages of the first.

`w series ts value` stages a sample, `f` publishes what is staged, `s` saves a snapshot, `l series` answers `OK ts value` (zeros where
nothing is published), `e series t0 t1` answers the rows as `ts,value` and `END`; every other line answers `ERR`. Samples never
pass through the driver: the writes between two other commands are one DataFrame. A written line answers `OK`, given by
`replies` as a relation; `act` answers the other commands, which are few, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from ..sources import shared
from ..sources.io import parsed_commands
from ..store import Store


class Dispatcher:
    """Commands of a store. Lines have a number (line_no) that gives their order; staged writes wait for the next `f`, also across calls."""

    def __init__(self, store: Store):
        self.store, self.staged = store, []

    @staticmethod
    def parsed(lines: DataFrame) -> DataFrame:
        return lines.select("line_no", *[c.alias(n) for n, c in parsed_commands(F.col("line")).items()])

    def replies(self, lines: DataFrame) -> DataFrame:
        """line_no and OK or ERR of every line, by its form alone."""
        return self.parsed(lines).select("line_no", F.col("rc").alias("reply"))

    def act(self, lines: DataFrame) -> Iterator[tuple[int, str]]:
        """(line_no, answer) of all lines but good writes, which are staged. Samples of series that don't exist are dropped."""
        parsed = shared.written(self.parsed(lines), "commands")
        writes = parsed.where("verb = 'w' and rc = 'OK'").select("line_no", "series", "ts_ms", "value")
        after = -1
        for c in parsed.where("verb <> 'w' or rc <> 'OK'").orderBy("line_no").toLocalIterator():
            if c.rc != "OK":
                yield c.line_no, "ERR"
            elif c.verb == "f":
                self._stage(writes, after, c.line_no)
                after = c.line_no
                self._flush()
                yield c.line_no, "OK"
            elif c.verb == "s":
                self.store.snapshot()
                yield c.line_no, "OK"
            elif c.verb == "l":
                ts, value = (self.store.latest(c.series) if c.series < 256 else None) or (0, 0.0)
                yield c.line_no, f"OK {ts} {value:f}"
            else:
                for ts, value in self.store.rows(c.series, c.ts_ms, c.t1_ms) if c.series < 256 else ():
                    yield c.line_no, f"{ts},{value:.9g}"
                yield c.line_no, "END"
        self._stage(writes, after, None)

    def _stage(self, writes: DataFrame, after: int, before: int | None) -> None:
        part = writes.where(F.col("line_no") > after)
        self.staged.append(part if before is None else part.where(F.col("line_no") < before))

    def _flush(self) -> None:
        for part in self.staged:  # event ids follow the store's, in the order of lines
            first = part.agg(F.min("line_no")).first()[0]
            if first is not None:
                samples = scan.accepted(part.withColumn("event_id", F.col("line_no") - first + self.store._next_id))
                self.store.append(samples)
        self.staged = []
