"""A stream of positions that hands out a fixed number of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART = 100_000  # positions that one task lists


class Positions(InputPartition):
    def __init__(self, first: int, stop: int, begin: int, steps: int, size: int):
        self.first, self.stop = first, stop
        self.begin, self.steps, self.size = begin, steps, size  # of the micro-batch: its first position and step


class StepReader(DataSourceStreamReader):
    """Positions from 0 to ``total`` in steps of ``size``; the last may have fewer. A micro-batch has ``at_once`` steps.

    The offset is the number of positions and of steps handed out, with the size of the
    last ones. After a restart Spark asks for the last planned micro-batch first, which
    tells where to go on.
    """

    def __init__(self, total: int, size: int, at_once: int = 1):
        self.total, self.size, self.at_once = total, size, at_once
        self.planned = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"position": 0, "steps": 0, "size": self.size}

    def latestOffset(self) -> dict:
        at = self.planned["position"]
        stop = max(at, min(self.total, at + self.size * self.at_once))
        if stop == at:
            return self.planned
        return {"position": stop, "steps": self._steps(self.planned) - (at - stop) // self.size, "size": self.size}

    def _steps(self, offset: dict) -> int:
        # older checkpoints hold the position alone
        return offset.get("steps", -(-offset["position"] // self.size))

    def partitions(self, start: dict, end: dict) -> list[Positions]:
        self.planned = end
        own = (start["position"], self._steps(start), end.get("size", self.size))
        return [Positions(k, min(k + PART, end["position"]), *own) for k in range(start["position"], end["position"], PART)]

    def read(self, partition: Positions) -> Iterator[pa.RecordBatch]:
        positions = range(partition.first, partition.stop)
        steps = [partition.steps + (k - partition.begin) // partition.size for k in positions]
        yield pa.record_batch([pa.array(positions, pa.int64()), pa.array(steps, pa.int64())], ["position", "step"])

    def commit(self, end: dict) -> None:
        pass


class StepSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirrorleaf_steps"

    def schema(self) -> str:
        return "position bigint, step bigint"

    def streamReader(self, schema) -> StepReader:
        return StepReader(int(self.options["total"]), int(self.options["step"]), int(self.options["at_once"]))


def step_positions(spark: SparkSession, total: int, step: int, at_once: int = 1) -> DataFrame:
    """Streaming (position, step) from 0 to ``total`` - 1: exactly ``step`` rows in each step but the last.

    A micro-batch has ``at_once`` steps. A start over an older checkpoint goes on behind
    what was handed out, also with another ``total`` or ``step``. The source has no
    admission that a draining trigger knows of: drain it with ``processAllAvailable``.
    """
    if step < 1 or at_once < 1:
        raise ValueError(f"a step has one item or more, not {step}, and a micro-batch one step or more, not {at_once}")
    spark.dataSource.register(StepSource)
    options = {"total": total, "step": step, "at_once": at_once}
    return spark.readStream.format(StepSource.name()).options(**options).load()
