"""A splittable source: restrictions are offset ranges, split for reading, with progress for streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


@dataclass(frozen=True)
class OffsetRange:
    """Positions start up to, but without, stop."""

    start: int
    stop: int

    def size(self) -> int:
        return max(0, self.stop - self.start)

    def split(self, n: int) -> list[OffsetRange]:
        step = max(1, -(-self.size() // max(1, n)))
        return [OffsetRange(a, min(a + step, self.stop)) for a in range(self.start, self.stop, step)]

    def truncate(self, claimed: int) -> OffsetRange:
        """What is left to finish on drain once positions before claimed are done."""
        return OffsetRange(self.start, min(self.stop, claimed))


class RangePartition(InputPartition):
    def __init__(self, piece: OffsetRange):
        super().__init__((piece.start, piece.stop))
        self.piece = piece


class RangeReader(DataSourceReader):
    def __init__(self, whole: OffsetRange, n: int):
        self.whole, self.n = whole, n

    def partitions(self):
        return [RangePartition(p) for p in self.whole.split(self.n)]

    def read(self, partition):
        for i in range(partition.piece.start, partition.piece.stop):
            yield (i, f"element {i}")


class RangeStream(SimpleDataSourceStreamReader):
    def __init__(self, whole: OffsetRange, step: int):
        self.whole, self.step = whole, step

    def initialOffset(self):
        return {"at": self.whole.start}

    def read(self, start):
        piece = OffsetRange(start["at"], min(start["at"] + self.step, self.whole.stop))
        return iter([(i, f"element {i}") for i in range(piece.start, piece.stop)]), {"at": piece.stop}

    def readBetweenOffsets(self, start, end):
        return iter([(i, f"element {i}") for i in range(start["at"], end["at"])])


class OffsetSource(DataSource):
    """format("offsets"): rows (id, value) of options start, stop and splits; as a stream, step rows a batch."""

    @classmethod
    def name(cls):
        return "offsets"

    def schema(self):
        return "id bigint, value string"

    def _whole(self) -> OffsetRange:
        return OffsetRange(int(self.options.get("start", 0)), int(self.options["stop"]))

    def reader(self, schema):
        return RangeReader(self._whole(), int(self.options.get("splits", 4)))

    def simpleStreamReader(self, schema):
        return RangeStream(self._whole(), int(self.options.get("step", 100)))
