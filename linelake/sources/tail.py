"""The new end of a grown file, as a Python data source that reads a range of bytes."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 64 << 20


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.start, self.end = options["path"].removeprefix("file://").removeprefix("file:"), int(options["start"]), int(options["end"])

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(a + CHUNK, self.end)) for a in range(self.start, self.end, CHUNK)]

    def read(self, part: _Range):
        """Lines that begin in the range. A last line without its end is left for later."""
        with open(self.path, "rb") as f:
            at = part.start
            if at > self.start:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(at)
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield self.path, at, line[:-1].decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """``spark.read.format("linelake_tail").option("path", p).option("start", a).option("end", b)``: (file, offset, line)."""

    @classmethod
    def name(cls) -> str:
        return "linelake_tail"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def reader(self, schema):  # noqa: ANN001
        return _Reader(self.options)
