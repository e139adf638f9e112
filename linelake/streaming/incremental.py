"""Profiles that grow with their input: value counts and type counts add up, so new files only add to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linelake import files
from linelake.functions.json import trimmed
from linelake.operators import index as ix
from linelake.operators.nodes import nodes
from linelake.operators.profile import TYPES, value_counts
from linelake.sources.lines import parsed


#: Batches whose counts stand beside each other before they are added up.
DELTAS = 16


class IncrementalProfile:
    """Exact counts of a folder's values, kept at ``out``: (path, key, n) and (path, json_type, n). Each batch of new files is added once: the
    batch's number is written with the counts, and a batch that is delivered again is left out. A batch only writes its own counts;
    every DELTAS batches what is there is added up."""

    def __init__(self, spark: SparkSession, path: str, out: str, depth: int = 6) -> None:
        self.spark, self.path, self.out, self.depth = spark, path, out.rstrip("/"), depth

    def run(self) -> StreamingQuery:
        """Take in what is new, then end."""
        lines = self.spark.readStream.option("lineSep", "\n").text(self.path)
        return (
            lines.writeStream.foreachBatch(self._add).option("checkpointLocation", f"{self.out}/checkpoint").trigger(availableNow=True).start()
        )

    def _add(self, batch: DataFrame, epoch: int) -> None:
        at = files.read_json(self.spark, f"{self.out}/current.json") or {"epoch": -1, "names": []}
        if epoch <= at["epoch"]:
            return
        rows = parsed(batch.select(trimmed(F.col("value")).alias("body")).where(F.length("body") > 0))
        counts = value_counts(nodes(rows.where("valid"), self.depth)).persist()
        name, old = uuid.uuid4().hex, []
        counts.where("key is not null").select("path", "key", "n").write.parquet(f"{self.out}/{name}/values")
        each = F.explode(F.array(*(F.struct(F.lit(t).alias("json_type"), F.col(f"n_{t}").alias("n")) for t in TYPES)))
        kinds = counts.select("path", each.alias("x")).where("x.n > 0").groupBy("path", "x.json_type").agg(F.sum("x.n").alias("n"))
        kinds.write.parquet(f"{self.out}/{name}/types")
        counts.unpersist()
        names = [*at["names"], name]
        if len(names) >= DELTAS:
            whole, old = uuid.uuid4().hex, names
            for part in ("values", "types"):
                self._sum(names, part).write.parquet(f"{self.out}/{whole}/{part}")
            names = [whole]
        files.write_json(self.spark, f"{self.out}/current.json", {"epoch": epoch, "names": names})
        for name in old:
            files.delete(self.spark, f"{self.out}/{name}")

    def _sum(self, names: list[str], part: str) -> DataFrame:
        keys = ["path", "key"] if part == "values" else ["path", "json_type"]
        return self.spark.read.parquet(*(f"{self.out}/{n}/{part}" for n in names)).groupBy(*keys).agg(F.sum("n").alias("n"))

    def counts(self, part: str = "values") -> DataFrame:
        at = files.read_json(self.spark, f"{self.out}/current.json")
        if at is None:
            raise ValueError(f"nothing was taken in from {self.path} yet")
        return self._sum(at["names"], part)


def first_tokens(stream: DataFrame, token: str, time: str, late: str) -> DataFrame:
    """A stream's first row of each token; a token is forgotten ``late`` after it was seen."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([token])


def latest_keys(old: DataFrame | None, batch: DataFrame, pk: list[str], facets: list[str], order: list[str]) -> DataFrame:
    """An index with a batch's rows added."""
    new = ix.keyed(batch, pk, facets, order)
    return ix.last_of_each(old.unionByName(new) if old is not None else new, order)
