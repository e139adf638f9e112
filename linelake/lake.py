"""A log of JSON lines as a dataset: read, write, profile, index, look up, browse."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import files
from .functions.json import checked_name
from .operators import index as ix
from .operators import profile as pr
from .sources.lines import decoded, log_of, numbered, parsed, scan
from .state import Meta, StateStore


@dataclass(frozen=True)
class WriterOptions:
    """ensure_dir: make the folder; reset: overwriting also forgets state, index and statistics; lock: one writer at a time."""

    ensure_dir: bool = True
    reset: bool = True
    lock: bool = True
    compression: str = "none"


@dataclass(frozen=True)
class IndexResult:
    rows: int
    keys: int
    invalid: int
    mode: str


class Lake:
    """The log at ``path``: a folder of files of JSON lines, or one file, plain or gzipped. The data are the only truth; index, statistics
    and state can all be built again from them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.state = spark, path, StateStore(spark, path)

    # reading

    def rows(self, paths: Sequence[str] | None = None) -> DataFrame:
        """(file, line_no, offset, body, valid, v) of all non-blank lines."""
        data = list(paths) if paths is not None else [e.path for e in self.state.data()]
        if not data:
            return parsed(self.spark.createDataFrame([], "file string, line_no long, offset long, body string"))
        return parsed(numbered(scan(self.spark, data)))

    def read(self, start_at: int = 1) -> DataFrame:
        """(line, v) of the rows that are objects or arrays; ``start_at`` only renumbers."""
        if start_at < 1:
            raise ValueError("start_at begins at 1")
        return decoded(self.rows()).select("file", (F.col("line_no") + (start_at - 1)).alias("line"), "v", "body")

    def first(self) -> Row | None:
        for entry in self.state.data():  # only as many files as it takes
            found = decoded(self.rows([entry.path])).orderBy("line_no").select("body").limit(1).first()
            if found:
                return found
        return None

    def contains_token(self, token: str) -> bool:
        path = f"{self.state.side}/tokens"
        return files.exists(self.spark, path) and not self.spark.read.parquet(path).where(F.col("token") == token).isEmpty()

    # writing

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One lock for all that changes a dataset; a second holder is refused. ``break_lock`` takes away the lock of a driver that has died."""
        fs_path = f"{self.state.side}/lock"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(fs_path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(p.getParent())
        if not fs.createNewFile(p):
            raise RuntimeError(f"{self.path} is locked by another writer ({fs_path})")
        try:
            yield
        finally:
            fs.delete(p, False)

    def break_lock(self) -> bool:
        return files.delete(self.spark, f"{self.state.side}/lock")

    def write(self, df: DataFrame, mode: str = "w", token: str | None = None, order: Sequence[str] = (), sparse: bool = False, options: WriterOptions = WriterOptions(), complete: bool = True, **context) -> Meta:
        """Append (``a``) or replace (``w``) the log by the rows of ``df``.

        token: a column that names each row; of one token only the first row in ``order`` is written, none if an earlier run wrote it.
        sparse: leave null fields out. Counts of rows and bytes are taken as the rows pass.
        """
        mode = mode.lower()
        if mode not in ("w", "a"):
            raise ValueError(f"mode {mode!r} is neither 'w' nor 'a'")
        if self.path.endswith((".jsonl", ".gz", ".gzip")):
            raise ValueError("a dataset that is written is a folder")
        if not options.ensure_dir and not files.exists(self.spark, self.path):
            raise ValueError(f"{self.path} does not exist")
        if options.lock:
            with self.lock():
                return self._write(df, mode, token, order, sparse, options, complete, context)
        return self._write(df, mode, token, order, sparse, options, complete, context)

    def _write(self, df, mode, token, order, sparse, options, complete, context) -> Meta:
        tokens, columns = f"{self.state.side}/tokens", df.columns
        if mode == "w" and options.reset:
            for part in ("meta.json", "tokens", "index", "stats", "rows"):
                files.delete(self.spark, f"{self.state.side}/{part}")
        meta = self.state.load()
        new_tokens = None
        if token:
            seen = self.spark.read.parquet(tokens) if mode == "a" and files.exists(self.spark, tokens) else None
            named = df.withColumn("token", F.col(token).cast("string"))
            df = ix.first_by_token(named, order, seen).persist()
            new_tokens = df.where("token is not null").select("token")
        seen_rows = Observation()
        body = log_of(df, *columns, keep_nulls=not sparse)
        body = body.observe(seen_rows, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("body").cast("long") + 1), F.lit(0)).alias("bytes"))
        replaced = self.state.data() if mode == "w" else []
        body.write.mode("append").option("compression", options.compression).text(self.path)
        for entry in replaced:  # only when the new rows are there
            files.delete(self.spark, entry.path)
        if new_tokens is not None:
            new_tokens.write.mode("append" if mode == "a" else "overwrite").parquet(tokens)
            df.unpersist()
        got = seen_rows.get
        meta.rows, meta.bytes = (meta.rows if mode == "a" else 0) + got["rows"], (meta.bytes if mode == "a" else 0) + got["bytes"]
        meta = self.state.save(self.state._with(meta, context))
        return self.state.mark_complete() if complete else meta

    # profile

    def profile(self, top: int = pr.TOP, depth: int = 6, most: int = pr.FIELDS) -> pr.Profile:
        """Statistics of all fields, also kept beside the data."""
        found = pr.profile(self.rows(), top, depth, most)
        self._swap(found.fields, "stats")
        return pr.Profile(found.rows, found.invalid, found.truncated, self.stats())

    def stats(self) -> DataFrame | None:
        return self._kept("stats")

    def elements(self, path: str, top: int = pr.TOP) -> DataFrame:
        return pr.element_stats(self.rows().where("valid"), path, top)

    # index

    def index(self, pk: Sequence[str] = ("id",), facets: Sequence[str] = ()) -> IndexResult:
        """Build or bring up to date the index: the last row of each key. New files are added to an index of unchanged ones; a changed file,
        other keys or facets, or lost parts mean a new index. Rows are named by file and offset, so no row is added twice. A row without a key is named
        by its line, in a folder by file and line."""
        for name in (*pk, *facets):
            checked_name(name)
        meta, now = self.state.load(), self.state.fingerprint()
        old = {tuple(e) for e in meta.indexed}
        same = meta.pkFields == list(pk) and meta.facetFields == list(facets) and old <= {tuple(e) for e in now}
        index = self._kept("index") if old and same else None
        paths = [e[0] for e in now if index is None or tuple(e) not in old]
        order = ["file", "line_no"]
        rows = self.rows(paths)
        both = ix.keyed(rows, pk, facets, order, several=self.state.is_folder)
        if index is not None:
            both = index.unionByName(both)
        seen = rows.agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("invalid")).first()
        if index is None or paths:
            self._swap(ix.last_of_each(both, order), "index")
        facts = {"rows": seen["rows"] + (meta.facts.get("rows", 0) if index is not None else 0), "invalid": seen["invalid"] + (meta.facts.get("invalid", 0) if index is not None else 0)}
        meta = self.state.load()
        meta.indexed, meta.pkFields, meta.facetFields, meta.facts = now, list(pk), list(facets), facts
        self.state.save(meta)
        return IndexResult(facts["rows"], self.key_count(), facts["invalid"], "full" if index is None else "incremental")

    def key_count(self) -> int:
        index = self._kept("index")
        return index.count() if index is not None else 0

    def get(self, key: str) -> str | None:
        """The row of a key, as JSON: by its offset in a plain file, else by its line."""
        index = self._kept("index")
        at = index.where(F.col("pk") == key).select("file", "offset", "line_no").first() if index is not None else None
        if at is None:
            return None
        if not at["file"].endswith(("gz", "gzip")):
            line, size, step = b"", 1 << 16, at["offset"]
            while b"\n" not in line:
                part = files.read_bytes(self.spark, at["file"], step, size)
                line, step = line + part, step + len(part)
                if len(part) < size:
                    break
            return line.split(b"\n")[0].strip(b" \t\r\0\x0b").decode()
        row = self.rows([at["file"]]).where(F.col("line_no") == at["line_no"]).first()
        return row["body"] if row else None

    def facet_counts(self, *facets: str) -> DataFrame:
        index = self._kept("index")
        if index is None:
            raise ValueError(f"{self.path} has no index")
        return ix.facet_counts(index, *facets).orderBy("facet", F.col("n").desc(), F.col("value").asc_nulls_first())

    def where(self, condition) -> DataFrame:
        """Rows whose attributes satisfy ``condition``."""
        return ix.fetch(self._kept("index"), self.rows(), condition, ["file", "line_no"])

    def browse(self, view: str | None = None, arrays_too: bool = False) -> DataFrame:
        """line_no and a column for each profiled scalar path, also as the view ``view``."""
        stats = self.stats() if self.stats() is not None else self.profile().fields
        names = [r["path"] for r in stats.where("is_array = 0" if not arrays_too else "true").orderBy("path").select("path").collect()]
        out = ix.browse(self.rows(), names)
        if view:
            out.createOrReplaceTempView(view)
        return out

    # cache

    def has_cache(self) -> bool:
        return files.exists(self.spark, f"{self.state.side}/rows")

    def keep_rows(self) -> DataFrame:
        """Keep the numbered lines as Parquet."""
        self._swap(self.rows().drop("v"), "rows")
        return parsed(self._kept("rows").drop("valid"))

    def vacuum(self) -> bool:
        """Drop the kept lines; index, statistics and state stay."""
        return files.delete(self.spark, f"{self.state.side}/rows")

    def _kept(self, part: str) -> DataFrame | None:
        at = files.read_json(self.spark, f"{self.state.side}/{part}/current.json")
        return self.spark.read.parquet(f"{self.state.side}/{part}/{at['name']}") if at else None

    def _swap(self, df: DataFrame, part: str) -> None:
        """Write anew, then point to it: a reader sees the old table or the new one."""
        base, name = f"{self.state.side}/{part}", uuid.uuid4().hex
        df.write.parquet(f"{base}/{name}")
        old = files.read_json(self.spark, f"{base}/current.json")
        files.write_json(self.spark, f"{base}/current.json", {"name": name})
        if old:
            files.delete(self.spark, f"{base}/{old['name']}")
