"""A dataset's state: counts, completion, freshness and context, in one small JSON document beside the data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import files
from .sources.lines import counts_by_file, scan

SCHEMA_VERSION = 1


@dataclass
class Meta:
    """startedAt and updatedAt are ISO times; fingerprint holds (path, size, mtime) of the data at completion; indexed those at indexing."""

    startedAt: str | None = None
    updatedAt: str | None = None
    rows: int = 0
    bytes: int = 0
    completed: bool = False
    fingerprint: list[list] = field(default_factory=list)
    context: dict[str, Any] = field(default_factory=dict)
    schemaVersion: int = SCHEMA_VERSION
    indexed: list[list] = field(default_factory=list)
    pkFields: list[str] = field(default_factory=list)
    facetFields: list[str] = field(default_factory=list)
    facts: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Meta:
        """Tolerant: other spellings of the times, numbers written as texts, unknown fields."""
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        for name, other in (("startedAt", "started_at"), ("updatedAt", "updated_at")):
            known.setdefault(name, raw.get(other))
        for name in ("rows", "bytes"):
            known[name] = int(known.get(name) or 0)
        known["completed"] = known.get("completed") in (True, 1, "1", "true")
        return cls(**known)


class StateStore:
    """State of the log at ``path``, a folder or a file. Writes replace the whole document at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def side(self) -> str:
        """Where all that is derived from the data stands; the data alone can rebuild it."""
        return f"{self.path}/_linelake" if not self.path.endswith((".jsonl", ".gz", ".gzip")) else f"{self.path}._linelake"

    @property
    def is_folder(self) -> bool:
        return not self.path.endswith((".jsonl", ".gz", ".gzip"))

    @property
    def meta_path(self) -> str:
        return f"{self.side}/meta.json"

    def exists(self) -> bool:
        return files.exists(self.spark, self.meta_path)

    def load(self) -> Meta:
        raw = files.read_json(self.spark, self.meta_path)
        meta = Meta.of(raw or {})
        if meta.schemaVersion > SCHEMA_VERSION:
            raise ValueError(f"{self.meta_path} was written by a newer version")
        return meta

    def save(self, meta: Meta) -> Meta:
        meta.updatedAt = datetime.now(UTC).isoformat(timespec="seconds")
        meta.startedAt = meta.startedAt or meta.updatedAt
        files.write_json(self.spark, self.meta_path, asdict(meta))
        return meta

    def ensure(self) -> Meta:
        """The state; made from the data itself where there is none yet."""
        return self.load() if self.exists() else self.save(Meta(rows=self.count_lines(), bytes=sum(e.size for e in self.data())))

    def touch(self, rows: int = 0, size: int = 0, **context: Any) -> Meta:
        meta = self.load()
        meta.rows, meta.bytes = meta.rows + rows, meta.bytes + size
        return self.save(self._with(meta, context))

    def put_context(self, **context: Any) -> Meta:
        return self.save(self._with(self.load(), context))

    @staticmethod
    def _with(meta: Meta, context: dict[str, Any]) -> Meta:
        """A null value takes its key away."""
        meta.context = {k: v for k, v in (meta.context | context).items() if v is not None}
        return meta

    def mark_complete(self) -> Meta:
        meta = self.load()
        meta.completed, meta.fingerprint = True, self.fingerprint()
        return self.save(meta)

    def reset(self) -> None:
        """Forget the state and all that was derived from the data."""
        files.delete(self.spark, self.side)

    def data(self) -> list[files.Entry]:
        return files.listing(self.spark, self.path, suffixes=(".jsonl", ".jsonl.gz", ".jsonl.gzip", ".txt", ".txt.gz", ".json", ".json.gz"))

    def fingerprint(self) -> list[list]:
        return [[e.path, e.size, e.mtime] for e in self.data()]

    def fresh(self) -> bool:
        """State and data are there, and the data are as they were at completion."""
        return self.exists() and bool(self.data()) and self.load().fingerprint == self.fingerprint()

    def count_lines(self) -> int:
        """Line ends in the data. A last line without one is not counted."""
        data = self.data()
        if not data:
            return 0
        return counts_by_file(scan(self.spark, [e.path for e in data])).agg(F.sum("ends")).first()[0] or 0

    def rows(self) -> int:
        return self.load().rows if self.exists() else self.count_lines()
