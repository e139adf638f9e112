"""Session settings that JSON semantics need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Repeated keys: the last wins. ``A`` and ``a`` are two fields.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.caseSensitive": "true"}


@contextmanager
def json_settings(spark: SparkSession) -> Iterator[None]:
    """Set what parsing needs while a plan is built, and put the caller's values back. Plans analysed inside keep their behaviour."""
    before = {k: spark.conf.get(k, "false") for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
