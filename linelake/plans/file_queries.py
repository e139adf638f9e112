"""Queries over files: tables are written as logs below the shared folder and read, indexed, profiled and counted there."""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake import files
from linelake.cli import _counts, main
from linelake.functions import hints
from linelake.functions.json import trimmed
from linelake.lake import Lake, WriterOptions
from linelake.operators import legacy
from linelake.operators import profile as pr
from linelake.operators.nodes import nodes
from linelake.sources.lines import log_of, parsed, scan
from linelake.streaming.incremental import IncrementalProfile, first_tokens

FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    FILE_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession) -> str:
    return f"{files.shared_dir(spark)}/lake-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> Lake:
    lake = Lake(df.sparkSession, place(df.sparkSession))
    lake.write(df, **options)
    return lake


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def one_row(spark: SparkSession, **values) -> DataFrame:
    """Facts about a dataset, as a row."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in values.items()))


@query
def files_plain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by segment, read from several plain files; line numbers run from 1 in each."""
    rows = written(customers(spark, sf_dir).repartition(3)).rows()
    each = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.min("line_no").alias("first"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum("last").alias("last_numbers"), F.max("first").alias("first_number"))


@query
def files_gzip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(customers(spark, sf_dir), options=WriterOptions(compression="gzip"))
    return lake.read().groupBy(F.try_variant_get("v", "$.c_mktsegment", "string").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.max(F.try_variant_get("v", "$.c_custkey", "bigint")).alias("last"))


@query
def files_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of a file's rows: where each begins after those before it."""
    lake = written(customers(spark, sf_dir).coalesce(1).sortWithinPartitions("c_custkey"))
    return lake.rows().select(F.try_variant_get("v", "$.c_custkey", "bigint").alias("custkey"), "line_no", "offset")


@query
def files_start_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(customers(spark, sf_dir).coalesce(1).sortWithinPartitions("c_custkey"))
    return lake.read(101).select("line", F.try_variant_get("v", "$.c_custkey", "bigint").alias("custkey"))


@query
def files_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").coalesce(1).sortWithinPartitions("s_suppkey"))
    return one_row(spark, body=lake.first()["body"])


@query
def files_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines and blanks around rows: what is left, by kind of line."""
    body, k = F.to_json(F.struct("event_id")), F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit(" \t"), body, F.lit("\r"))).when(k == 1, "   ").when(k == 2, F.concat(body, F.lit("\x0b "))).otherwise(body)
    path = place(spark)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    left = trimmed(F.col("line"))
    return scan(spark, path).groupBy(F.length(left).alias("left")).agg(F.count(F.lit(1)).alias("n"))


@query
def files_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null fields left out: how many rows still name each field."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    return pr.folded(pr.value_counts(_nodes(written(e, sparse=True)))).select("path", "present", "non_null")


def _nodes(lake: Lake) -> DataFrame:
    return nodes(lake.rows().where("valid"), 1)


@query
def files_append_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written in two runs: of each user the first event, none of users that the first run wrote."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    lake = written(e.where("event_id % 50 = 0"), token="user_id", order=["event_id"])
    lake.write(e, mode="a", token="user_id", order=["event_id"])
    return lake.read().select(F.try_variant_get("v", "$.user_id", "bigint").alias("user_id"), F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"))


@query
def files_token_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), token="c_mktsegment", order=["c_custkey"])
    return one_row(spark, building=lake.contains_token("BUILDING"), other=lake.contains_token("no such segment"), n_rows=lake.state.rows())


@query
def files_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and freshness after writing, after adding a file from outside, after writing anew."""
    lake = written(customers(spark, sf_dir))
    meta, fresh = lake.state.load(), lake.state.fresh()
    log_of(table(spark, sf_dir, "nation")).coalesce(1).write.mode("append").text(lake.path)
    stale, lines = lake.state.fresh(), lake.state.count_lines()
    again = lake.write(table(spark, sf_dir, "region"))
    return one_row(spark, n_rows=meta.rows, n_bytes=meta.bytes, completed=meta.completed, fresh=fresh, still_fresh=stale, n_lines=lines, rows_after=again.rows, fresh_after=lake.state.fresh())


@query
def files_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a dataset: later values win, nulls take keys away."""
    df = table(spark, sf_dir, "nation")
    lake = written(df, source="nation", n=df.count(), gone=1)
    lake.state.put_context(source="nations", gone=None)
    context = lake.state.touch(rows=5, more=2).context
    return one_row(spark, context=json.dumps(context, sort_keys=True), n_rows=lake.state.rows())


@query
def files_directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of files below a folder, all of one base name, most first, with the total."""
    path = place(spark)
    for name in ("customer", "orders", "part", "supplier"):
        made = place(spark)
        log_of(table(spark, sf_dir, name)).coalesce(1).write.text(made)
        part = next(e.path for e in files.listing(spark, made, suffixes=(".txt",)))
        hadoop = spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop.Path(f"{path}/{name}"))
        fs.rename(hadoop.Path(part), hadoop.Path(f"{path}/{name}/x.jsonl"))
    counts = _counts(spark, path, True)
    rows = [(i, p.split("/")[-2], n) for i, (p, n) in enumerate(counts, 1)]
    return spark.createDataFrame([*rows, (len(rows) + 1, "TOTAL", sum(n for *_, n in rows))], "place bigint, name string, n_rows bigint")


@query
def files_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of files, brought up to date after more were added: the last row of each key, by file and line."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    lake = written(o.where("o_orderkey % 2 = 0").coalesce(1).sortWithinPartitions("o_orderkey"))
    first = lake.index(["id"], ["o_orderstatus"])
    lake.write(o.where("o_orderkey % 2 = 1").coalesce(1), mode="a")
    second = lake.index(["id"], ["o_orderstatus"])
    return one_row(spark, rows_first=first.rows, keys_first=first.keys, mode_first=first.mode, n_rows=second.rows, n_keys=second.keys, mode=second.mode, invalid=second.invalid)


@query
def files_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched by key from their place in the file."""
    lake = written(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size").repartition(2))
    lake.index(["id"])
    return spark.createDataFrame([(k, lake.get(k)) for k in ("1", "7", "42", "none")], "pk string, body string")


@query
def files_keyless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key in several files: each is a key of its own."""
    lake = written(customers(spark, sf_dir).repartition(4))
    found = lake.index(["no_such_field"])
    return one_row(spark, n_rows=found.rows, n_keys=found.keys)


@query
def files_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values by frequency, then by value, in this order."""
    lake = written(customers(spark, sf_dir))
    lake.index(["c_custkey"], ["c_mktsegment", "c_nationkey"])
    rows = lake.facet_counts("c_mktsegment", "c_nationkey").collect()  # as shown: a row for each value of a facet
    return spark.createDataFrame([(i, r.facet, r.value, r.n) for i, r in enumerate(rows, 1)], "place bigint, facet string, value string, n bigint")


@query
def files_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most present fields of a log with optional ones, as kept beside the data; how many were left out."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("a"), F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("b"))
    lake = written(e, sparse=True)
    found = lake.profile(most=2)
    return lake.stats().select("path", "present", "distinct_n", "min_v", "max_v", F.lit(found.truncated).cast("bigint").alias("left_out"), F.lit(found.rows).cast("bigint").alias("n_rows"))


@query
def files_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.array("s_nationkey").alias("list")))
    lake.profile()
    lake.browse(view := f"v_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT s_suppkey, s_name FROM {view} WHERE s_name LIKE '%1'")


@query
def files_row_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = written(customers(spark, sf_dir))
    before, n, there, dropped = lake.has_cache(), lake.keep_rows().count(), lake.has_cache(), lake.vacuum()
    return one_row(spark, before=before, n=n, there=there, dropped=dropped, after=lake.has_cache(), n_again=lake.rows().count())


@query
def files_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of a dataset, each in its place."""
    base = place(spark)
    names = [files.block_path(base, f"lang={r.lang}") for r in table(spark, sf_dir, "documents").select("lang").distinct().collect()]
    for path in names:
        lang = F.col("lang") == path.removesuffix(".jsonl").split("=")[-1]
        log_of(table(spark, sf_dir, "documents").select("doc_id", "lang").where(lang)).write.text(path)
    return one_row(spark, n_blocks=sum(files.exists(spark, p) for p in names), n_rows=spark.read.text(names).count())


def _said(spark: SparkSession, *args: str) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        main(list(args), spark)
    return out.getvalue()


@query
def command_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What index, info, state, vacuum and clean say of a log."""
    lake = written(customers(spark, sf_dir))
    index = json.loads(_said(spark, "index", lake.path, "--pk", "c_custkey", "--facet", "c_mktsegment"))
    _said(spark, "profile", lake.path)
    info, state = json.loads(_said(spark, "info", lake.path)), json.loads(_said(spark, "state", lake.path, "-j"))
    vacuum, cleaned = _said(spark, "vacuum", lake.path).strip(), len(_said(spark, "clean", lake.path).splitlines())
    return one_row(
        spark, keys=index["keys"], mode=index["mode"], info_rows=info["rows"], fields=info["fields"], facets=",".join(info["facets"]), fresh=state["fresh"], state_rows=state["rows"],
        vacuum=vacuum, cleaned=cleaned, left=files.exists(spark, lake.state.side),
    )


@query
def command_profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older document of a profile, as exported beside the data."""
    lake = written(table(spark, sf_dir, "labels"))
    _said(spark, "profile", lake.path, "--legacy-json")
    doc = files.read_json(spark, f"{lake.path}.profile.json")
    rows = [(path, f["total"], f["nulls"], "|".join(f["types"]), f["distinct"], f["storageHint"], f["booleanLike"], f["facetCandidate"], legacy.labels(f)["distinct"]) for path, f in doc["fields"].items()]
    kinds = "path string, total bigint, nulls bigint, types string, distinct_n bigint, storage string, boolean_like boolean, facet boolean, label string"
    return spark.createDataFrame(rows, kinds)


@query
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of a folder taken in by a stream in two runs."""
    path = place(spark)
    p, o = IncrementalProfile(spark, path, place(spark), 1), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        log_of(o.where(part), "o_orderstatus", "o_orderpriority").write.mode("append").text(path)
        p.run().awaitTermination()
    return p.counts().select("path", F.expr("substring(key, 3)").alias("value"), "n")


@query
def stream_first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of a stream of events, each once."""
    path, out = place(spark), place(spark)
    table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(path)
    first = first_tokens(stream, "user_id", "ts", "3650 days").select("user_id")
    first.writeStream.format("parquet").option("checkpointLocation", place(spark)).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint").parquet(out)


@query
def hint_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.explode(F.array("url", F.substring("html", 1, 60))).alias("s"))
    return p.groupBy(F.startswith("s", F.lit("http")).alias("url")).agg(F.count_if(hints.is_code(F.col("s"))).alias("hits"), F.count(F.lit(1)).alias("checked"))


@query
def hint_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics with what a caller knows of two fields."""
    s = pr.folded(pr.value_counts(nodes(parsed(log_of(table(spark, sf_dir, "labels"))), 1))).select("path", "present", "distinct_n")
    return legacy.overridden(s, {"quality": {"storage_hint": "bool"}, "doc_id": {"distinct_n": 0}})


FILE_ORACLES = {
    "files_plain_scan": "SELECT count(*) AS n_rows, count(*) AS last_numbers, 1 AS first_number FROM customer",
    "files_gzip_scan": "SELECT c_mktsegment AS segment, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1",
    "files_offsets": """
SELECT c_custkey AS custkey, row_number() OVER w AS line_no, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
  SELECT c_custkey, strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') + 1 AS size FROM customer)
WINDOW w AS (ORDER BY c_custkey)""",
    "files_start_at": "SELECT row_number() OVER (ORDER BY c_custkey) + 100 AS line, c_custkey AS custkey FROM customer",
    "files_first": """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS body FROM supplier ORDER BY s_suppkey LIMIT 1""",
    "files_trimmed": "SELECT CASE WHEN event_id % 4 = 1 THEN 0 ELSE strlen('{\"event_id\":' || event_id || '}') END AS \"left\", count(*) AS n FROM events GROUP BY 1",
    "files_sparse": """
SELECT 'event_id' AS path, count(*) AS present, count(*) AS non_null FROM events
UNION ALL SELECT 'kind', count(event_type), count(event_type) FROM events WHERE event_id % 3 = 0""",
    "files_append_tokens": "SELECT user_id, coalesce(min(event_id) FILTER (event_id % 50 = 0), min(event_id)) AS event_id FROM events GROUP BY user_id",
    "files_token_membership": "SELECT count(*) FILTER (c_mktsegment = 'BUILDING') > 0 AS building, false AS other, count(DISTINCT c_mktsegment) AS n_rows FROM customer",
    "files_state": """
SELECT count(*) AS n_rows, sum(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') + 1)::BIGINT AS n_bytes,
       true AS completed, true AS fresh, false AS still_fresh, count(*) + (SELECT count(*) FROM nation) AS n_lines, (SELECT count(*) FROM region) AS rows_after, true AS fresh_after FROM customer""",
    "files_context": """SELECT '{"more": 2, "n": ' || count(*) || ', "source": "nations"}' AS context, count(*) + 5 AS n_rows FROM nation""",
    "files_directory_counts": """
WITH c AS (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)
SELECT row_number() OVER (ORDER BY n DESC, name) AS place, name, n AS n_rows FROM c UNION ALL SELECT 5, 'TOTAL', sum(n)::BIGINT FROM c""",
    "files_index": """
SELECT count(*) FILTER (o_orderkey % 2 = 0) AS rows_first, count(DISTINCT o_custkey) FILTER (o_orderkey % 2 = 0) AS keys_first, 'full' AS mode_first,
       count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, 'incremental' AS mode, 0 AS invalid FROM orders""",
    "files_get": """
SELECT k AS pk, (SELECT '{"id":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || '}' FROM part WHERE p_partkey::VARCHAR = k) AS body FROM (VALUES ('1'), ('7'), ('42'), ('none')) t(k)""",
    "files_keyless_rows": "SELECT count(*) AS n_rows, count(*) AS n_keys FROM customer",
    "files_facets": """
WITH f AS (SELECT 'c_mktsegment' AS facet, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2)
SELECT row_number() OVER (ORDER BY facet, n DESC, value) AS place, * FROM f""",
    "files_profile": """
SELECT 'event_id' AS path, count(*) AS present, count(DISTINCT event_id) AS distinct_n, min(event_id)::VARCHAR AS min_v, max(event_id)::VARCHAR AS max_v, 1 AS left_out, count(*) AS n_rows FROM events
UNION ALL SELECT 'a', count(user_id), count(DISTINCT user_id), min(user_id)::VARCHAR, max(user_id)::VARCHAR, 1, (SELECT count(*) FROM events) FROM events WHERE event_id % 2 = 0""",
    "files_browse": "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier WHERE s_name LIKE '%1'",
    "files_row_cache": "SELECT false AS before, count(*) AS n, true AS there, true AS dropped, false AS after, count(*) AS n_again FROM customer",
    "files_block": "SELECT count(DISTINCT lang) AS n_blocks, count(*) AS n_rows FROM documents",
    "command_outputs": """
SELECT count(*) AS keys, 'full' AS mode, count(*) AS info_rows, 4 AS fields, 'c_mktsegment' AS facets, true AS fresh, count(*) AS state_rows, 'nothing to drop' AS vacuum, 1 AS cleaned, false AS left FROM customer""",
    "command_profile_export": " UNION ALL ".join(
        f"SELECT '{c}' AS path, count(*) AS total, count(*) - count({c}) AS nulls, 'int' AS types, count(DISTINCT {c}) AS distinct_n, 'int' AS storage, count(DISTINCT {c}) <= 4 AND bool_and({c} IN (0, 1)) AS boolean_like, "
        f"count(DISTINCT {c}) BETWEEN 1 AND 64 AS facet, count(DISTINCT {c})::VARCHAR AS label FROM labels" for c in ("doc_id", "quality", "toxic")
    ),
    "incremental_profile": "SELECT 'o_orderstatus' AS path, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "stream_first_tokens": "SELECT DISTINCT user_id FROM events",
    "hint_code": r"""
WITH s AS (SELECT unnest([url, substring(html, 1, 60)]) AS s FROM pages),
m AS (SELECT s, len(regexp_extract_all(s, '[{}<>$#@=:_\\/]')) AS marks, len(regexp_extract_all(s, '\d')) AS digits, length(s) AS n FROM s)
SELECT starts_with(s, 'http') AS url, count(*) FILTER (n >= 12 AND ((NOT contains(s, ' ') AND (marks >= 3 OR digits >= 4)) OR marks / n >= 0.12)) AS hits, count(*) AS checked FROM m GROUP BY 1""",
    "hint_overrides": """
SELECT 'doc_id' AS path, count(*) AS present, 0 AS distinct_n, NULL::VARCHAR AS storage_hint FROM labels
UNION ALL SELECT 'quality', count(*), count(DISTINCT quality), 'bool' FROM labels UNION ALL SELECT 'toxic', count(*), count(DISTINCT toxic), NULL FROM labels""",
}
