"""The registered queries: each applies an operator to the driver's tables, as logs of JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.functions import hints
from linelake.functions.json import once, strict
from linelake.operators import index as ix
from linelake.operators import legacy
from linelake.operators import profile as pr
from linelake.operators.nodes import nodes
from linelake.session import json_settings
from linelake.sources.lines import decoded, log_of, parsed, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, name: str, *columns: str, **others) -> DataFrame:
    return parsed(log_of(spread(table(spark, sf_dir, name)), *columns, **others))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "events").select(F.col("props").alias("body"), "event_id"))


@query
def json_type_histogram_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(props(spark, sf_dir), 1).groupBy("path", "json_type").agg(F.count(F.lit(1)).alias("n"))


@query
def profile_orders_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.folded(pr.value_counts(nodes(log(spark, sf_dir, "orders"), 1))).select("path", "present", "non_null", "is_array")


@query
def profile_lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pr.value_counts(nodes(log(spark, sf_dir, "lineitem"), 1))
    return pr.folded(counts).select("path", "present", "len_min", "len_max", "distinct_n")


@query
def profile_customer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.distinct_counts(pr.value_counts(nodes(log(spark, sf_dir, "customer"), 1)))


@query
def profile_documents_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pr.folded(pr.value_counts(nodes(log(spark, sf_dir, "documents"), 1)))
    return found.select("path", "len_min", "len_max", "len_avg")


@query
def profile_part_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pr.summary(nodes(log(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"), 1))
    return found.select("path", "min_v", "max_v")


@query
def profile_orders_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(log(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority"), 1)
    return pr.top_values(pr.value_counts(found), found).select("path", F.col("rank").cast("long").alias("rank"), "value", "n")


@query
def profile_nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("seg"), F.struct(F.col("c_nationkey").alias("key"), F.col("c_name").alias("full name")).alias("nation")).alias("cust"))
    found = nodes(parsed(log_of(c)), 3)
    return pr.summary(found).select("path", "present", "non_null", "distinct_n")


@query
def profile_sparse_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("who"))
    return pr.folded(pr.value_counts(nodes(parsed(log_of(e)), 1))).select("path", "present", "non_null", "n_null")


@query
def profile_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"x":'), k.cast("string"), F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"x":"'), F.col("o_orderstatus"), F.lit('"}')))
    body = text.when(k % 4 == 2, F.lit('{"x":true}')).otherwise(F.lit('{"x":null}'))
    rows = parsed(table(spark, sf_dir, "orders").select(body.alias("body")))
    found = nodes(rows, 1)
    s = pr.summary(found).select("path", "n_integer", "n_text", "n_true", "n_null", "present", "non_null", "min_v", "max_v", "distinct_n")
    return s


@query
def profile_hints_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(log(spark, sf_dir, "pages", "page_id", "url"), 1)
    top = pr.top_values(pr.value_counts(found), found)
    return pr.field_hints(top)


@query
def array_elements_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pr.element_stats(log(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding")
    return out.select("path", F.col("count").alias("elements"), "arrays", "avg_per_row")


@query
def array_elements_tags_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return pr.element_top(parsed(log_of(p)), "tags").select(F.col("rank").cast("long").alias("rank"), "value", "n")


@query
def array_elements_tags_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return pr.element_stats(parsed(log_of(p)), "tags").select("path", "count", "distinct", "avg_per_row")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a log in order of its keys, then of l_partkey and l_returnflag: the order is in columns, so no global numbering is needed."""
    order = {"o1": F.col("l_partkey"), "o2": F.col("l_returnflag"), "line_no": F.col("l_orderkey") * 100 + F.col("l_linenumber")}
    return log(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", **order)


@query
def index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ix.keyed(lines_of(spark, sf_dir), ["l_orderkey"], ["l_partkey", "l_returnflag"], ["line_no", "o1", "o2"])
    last = ix.last_of_each(entries, ["line_no", "o1", "o2"])
    return last.select("pk", "line_no", F.col("attrs")["l_partkey"].alias("partkey"), F.col("attrs")["l_returnflag"].alias("flag"))


@query
def index_composite_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ix.keyed(lines_of(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    return ix.last_of_each(entries).select("pk", "line_no")


@query
def index_pk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")))
    rows = parsed(log_of(o, "k", "o_orderstatus", line_no=F.col("o_orderkey")))
    return ix.last_of_each(ix.keyed(rows, ["k"])).select("pk", "line_no")


@query
def index_rows_vs_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ix.keyed(lines_of(spark, sf_dir), ["l_orderkey"])
    n = F.sum("n")
    return entries.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).agg(n.alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), (n - F.count(F.lit(1))).alias("n_replaced"))


@query
def index_merge_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first part of a log, merged with the entries of the rest."""
    entries = ix.keyed(lines_of(spark, sf_dir), ["l_partkey"], ["l_returnflag"], ["line_no", "o2"])
    old = ix.last_of_each(entries.where("line_no % 2 = 0"), ["line_no", "o2"])
    return ix.last_of_each(old.unionByName(entries.where("line_no % 2 = 1")), ["line_no", "o2"]).select("pk", "line_no", F.col("attrs")["l_returnflag"].alias("flag"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "events", "event_id", "user_id", "event_type", line_no=F.col("event_id"))


@query
def facet_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ix.last_of_each(ix.keyed(events(spark, sf_dir), ["event_id"], ["event_type"]))
    return ix.facet_counts(index, "event_type")


@query
def facet_counts_documents_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir, "documents", "doc_id", "lang", line_no=F.col("doc_id"))
    return ix.facet_counts(ix.last_of_each(ix.keyed(rows, ["doc_id"], ["lang"])), "lang")


@query
def facet_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir, "documents", "doc_id", "lang", "source", line_no=F.col("doc_id"))
    return ix.facet_counts(ix.last_of_each(ix.keyed(rows, ["doc_id"], ["lang", "source"])), "lang", "source")


@query
def facet_filter_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    index = ix.last_of_each(ix.keyed(rows, ["event_id"], ["event_type"]))
    return ix.fetch(index, rows, F.col("attrs")["event_type"] == "click").select("pk", "line_no", "body")


@query
def lookup_by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return ix.fetch(ix.last_of_each(ix.keyed(rows, ["user_id"])), rows, F.col("pk").isin("7", "42")).select("pk", "body")


@query
def browse_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", line_no=F.col("c_custkey"))
    view = ix.browse(rows, {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"})
    return view.where("c_mktsegment = 'BUILDING'").orderBy(F.col("c_name").desc(), "line_no").limit(50)


@query
def token_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), "event_id", "event_type")
    return ix.first_by_token(e, ["event_id"])


@query
def token_anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), "event_id", "event_type")
    seen = e.where("event_id % 20 = 0").select("token").distinct()
    return ix.first_by_token(e.where("event_id % 20 != 0"), ["event_id"], seen)


@query
def directory_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = None
    for name in ("customer", "orders", "part", "supplier"):
        one = log_of(table(spark, sf_dir, name)).select(F.lit(name).alias("name"), "body")
        logs = one if logs is None else logs.unionByName(one)
    return logs.rollup("name").agg(F.count("body").alias("n_rows")).select(F.coalesce("name", F.lit("TOTAL")).alias("name"), "n_rows")


@query
def valid_vs_invalid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("event_id") % 8, F.col("props")
    broken = F.when(k == 0, F.concat(b, F.lit(" x"))).when(k == 1, F.concat(b, b)).when(k == 2, F.lit("[1,2] ,")).when(k == 3, F.lit("null")).when(k == 4, F.lit('{"a":01}'))
    rows = parsed(table(spark, sf_dir, "events").select(k.alias("kind"), broken.otherwise(b).alias("body")))
    return rows.groupBy("kind").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query
def reader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader yields: valid objects and arrays, not scalars."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.col("props"))
    rows = parsed(table(spark, sf_dir, "events").select(k.alias("kind"), body.alias("body")))
    return decoded(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def hint_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    p = table(spark, sf_dir, "pages").agg(F.count_if(hints.is_url(url) & (F.octet_length(url) <= 2048)).alias("hits"), F.count_if(F.trim(url) != "").alias("checked"))
    return p.select("hits", "checked", hints.ratio_like(F.col("hits"), F.col("checked"), 0.6, 3).alias("url_like"))


@query
def hint_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".JPG").when(F.col("page_id") % 3 == 1, "/x.webp?y=.txt").otherwise("/z.html"))
    clean = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".JPG").when(F.col("page_id") % 3 == 1, "/x.webp?y=.txt").otherwise("/z.html"))
    p = table(spark, sf_dir, "pages").agg(F.count_if(hints.is_image_url(clean)).alias("hits"), F.count_if(hints.is_image_url(url)).alias("raw_hits"), F.count(F.lit(1)).alias("checked"))
    return p.select("hits", "raw_hits", "checked", hints.ratio_like(F.col("hits"), F.col("checked"), 0.5).alias("image_like"))


@query
def hint_natural_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(hints.is_sentence(F.col("text"))).alias("hits"), F.count(F.lit(1)).alias("checked"))
    return d.select("lang", "hits", "checked", hints.ratio_like(F.col("hits"), F.col("checked"), 0.5).alias("natural_language_like"))


@query
def hint_boolean_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(log(spark, sf_dir, "labels"), 1).unionByName(nodes(log(spark, sf_dir, "orders", "o_orderstatus"), 1))
    return hints.boolean_likes(pr.value_counts(found))


@query
def hint_facet_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(log(spark, sf_dir, "documents"), 1)
    s = pr.folded(pr.value_counts(found))
    return s.select("path", hints.facet_candidate(F.col("distinct_n"), F.col("len_max"), F.col("is_array") == 1).alias("facet_candidate"))


@query
def hint_storage_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.lit("1")).otherwise(F.lit("1.5")).alias("mixed"), (F.col("event_id") % 2 == 0).alias("flag"), F.array("user_id").alias("list"))
    j = e.select(F.concat(F.regexp_replace(F.to_json(F.struct("event_id", "event_type", "flag", "list")), r"\}$", ',"mixed":'), F.col("mixed"), F.lit("}")).alias("body"))
    s = pr.folded(pr.value_counts(nodes(parsed(j), 1)))
    types = F.filter(F.array(*(F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in pr.TYPES if t != "null")), lambda x: x.isNotNull())
    return s.select("path", hints.storage_strict(types).alias("strict"), hints.storage_model(types, F.col("len_max")).alias("model"))


@query
def split_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.concat_ws("; ", F.split("p_name", " ")))
    values = table(spark, sf_dir, "part").select(F.lit("p").alias("path"), s.alias("s"))
    return legacy.split_candidates(values).select("delimiter", "ratio", "parts_avg", "score", "enabled", "confidence")


@query
def locale_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words = once(spread(d), words=hints.words(F.col("text")))
    hits = {name: F.sum(hints.stopword_hits(F.col("words"), name)).alias(name) for name in hints.STOPWORDS}
    g = words.groupBy("lang").agg(*hits.values())
    return g.select("lang", *hits, hints.locale_of({n: F.col(n) for n in hits}).alias("locale"))


@query
def json_in_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("props")).alias("s"))
    with json_settings(spark):
        out = e.agg(F.count_if(hints.is_json_text(F.col("s"), strict(F.col("s"))[0])).alias("hits"), F.count(F.lit(1)).alias("checked"))
        out.schema  # noqa: B018
    return out.select("hits", "checked", hints.ratio_like(F.col("hits"), F.col("checked"), 0.6, 3).alias("json_like"))


@query
def bytes_and_rows_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = [log_of(table(spark, sf_dir, n)).select(F.lit(n).alias("name"), "body") for n in ("nation", "region", "labels")]
    each = logs[0].unionByName(logs[1]).unionByName(logs[2])
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("body").cast("long") + 1).alias("n_bytes"))


@query
def legacy_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.text_stats(nodes(log(spark, sf_dir, "orders"), 1)).select("path", "total", "nulls", "distinct", "unique")


@query
def legacy_array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of words, objects and lists of numbers."""
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags"), F.struct("p_size", "p_brand", "p_retailprice").alias("facts"))
    both = parsed(log_of(p)).select("v").unionByName(log(spark, sf_dir, "embeddings", "embedding").select("v"))
    return legacy.array_stats(both).withColumns({"elem_types": F.array_join("elem_types", "|"), "elem_len_avg": F.round("elem_len_avg", 4)})


@query
def legacy_boolean_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select((third == 0).alias("flag"), F.when(third == 0, "Yes").when(third == 1, " no ").otherwise("").alias("word"), third.alias("number"), "lang")
    return legacy.boolean_fields(nodes(parsed(log_of(d)), 1))


@query
def legacy_image_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("page_id") % 3
    s = F.when(third == 0, F.concat(F.lit("pic "), F.col("page_id"), F.lit(".PNG"))).when(third == 1, F.concat("url", F.lit("/a.b/c.jpg"))).otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").agg(F.count_if(hints.is_image_name(s)).alias("hits"), F.count(F.lit(1)).alias("checked"))
    return p.select("hits", "checked", hints.ratio_like(F.col("hits"), F.col("checked"), 0.5, 3).alias("image_like"))


@query
def legacy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.distribution(pr.value_counts(nodes(log(spark, sf_dir, "orders"), 1)))


@query
def merge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of two parts of a log, added up, are those of the whole."""
    def of(part: str) -> DataFrame:
        rows = parsed(log_of(table(spark, sf_dir, "orders").where(part), "o_orderstatus", "o_orderpriority"))
        return pr.value_counts(nodes(rows, 1))

    both = of("o_orderkey % 2 = 0").unionByName(of("o_orderkey % 2 = 1")).groupBy("path", "key").agg(F.sum("n").alias("n"))
    return both.select("path", F.expr("substring(key, 3)").alias("value"), "n")
