"""URL filters: rules of hosts and paths, and association rules mined from labelled urls."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged, table

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SUPPORT = 0.001
CONFIDENCE = 0.5
#: Labelled urls that must bear a mined rule out.
LEAST = 5
BROADCAST_RULES = 100_000
_BAD = "label bad"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """A url's distinct tokens: scheme, host, the host's words and last label, the path's folders, depth, the file name's words and ending, the
    query's keys and pairs, a class of length. Pure numbers are left out: they name one page."""
    some = lambda label, values: F.transform(F.filter(values, lambda x: ~F.regexp_like(x, F.lit(r"^\d*$"))), lambda x: F.concat(F.lit(f"{label} "), x))
    url = F.coalesce(url, F.lit(""))
    pairs = F.array_remove(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), "")
    steps = F.split(path, "/")
    file = F.element_at(steps, -1)
    stem, ending = F.regexp_replace(file, r"\.[A-Za-z0-9]{1,8}$", ""), F.regexp_extract(file, r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.array_distinct(F.concat(
        some("scheme", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))), some("host", F.array(host)), some("word", F.split(host, r"[.\-]")),
        some("top", F.array(F.element_at(F.split(host, r"\."), -1))), some("folder", F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))),
        some("file", F.split(stem, r"[.\-_+]|%20")), some("ending", F.array(F.lower(ending))), some("key", F.transform(pairs, lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
        some("pair", F.filter(pairs, lambda x: F.contains(x, F.lit("=")) & ~F.regexp_like(x, F.lit(r"=\d*$")))),
        F.array(F.concat(F.lit("depth "), F.size(steps).cast("string")), F.concat(F.lit("length "), F.length(F.bin(F.length(url).cast("long"))).cast("string"))),
    ))


def alike(named: DataFrame, n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Of ``n`` rows ``named`` (row, tokens, bad): (items, bad) for each row, and (token, item) for each token that a rule may hold.

    A rule's tokens are all in ``least`` bad rows, so others are left out; so are those in all rows, as a rule is as sure without them. Tokens that
    are in the very same rows (by their number and a hash of 128 bits) are one item, named by the first of them: a rule may hold any one of
    them, and a second adds nothing.
    """
    each = named.select("row", "bad", F.explode("tokens").alias("token"))
    rows = (F.count(F.lit(1)).alias("uses"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit("other"), "row")).alias("b"))
    counts = staged(each.groupBy("token").agg(F.count_if("bad").alias("hits"), *rows).where((F.col("hits") >= least) & (F.col("uses") < n)), "counts")
    firsts = counts.groupBy("uses", "a", "b").agg(F.min("token").alias("item"))
    items = staged(counts.join(firsts, ["uses", "a", "b"]).select("token", "item"), "items")
    own = each.join(items.where("token = item"), "token").groupBy("row").agg(F.collect_list("item").alias("items"))
    return named.join(own, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad"), items


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(items, n, confidence): combinations of items of ``urls`` (tokens, bad) which imply bad; and (token, item), as ``alike`` makes them.

    FP-growth finds the combinations of a share ``support`` of the rows, of all tokens. A rule holds if it is borne out by ``least`` rows and
    right for a share ``confidence`` of those that fit, and for a greater one than is bad of all rows; one that a part of its items implies as
    surely is left out. The combinations grow with 2 to the power of the items that many rows share and that vary independently.
    """
    none = urls.sparkSession.createDataFrame([], "items array<string>, n long, confidence double")
    named = staged(urls.withColumn("row", F.monotonically_increasing_id()), "named")
    total, hits = named.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    some, spelled = alike(named, total, max(least, math.ceil(support * total)))
    items = F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items"))
    baskets = staged(some.select(items.alias("items")), "baskets")
    if baskets.where(F.array_contains("items", _BAD)).isEmpty():
        return none, spelled
    sets = staged(FPGrowth(minSupport=support).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    bad = sets.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("n"))
    share = (F.col("n") / F.col("freq")).alias("confidence")
    rules = staged(bad.join(sets, "items").select("items", "n", "freq", share).where((F.col("n") >= least) & (F.col("confidence") >= confidence) & (F.col("n") * total > F.col("freq") * hits)), "rules")
    # each rule looks up the rules that have one item less: what is implied as surely by those is also implied by any smaller one kept
    less = rules.select(F.col("items").alias("whole"), F.col("confidence").alias("own"), F.explode("items").alias("x")).select("whole", "own", F.array_except("whole", F.array("x")).alias("items"))
    needless = less.join(rules, "items").where("confidence >= own").select(F.col("whole").alias("items")).distinct()
    return staged(rules.join(needless, "items", "left_anti").select("items", "n", "confidence"), "mined"), spelled


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, document: Column | None = None) -> DataFrame:
    """For each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mined (whether a mined rule fits).

    A given rule fits its host and all hosts below, if the path starts with the rule's; of several the longest (host and path) decides. Where
    none fits, urls that fit a mined rule are blocked, all others allowed. ``labels`` (doc_id, quality, toxic) marks a page bad whose
    ``document``, a column of pages (page_id if none is given), has quality 0 or toxic 1; several rows of one id: bad if any is. Mined rules are
    kept in an index by their rarest item: a url looks up its items and is held against the rules found.

    Null urls and those without ``://`` have an empty host and path and are allowed, as no rule fits. Repeated rows get equal verdicts. Urls of
    any length and number of tokens will do. Without pages there are no rows, without labels no mined rules. Further columns aren't looked at.
    """
    own = F.col("page_id") if document is None else document
    found = staged(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), own.cast("long").alias("document")), "urls")
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    mined, spelled = mine(found.where("host != ''").join(marked, found["document"] == marked["doc_id"]).select(tokens.alias("tokens"), "bad"), support, confidence, least)
    spelled = staged(spelled.join(mined.select(F.explode("items").alias("item")).distinct(), "item"), "spelled")
    each = found.where("host != ''").groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n")).select("url", "n", F.explode(tokens).alias("token"))
    urls = staged(each.join(spelled, "token").groupBy("url", "n").agg(F.collect_set("item").alias("own")), "own")
    looked = urls.select("url", "own", F.explode("own").alias("item"))
    freq = staged(urls.select("n", F.explode("own").alias("item")).groupBy("item").agg(F.sum("n").alias("uses")), "rarity")
    index = staged(
        mined.select("items", F.explode("items").alias("item")).join(freq, "item")
        .groupBy("items").agg(F.min(F.struct("uses", "item")).alias("rare")).select("items", "rare.item"), "index"
    )
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    hit = staged(looked.join(index, "item").where(F.size(F.array_except("items", "own")) == 0).select(F.col("url").alias("hit")).distinct(), "hit")
    best = None
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))) & F.startswith("path", F.lit(start))
        this = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, this) if best is None else F.when(fits, this).otherwise(best)
    best = F.lit(None).cast("struct<rule:string,verdict:string>") if best is None else best
    mined_too = F.col("hit").isNotNull()
    return (
        found.join(hit, found["url"] == hit["hit"], "left").withColumn("best", best)
        .select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.when(mined_too, "block").otherwise("allow")).alias("verdict"), mined_too.alias("mined"))
    )


def document_of(url: Column) -> Column:
    """The document that a page of the given tables shows: its number is the last step of the path, after the language."""
    return F.regexp_extract(path(url), r"^/[a-z]{2}/(\d{1,18})(?:\.html|/)?$", 1).try_cast("long")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, table(spark, sf_dir, "labels"), document=document_of(F.col("url")))
