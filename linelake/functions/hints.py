"""What a field's values look like: column functions over values, and over a field's aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp")
BOOLEAN_WORDS = ("0", "1", "true", "false", "yes", "no", "y", "n", "t", "f")
BOOLEAN_WORDS_MODEL = ("0", "1", "true", "false", "yes", "no", "y", "n", "on", "off")
DELIMITERS = (";", "|", ",")
STOPWORDS = {
    "en": ("the", "and", "of", "to", "in", "for", "with", "on", "at", "by", "from", "is", "are", "was", "were", "be", "as", "or"),
    "nl": ("de", "het", "een", "en", "van", "voor", "met", "op", "aan", "bij", "uit", "is", "zijn", "was", "waren", "te", "als", "of"),
    "fr": ("le", "la", "les", "un", "une", "et", "de", "des", "pour", "avec", "sur", "à", "par", "dans", "est", "sont", "été", "ou"),
    "es": ("el", "la", "los", "las", "un", "una", "y", "de", "del", "para", "con", "en", "a", "por", "es", "son", "fue", "o"),
}
_PUNCTUATION = r"[{}<>$#@=:_\\/]"


def is_url(s: Column) -> Column:
    """Starts with http:// or https:// and has a host; ASCII only."""
    return F.coalesce(F.regexp_like(s, F.lit(r"^https?://[A-Za-z0-9.\-_~%:@\[\]]+(?:[/?#][\x21-\x7E]*)?$")), F.lit(False))


def ending(s: Column) -> Column:
    """The lower-case file ending of a url's path, or of the text itself."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"^https?://[^/]*", ""), r"\.([^./]*)$", 1))


def is_image_url(s: Column) -> Column:
    return is_url(s) & ending(s).isin(*IMAGE_ENDINGS)


def is_image_name(s: Column) -> Column:
    """Any text whose path ends as an image does: a url's path, or the text itself where it has none."""
    path = F.regexp_replace(F.regexp_replace(s, r"(?s)[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    end = F.regexp_extract(F.when(path == "", s).otherwise(path), r"\.([^./]*)$", 1)
    return F.coalesce(F.lower(end).isin(*IMAGE_ENDINGS), F.lit(False))


def is_sentence(s: Column) -> Column:
    """At least two spaces inside."""
    t = F.trim(s)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 2


def is_json_text(s: Column, valid: Column) -> Column:
    """An object or array in a text of at most 4096 bytes; ``valid`` is the strict parser's verdict on it."""
    return F.regexp_like(F.ltrim(s), F.lit(r"^[{\[]")) & (F.octet_length(s) <= 4096) & valid


def is_code(s: Column) -> Column:
    marks, digits, n = F.regexp_count(s, F.lit(_PUNCTUATION)), F.regexp_count(s, F.lit(r"\d")), F.length(s)
    return (n >= 12) & ((~F.contains(s, F.lit(" ")) & ((marks >= 3) | (digits >= 4))) | (marks / n >= 0.12))


def ratio_like(hits: Column, of: Column, least: float, least_hits: int = 0) -> Column:
    """A share of at least ``least``, with at least ``least_hits`` hits; false for no values."""
    return F.coalesce((of > 0) & (hits / of >= least) & (hits >= least_hits), F.lit(False))


def parts(s: Column, delimiter: str) -> Column:
    """Non-empty trimmed parts; null where the text isn't a candidate: too long, or a comma between digits."""
    cut = F.filter(F.transform(F.split(s, "\\" + delimiter), F.trim), lambda x: x != "")
    skip = F.regexp_like(s, F.lit(r"\d,\d")) if delimiter == "," else F.lit(False)
    return F.when((F.octet_length(s) <= 4000) & ~skip & (F.size(cut) >= 2), cut)


def split_score(delimiter: Column, ratio: Column, parts_avg: Column, token_avg: Column, token_max: Column, preferred: str | None = None) -> Column:
    score = ratio + F.when(parts_avg >= 2, 0.10).otherwise(0.0) + F.when((token_avg > 0) & (token_avg <= 40), 0.10).otherwise(0.0)
    score = F.when(delimiter == ",", score * 0.75 * F.when(ratio < 0.35, 0.5).otherwise(1.0)).otherwise(score)
    if preferred:
        score = score + F.when(delimiter == preferred, 0.08).otherwise(0.0)
    return score * F.when(token_max > 250, 0.25).when(token_max > 160, 0.5).otherwise(1.0)


def split_enabled(ratio: Column, parts_avg: Column, token_max: Column) -> Column:
    return (ratio >= 0.30) & (parts_avg >= 2) & (token_max <= 250)


def split_confidence(ratio: Column, parts_avg: Column, enabled: Column) -> Column:
    base = F.least(F.lit(1.0), 1.15 * ratio + F.least(F.lit(0.10), (parts_avg - 2) * 0.03))
    return base * F.when(enabled, 1.0).otherwise(0.6)


def words(s: Column) -> Column:
    """Lower-case words: runs of letters."""
    return F.split(F.lower(s), r"[^\p{L}]+")


def stopword_hits(words: Column, language: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*STOPWORDS[language])))


def locale_of(hits: dict[str, Column]) -> Column:
    """The language with most hits, the first of equals in the list's order; null without hits."""
    best = F.greatest(*hits.values())
    out = F.lit(None).cast("string")
    for name in reversed(list(hits)):
        out = F.when((hits[name] == best) & (best > 0), F.lit(name)).otherwise(out)
    return out


def boolean_likes(counts: DataFrame) -> DataFrame:
    """(path, boolean_like, boolean_like_model) of value counts (path, key): all distinct non-blank values, in any case, are words for yes and no,
    and there are 1 to 6, or 1 to 4 of the model's words. All values are looked at."""
    word = F.lower(F.trim(F.substring("key", 3, 1 << 30)))
    full = counts.where("key is not null").select("path", F.when(F.startswith("key", F.lit("h:")), F.col("key")).otherwise(word).alias("word")).where("word != ''")
    n = F.count_distinct("word")
    known = lambda words: F.every(F.col("word").isin(*words))
    return full.groupBy("path").agg((known(BOOLEAN_WORDS) & (n <= 6)).alias("boolean_like"), (known(BOOLEAN_WORDS_MODEL) & (n <= 4)).alias("boolean_like_model"))


def facet_candidate(distinct: Column, len_max: Column, is_container: Column) -> Column:
    return distinct.between(1, 64) & (F.coalesce(len_max, F.lit(0)) <= 128) & ~is_container


def storage_strict(types: Column) -> Column:
    """json, bool, int, float or string from the set of a field's types (null left out); whole and other numbers mixed are a string."""
    only = lambda *ts: (F.size(types) > 0) & (F.size(F.array_except(types, F.array(*map(F.lit, ts)))) == 0)
    return (
        F.when(F.arrays_overlap(types, F.array(F.lit("array"), F.lit("object"))), "json").when(only("true", "false", "boolean"), "bool")
        .when(only("integer"), "int").when(only("real"), "float").otherwise("string")
    )


def storage_model(types: Column, len_max: Column) -> Column:
    has = lambda *ts: F.arrays_overlap(types, F.array(*map(F.lit, ts)))
    return (
        F.when(has("array", "object"), "json").when(has("true", "false", "boolean"), "bool")
        .when((F.size(types) > 0) & (F.size(F.array_except(types, F.array(F.lit("integer")))) == 0), "int")
        .when((F.size(types) > 0) & (F.size(F.array_except(types, F.array(F.lit("integer"), F.lit("real")))) == 0), "float")
        .when(len_max > 255, "text").otherwise("string")
    )
