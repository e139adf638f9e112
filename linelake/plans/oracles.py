"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from linelake.functions.hints import BOOLEAN_WORDS, BOOLEAN_WORDS_MODEL, IMAGE_ENDINGS, STOPWORDS


def _each(table: str, columns: str, item: str, source: str | None = None) -> str:
    """``item``, with {c} for the column, of each column, as one union."""
    return " UNION ALL ".join(f"SELECT {item.format(c=c)} FROM {source or table}" for c in columns.split())


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
_URL = r"^https?://[A-Za-z0-9.\-_~%:@\[\]]+([/?#][\x21-\x7E]*)?$"
_ENDING = r"lower(regexp_extract(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^https?://[^/]*', ''), '\.([^./]*)$', 1))"
_MADE = "CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '/x.webp?y=.txt' ELSE '/z.html' END"


def _image(u: str) -> str:
    return f"regexp_matches({u}, '{_URL}') AND {_ENDING.format(u=u)} IN {_words(IMAGE_ENDINGS)}"


def _words(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _hits(name: str) -> str:
    return f"sum(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w IN {_words(STOPWORDS[name])})))::BIGINT AS {name}"


_LAST = "SELECT {pk}::VARCHAR AS pk, {line} AS line_no{more} FROM (SELECT *, row_number() OVER (PARTITION BY {pk} ORDER BY {order}) AS r FROM {table}) WHERE r = 1"

ORACLES = {
    "json_type_histogram_events": """
SELECT key AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'real' WHEN type = 'VARCHAR' THEN 'text' ELSE lower(type) END AS json_type,
       count(*) AS n FROM events, json_each(props) GROUP BY ALL""",
    "profile_orders_presence": _each("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "'{c}' AS path, count(*) AS present, count({c}) AS non_null, 0 AS is_array"),
    "profile_lineitem_summary": _each("lineitem", "l_returnflag l_linestatus", "'{c}' AS path, count(*) AS present, min(length({c}))::BIGINT AS len_min, max(length({c}))::BIGINT AS len_max, count(DISTINCT {c}) AS distinct_n")
    + " UNION ALL " + _each("lineitem", " ".join(LINEITEM.split()[:8]), "'{c}' AS path, count(*) AS present, NULL::BIGINT AS len_min, NULL::BIGINT AS len_max, count(DISTINCT {c}) AS distinct_n")
    + " UNION ALL SELECT 'l_shipdate', count(*), 23, 23, count(DISTINCT l_shipdate) FROM lineitem",
    "profile_customer_distinct": _each("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "'{c}' AS path, count(DISTINCT {c}) AS distinct_n"),
    "profile_documents_lengths": _each("documents", "text lang source", "'{c}' AS path, min(length({c}))::BIGINT AS len_min, max(length({c}))::BIGINT AS len_max, round(avg(length({c})), 2) AS len_avg")
    + " UNION ALL " + _each("documents", "doc_id n_chars", "DISTINCT '{c}' AS path, NULL::BIGINT AS len_min, NULL::BIGINT AS len_max, NULL::DOUBLE AS len_avg"),
    "profile_part_minmax": _each("part", "p_partkey p_name p_brand p_type p_size", "'{c}' AS path, min({c})::VARCHAR AS min_v, max({c})::VARCHAR AS max_v"),
    "profile_orders_topn": "SELECT path, rank, value, n FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS path, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c}::VARCHAR AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
    ) + ") WHERE rank <= 20",
    "profile_nested_paths": " UNION ALL ".join(
        f"SELECT '{p}' AS path, count(*) AS present, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_n FROM customer"
        for p, c in (("c_custkey", "c_custkey"), ("cust.seg", "c_mktsegment"), ("cust.nation.key", "c_nationkey"), ('cust.nation."full name"', "c_name"))
    ),
    "profile_sparse_nulls": " UNION ALL ".join(
        f"SELECT '{p}' AS path, count(*) AS present, count({e}) AS non_null, count(*) - count({e}) AS n_null FROM events"
        for p, e in (("event_id", "event_id"), ("kind", "CASE WHEN event_id % 3 = 0 THEN event_type END"), ("who", "CASE WHEN event_id % 7 = 0 THEN user_id END"))
    ),
    "profile_mixed_types": """
WITH k AS (SELECT o_orderkey % 4 AS m, o_orderkey AS k, o_orderstatus AS s FROM orders)
SELECT 'x' AS path, count(*) FILTER (m = 0) AS n_integer, count(*) FILTER (m = 1) AS n_text, count(*) FILTER (m = 2) AS n_true, count(*) FILTER (m = 3) AS n_null,
       count(*) AS present, count(*) FILTER (m < 3) AS non_null,
       (SELECT min(CASE WHEN m = 2 THEN 1 ELSE k END)::VARCHAR FROM k WHERE m IN (0, 2)) AS min_v, max(s) FILTER (m = 1) AS max_v,
       count(DISTINCT CASE m WHEN 0 THEN 'n' || k WHEN 2 THEN 'n1' WHEN 1 THEN 't' || s END) AS distinct_n FROM k""",
    "profile_hints_pages": f"""
WITH t AS (SELECT url FROM pages GROUP BY url ORDER BY count(*) DESC, url LIMIT 20)
SELECT 'page_id' AS path, false AS url_like, false AS image_like, false AS natural_language_like
UNION ALL SELECT 'url', avg(regexp_matches(url, '{_URL}')::INT) >= 0.6, avg(({_image("url")})::INT) >= 0.5, false FROM t""",
    "array_elements_embeddings": "SELECT 'embedding' AS path, sum(len(embedding))::BIGINT AS elements, count(embedding) AS arrays, round(sum(len(embedding)) / count(embedding), 2) AS avg_per_row FROM embeddings",
    "array_elements_tags_top": """
SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value, n FROM (SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value) ORDER BY n DESC, value LIMIT 20""",
    "array_elements_tags_distinct": """
SELECT 'tags' AS path, count(*) AS count, count(DISTINCT t) AS distinct, round(count(*) / (SELECT count(*) FROM part), 2) AS avg_per_row FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)""",
    "index_last_wins": _LAST.format(pk="l_orderkey", line="l_orderkey * 100 + l_linenumber", more=", l_partkey::VARCHAR AS partkey, l_returnflag AS flag", order="l_linenumber DESC, l_partkey DESC, l_returnflag DESC", table="lineitem"),
    "index_composite_pk": "SELECT l_orderkey || ':' || l_linenumber AS pk, max(l_orderkey * 100 + l_linenumber) AS line_no FROM lineitem GROUP BY 1",
    "index_pk_fallback": """
SELECT CASE WHEN o_orderkey % 5 != 0 THEN o_custkey::VARCHAR ELSE '#' || o_orderkey END AS pk, max(o_orderkey) AS line_no FROM orders GROUP BY 1""",
    "index_rows_vs_keys": "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) - count(DISTINCT l_orderkey) AS n_replaced FROM lineitem",
    "index_merge_increment": _LAST.format(pk="l_partkey", line="l_orderkey * 100 + l_linenumber", more=", l_returnflag AS flag", order="l_orderkey * 100 + l_linenumber DESC, l_returnflag DESC", table="lineitem"),
    "facet_counts_events": "SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY event_type",
    "facet_counts_documents_lang": "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang",
    "facet_multi": "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source",
    "facet_filter_fetch": """
SELECT event_id::VARCHAR AS pk, event_id AS line_no, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS body FROM events WHERE event_type = 'click'""",
    "lookup_by_pk": """
SELECT user_id::VARCHAR AS pk, '{"event_id":' || max(event_id) || ',"user_id":' || user_id || ',"event_type":"' || max_by(event_type, event_id) || '"}' AS body FROM events WHERE user_id IN (7, 42) GROUP BY user_id""",
    "browse_filter_sort": "SELECT c_custkey AS line_no, c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name DESC, c_custkey LIMIT 50",
    "token_dedup_first": "SELECT user_id::VARCHAR AS token, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "token_anti_join_resume": """
SELECT user_id::VARCHAR AS token, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events
WHERE event_id % 20 != 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 20 = 0) GROUP BY user_id""",
    "directory_count_total": "SELECT coalesce(name, 'TOTAL') AS name, count(*) AS n_rows FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name FROM {t}" for t in ("customer", "orders", "part", "supplier")) + ") GROUP BY ROLLUP (name)",
    "valid_vs_invalid_lines": """
WITH b AS (SELECT event_id % 8 AS kind, CASE event_id % 8 WHEN 0 THEN props || ' x' WHEN 1 THEN props || props WHEN 2 THEN '[1,2] ,' WHEN 3 THEN 'null' WHEN 4 THEN '{"a":01}' ELSE props END AS body FROM events)
SELECT kind, count(*) FILTER (json_valid(body)) AS n_valid, count(*) FILTER (NOT json_valid(body)) AS n_invalid FROM b GROUP BY kind""",
    "reader_rows": "SELECT event_id % 3 AS kind, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1",
    "hint_url_pages": f"""
SELECT count(*) FILTER (regexp_matches(url, '{_URL}') AND strlen(url) <= 2048) AS hits, count(*) FILTER (trim(url) != '') AS checked,
       count(*) FILTER (regexp_matches(url, '{_URL}')) >= greatest(3, 0.6 * count(*)) AS url_like FROM pages""",
    "hint_image_urls": f"""
WITH p AS (SELECT url || {_MADE} AS raw, regexp_replace(url, '[?#].*$', '') || {_MADE} AS u FROM pages)
SELECT count(*) FILTER ({_image("u")}) AS hits, count(*) FILTER ({_image("raw")}) AS raw_hits, count(*) AS checked, count(*) FILTER ({_image("u")}) >= 0.5 * count(*) AS image_like FROM p""",
    "hint_natural_language": """
SELECT lang, count(*) FILTER (length(trim(text, ' ')) - length(replace(trim(text, ' '), ' ', '')) >= 2) AS hits, count(*) AS checked,
       count(*) FILTER (length(trim(text, ' ')) - length(replace(trim(text, ' '), ' ', '')) >= 2) >= 0.5 * count(*) AS natural_language_like FROM documents GROUP BY lang""",
    "hint_boolean_like": " UNION ALL ".join(
        f"SELECT '{c}' AS path, count(DISTINCT {c}) <= 6 AND bool_and(lower({c}::VARCHAR) IN {_words(BOOLEAN_WORDS)}) AS boolean_like, "
        f"count(DISTINCT {c}) <= 4 AND bool_and(lower({c}::VARCHAR) IN {_words(BOOLEAN_WORDS_MODEL)}) AS boolean_like_model FROM {t}"
        for c, t in (("doc_id", "labels"), ("quality", "labels"), ("toxic", "labels"), ("o_orderstatus", "orders"))
    ),
    "hint_facet_candidate": _each("documents", "doc_id n_chars", "'{c}' AS path, count(DISTINCT {c}) BETWEEN 1 AND 64 AS facet_candidate")
    + " UNION ALL " + _each("documents", "text lang source", "'{c}' AS path, count(DISTINCT {c}) BETWEEN 1 AND 64 AND max(length({c})) <= 128 AS facet_candidate"),
    "hint_storage_type": """
WITH e AS (SELECT unnest([{'p': 'event_id', 't': 'integer', 'n': NULL}, {'p': 'event_type', 't': 'text', 'n': length(event_type)}, {'p': 'flag', 't': 'boolean', 'n': NULL}, {'p': 'list', 't': 'array', 'n': NULL},
                         {'p': 'mixed', 't': CASE WHEN event_id % 2 = 0 THEN 'integer' ELSE 'real' END, 'n': NULL}]) AS x FROM events),
k AS (SELECT x.p AS path, list(DISTINCT x.t ORDER BY x.t) AS t, max(x.n) AS longest FROM e GROUP BY 1)
SELECT path, CASE WHEN list_contains(t, 'array') THEN 'json' WHEN t = ['boolean'] THEN 'bool' WHEN t = ['integer'] THEN 'int' WHEN t = ['real'] THEN 'float' ELSE 'string' END AS strict,
       CASE WHEN list_contains(t, 'array') THEN 'json' WHEN list_contains(t, 'boolean') THEN 'bool' WHEN t = ['integer'] THEN 'int' WHEN list_has_all(['integer', 'real'], t) THEN 'float' WHEN longest > 255 THEN 'text' ELSE 'string' END AS model FROM k""",
    "split_candidate": """
WITH s AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE array_to_string(string_split(p_name, ' '), '; ') END AS s FROM part),
p AS (SELECT s, list_filter(list_transform(string_split(s, ';'), lambda x: trim(x)), lambda x: x != '') AS p FROM s),
g AS (SELECT (SELECT count(*) FROM s) AS checked, count(*) AS hits, sum(len(p)) AS n, sum(list_sum(list_transform(p, lambda x: length(x)))) AS chars, max(list_max(list_transform(p, lambda x: length(x)))) AS longest FROM p WHERE len(p) >= 2),
r AS (SELECT hits / checked AS ratio, n / hits AS avg, chars / n AS tok, longest FROM g)
SELECT ';' AS delimiter, round(ratio, 4) AS ratio, round(avg, 3) AS parts_avg, round(ratio + CASE WHEN avg >= 2 THEN 0.1 ELSE 0 END + CASE WHEN tok > 0 AND tok <= 40 THEN 0.1 ELSE 0 END, 4) AS score,
       ratio >= 0.3 AND avg >= 2 AND longest <= 250 AS enabled, round(least(1.0, 1.15 * ratio + least(0.10, (avg - 2) * 0.03)), 4) AS confidence FROM r""",
    "locale_guess": f"""
WITH g AS (SELECT lang, {", ".join(map(_hits, STOPWORDS))} FROM documents GROUP BY lang)
SELECT *, CASE greatest(en, nl, fr, es) WHEN 0 THEN NULL WHEN en THEN 'en' WHEN nl THEN 'nl' WHEN fr THEN 'fr' ELSE 'es' END AS locale FROM g""",
    "json_in_string": """
WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN event_type ELSE props END AS s FROM events)
SELECT count(*) FILTER (json_valid(s) AND s[1] IN ('{', '[')) AS hits, count(*) AS checked, count(*) FILTER (json_valid(s) AND s[1] IN ('{', '[')) >= 0.6 * count(*) AS json_like FROM e""",
    "bytes_and_rows_state": """
SELECT 'nation' AS name, count(*) AS n_rows, sum(strlen('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') + 1)::BIGINT AS n_bytes FROM nation
UNION ALL SELECT 'region', count(*), sum(strlen('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') + 1)::BIGINT FROM region
UNION ALL SELECT 'labels', count(*), sum(strlen('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') + 1)::BIGINT FROM labels""",
    "legacy_text_stats": _each("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "'{c}' AS path, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct, CASE WHEN count(DISTINCT {c}) <= 100000 THEN count(DISTINCT {c}) = count(*) END AS unique"),
    "legacy_array_stats": """
WITH e AS (
  SELECT 'tags' AS path, p_partkey AS id, 'string' AS kind, unnest(string_split(p_name, ' ')) AS t FROM part
  UNION ALL SELECT 'facts', p_partkey, 'int', p_size::VARCHAR FROM part
  UNION ALL SELECT 'facts', p_partkey, 'string', p_brand FROM part
  UNION ALL SELECT 'facts', p_partkey, 'float', CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END FROM part
  UNION ALL SELECT 'embedding', vec_id, 'float', unnest(embedding)::VARCHAR FROM embeddings)
SELECT path, count(DISTINCT id) AS arrays, count(*) AS elements, array_to_string(list_sort(list(DISTINCT kind), 'ASC'), '|').replace('float|int|string', 'int|float|string') AS elem_types,
       min(strlen(t)) FILTER (kind = 'string')::BIGINT AS elem_len_min, max(strlen(t)) FILTER (kind = 'string')::BIGINT AS elem_len_max, round(avg(strlen(t)) FILTER (kind = 'string'), 4) AS elem_len_avg,
       least(count(DISTINCT t), 100000) AS elem_distinct, count(DISTINCT t) > 100000 AS elem_capped FROM e GROUP BY path""",
    "legacy_boolean_like": f"""
WITH v AS (
  SELECT 'word' AS path, CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' ELSE '' END AS t, true AS texts FROM documents
  UNION ALL SELECT 'lang', lang, true FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'number', (doc_id % 3)::VARCHAR, false FROM documents)
SELECT path, bool_or(texts) AND count(DISTINCT t) <= 6 AND bool_and(trim(t) = '' OR lower(trim(t)) IN {_words(BOOLEAN_WORDS)}) AS boolean_like FROM v GROUP BY path
UNION ALL SELECT 'flag', bool_and(doc_id % 3 = 0 OR doc_id % 3 != 0) FROM documents""",
    "legacy_image_like": f"""
WITH s AS (SELECT CASE page_id % 3 WHEN 0 THEN 'pic ' || page_id || '.PNG' WHEN 1 THEN url || '/a.b/c.jpg' ELSE url END AS s FROM pages)
SELECT count(*) FILTER ({_ENDING.format(u='s')} IN {_words(IMAGE_ENDINGS)}) AS hits, count(*) AS checked, count(*) FILTER ({_ENDING.format(u='s')} IN {_words(IMAGE_ENDINGS)}) >= 0.5 * count(*) AS image_like FROM s""",
    "legacy_distribution": " UNION ALL ".join(
        f"SELECT '{c}' AS path, {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE (SELECT count(DISTINCT {c}) FROM orders) <= 100 GROUP BY {c}" for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    ),
    "merge_profiles": _each("orders", "o_orderstatus o_orderpriority", "'{c}' AS path, {c} AS value, count(*) AS n").replace("FROM orders UNION", "FROM orders GROUP BY ALL UNION") + " GROUP BY ALL",
}
