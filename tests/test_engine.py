"""The engine on small logs with values worked out by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from linelake import files
from linelake.cli import main
from linelake.functions import hints
from linelake.lake import Lake
from linelake.operators import index as ix
from linelake.operators import legacy
from linelake.operators import profile as pr
from linelake.operators.nodes import nesting, nodes
from linelake.sources.lines import decoded, log_of, parsed
from linelake.sources.tail import TailSource
from linelake.streaming import incremental
from linelake.streaming.incremental import IncrementalProfile

LINES = '{"id":1,"n":"é"}\r\n\n  {"id":2}  \nnot json\n{"id":1,"n":"last"}\n5\n{"id":3}'


def bodies(spark, *texts):
    return parsed(spark.createDataFrame([(t, i) for i, t in enumerate(texts, 1)], "body string, line_no long"))


def folder(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    return f"file://{tmp_path}"


def test_lines(spark, tmp_path):
    lake = Lake(spark, folder(tmp_path, a=LINES))
    rows = lake.rows().orderBy("line_no").collect()
    assert [(r.line_no, r.offset, r.valid) for r in rows] == [(1, 0, True), (2, 20, True), (3, 33, False), (4, 42, True), (5, 62, True), (6, 64, True)]
    assert decoded(lake.rows()).count() == 4 and lake.state.count_lines() == 6
    assert [r.line for r in lake.read(101).orderBy("line").collect()] == [101, 102, 104, 106]
    assert json.loads(lake.first().body) == {"id": 1, "n": "é"}
    with pytest.raises(ValueError):
        lake.read(0)
    got = lake.index(["id"], ["n"])
    assert (got.rows, got.keys, got.invalid, got.mode) == (5, 4, 1, "full")
    assert json.loads(lake.get("1")) == {"id": 1, "n": "last"} and lake.get("#a.jsonl:5") == "5" and lake.get("9") is None
    one = Lake(spark, f"file://{tmp_path}/a.jsonl")
    assert one.index(["id"]).keys == 4 and one.get("#5") == "5"
    (tmp_path / "b.jsonl").write_text("1\n2\n3\n4\n5\n")
    assert lake.index(["id"], ["n"]).keys == 9 and lake.get("#b.jsonl:5") == "5"


def test_splits_and_bom(spark, tmp_path):
    text = "".join(f'{{"id":{i},"t":"{"ü" * (i % 7)}"}}\n' + ("\n" if i % 5 == 0 else "") for i in range(3000))
    lake = Lake(spark, folder(tmp_path, a=text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = lake.rows().orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    data = text.encode()
    assert [r.line_no for r in rows] == list(range(1, 3001))
    assert all(data[r.offset :].startswith(r.body.encode()) for r in rows)
    (tmp_path / "b.jsonl").write_bytes(b"\xef\xbb\xbf" + b'{"id":1}\n{"id":2}\n')
    marked = [r for r in lake.rows([f"file://{tmp_path}/b.jsonl"]).orderBy("line_no").collect()]
    assert [r.offset for r in marked] == [3, 12]


def test_strict(spark):
    bad = ['{"a":1} x', '{"a":1}{"b":2}', "[1,2] ,", "1,2", "1] x", "NaN", "{'a':1}", '{"a":01}', ""]
    good = ["null", "true", '"s"', "5", "{}", "[]", '{"a":1,"a":2}']
    got = {r.body: r.valid for r in bodies(spark, *bad, *good).collect()}
    assert [b for b in bad if got[b]] == [] and [g for g in good if not got[g]] == []


def test_mixed(spark):
    rows = bodies(spark, *('{"v":%s}' % x for x in ("1", "1.0", "true", '"1"', "null", "[1]", '{"x":2}')), "{}")
    s = {r.path: r for r in pr.field_stats(rows, depth=2).collect()}
    v = s["v"]
    assert (v.present, v.non_null, v.distinct_n, v.min_v, v.max_v, v.is_array) == (6, 5, 2, "1", "1", 1)
    assert v.json_types == {"integer": 1, "real": 1, "true": 1, "text": 1, "null": 1, "array": 1}
    assert [(t.value, t["count"]) for t in v.top_values] == [("1", 3), ("1", 1)]
    assert s["v.x"].json_types == {"integer": 1} and set(s) == {"v", "v.x"}


def test_nested(spark):
    rows = bodies(spark, '{"id":1,"a":{"b":{"c":[1,2]},"_v":true,"x y":"q"},"e":{},"n":null,"f":1.0,"t":["p",null,{"z":1}]}')
    assert nesting(rows) == 3 and nesting(bodies(spark, '{"a":{"b":[{"c":{"d":1}}]}}')) == 2 and nesting(bodies(spark, '{"a":1}', '{"a":{"b":1}}')) == 6
    assert {r.path for r in pr.summary(nodes(rows, 3)).collect()} == {"id", "a.b.c", "a._v", 'a."x y"', "n", "f", "t"}
    t = pr.element_stats(rows, "t").first()
    assert (t["count"], t.distinct, t.avg_per_row) == (3, 1, 3.0) and [(x.value, x.n) for x in t.top] == [(None, 1), ("p", 1)]
    deep = bodies(spark, '{"a":' * 8 + "1" + "}" * 8, '{"A":1,"a":2}', '{"b.c":1}', '{"k[0]":1}')
    assert {r.path for r in pr.summary(nodes(deep)).collect()} == {"A", "a", '"b.c"'}
    assert pr.profile(bodies(spark, '{"a":1,"b":1,"c":1}', '{"a":1}', "x"), most=2).truncated == 1


def test_long_values(spark):
    long = "x" * 500
    rows = bodies(spark, json.dumps({"t": long}), json.dumps({"t": long}), json.dumps({"t": "y" * 300}), json.dumps({"t": "z"}))
    r = pr.field_stats(rows, depth=1).first()
    assert r.distinct_n == 3 and r.max_v == "z" and r.len_max == 500 and [(t.value, t["count"]) for t in r.top_values][0] == (long, 2)


def test_keys_and_facets(spark):
    rows = bodies(spark, '{"a":1,"b":null,"f":"x"}', '{"a":1,"b":2,"f":""}', '{"a":1,"b":2,"f":null}', '{"a":true,"b":1.0,"a.b":"q"}', '{"a":{"b":7}}')
    got = {r.pk: r for r in ix.last_of_each(ix.keyed(rows, ["a", "b"], ["f"])).collect()}
    assert set(got) == {"#1", "1:2", "1:1.0", "#5"} and got["1:2"].line_no == 3
    facets = {(r.value, r.n) for r in ix.facet_counts(ix.last_of_each(ix.keyed(rows, ["line"], ["f"])), "f").collect()}
    assert facets == {("x", 1), ("", 1), (None, 3)}
    assert {(r.value, r.n) for r in ix.facet_counts(ix.keyed(rows, ["line"], ["a.b"]), "a.b").collect()} == {("7", 1), (None, 4)}
    with pytest.raises(ValueError):
        ix.keyed(rows, ["a'b"])


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("BroadcastHashJoin", "SortMergeJoin") if name in plan]


def test_fetch_by_facet_broadcasts_no_log(spark):
    rows = bodies(spark, '{"id":1,"f":"x"}', '{"id":2,"f":"y"}', '{"id":1,"f":"y"}', "no", '{"id":3,"f":"x"}')
    index = ix.last_of_each(ix.keyed(rows, ["id"], ["f"]))
    got = ix.fetch(index, rows, F.col("attrs")["f"] == "y").select("pk", "line_no", "body")
    assert sorted(got.collect()) == [("1", 3, '{"id":1,"f":"y"}'), ("2", 2, '{"id":2,"f":"y"}')]
    assert joins_of(got) == ["SortMergeJoin"]


def test_lookup_broadcasts_no_log(spark):
    rows = bodies(spark, '{"id":7}', '{"id":8}', '{"id":7,"n":1}', '{"id":42}')
    got = ix.fetch(ix.last_of_each(ix.keyed(rows, ["id"])), rows, F.col("pk").isin("7", "42")).select("pk", "body")
    assert sorted(got.collect()) == [("42", '{"id":42}'), ("7", '{"id":7,"n":1}')]
    assert joins_of(got) == ["SortMergeJoin"]


def test_write_and_tokens(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/out")
    df = spark.createDataFrame([("1", "alpha", 1), ("2", "beta", 2), ("2", "other", 3)], "id string, name string, at int")
    meta = lake.write(df, token="id", order=["at"])
    assert meta.rows == 2 and meta.completed and lake.state.fresh() and lake.contains_token("2") and not lake.contains_token("9")
    assert {json.loads(r.body)["name"] for r in lake.read().collect()} == {"alpha", "beta"}
    meta = lake.write(spark.createDataFrame([("2", "late", 4), ("3", "gamma", 5)], df.schema), mode="A", token="id", order=["at"], note="x")
    assert meta.rows == 3 and meta.context == {"note": "x"} and meta.bytes == sum(len(r.body) + 1 for r in lake.read().collect())
    (tmp_path / "out" / "more.jsonl").write_text("{}\n")
    assert not lake.state.fresh()
    assert lake.write(df.where("at = 1").withColumn("name", F.lit(None).cast("string")), sparse=True).rows == 1
    assert [r.body for r in lake.read().collect()] == ['{"id":"1","at":1}']
    with pytest.raises(ValueError):
        lake.write(df, mode="x")
    with lake.lock(), pytest.raises(RuntimeError):
        lake.write(df)


def test_gzip(spark, tmp_path):
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"id":10,"name":"gamma"}\n{"id":11,"name":"delta"}\n'))
    lake = Lake(spark, f"file://{tmp_path}")
    assert [r.line_no for r in lake.rows().orderBy("line_no").collect()] == [1, 2]
    lake.index()
    assert json.loads(lake.get("11"))["name"] == "delta"


def test_growth(spark, tmp_path):
    lake = Lake(spark, folder(tmp_path, a='{"id":1,"v":1}\n{"id":2,"v":1}\n'))
    assert lake.index().mode == "full" and lake.key_count() == 2
    folder(tmp_path, b='{"id":2,"v":2}\n{"id":3,"v":2}\n')
    lake.state.mark_complete()
    lake.profile()
    got = lake.index()
    assert (got.mode, got.rows, got.keys) == ("incremental", 4, 3) and json.loads(lake.get("2"))["v"] == 2
    assert lake.index().rows == 4 and lake.index(["id"], ["v"]).mode == "full"
    folder(tmp_path, a='{"id":9,"v":9}\n{"id":8,"v":9}\n')
    got = lake.index(["id"], ["v"])
    assert (got.mode, got.keys) == ("full", 4) and lake.get("1") is None
    assert {(r.value, r.n) for r in lake.facet_counts("v").collect()} == {("9", 2), ("2", 2)}
    assert lake.where(F.col("attrs")["v"] == "9").count() == 2


def test_browse_and_cache(spark, tmp_path):
    lake = Lake(spark, folder(tmp_path, a='{"id":1,"a":{"b":"x"},"t":[1]}\n{"id":2,"a":{"b":"y"}}\n'))
    rows = lake.browse("v_rows").orderBy("line_no").collect()
    assert [(r["id"], r["a.b"]) for r in rows] == [("1", "x"), ("2", "y")] and "t" not in rows[0].asDict()
    assert spark.sql("select count(*) from v_rows where `a.b` = 'y'").first()[0] == 1
    assert lake.keep_rows().count() == 2 and lake.has_cache() and lake.vacuum() and not lake.has_cache() and lake.stats() is not None


def test_tail(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'{"id":1}\n{"id":2}\n{"id":')
    spark.dataSource.register(TailSource)
    got = spark.read.format("linelake_tail").option("path", str(path)).option("start", "9").option("end", str(path.stat().st_size)).load()
    assert [(r.offset, r.line) for r in got.collect()] == [(9, '{"id":2}')]


def test_streaming_adds_up(spark, tmp_path, monkeypatch):
    data = tmp_path / "in"
    data.mkdir()
    p = IncrementalProfile(spark, f"file://{data}", f"file://{tmp_path}/out", depth=1)
    (data / "1.jsonl").write_text('{"a":1,"b":"x"}\n{"a":2,"b":"x"}\n')
    p.run().awaitTermination()
    (data / "2.jsonl").write_text('{"a":2,"b":"y"}\nbad\n')
    p.run().awaitTermination()
    p.run().awaitTermination()
    monkeypatch.setattr(incremental, "DELTAS", 3)
    (data / "3.jsonl").write_text('{"b":null}\n{"a":true}\n')
    p.run().awaitTermination()
    assert len(files.read_json(spark, f"file://{tmp_path}/out/current.json")["names"]) == 1
    whole = pr.value_counts(nodes(bodies(spark, '{"a":1,"b":"x"}', '{"a":2,"b":"x"}', '{"a":2,"b":"y"}', '{"a":true}'), 1))
    assert {(r.path, r.json_type, r.n) for r in p.counts("types").collect()} == {("a", "integer", 3), ("a", "true", 1), ("b", "text", 3), ("b", "null", 1)}
    key = lambda df: sorted((r.path, r.key, r.n) for r in df.collect())
    assert key(p.counts()) == key(whole)


def test_legacy(spark):
    rows = bodies(spark, *('{"v":%s}' % x for x in ("1", '"1"', "true", "1.0", "false", '""', "null")), '{"w":"The cat of the house is in the garden"}')
    found = nodes(rows, 1)
    old = {r.path: r for r in legacy.text_stats(found).collect()}["v"]
    assert (old.total, old.nulls, old.distinct, old.len_max) == (7, 1, 2, 1)
    pushed = {r.path: r for r in legacy.text_stats(found, pushed=True).collect()}["v"]
    assert (pushed.total, pushed.nulls, pushed.distinct) == (5, 2, 2)
    words = found.where("json_type = 'text'").select("path", F.lit(1).alias("at"), F.col("atom.txt").alias("s"))
    guess = {r.path: r for r in legacy.sampled_hints(words).collect()}["w"]
    assert guess.natural_language_like and guess.locale == "en"
    doc = legacy.document("x", 8, [r.asDict(recursive=True) for r in pr.field_stats(rows, depth=1).collect()])
    assert doc["fields"]["v"]["nulls"] == 1 and doc["fields"]["w"]["storageHint"] == "string" and legacy.short("x" * 50) == "x" * 39 + "…"


def test_legacy_arrays(spark):
    rows = bodies(spark, '{"a":[1,"1",true,1.0,null,"",false,"käse",[2],{"x":1}],"s":"x"}', '{"a":[],"o":{"k":2.5}}', '{"a":null,"o":{}}', '{"a":"text"}', "[]")
    got = {r.path: r for r in legacy.array_stats(rows).collect()}
    a, o = got["a"], got["o"]
    assert set(got) == {"a", "o"}
    assert (a.arrays, a.elements, a.elem_distinct, a.elem_capped) == (2, 10, 3, False)  # 1, the empty text, käse
    assert (a.elem_len_min, a.elem_len_max, a.elem_len_avg) == (0, 5, 2.0) and a.elem_types == ["int", "float", "bool", "string", "array", "other"]
    assert (o.arrays, o.elements, o.elem_types, o.elem_len_avg, o.elem_distinct) == (2, 1, ["float"], None, 1)
    assert not legacy.array_stats(bodies(spark)).collect()
    doc = legacy.legacy_field({"json_types": {"array": 1}, "top_values": [], "present": 1, "non_null": 1, "distinct_n": 0, "min_v": None, "max_v": None, "len_min": None, "len_max": None, "len_avg": None,
                               "is_array": 1, "url_like": False, "image_like": False, "natural_language_like": False, "elements": {"count": 3, "distinct": 2, "avg_per_row": 1.5}})
    assert doc["arrayStats"] == {"elements": 3, "elemDistinct": 2, "avgPerRow": 1.5}


def test_older_hints(spark):
    rows = bodies(spark, *('{"logic":%s,"word":"%s","number":%s,"mixed":%s}' % x for x in (("true", "Yes", "1", "true"), ("null", " no ", "0", '"Y"'), ("false", "", "1", '"maybe"'))))
    assert {r.path: r.boolean_like for r in legacy.boolean_fields(nodes(rows, 1)).collect()} == {"logic": True, "word": True, "number": False, "mixed": False}
    names = ["a b.PNG", "https://x.org/a.jpg?y=1", "https://x.org/a.html", "photo.gif#top", "https://x.jpg", "jpg", "", None, "a.png/b"]
    found = spark.createDataFrame([(n,) for n in names], "s string").select(hints.is_image_name(F.col("s")).alias("x")).collect()
    assert [r.x for r in found] == [True, True, False, True, True, False, False, False, False]
    values = spark.createDataFrame([(p, "a; b; c") for p in "pq"], "path string, s string")
    split = {r.path: (r.enabled, r.delimiter) for r in legacy.split_candidates(values, disabled=["q"]).collect()}
    assert split == {"p": (True, ";"), "q": (False, None)}


def test_commands(spark, tmp_path, capsys):
    path = folder(tmp_path, a='{"id":1,"k":"x"}\n{"id":2,"k":"y"}\n', b="{}\n")
    for args in (["count", path], ["index", path, "--facet", "k"], ["profile", path], ["info", path], ["state", path, "--ensure", "-j"], ["vacuum", path], ["clean", path, "--dry-run"]):
        assert main(args, spark) == 0
    said = capsys.readouterr().out
    assert "TOTAL" in said and '"keys": 3' in said and "nothing to drop" in said
    assert main(["info", path + "/none"], spark) == 2
    (tmp_path / "old.sidecar.json").write_text("{}")
    assert main(["clean", path], spark) == 0 and not files.exists(spark, path + "/old.sidecar.json")


def test_counts_by_whole_path(spark, tmp_path, capsys):
    for name, text in (("a", "{}\n{}\n{}\n"), ("b", "{}\n\n{}"), ("c d", "{}\n" * 5)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text(text)
    assert main(["count", f"file://{tmp_path}", "-r"], spark) == 0
    assert [line.split(None, 1)[0] for line in capsys.readouterr().out.splitlines()] == ["5", "3", "2", "10"]


def test_documents_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    for n in range(3):
        files.write_json(spark, path, {"n": n})
        assert files.read_json(spark, path) == {"n": n}
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_tables_as_logs(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(r.body for r in log_of(df).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert '{"a":1}' in {r.body for r in log_of(df, keep_nulls=False).collect()}
