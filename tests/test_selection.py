"""Quantiles by selection, JSON arrays by ranges, the bucketed lookup."""

import json
import math
import random
import struct

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from prooflake.operators import ingest, quantiles
from prooflake.sources import files, json_arrays


def test_image_has_the_order_of_doubles(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    values += [math.nextafter(2.0**k, 0) for k in range(-1021, 1024)] + [2.0**k for k in range(-1022, 1024)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.image(F.col("v")).alias("i")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.i == ((1 << 63) - 1 if math.isnan(r.v) else -bits if r.v < 0 else bits), r.v


@pytest.mark.parametrize("small", [0, 3, 10_000])
def test_quantiles_equal_sorting(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=501), "near": 1 + rng.integers(0, 5, 400) * 2.0**-52, "one": np.array([7.5]), "two": np.array([-1.0, 4.0]), "hot": np.array([3.0] * 500 + [9.0]), "wide": 10.0 ** rng.uniform(-300, 300, 300), None: rng.normal(size=9)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, shares), rtol=1e-12, atol=0), g


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.quantiles(df, [], "v", [0.5, 0.1]).first().q == [500.0, 100.0]
    assert quantiles.quantiles(df.where("false"), [], "v", [0.5]).collect() == []
    plan = quantiles.quantiles(df, [], "v", [0.5])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan


# -- JSON arrays ---------------------------------------------------------------------------------------------------------------

SCHEMA = "k int, t string, x struct<a:array<struct<b:string>>,c:string>, z array<int>"


def record(k, rng):
    letters = ['"', "\\", "{", "}", "[", "]", ",", "é", "🙂", "\n", "a", "\\\\", '\\"', " "]
    word = lambda n: "".join(rng.choices(letters, k=rng.randint(0, n)))
    return {"k": k, "t": word(40), "x": {"a": [{"b": word(9)} for _ in range(rng.randint(0, 3))], "c": None if k % 5 == 0 else word(300 if k % 17 == 0 else 5)}, "z": [1, 2][: k % 3]}


@pytest.mark.parametrize("size", ["64b", "997b", "1m"])
def test_json_arrays_by_ranges_equal_whole_files(spark, tmp_path, size):
    rng = random.Random(3)
    texts = [json.dumps([record(k, rng) for k in range(120)], ensure_ascii=False), json.dumps([record(k, rng) for k in range(120, 150)], indent=2), "[]", " [ ] \n", json.dumps([record(150, rng)])]
    for k, text in enumerate(texts):
        (tmp_path / f"part{k}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = json_arrays.read(spark, str(tmp_path), SCHEMA, "ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = [dict(r, ordinal=k) for text in texts for k, r in enumerate(json.loads(text))]
    assert sorted((r.asDict(recursive=True) for r in got), key=lambda r: r["k"]) == wanted
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(str(r) for r in json_arrays.read(spark, str(tmp_path), SCHEMA).collect())


def test_json_arrays_that_break_are_errors(spark, tmp_path):
    for name, text in (("open", '[{"k": 1}, {"k": 2, "t": "x'), ("wrong", '[{"k": 1}, {"k": "no number"}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(text)
        with pytest.raises((SparkRuntimeException, Py4JJavaError)):
            json_arrays.read(spark, str(tmp_path / name), SCHEMA).collect()


def test_json_arrays_round_trip(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([record(k, rng) for k in range(300)], SCHEMA).repartition(7)
    json_arrays.write(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 7 and all(isinstance(json.loads(f.read_text()), list) for f in (tmp_path / "out").glob("part-*"))
    assert sorted(map(str, json_arrays.read(spark, str(tmp_path / "out"), SCHEMA).collect())) == sorted(map(str, df.collect()))


# -- lookup --------------------------------------------------------------------------------------------------------------------


def numbered(spark, n):
    sentences = spark.range(n).select(F.concat(F.lit("page_"), F.col("id").cast("string")).alias("page_id"), (F.col("id") % 3).cast("int").alias("sent_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    refs = spark.range(n).select("id", F.replace(F.concat(F.lit("page_"), F.col("id").cast("string")), F.lit("_"), F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise(F.lit("_"))).alias("url"), (F.col("id") % 3).cast("int").alias("sent_id"))
    return sentences, refs


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_references_keep_their_text_however_they_are_dealt(spark, threshold):
    sentences, refs = numbered(spark, 20_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for given in (refs, refs.repartition(8), refs.repartition(3, "url").union(refs)):
            found = ingest.resolve_references(given, sentences)
            assert found.where(~F.col("text").eqNullSafe(F.concat(F.lit("text of "), F.col("id").cast("string")))).count() == 0
            assert found.count() == given.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_scan(plan, name):
    """Whether an exchange stands between the scan of a table and the join that it feeds; depth is where a line's text begins."""
    above = []
    for line in plan.splitlines():
        text = line.lstrip(" :+-*(0123456789)")
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, t) for d, t in above if d < depth]
        if "FileScan" in text and name in text:
            for _, t in reversed(above):
                if "Join" in t:
                    return False
                if "Exchange" in t:
                    return True
        above.append((depth, text))
    raise AssertionError(f"no joined scan of {name}")


def test_bucketed_lookup_is_read_in_place(spark, tmp_path):
    sentences, refs = numbered(spark, 3000)
    path = str(tmp_path / "lookup")
    files.write_lookup(sentences, path, 8)
    lookup = files.open_lookup(spark, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = ingest.resolve_references(refs.repartition(3), *lookup)
        plan = found._jdf.queryExecution().executedPlan().toString()
        for name in ("sentences", "pages"):
            assert not shuffled_scan(plan, files._name(f"{path}/{name}")), plan
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ingest.resolve_references(refs, sentences).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # another session knows only the path
    for name in ("sentences", "pages"):
        spark.sql(f"DROP TABLE {files._name(f'{path}/{name}')}")
    again = files.open_lookup(spark, path)
    assert again.sentences.count() == 3000 and again.pages.count() == 3000
    files.write_lookup(sentences.where("page_id < 'page_2'"), path, 4)
    assert files.read_lookup(spark, path).count() == sentences.where("page_id < 'page_2'").count()


def test_lists_become_records_at_any_depth(spark, tmp_path):
    kind = "k int, top struct<name:string,mid:array<struct<tag:string,low:struct<a:array<int>,b:array<string>>>>>, flat struct<t:array<string>,n:array<int>>, m map<string,struct<p:array<int>>>, plain array<int>"
    rows = [
        (1, ("x", [("t", ([1, 2], ["one"])), ("u", None)]), (["a"], [5]), {"q": ([7, 8],)}, [1]),
        (2, None, (None, [6]), None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.k: r.asDict(recursive=True) for r in files.lists_as_records(df).collect()}
    assert got[1]["top"]["mid"] == [{"tag": "t", "low": [{"a": 1, "b": "one"}, {"a": 2, "b": None}]}, {"tag": "u", "low": None}]
    assert got[1]["flat"] == [{"t": "a", "n": 5}] and got[1]["m"] == {"q": [{"p": 7}, {"p": 8}]} and got[1]["plain"] == [1]
    assert got[2]["top"] is None and got[2]["flat"] == [{"t": None, "n": 6}] and got[2]["m"] is None
    # nested structs of lists inside structs of lists: three levels
    deep = spark.createDataFrame([(([(["a", "b"], [([1], ["x"]), ([2], ["y"])])],),)], "d struct<l:array<struct<s:array<string>,i:array<struct<v:array<int>,w:array<string>>>>>>")
    wanted = [{"l": [{"s": "a", "i": [{"v": 1, "w": "x"}]}, {"s": "b", "i": [{"v": 2, "w": "y"}]}]}]
    assert files.lists_as_records(deep).first().asDict(recursive=True)["d"] == wanted
    df.write.parquet(str(tmp_path / "set/train"))
    back = files.read_split(spark, str(tmp_path / "set"), "train", records=("flat",))
    assert back.schema["flat"].dataType.simpleString() == "array<struct<t:string,n:int>>" and back.schema["top"] == df.schema["top"]
    assert sorted(r.ordinal for r in back.collect()) == [0, 1]
