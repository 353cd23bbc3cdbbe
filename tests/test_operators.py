import itertools
import json

import pytest
from pyspark.sql import functions as F

from skein import sources, streaming
import skein.plans  # noqa: F401
from skein.catalogue import QUERIES
from skein.functions import kappa, normal_phrase
from skein.operators import contracts, exact, gates, joins, packaging, ranks, resample


def test_auc_equals_counting_pairs(spark):
    data = [(i % 7, int(i % 3 == 0)) for i in range(40)]
    got = ranks.auc(spark.createDataFrame(data, "s int, y int"), "s", "y").first().auc
    pairs = [(a > b) + 0.5 * (a == b) for (a, y), (b, z) in itertools.product(data, data) if y == 1 and z == 0]
    assert abs(got - sum(pairs) / len(pairs)) < 1e-12
    assert ranks.auc(spark.createDataFrame([(1, 1)], "s int, y int"), "s", "y").first().auc is None


def test_exact_tails():
    assert abs(exact.fisher_exact(8, 2, 1, 5) - 0.03497) < 1e-4
    assert abs(exact.hypergeometric_sf(1, 10, 3, 2) - (1 - 21 / 45)) < 1e-12
    low, high = exact.poisson_interval(10)
    assert abs(low - 4.795) < 1e-3 and abs(high - 18.390) < 1e-3 and exact.poisson_interval(0)[0] == 0
    assert abs(exact.two_sided_normal(1.959963985) - 0.05) < 1e-9


def test_bootstrap_is_near_the_closed_form(spark, sf):
    df = spark.range(400).select(F.col("id").alias("c"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    draws = resample.weighted(df, "c", {"y": F.col("y"), "n": F.lit(1)}, 800).withColumn("m", F.col("y") / F.col("n"))
    x = resample.interval(draws, "m").first()
    assert abs(x["mean"] - 0.25) < 0.005 and abs((x.high - x.low) / 2 - 1.96 * (0.25 * 0.75 / 400) ** 0.5) < 0.008
    assert QUERIES["sta_bootstrap"](spark, sf).first().defined == 1000


def test_joins(spark):
    right = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, o int")
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert {r.k: r.v for r in joins.lookup(left, right, "k", "v", "o", "-").collect()} == {1: "b", 2: "-"}
    with pytest.raises(ValueError):
        joins.many_to_one(left, right, ["k"])
    s = spark.createDataFrame([(1, 1, 6, 12)], "g int, id int, s int, e int")
    t = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 14, 19)], "g int, t_id int, t_s int, t_e int")
    assert joins.nearest(s, t, ["g"], False).first().tie and joins.nearest(s, t, ["g"], True).first().t_id == 2


def test_gates_refuse_to_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, " "), (2, None)], "k int, v string")
    bad = gates.all_rules(gates.row_rules(df, {"blank": gates.blank("v")}), gates.repeated(df, ["k"], "unique"))
    assert {r.rule: r.violations for r in bad.collect()} == {"blank": 2, "unique": 1}
    with pytest.raises(gates.GateError):
        gates.write_gated(df, bad, str(tmp_path / "x"))
    gates.write_gated(df, bad.where("false"), str(tmp_path / "x"))
    assert gates.missing_columns(df, ["k", "z"]) == ["z"]


def test_contract(spark):
    ok = json.dumps({"findings": [{"concept_id": "a", "assertion": "present"}]})
    assert contracts.parse_output(ok, {"a"}) == ([("a", "present")], None)
    bad = {"": "not_json", "[]": "keys", '{"findings":1}': "not_a_list", '{"findings":[{"concept_id":"a"}]}': "finding_keys", ok.replace("present", "x"): "assertion", ok.replace('"a"', '"b"'): "inventory"}
    assert {k: contracts.parse_output(k, {"a"})[1] for k in bad} == bad
    rows = spark.createDataFrame([(ok,), (None,)], "raw string").select(contracts.parsed({"a"})(F.col("raw")).alias("x")).collect()
    assert [r.x.ok for r in rows] == [True, False]
    assert contracts.stop_early([True] * 5 + [False] * 3) and not contracts.stop_early([True] * 7)

    class Upper:
        name = "upper"

        def run(self, texts):
            return [t.upper() for t in texts]

    assert contracts.apply_adapter(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", Upper()).first().output == "A"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,v\n1,None\n2,\n", encoding="utf-8")
    df = sources.read_csv(spark, str(tmp_path / "a.csv"), literal_none=True)
    assert df.columns == ["id", "v"] and [r.v for r in df.orderBy("id").collect()] == ["None", ""]
    (tmp_path / "b.csv").write_text("x\n1\n")
    both, skipped = sources.read_tolerant(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "no.csv")], "id")
    assert both.count() == 2 and len(skipped) == 2
    (tmp_path / "ids.txt").write_text("p/q/a\nb\n\n")
    assert sorted(r.id for r in sources.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    at = str(tmp_path / "t")
    sources.write_parquet(spark.range(3), at)
    sources.rewrite(spark, at, lambda x: x.where("id > 0"))
    assert spark.read.parquet(at).count() == 2
    sources.write_jsonl_once(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":null,"b":1}'
    with pytest.raises(Exception):
        sources.write_jsonl_once(spark.range(1).toDF("b"), str(tmp_path / "j"))
    assert packaging.records_hash([{"b": 1, "a": 2}]) == packaging.records_hash([{"a": 2, "b": 1}])


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    q = streaming.phrase_counts(spark, str(tmp_path / "in"), "doc_id long, text string").writeStream.outputMode("complete").format("memory").queryName("phrases").start()
    q.processAllAvailable()
    q.stop()
    want = docs.select(F.explode(F.split("text", r"\n+|\. ")).alias("p")).select(normal_phrase(F.col("p")).alias("phrase")).where("phrase <> ''").groupBy("phrase").count()
    assert sorted(map(tuple, spark.table("phrases").collect())) == sorted(map(tuple, want.collect()))


def test_undefined_kappa_is_null_or_the_value_given(spark):
    x = spark.createDataFrame([(5, 0, 0, 0)], "tp int, fp int, fn int, tn int")
    c = [F.col(k) for k in ("tp", "fp", "fn", "tn")]
    assert x.select(kappa(*c).alias("a"), kappa(*c, undefined=0.0).alias("b")).first() == (None, 0.0)
