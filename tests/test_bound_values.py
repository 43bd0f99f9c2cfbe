"""Values are bound and payloads parsed without work that each row repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersely.functions.scoring import compaction_score, kind_score
from tersely.functions.text import let
from tersely.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_let_binds_a_value_without_an_array_item(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "n long, t string")
    nested = let(
        F.col("t"),
        lambda t: F.struct(
            let(F.concat(t, t), lambda tt: F.concat(t, F.lit("-"), tt)).alias("own"),
            F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: let(i * 10, lambda j: i + j)).alias("sums"),
            t.isNull().alias("none"),
        ),
    )
    bound = docs.select("n", nested.alias("v"))
    found = {r.n: (r.v.own, r.v.sums, r.v.none) for r in bound.collect()}
    assert found == {1: ("ab-abab", [11], False), 2: (None, [11, 22], True)}
    assert "transform(array(" not in plan_of(bound)


def test_payload_is_parsed_once(spark, tmp_path):
    props = ['{"k": 1}', "", None, "two\nlines", '{"a":{"b":[1,2,3]},"c":"x\\ny"}']
    rows = [(n, "view", p) for n, p in enumerate(props)] + [(9, "error", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(
        str(tmp_path / "events.parquet")
    )
    payload = QUERIES["inspect_payload"](spark, str(tmp_path))
    plan = plan_of(payload)
    assert "get_json_object(payload" not in plan
    assert plan.count("from_json") in (1, 2)  # once for each branch of the union at most
    found = {r.doc_id: r for r in payload.collect()}
    assert found.keys() == {0, 1, 2, 3, 4, 9}
    assert found[0].type == "json" and found[0].bytes == 8 and found[0].output == '{"k": 1}'
    assert found[1].type is None and found[1].output == "" and found[1].bytes == 0
    assert found[2].bytes is None and found[2].tokens_saved is None and found[2].action == "pass-through"
    assert found[3].type == "plain" and found[3].line_end == 2 and found[3].output == "two\nlines"
    assert found[9].action == "transformed" and found[9].tokens_saved > 0


def test_score_of_a_kind_in_any_case(spark):
    row = spark.createDataFrame([('{"a":1}', "JSON")], "t string, k string").select(
        compaction_score(F.col("t"), F.col("k")).alias("any"), kind_score(F.col("t"), F.lower("k")).alias("low")
    )
    assert row.first() == (0.5, 0.5)
