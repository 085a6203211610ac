"""Lines of the nested layout: expected ones go straight into typed columns, odd ones through VARIANT, with the same rules."""

import glob
import json
import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill import queries, queries_cases  # noqa: F401 - the registry comes first
from lexmill.functions.columns import article_labels
from lexmill.sources import jsonl, sinks

P = {"death_penalty": False, "life_imprisonment": False, "imprisonment": 0, "detention": 0, "surveillance": 0}
#: final_penalty, the only judgment's penalty, (type, months, fallback)
CASES = [
    (P | {"imprisonment": 7}, None, ("fixed_term", 7, None)),
    (P, {"imprisonment": 3}, ("exempt", None, None)),
    (P | {"death_penalty": True, "imprisonment": -4}, None, ("death", None, None)),
    (P | {"life_imprisonment": True}, None, ("life", None, None)),
    ({"detention": 2, "imprisonment": None}, None, ("detention", None, None)),
    ({"surveillance": 2}, None, ("control", None, None)),
    ({"imprisonment": 3_000_000_000, "detention": 1}, None, ("detention", None, None)),
    ({"imprisonment": -3_000_000_000, "detention": 1}, None, ("detention", None, None)),
    ({}, {"imprisonment": 9}, ("fixed_term", 9, "unusable_final_penalty_fallback")),
    (None, {"imprisonment": 9}, ("fixed_term", 9, None)),
    ({"death_penalty": None, "imprisonment": 9}, P | {"imprisonment": 5}, ("fixed_term", 5, "unusable_final_penalty_fallback")),
    ("", {"imprisonment": 9}, ("fixed_term", 9, "unusable_final_penalty_fallback")),
    ({"imprisonment": "9"}, {"detention": 4}, ("detention", None, "unusable_final_penalty_fallback")),
    ({"imprisonment": "", "detention": 4}, None, ("detention", None, None)),
    ({"imprisonment": 9.5}, P | {"death_penalty": "true"}, ("unknown", None, None)),
    (P | {"death_penalty": 1}, {"surveillance": 1}, ("control", None, "unusable_final_penalty_fallback")),
    ([1], {"surveillance": 1}, ("control", None, "unusable_final_penalty_fallback")),
]


def cases(spark, lines):
    src = spark.createDataFrame([("f", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "path string, line_no long, value string")
    return jsonl.joint_cases(src, "train")


def test_penalties_of_any_kind(spark):
    lines = [{"fact": str(i), "outcomes": [{"name": "a", "judgment": [{"accusation": "x", "article": [264, "0025-1"], "penalty": own}], "final_penalty": final}]} for i, (final, own, _) in enumerate(CASES)]
    got = {int(r.fact_raw): r for r in cases(spark, lines).collect()}
    assert [(got[i].penalty_type, got[i].imprisonment_months, got[i].penalty_fallback) for i in range(len(CASES))] == [c[2] for c in CASES]
    assert {tuple(r.conviction_articles) for r in got.values()} == {("criminal_law:264", "criminal_law:25:1")}


def test_odd_lines(spark):
    one = {"name": "a", "judgment": [{"accusation": "x", "article": [1]}]}
    lines = [{"fact": "many", "outcomes": [one | {"name": f"n{i}"} for i in range(1002)]}, {"fact": "none", "outcomes": None}, {"fact": "no", "x": 1}, {"fact": 1.50, "outcomes": [one]}, "[1]"]
    rows = cases(spark, lines).collect()
    assert len(rows) == 1003 and {r.fact_raw for r in rows} == {"many", "1.5"}
    assert {r.case_id.rpartition("-d")[2] for r in rows} >= {"000", "099", "999", "1001"}
    for bad in ({"outcomes": 5}, {"outcomes": ["y"]}, "{'outcomes': []}", "{broken", {"outcomes": [one | {"final_penalty": {"imprisonment": -1}}]}):
        with pytest.raises(Exception):
            cases(spark, [bad]).collect()


def test_lines_are_parsed_once(spark):
    """No filter is inferred that parses every line once more below."""
    plan = cases(spark, [{"fact": "f", "outcomes": []}]).select("penalty_type", F.size("charges"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_lines_of_the_query_take_little_disk(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines")
    monkeypatch.setattr(queries_cases, "folder", lambda spark: path)
    queries_cases.s03(spark, "/root/testdata/sf0.001")
    stored = sum(os.path.getsize(f) for f in glob.glob(f"{path}/*"))
    assert 0 < stored < spark.read.text(path).agg(F.sum(F.length("value"))).first()[0] / 10


def test_compressed_files_hold_few_lines(spark, tmp_path):
    n = sinks.write_json_lines(spark.range(35).coalesce(1), str(tmp_path / "j"), compressed=True, most=10)
    got = jsonl.lines(spark, str(tmp_path / "j"))
    assert n == 35 and got.rdd.getNumPartitions() == 4
    assert sorted(r.line_no for r in got.collect()) == sorted([*range(1, 11)] * 3 + [*range(1, 6)])


def test_generated_methods_are_compiled(spark):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    plan = cases(spark, [{"fact": "f", "outcomes": []}])._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_labels_of_plain_and_other_articles(spark):
    given = [["264", "25"], ["264", "0025-1", "264"], ["7", " 7 "], [], None, ["9" * 30]]
    want = [["l:264", "l:25"], ["l:264", "l:25:1"], ["l:7"], [], None, ["l:" + "9" * 30]]
    df = spark.createDataFrame([(x,) for x in given], "a array<string>")
    assert [r[0] for r in df.select(article_labels("a", "l")).collect()] == want
    for bad in (["1,2"], ["1", None], ["1\n,2"], ["0"], [""]):
        with pytest.raises(Exception, match="invalid article label|USER_RAISED"):
            spark.createDataFrame([(bad,)], "a array<string>").select(article_labels("a", "l")).collect()


def test_judgments_of_any_number_and_empty_charges(spark):
    j = lambda standard, said: {"standard_accusation": standard, "accusation": said, "article": ["1"]}
    given = [[j("", "a罪")], [j(None, "a"), j("b罪", "c")], [j("", "罪"), j("", "a")], [j("", f"{i}罪") for i in range(4)], [j(None, None), j("", ""), j("x", "")]]
    got = {int(r.fact_raw): r.charges for r in cases(spark, [{"fact": str(i), "outcomes": [{"name": "n", "judgment": x}]} for i, x in enumerate(given)]).collect()}
    assert [got[i] for i in range(len(given))] == [["a"], ["a", "b"], ["a"], ["0", "1", "2", "3"], ["x"]]


GOOD = json.dumps({"fact": "f", "more": 1.5, "defendants": ["a"], "outcomes": [{"name": "a", "judgment": [{"accusation": "x罪", "article": ["1"], "penalty": P}], "final_penalty": None}]})


def batch(lines):
    return pa.RecordBatch.from_arrays([pa.array(["f"] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["path", "line_no", "value"])


def test_expected_lines_are_typed_by_arrow():
    lines = [GOOD] * 1500 + ['{"fact":1}'] + [GOOD] * 1500
    out = pa.Table.from_batches(jsonl._typed(iter([batch(lines)])))
    assert out["line_no"].to_pylist() == list(range(3001)) and out["value"][1500].as_py() == '{"fact":1}'
    assert len(out) - 128 <= out["value"].null_count < len(out)
    first = json.loads(GOOD)
    assert out["outcomes"][0].as_py() == [{"name": "a", "judgment": [first["outcomes"][0]["judgment"][0] | {"standard_accusation": None}], "final_penalty": None}]


@pytest.mark.parametrize("odd", ['{"fact":"a"}{"fact":"b"}', "", " ", None, '{"x":NaN}', '{"x":-Inf}', '{"fact":1}', "[1]", '{"fact":"a","fact":"b"}', '{"outcomes":[{"final_penalty":{"death_penalty":null}}]}', '{"fact":"a"', '{"outcomes":[{"final_penalty":{"detention":1.0}}]}'])
def test_other_lines_are_left_to_spark(odd):
    for lines in ([odd], [GOOD, odd], [odd, '{"fact":"a"}{"fact":"b"}', GOOD]):
        assert jsonl._plain(batch(lines).column(2)) is None


def test_both_ways_give_the_same_cases(spark):
    """A null flag sends every line of a batch the way over Spark's reader."""
    some = [{"fact": f"{i}\"\\一\U0001f600", "outcomes": [{"name": f"n{i}", "judgment": [{"standard_accusation": s, "accusation": "c罪", "article": a, "penalty": P | {"imprisonment": i}}] * k, "final_penalty": p}]}
            for i, (s, a, k, p) in enumerate([("a罪", ["1"], 1, None), (None, None, 2, P), ("", ["2", "3"], 3, P | {"imprisonment": 5}), ("b", [], 1, {})])]
    odd = {"fact": "odd", "outcomes": [{"name": "n", "judgment": [{"accusation": "c"}], "final_penalty": {"death_penalty": None}}]}
    rows = lambda lines: [r.asDict() | {"source_path": ""} for r in sorted(cases(spark, lines).collect(), key=lambda r: r.fact_raw) if r.fact_raw != "odd"]
    alone, mixed = (batch([json.dumps(x) for x in lines]).column(2) for lines in (some, [*some, odd]))
    assert jsonl._plain(alone) is not None and jsonl._plain(mixed) is None
    assert len(rows(some)) == 4 and rows(some) == rows([x for s in some for x in (s, odd)])
