"""Hand-computed values of the text operators, metrics and stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.operators import bootstrap, coverage, dedup, factors, interventions, metrics, redact, splits, store
from lexmill.operators.components import connected, dense_index
from lexmill.sources import jsonl, sinks
from lexmill.streaming.append import append_new


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "int", float: "double", list: "array<string>"}[type(v)]) for k, v in values.items())))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw,want", [("303-2", "criminal_law:303:2"), (" 0234 ", "criminal_law:234"), ("0", None), ("a", None), ("1--2", None), ("293.1/2", "criminal_law:293:1:2")])
def test_article_label(spark, raw, want):
    assert one(spark, C.article_label("v"), v=raw) == want


PENALTIES = [
    ('{"imprisonment":10,"detention":0,"surveillance":0,"death_penalty":false,"life_imprisonment":false}', ("fixed_term", 10)),
    ('{"life_imprisonment":true,"imprisonment":120}', ("life", None)),
    ('{"death_penalty":true,"imprisonment":120}', ("death", None)),
    ('{"detention":3}', ("detention", None)),
    ('{"surveillance":6}', ("control", None)),
    ('{"imprisonment":0,"detention":0,"surveillance":0}', ("exempt", None)),
    ('{"imprisonment":null}', None), ('{"imprisonment":""}', None), ('{"death_penalty":false}', None), ('{"imprisonment":"x"}', None),
    ('{"imprisonment":false,"detention":3}', None), ('{"death_penalty":"no","imprisonment":3}', None), ('""', None), ("null", None), ('{"other":1}', None),
]


@pytest.mark.parametrize("raw,want", PENALTIES)
def test_read_penalty(spark, raw, want):
    got = one(spark, C.read_penalty(F.parse_json("v")), v=raw)
    assert (None if got is None else (got["type"], got["months"])) == want


def test_sentence_bins(spark):
    rows = spark.createDataFrame([("fixed_term", 6.5), ("fixed_term", 6.0), ("fixed_term", None), ("fixed_term", float("nan")), ("life", None), ("x", 1.0), ("fixed_term", 121.0)], "p string, m double")
    assert [r[0] for r in rows.select(C.sentence_class("p", "m")).collect()] == ["fixed_term_7_12", "fixed_term_0_6", "unknown", "unknown", "life", "unknown", "fixed_term_121_plus"]


def test_minhash_equals_numpy(spark):
    a, b = dedup.coefficients()
    text = "乙方盗窃财物价值4450元"
    codes = [ord(c) for c in text]
    hashes = set()
    for i in range(len(codes) - 4):
        h = 0
        for c in codes[i : i + 5]:
            h = (h * 1000003 + c) % ((1 << 31) - 1)
        hashes.add(h)
    want = [min((x * h + y) % ((1 << 31) - 1) for h in hashes) for x, y in zip(a, b)]
    assert dedup.signatures(spark.createDataFrame([(text + "。",)], "text string")).first()["sig"] == want


def test_near_duplicates_cross_splits_only(spark):
    base = "".join(chr(0x4E00 + i * 37 % 6000) for i in range(400))
    docs = [(0, base + "4450", "train"), (1, base + "，4460", "test"), (2, base[::-1], "test"), (3, base[200:] + base[:100], "train")]
    df = spark.createDataFrame(docs, "id int, text string, split string").withColumn("key", C.content_key("text"))
    plan = {r["key"]: (r["assigned"], r["group_id"]) for r in splits.split_plan(df, "d").collect()}
    keys = {r["id"]: r["key"] for r in df.collect()}
    assert plan[keys[0]][0] == "test" and plan[keys[0]][1] == plan[keys[1]][1] != plan[keys[2]][1]
    assert {r["id"] for r in splits.reassign(df, splits.split_plan(df, "d")).collect()} == {1, 2, 3}
    assert plan[keys[3]][0] == "train"


def test_components_and_dense_index(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    assert set(roots.values()) == {1, 100} and len(roots) == 60
    idx = dense_index(spark.range(50), F.col("id") % 4, ["id"]).collect()
    assert sorted(r["idx"] for r in idx) == list(range(50))
    assert [r["id"] for r in sorted(idx, key=lambda r: r["idx"])] == sorted(range(50), key=lambda i: (i % 4, i))


def test_label_metrics(spark):
    rows = spark.createDataFrame([([1, 0], [1, 0]), ([1, 1], [1, 0]), ([0, 1], [0, 1])], "t array<int>, p array<int>")
    m = metrics.label_metrics(metrics.label_counts(rows, "t", "p")).first()
    assert (m.macro_precision, m.macro_recall) == (1.0, 0.75)
    assert m.micro_f1 == pytest.approx(6 / 7) and m.macro_f1 == pytest.approx(5 / 6)
    a = metrics.row_agreement(rows, "t", "p").first()
    assert a.accuracy == pytest.approx(2 / 3) and a.hamming_accuracy == pytest.approx(5 / 6)


def test_unseen_labels_are_classes(spark):
    rows = spark.createDataFrame([([1], [1], ["x"]), ([1], [1], [])], "t array<int>, p array<int>, u array<string>")
    m = metrics.label_metrics(metrics.label_counts(rows, "t", "p", "u")).first()
    assert m.macro_recall == 0.5 and m.micro_recall == pytest.approx(2 / 3)
    assert metrics.row_agreement(rows, "t", "p", "u").first().accuracy == 0.5


def test_case_levels(spark):
    rows = spark.createDataFrame(
        [("g1", True, True, "fixed_term", 12.0, "fixed_term", 12.0), ("g1", False, False, "fixed_term", 3.0, "life", None), ("g2", True, True, "fixed_term", 3.0, "fixed_term", 20.0)],
        "group_id string, correct boolean, article_correct boolean, penalty_type string, true_months double, predicted_penalty_type string, predicted_months double",
    )
    m = metrics.case_metrics(metrics.case_levels(rows)).first()
    assert m.defendant_charge_article_accuracy == pytest.approx(2 / 3) and m.case_charge_article_accuracy == 0.5
    assert m.defendant_full_accuracy == pytest.approx(1 / 3) and m.case_full_accuracy == 0


def test_bootstrap_weights_equal_resampling(spark):
    stats = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("c", 5.0, 4.0)], "g string, s double, n double")
    w = bootstrap.numpy_weights(spark, ["a", "b", "c"], "g", 20, 42)
    got = {r.rep: r.m for r in bootstrap.replicate_means(stats, w, "g", {"m": ("s", "n")}).collect()}
    rng, s, n = np.random.default_rng(42), np.array([1.0, 3.0, 5.0]), np.array([2.0, 1.0, 4.0])
    for rep in range(20):
        pick = rng.choice(3, 3)
        assert got[rep] == pytest.approx(s[pick].sum() / n[pick].sum(), abs=1e-12)


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", float("nan"))], "metric string, p_value double")
    got = {r.metric: r.adjusted for r in bootstrap.holm(t).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == got["c"] == pytest.approx(0.06) and got["d"] != got["d"]


def test_pairing_counts(spark):
    rows = [("a", "g", 1), ("a", "g", 2), ("b", "g", 1), ("b", "g", 1), ("c", "g", 1)]
    df = spark.createDataFrame(rows, "k string, g string, t int")
    r = bootstrap.paired_rows(df, df, ["k"], "g", ["t"]).first()
    assert tuple(r) == (5, 3, 2, 4, 1, 0)
    assert bootstrap.paired_rows(df, df.where("k <> 'c'"), ["k"], "g", ["t"]).first().mismatches == 1


def test_redaction_masks_and_audits(spark):
    df = spark.createDataFrame([(1, "公诉机关指控甲窃取手机。本院认为构成盗窃罪。乙曾因盗窃被从重处罚，其他无异。依第二百六十四条。")], "id int, text string")
    r = redact.redact(df, names=["盗窃"], keep=["id"]).first()
    assert r.fact_conservative == "[已屏蔽]甲窃取手机。[已屏蔽]。乙曾因盗窃被从重处罚，其他无异。依第二百六十四条。"
    assert "第二百六十四条" not in r.fact_strict
    for x in r.redactions:
        source = r.fact_raw if x.mode == "conservative" else r.fact_conservative
        assert source[x.start : x.end] == x.text
    assert df.select(redact.conservative("text")).first()[0] == r.fact_conservative
    labels = spark.createDataFrame([(" [走私、贩卖]毒品罪",), ("盗窃",), ("a[b、]c[d、e]",), ("[x",), ("杀",), (None,)], "label string")
    got = {r[0]: r[1] for r in labels.select("label", redact.surface_forms("label")).collect()}
    assert got[" [走私、贩卖]毒品罪"] == ["走私毒品", "贩卖毒品", "走私、贩卖毒品"] and got["盗窃"] == ["盗窃"] and got["[x"] == ["[x"] and not got[None]
    assert got["a[b、]c[d、e]"] == ["abcd", "abce", "abcd、e"]
    assert redact.lexicon_names(labels, "label") == ["走私、贩卖毒品", "abcd、e", "abcd", "abce", "贩卖毒品", "走私毒品", "[x", "盗窃"]


def test_redaction_joins_overlaps_as_an_interval_union_does(spark):
    """Every text against spans found one by one and a mask painted over its characters."""
    import random
    import re

    rng = random.Random(3)
    parts = ["盗窃", "罪", "犯", "案", "构成", "第十条", "《", "》", "刑法", "一、", "：", "。", "，", "乙", "\n", "本院认为", "曾", "依法惩处", "公诉机关指控", "抢劫"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "构成" + "盗窃" * 3 + "罪"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = ["盗窃", "抢劫"]
    from lexmill import presets

    patterns = [presets.ARTICLE, redact.mention_pattern(names), "(?:犯|构成|涉嫌|触犯|(?:应当|(?<!答)应)以)([一-龥、]{2,12}?(?<![认悔无有获得])罪)"]
    for r in redact.redact(df, names=names, keep=["id"]).collect():
        mild, spans = r.fact_conservative, set()
        for p in patterns:
            spans |= {m.span(m.lastindex or 0) for m in re.finditer(p, mild)}
        out, last = [], (0, 0)
        for a, b in sorted(spans):
            if out and a < last[1]:
                last = out[-1] = (last[0], max(b, last[1]))
            else:
                out.append((a, b))
                last = (a, b)
        want = mild
        for a, b in reversed(out):
            want = want[:a] + presets.MASK + want[b:]
        assert r.fact_strict == want
        assert {(x.start, x.end) for x in r.redactions if x.mode == "strict"} == spans
        assert all((r.fact_raw if x.mode == "conservative" else mild)[x.start : x.end] == x.text for x in r.redactions)


POLARITY = [("甲主动投案自首", True), ("甲尚未自首", False), ("甲不但退赔而且自首", True), ("甲自首，乙未自首", None), ("甲拒不如实供述而后自首", None), ("无", None), ("未成年人自首", True), ("没有主动自首", False)]


@pytest.mark.parametrize("text,want", POLARITY)
def test_polarity(spark, text, want):
    assert one(spark, factors.cue_polarity("t", ["投案自首", "主动投案", "构成自首", "自首"]), t=text) is want


def test_factors_of_the_target_only(spark):
    t = "甲窃取现金，价值3500元。乙骗取2万元，系从犯。"
    df = spark.createDataFrame([(t, "甲", ["乙"])], "t string, who string, co array<string>")
    f = factors.with_factors(df, "t", "who", "co").first().factors
    assert (f.amount, f.role, f.conduct) == (3500.0, "unknown", "秘密窃取")


def test_proposals_and_bands(spark):
    assert one(spark, C.same_band_amount("a"), a=4450.0) == 4494.5
    assert one(spark, C.same_band_amount("a"), a=4990.0) == pytest.approx(4940.1)
    assert one(spark, interventions.neighbours(F.col("c"), [["a", "b"], ["b", "c", "a"]]), c="a") == ["b", "c"]


def test_focus_skips_what_does_not_fit(spark):
    t = "甲打人。" + "乙" * 30 + "。" + "无人" * 20 + "。天气好。甲走了。"
    assert one(spark, C.focus("t", F.lit("甲"), F.array(F.lit("乙")), 14), t=t) == "甲打人。天气好。甲走了。"


def test_joint_layout(spark, tmp_path):
    import json

    line = {"fact": "甲乙共同盗窃", "defendants": ["甲", "乙"], "outcomes": [
        {"name": "甲", "judgment": [{"standard_accusation": "盗窃罪", "article": ["264"], "penalty": {"imprisonment": 3}}], "final_penalty": {"imprisonment": 10, "detention": 0}},
        {"name": "乙", "judgment": [{"accusation": "盗窃", "article": ["264", "0025"], "penalty": {"detention": 3}}], "final_penalty": ""}]}
    (tmp_path / "a.jsonl").write_text("\n" + json.dumps(line, ensure_ascii=False) + "\n")
    src = jsonl.lines(spark, str(tmp_path / "a.jsonl")).where(F.trim("value") != "")
    rows = sorted(jsonl.joint_cases(src, "train").collect(), key=lambda r: r.case_id)
    assert [r.penalty_type for r in rows] == ["fixed_term", "detention"] and rows[0].imprisonment_months == 10
    assert rows[0].co_defendants == ["乙"] and rows[1].conviction_articles == ["criminal_law:264", "criminal_law:25"]
    assert rows[1].penalty_fallback == "unusable_final_penalty_fallback" and rows[0].case_id.endswith("-d000")
    assert rows[0].source_path.endswith(":2") and rows[0].group_id == rows[1].group_id


def test_simple_layout_and_errors(spark, tmp_path):
    import json

    good = {"fact": "甲打人", "meta": {"criminals": ["甲"], "accusation": ["故意伤害罪", "寻衅滋事"], "relevant_articles": ["234", "293-1"], "term_of_imprisonment": {"death_penalty": False, "life_imprisonment": False, "imprisonment": 12}}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good, ensure_ascii=False))
    r = jsonl.simple_cases(jsonl.read_json_lines(spark, str(tmp_path / "a.jsonl"), jsonl.SIMPLE), "train").first()
    assert r.charges == ["故意伤害", "寻衅滋事"] and r.conviction_articles == ["criminal_law:234", "criminal_law:293:1"] and r.imprisonment_months == 12
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception, match="b.jsonl:2"):
        jsonl.read_json_lines(spark, str(tmp_path / "b.jsonl"), jsonl.SIMPLE).collect()
    assert jsonl.read_json_lines(spark, str(tmp_path / "b.jsonl"), jsonl.SIMPLE, "drop").count() == 1
    m = jsonl.manifest(spark, [str(tmp_path / "b.jsonl")]).first()
    assert m.records == 2 and m.bytes == (tmp_path / "b.jsonl").stat().st_size
    assert [x.line_no for x in jsonl.tail(spark, str(tmp_path / "b.jsonl"), 1).collect()] == [2]


def test_store_view_and_publish(spark, tmp_path):
    req = spark.createDataFrame([("a", 0), ("b", 1)], "generation_id string, ord int")
    held = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "generation_id string, v int")
    assert [r.v for r in store.view(req, held, order="ord").collect()] == [1, 2]
    with pytest.raises(ValueError, match="missing: z"):
        store.view(spark.createDataFrame([("z", 0)], "generation_id string, ord int"), held)
    path = str(tmp_path / "view")
    with pytest.raises(FileNotFoundError):
        store.published(spark, path)
    assert [store.publish(held, path), store.publish(held.where("v < 3"), path)] == [1, 2]
    assert store.published(spark, path).count() == 2
    broken = held.withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        store.publish(broken, path)
    assert store.published(spark, path).count() == 2
    assert store.publish(held.where("v < 2"), path) == 4 and store.published(spark, path).count() == 1
    assert spark.read.parquet(f"{path}/version-2").count() == 2 and not (tmp_path / "view" / "version-1").exists()
    assert sinks.write_json_lines(held, str(tmp_path / "j"), compressed=True) == 3
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_appends_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"x{i}", k) for i in range(3 + k)], "id string, k int").coalesce(1).write.mode("append").parquet(src)
        append_new(spark.readStream.schema("id string, k int").parquet(src), out, str(tmp_path / "ck"), "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["x0", "x1", "x2", "x3"]


def test_coverage_case_size_is_the_declared_one(spark):
    p = spark.createDataFrame([("g1", 100, ["a"], 2, False), ("g1", 600, ["a", "b"], 1, True), ("g2", 5000, [], 1, True)], "case_group_id string, chars int, charges array<string>, defendant_count int, length_excluded boolean")
    t = {(r.part, r.name): r.n for r in coverage.parent_table(p).collect()}
    assert t["defendants_per_case", "2"] == 1 and t["charge", "a"] == 2 and t["count", "case"] == 2
    assert tuple(coverage.length_exclusion(p).first()) == (2, 2, 1)


def test_messages_and_answers(spark):
    import json

    from lexmill.operators import prompts

    f = "struct<amount:double,surrender:boolean,restitution:boolean,confession:boolean,role:string,conduct:string>"
    df = spark.createDataFrame([("甲", ["乙"], ["amount", "conduct"], (4494.5, None, None, None, "unknown", "秘密窃取"))], f"target_defendant string, co_defendants array<string>, changed_fields array<string>, target_factors {f}")
    spec = F.struct(*[F.col(c) for c in df.columns])
    got = json.loads(df.select(prompts.messages(spec, F.lit("原文"), F.lit("一句。"))).first()[0])
    user = json.loads(got[1]["content"])
    assert user["source_sentence"] == "一句。" and len(user["edits"]) == 2 and "4494.5元" in user["edits"][0]
    rows = spark.createDataFrame([('{"replacement_sentence":"x"}',), ("{",), ('{"replacement_sentence":3}',), ("[]",), (None,)], "r string")
    assert [r[0] for r in rows.select(prompts.answer("r")).collect()] == ["x", None, None, None, None]


def test_losses_and_schedule(spark):
    from lexmill.operators import losses

    df = spark.createDataFrame([([0.0, 2.0], [1.0, 0.0], 1)], "x array<double>, y array<double>, k int")
    r = df.select(losses.bce("x", "y").alias("b"), losses.cross_entropy("x", "k").alias("c"), losses.hinge(1.0, F.lit(-1), F.lit(0.25)).alias("h")).first()
    assert r.b == pytest.approx(np.log(2) + 2 + np.log1p(np.exp(-2))) and r.c == pytest.approx(np.log(1 + np.exp(-2))) and r.h == 1.25
    assert losses.smooth_l1(F.lit(3.0), F.lit(1.0)) is not None
    assert df.agg(losses.masked_mean(F.lit(2.0), F.lit(False))).first()[0] == 0.0


def test_edits_of_cases(spark):
    from lexmill.queries import QUERIES

    got = {r["name"]: r for r in QUERIES["t18_t31_edits"](spark, "").collect()}
    assert got["amount"].edited == "甲窃取手机，价值3535元。案发后甲退赔。" and got["amount"].valid
    assert got["flip"].edited.startswith("张某无事生非，随意殴打他人，致其轻伤二级。") and got["flip"].valid
    assert got["restitution"].edited.endswith("李某案发后已退赃退赔。") and "attribution_ambiguous" in got["restitution"].errors
    assert [got[n].reason for n in ("two places", "shared", "initial")] == ["incomplete_flip", "no_restitution_span", "abbreviated_ambiguous"]


def test_components_of_all_links(spark, tmp_path):
    from lexmill.queries import QUERIES

    rng = np.random.default_rng(4)
    links = [(int(a), int(b), int(n), float(q)) for a, b, n, q in zip(rng.integers(1, 90, 100), rng.integers(1, 90, 100), rng.integers(1, 8, 100), rng.integers(1, 51, 100))]
    spark.createDataFrame(links, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {n: n for a, b, *_ in links for n in (10 * a, 10 * b + 1)}
    find = lambda n: n if root[n] == n else find(root[n])
    for a, b, *_ in links:
        x, y = find(10 * a), find(10 * b + 1)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in QUERIES["j02_components_all_links"](spark, str(tmp_path)).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_view_problems_ask_for_every_order(spark, monkeypatch):
    from lexmill.operators import store
    from lexmill.queries import QUERIES

    asked, plain = [], store.view_problems
    monkeypatch.setattr(store, "view_problems", lambda requests, held, **k: asked.append(requests.count()) or plain(requests, held, **k))
    QUERIES["j09_view_problems"](spark, "/root/testdata/sf0.001")
    assert asked == [spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()]


def test_text_queries_take_every_document(spark):
    """A row a document, and all of its own text in what is masked."""
    from lexmill.queries import QUERIES
    from lexmill.queries_text import CASES

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for name in ("t07_redaction", "t05_conservative_native", "t11_t17_factors", "w08_own_text", "w04_focus"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert sorted(r.doc_id for r in rows) == sorted(docs)
        if name.startswith("t0"):
            body = lambda r: (docs[r.doc_id].text or "").translate(str.maketrans(".,;!?", "。，；！？"))
            assert all((r.fact_conservative if name == "t07_redaction" else r.masked).startswith(body(r) + "\n") for r in rows)
            assert sum((r.n_redactions if name == "t07_redaction" else r.n_masks) > 0 for r in rows) >= 2 * len(rows) // len(CASES)
        if name == "t11_t17_factors":
            told = [r.amount == 3500.0 for r in rows if r.doc_id % len(CASES) == 0]  # not where another's name lies in the target's
            assert sum(told) > len(told) / 2
    parents = {r.parent_case_id for r in QUERIES["t32_proposals"](spark, "/root/testdata/sf0.001").collect()}
    assert parents <= set(docs) and parents >= {d for d in docs if d % 7}
