"""The three plans end to end on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill import config
from lexmill.operators import store
from lexmill.plans import build, evaluate, generate


def line(fact, charge="盗窃罪", months=12, who="甲"):
    return json.dumps({"fact": fact, "meta": {"criminals": [who], "accusation": [charge], "relevant_articles": ["264"], "term_of_imprisonment": {"death_penalty": False, "life_imprisonment": False, "imprisonment": months}}}, ensure_ascii=False)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cases")
    base = "".join(chr(0x4E00 + i * 37 % 6000) for i in range(400))
    (folder / "train.jsonl").write_text("\n".join([line("甲窃取手机，价值3500元，后退赔。"), line("甲窃取手机，价值3500元，后退赔。"), line(base + "4450"), line("甲因琐事殴打他人致人轻伤。", "故意伤害罪")]))
    (folder / "test.jsonl").write_text("\n".join([line(base + "4460"), line("甲骗取2万元。本院认为构成诈骗罪。", "诈骗罪")]))
    out = str(folder / "out")
    return out, build.build(spark, {"train": str(folder / "train.jsonl"), "test": str(folder / "test.jsonl")}, "cail", out)


def test_build(spark, built):
    out, meta = built
    assert meta["split_units"] == {"train": 2, "test": 2} and meta["charge_vocabulary"] == ["故意伤害", "盗窃"]
    assert meta["split_integrity"]["dropped_units"] == {"train": 1, "test": 0} and meta["split_integrity"]["duplicate_case_ids_dropped"]["train"] == 1
    assert meta["label_coverage"]["test"]["units_with_unseen_charge"] == 1
    rows = spark.read.parquet(f"{out}/records")
    fraud = rows.where(F.array_contains("charges", "诈骗")).first()
    assert fraud.fact_conservative == "甲骗取2万元。[已屏蔽]。" and fraud.factors.conduct == "虚构事实使被害人自愿交付"
    assert spark.read.parquet(f"{out}/manifest").agg(F.sum("records")).first()[0] == 6


def test_generate_resumes(spark, built, tmp_path):
    rows = spark.read.parquet(f"{built[0]}/records")
    edges = [["盗窃", "抢夺"], ["故意伤害", "寻衅滋事"]]
    asked = []
    first = generate.run(rows, edges, str(tmp_path / "store"), str(tmp_path / "view"), writer=lambda *parts: asked.append(parts) or generate.mock_sentence(*parts))
    n = spark.read.parquet(str(tmp_path / "store")).count()
    assert n == first["view"].count() > 3 and first["view"].where("validation.valid").count() >= 1
    told = first["report"].first()
    assert asked and told.generation.new == told.view.records == n and told.parents["count"] == rows.count() and told.generation.passed + told.generation.failed_validation == n
    second = generate.run(rows, edges, str(tmp_path / "store"), str(tmp_path / "view"))
    few, every = (generate.requests(rows, edges, limit=k).orderBy("parent_case_id", "ord").select("parent_case_id", "ord").collect() for k in (2, None))
    assert few == every[:2]
    assert spark.read.parquet(str(tmp_path / "store")).count() == n
    assert store.clean_records(second["view"]).count() <= n
    assert {r.part for r in second["parents"].collect()} == {"count", "length_bucket", "charge", "defendants_per_case"}


def rows_of(spark, shift):
    made = [(str(i), f"g{i % 5}", [1, 0] if i % 2 else [0, 1], [1, 0] if (i + shift) % 3 else [0, 1], [], [1], [1], [], "fixed_term", "fixed_term", float(i), float(i + shift)) for i in range(20)]
    return spark.createDataFrame(made, "case_id string, group_id string, true_charges array<int>, predicted_charges array<int>, unseen_true_charge_labels array<string>, true_articles array<int>, predicted_articles array<int>, unseen_true_article_labels array<string>, penalty_type string, predicted_penalty_type string, true_months double, predicted_months double")


def test_evaluate_and_compare(spark):
    a, b = rows_of(spark, 0), rows_of(spark, 4)
    got = {r.metric: r for r in evaluate.evaluate(a, "static", 20).collect()}
    assert got["sentence_mae"].estimate == 0 and got["article_macro_f1"].estimate == 1
    assert all(r.lower <= r.estimate + 0.3 and r.lower <= r.upper for r in got.values())
    diff = {r.metric: r for r in evaluate.compare(a, b, "static", "case_id", ["true_charges", "true_months"], 20).collect()}
    assert diff["sentence_mae"].difference == -4 and diff["sentence_mae"].adjusted >= diff["sentence_mae"].p_value
    with pytest.raises(ValueError):
        evaluate.compare(a, b.where("case_id <> '3'"), "static", "case_id", ["true_charges"], 5)


def weighted_directly(rows, kind, weights):
    """Replicates the long way: every row meets its group's weight."""
    from lexmill.operators import metrics

    if kind == "cmdl":
        return metrics.case_metrics(metrics.case_levels(rows).join(weights, "group_id"), ["rep"], "weight")
    j = rows.join(weights, "group_id")
    return evaluate.static_metrics(j, "weight", ["rep"]) if kind == "static" else metrics.counterfactual_metrics(j, 0.1, "weight", ["rep"])


def test_replicates_equal_weighted_rows(spark):
    from lexmill.operators import bootstrap

    static = rows_of(spark, 3).withColumns({"correct": F.col("true_charges") == F.col("predicted_charges"), "article_correct": F.lit(True)})
    static = static.withColumn("unseen_true_charge_labels", F.when(F.col("case_id") == "7", F.array(F.lit("new"))).otherwise(F.col("unseen_true_charge_labels")))
    kinds = F.array(F.lit("charge_flip"), F.lit("invariant"), F.lit("sentence_rank"))
    i = F.col("case_id").cast("int")
    pairs = static.select(
        "group_id", F.get(kinds, i % 3).alias("intervention_type"), (i % 2).alias("target_charge"), F.array(1 - i % 2).alias("parent_charge_indices"), F.lit(0.5).alias("charge_threshold"), F.lit(1).alias("rank_direction"),
        F.array(i / 20, 1 - i / 20).alias("parent_charge_probabilities"), F.array(1 - i / 20, i / 20).alias("counterfactual_charge_probabilities"), F.lit(5.0).alias("parent_sentence"), i.cast("double").alias("counterfactual_sentence"),
    )
    for kind, rows in (("static", static), ("counterfactual", pairs), ("cmdl", static)):
        weights = bootstrap.group_weights(rows, "group_id", 12, 5)
        got = evaluate.replicates(rows, kind, weights).orderBy("rep").toPandas()
        want = weighted_directly(rows, kind, weights).orderBy("rep").toPandas()
        assert len(got) == 12 and set(evaluate.ENDPOINTS[kind]) <= set(got.columns)
        for c in got.columns:
            assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(got[c], want[c])), c


def test_payload_and_strict_pairs(spark):
    a, b = rows_of(spark, 0), rows_of(spark, 4)
    told = json.loads(evaluate.payload(a, "static", 10, reference=b, truth=["true_charges"], names=["sentence_mae", "charge_macro_f1"]).first()[0])
    assert told["metrics"]["sentence_mae"] == 0 and set(told["confidence_intervals"]) == {"sentence_mae", "charge_macro_f1"} and told["comparison"]["sentence_mae"]["difference"] == -4 and told["bootstrap"]["iterations"] == 10
    for names in ([], ["none"], ["sentence_mae"] * 6):
        with pytest.raises(ValueError):
            evaluate.payload(a, "static", 2, names=names)
    with pytest.raises(ValueError, match="repeated"):
        evaluate.compare(a.unionByName(a.limit(1)), b, "static", "case_id", ["true_charges"], 2, strict=True)


def test_experiments(spark):
    from lexmill.plans import experiments

    assert experiments.experiment("A4") == experiments.experiment("M") | {"use_factors": False, "name": "A4"}
    assert experiments.kinds(experiments.experiment("A1")) == ["charge_flip", "sentence_rank"] and experiments.experiment("A6")["filter_counterfactuals"] is False
    with pytest.raises(ValueError):
        experiments.experiment("Z")
    records = spark.createDataFrame([("r1", ["a"])], "case_id string, charges array<string>")
    valid = "struct<valid:boolean,errors:array<string>>"
    pairs = spark.createDataFrame(
        [("1", "r1", ["a"], "charge_flip", "b", (True, []), False), ("2", "r1", ["a"], "charge_flip", "z", (True, []), False), ("3", "r1", ["a"], "invariant", None, (False, ["unchanged"]), False), ("4", "r1", ["a"], "invariant", None, (True, []), False)],
        f"generation_id string, case_id string, charges array<string>, intervention_type string, target_charge string, validation {valid}, leakage boolean",
    ).withColumns({"counterfactual_strict": F.lit("t"), "target_factors": F.lit(None).cast("string")})
    ids = lambda name, **k: experiments.training_rows(records, pairs, experiments.experiment(name), ["a", "b"], **k)
    assert ids("B3") == (records, None)
    assert [r.generation_id for r in ids("M")[1].orderBy("generation_id").collect()] == ["1", "4"]
    assert [r.generation_id for r in ids("A6")[1].orderBy("generation_id").collect()] == ["1", "3", "4"]
    assert [r.generation_id for r in ids("M", limit=1)[1].collect()] == ["1"]
    assert sorted(r.charges for r in ids("B5")[0].collect()) == [["a"], ["a"], ["b"]]


def test_losses_are_guarded(spark, tmp_path):
    from lexmill.operators import losses

    rows = spark.createDataFrame([(1.0, True), (3.0, True), (9.0, False)], "v double, m boolean")
    terms = {"charge": [(F.col("v"), F.col("m"))], "sentence": [(F.col("v"), F.col("m")), (F.col("v") * 2, ~F.col("m"))], "factor": [(F.col("v"), F.lit(False))]}
    got = losses.typed_losses(rows, terms, {"charge": 5.0, "sentence": 0.5})
    r = got.first()
    assert (r.charge, r.sentence, r.factor, r.total, r.n_charge, r.n_sentence, r.n_factor, r.article) == (2.0, 20.0, 0.0, 12.0, 2, 3, 0, 0.0)
    losses.guard(got, 1)
    with pytest.raises(ArithmeticError, match="factor:nonzero"):
        losses.guard(got.withColumn("factor", F.lit(1.0)), 2, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().step == 2
    with pytest.raises(ArithmeticError, match="charge, sentence, total"):
        losses.guard(losses.typed_losses(rows.withColumn("v", F.lit(float("nan"))), terms), 3)


def test_resumed_batches(spark):
    from lexmill.operators import batches

    df = spark.range(500).withColumn("n", (F.col("id") % 17 + 1).cast("int"))
    made = batches.numbered(batches.token_batches(df, "n", 64, 8, "id", window=100, seed=3, epoch=1)).persist()
    total = made.agg(F.max("place")).first()[0] + 1
    assert made.select("place").distinct().count() == total == made.select("shuffle_window", "batch").distinct().count()
    half = batches.resumed(made, {"seed": 3, "epoch": 1, "start": total // 2}, 3, 1)
    assert half.agg(F.min("place")).first()[0] == total // 2 and batches.resumed(made, {"seed": 3, "epoch": 1, "start": total}, 3, 1).isEmpty()
    for state in ({"seed": 4, "epoch": 1, "start": 0}, {"seed": 3, "epoch": 1, "start": total + 1}):
        with pytest.raises(ValueError):
            batches.resumed(made, state, 3, 1)


def test_observed_factors(spark):
    from lexmill.operators import factors

    kind = "struct<amount:double,surrender:boolean,restitution:boolean,confession:boolean,role:string,conduct:string>"
    wish = lambda amount, back: (amount, None, back, None, "unknown", None)
    text = "甲窃取手机，价值3500元。案发后甲退赔。"
    rows = [(1, wish(3500.00001, True), ["amount"]), (2, wish(3535.0, True), ["amount"]), (3, wish(None, None), ["restitution"]), (4, wish(1.0, True), ["restitution"]), (5, wish(1.0, False), []), (6, wish(None, True), ["amount"])]
    df = spark.createDataFrame(rows, f"id int, target_factors {kind}, changed_fields array<string>").withColumns({"t": F.lit(text), "target_defendant": F.lit("甲"), "co_defendants": F.array().cast("array<string>")})
    got = {r.id: r.observed_factors for r in factors.observed(df, "t").collect()}
    assert [k for k, v in sorted(got.items()) if v is not None] == [1, 4, 5] and got[5].amount == 3500.0


def test_gates(spark):
    from lexmill.operators import interventions

    rows = spark.createDataFrame([("invariant", True), ("charge_flip", None)], "intervention_type string, articles_available boolean")
    assert interventions.allowed(rows, ["invariant", "sentence_rank"]).count() == 1
    evaluate.require_article_labels(rows.where("intervention_type = 'invariant'"))
    for wrong in (lambda: interventions.allowed(rows, ["sentence_rank"]), lambda: interventions.allowed(rows, []), lambda: evaluate.require_article_labels(rows), lambda: evaluate.require_article_labels(rows.drop("articles_available"))):
        with pytest.raises(ValueError):
            wrong()


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"data": {"dataset": "cail", "limit": 3}}')
    got = config.load(str(path), {"LEXMILL_DATA__LIMIT": "7", "OTHER": "x"}, {"train.rate": 0.5, "data.none": None})
    assert got == {"data": {"dataset": "cail", "limit": 7}, "train": {"rate": 0.5}}
    assert config.parse_overrides(["a.b=true", "c=x=y"]) == {"a.b": True, "c": "x=y"}
    assert [config.scalar(x) for x in ("on", "off", "TRUE", "NULL", "~", "1e3", "1.5", "[1]", "a: b", "", "x y")] == [True, False, True, None, None, "1e3", 1.5, "[1]", "a: b", None, "x y"]
    yaml_file = tmp_path / "c.yaml"
    yaml_file.write_text("data:\n  empty: {}\n  list: [1, 2]\nname: x\n")
    got = config.load(str(yaml_file), {}, {"data": {"a": 1}, "data.b.c": 2, "Name": None})
    assert got == {"data": {"a": 1, "b": {"c": 2}}, "name": "x"}
    assert config.load(str(yaml_file), {"LEXMILL_DATA__EMPTY__K": "1"})["data"] == {"empty": {"k": 1}, "list": [1, 2]}
    for bad in ({"name.x": 1}, {"data.list.x": 1}):
        with pytest.raises(ValueError):
            config.load(str(yaml_file), {}, bad)
    with pytest.raises(ValueError):
        config.parse_overrides(["a"])
    config.ensure_identity(str(tmp_path / "id.json"), {"model": 1})
    config.ensure_identity(str(tmp_path / "id.json"), {"model": 1})
    with pytest.raises(ValueError):
        config.ensure_identity(str(tmp_path / "id.json"), {"model": 2})
