"""Queries of cases, pairs, reports and stores over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import batches, bootstrap, coverage, edits, factors, interventions, losses, metrics, redact, splits, store
from .plans import evaluate, experiments, generate
from .queries import query, table
from .queries_files import folder
from .queries_stats import SCORED, rounded, scored
from .sources import audit, jsonl, sinks
from .streaming.append import append_bucketed, append_new, route_late


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_quantity").cast("int"), "p": F.concat(F.lit("p"), "l_partkey"), "s": F.concat(F.lit("s"), "l_suppkey")})


@query(
    "s03_p02_p03_p04_joint_cases",
    """WITH b AS (SELECT *, l_quantity::INT AS q, (l_quantity::INT % 3) * 6 AS i, l_linenumber % 3 <> 0 OR l_linenumber % 2 = 1 AS has FROM lineitem),
            k AS (SELECT *, CASE WHEN q % 13 = 0 THEN 'death' WHEN q % 11 = 0 THEN 'life' WHEN i > 0 THEN 'fixed_term' WHEN q % 2 = 1 THEN 'detention' ELSE 'exempt' END AS kind FROM b)
       SELECT l_orderkey || '/' || l_linenumber AS fact_raw, 'p' || l_partkey AS target_defendant, 's' || l_suppkey AS others, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'x' || l_returnflag END AS charges,
              CASE WHEN has THEN kind ELSE 'unknown' END AS penalty_type, CASE WHEN has AND kind = 'fixed_term' THEN i::DOUBLE END AS months, NOT has AS mask_penalty,
              CASE WHEN NOT has THEN 'missing_penalty_fields' END AS penalty_exclusion, l_partkey % 4 <> 0 AS articles_available, CASE WHEN l_partkey % 4 <> 0 THEN 'criminal_law:' || (l_partkey % 400 + 1) ELSE '' END AS articles FROM k
       UNION ALL
       SELECT l_orderkey || '/' || l_linenumber, 's' || l_suppkey, 'p' || l_partkey, 'a+b', 'unknown', NULL, true, 'missing_final_penalty', true, 'criminal_law:1+criminal_law:2' FROM k""",
)
def s03(spark, sf_dir):
    """Every line of an order as a case of two defendants in the nested layout: one with a final or a single penalty, one with two judgments and none."""
    path, q = folder(spark), F.col("q")
    penalty = F.struct((q % 13 == 0).alias("death_penalty"), (q % 11 == 0).alias("life_imprisonment"), (q % 3 * 6).alias("imprisonment"), (q % 2 * 3).alias("detention"), F.lit(0).alias("surveillance"))
    named = F.when(F.col("l_linestatus") == "O", F.concat("l_returnflag", F.lit("罪"))).otherwise("")
    judgment = lambda standard, said, article, own: F.struct(standard.alias("standard_accusation"), said.alias("accusation"), article.alias("article"), own.alias("penalty"))
    none = F.lit(None).cast("struct<death_penalty:boolean,life_imprisonment:boolean,imprisonment:int,detention:int,surveillance:int>")
    fixed = lambda name, article: judgment(F.lit(""), F.lit(name), F.array(F.lit(article)), none)
    first = judgment(named, F.concat(F.lit("x"), "l_returnflag", F.lit("罪")), F.when(F.col("l_partkey") % 4 != 0, F.array((F.col("l_partkey") % 400 + 1).cast("string"))), F.when(F.col("l_linenumber") % 2 == 1, penalty))
    outcomes = F.array(
        F.struct(F.col("p").alias("name"), F.array(first).alias("judgment"), F.when(F.col("l_linenumber") % 3 != 0, penalty).alias("final_penalty")),
        F.struct(F.col("s").alias("name"), F.array(fixed("a罪", "1"), fixed("b罪", "2")).alias("judgment"), none.alias("final_penalty")),
    )
    fact = F.concat_ws("/", "l_orderkey", "l_linenumber")
    sinks.write_json_lines(lines_of(spark, sf_dir).select(fact.alias("fact"), F.array("p", "s").alias("defendants"), outcomes.alias("outcomes")), path, compressed=True)
    got = jsonl.joint_cases(jsonl.lines(spark, path), "train")
    return got.select(
        "fact_raw", "target_defendant", F.array_join("co_defendants", "+").alias("others"), F.array_join("charges", "+").alias("charges"), "penalty_type", F.col("imprisonment_months").cast("double").alias("months"), "mask_penalty",
        "penalty_exclusion", "articles_available", F.array_join("conviction_articles", "+").alias("articles"),
    )


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.array("o_orderstatus").alias("charges"), F.when(i % 2 == 0, "charge_flip").otherwise("invariant").alias("intervention_type"), F.col("o_orderpriority").alias("target_charge"),
        F.concat(F.lit("edited "), "o_orderkey").alias("counterfactual_strict"), F.concat(F.lit("edited "), "o_orderkey").alias("counterfactual_text"), F.lit("fact").alias("fact_strict"), F.lit("mild").alias("fact_conservative"),
        F.lit("own").alias("factors"), F.when(i % 3 == 0, "new").alias("target_factors"), F.when(i % 3 == 0, "seen").alias("counterfactual_factors"),
        F.lit(False).alias("mask_penalty"), F.lit("fixed_term").alias("penalty_type"), (i % 9).cast("int").alias("imprisonment_months"),
    )


@query("p19_u02_augmentation", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS charge, 'edited ' || o_orderkey AS fact_strict, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS factors, true AS mask_penalty, 'unknown' AS penalty_type, 0::BIGINT AS months FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, 'fact', 'own', false, 'fixed_term', 1 FROM orders""")
def p19(spark, sf_dir):
    """Records and, below them, the records that ordinary augmentation makes of every pair."""
    pairs = pairs_of(spark, sf_dir)
    records = pairs.select("o_orderkey", "charges", "fact_strict", "factors", "mask_penalty", "penalty_type", "imprisonment_months")
    settings = experiments.experiment("B5") | {"filter_counterfactuals": False}
    words = [r[0] for r in pairs.select("target_charge").distinct().collect()]  # a vocabulary of five
    rows, _ = experiments.training_rows(records, pairs, settings, words)
    return rows.select("o_orderkey", F.get("charges", F.lit(0)).alias("charge"), "fact_strict", "factors", "mask_penalty", "penalty_type", F.col("imprisonment_months").isNotNull().cast("bigint").alias("months"))


@query("p18_overlaid", "SELECT o_orderkey, 'edited ' || o_orderkey AS fact_strict, 'edited ' || o_orderkey AS fact_conservative, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' ELSE 'own' END AS factors FROM orders")
def p18(spark, sf_dir):
    return interventions.overlaid(pairs_of(spark, sf_dir)).select("o_orderkey", "fact_strict", "fact_conservative", "factors")


@query("f06_allowed_kinds", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def f06(spark, sf_dir):
    return interventions.allowed(pairs_of(spark, sf_dir), experiments.kinds(experiments.experiment("A2"))).select("o_orderkey")


@query("o06_pair_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 OR o_orderpriority LIKE '1%' ORDER BY o_orderkey DESC LIMIT 500")
def o06(spark, sf_dir):
    """The first 500 pairs of what the filters leave."""
    known = interventions.known_targets(pairs_of(spark, sf_dir), ["1-URGENT"])
    return splits.first_rows(known.withColumn("at", -F.col("o_orderkey")), ["at"], 500).select("o_orderkey")


@query("p21_j12_counterfactual_predictions", """
    SELECT vec_id, CASE WHEN label < 5 AND vec_id % 2 = 0 THEN label ELSE -1 END AS target_charge, CASE WHEN label < 5 THEN label || '+0' ELSE '0' END AS parents, 0.4::DOUBLE AS threshold FROM embeddings""")
def p21(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("c"), "label")
    rows = e.select(
        F.col("vec_id").alias("case_id"), F.col("vec_id").alias("group_id"), F.col("vec_id").alias("generation_id"), F.lit("charge_flip").alias("intervention_type"), F.when(F.col("vec_id") % 2 == 0, name).alias("target_charge"), F.array(name, F.lit("c0")).alias("charges"),
        F.lit(1).alias("rank_direction"), *[F.lit(None).alias(c) for c in ("parent_charge_probabilities", "counterfactual_charge_probabilities", "parent_sentence", "counterfactual_sentence", "penalty_type", "imprisonment_months", "restitution")],
    )
    got = metrics.counterfactual_predictions(rows, [f"c{i}" for i in range(5)], 0.4)
    place = F.greatest(F.coalesce("target_charge", F.lit(-1)), F.lit(-1)).cast("bigint")  # unknown and none alike
    return got.select(F.col("case_id").alias("vec_id"), place.alias("target_charge"), F.array_join(F.col("parent_charge_indices").cast("array<string>"), "+").alias("parents"), F.col("charge_threshold").cast("double").alias("threshold"))


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record: two records a group, its source as the charge, none to two others beside it."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("case_id"), F.floor(F.col("doc_id") / 2).cast("string").alias("group_id"), F.col("text").alias("fact_strict"), F.array("source").alias("charges"),
        F.array_repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int")).alias("co_defendants"), F.col("doc_id").alias("i"),
    )


PARENTS = """
    d AS (SELECT doc_id, doc_id // 2 AS g, source, length(text) AS chars, doc_id % 3 + 1 AS people FROM documents),
    s AS (SELECT g, max(people) AS size FROM d GROUP BY 1)
"""


@query("a09_f02_parents", f"WITH {PARENTS} SELECT doc_id::VARCHAR AS case_id, g::VARCHAR AS grp, chars, people, chars > 900 AS length_excluded FROM d")
def a09(spark, sf_dir):
    p = generate.parents(records_of(spark, sf_dir), 900)
    return p.select("case_id", F.col("case_group_id").alias("grp"), F.col("chars").cast("bigint").alias("chars"), F.col("defendant_count").cast("bigint").alias("people"), "length_excluded")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: every fourth is invalid with two errors, every seventh of the others without any."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    bad = F.array(F.lit("unchanged"), F.concat(F.lit("non_target_defendant_changed:"), "lang"))
    errors = F.when(i % 4 == 0, bad).otherwise(F.array().cast("array<string>"))
    return d.select(i.cast("string").alias("generation_id"), F.struct(((i % 4 != 0) & (i % 7 != 0)).alias("valid"), errors.alias("errors")).alias("validation"))


@query("a12_generation_totals", """
    SELECT count(*) AS "new", 5::BIGINT AS resumed, 3::BIGINT AS duplicate, count(*) + 5 AS current_total, count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0) AS passed,
           count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 7 = 0) AS failed_validation, 2::BIGINT AS transport_failures FROM documents""")
def a12(spark, sf_dir):
    out = coverage.generation_totals(judged(spark, sf_dir), 5, 3, 2)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


@query("a13_j15_last_requests", """
    WITH r AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
    SELECT r.o_custkey, k AS o_orderkey, o_orderpriority FROM r JOIN orders ON o_orderkey = k""")
def j15(spark, sf_dir):
    """Of each customer's orders that a view holds, the last one stands for them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("case_id", F.col("o_custkey"))
    held = o.where(F.col("o_orderkey") % 5 != 0).select("o_orderkey")
    return coverage.last_requests(o, held, "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("a14_coverage_report", f"""
    WITH {PARENTS}, e AS (SELECT g, count(*) FILTER (WHERE chars > 900) AS lost, count(*) FILTER (WHERE chars <= 900) AS kept FROM d GROUP BY 1),
         c AS (SELECT source, count(*) AS n FROM d GROUP BY 1), z AS (SELECT size, count(*) AS n FROM s GROUP BY 1)
    SELECT (SELECT count(*) FROM d) AS records, (SELECT count(*) FROM s) AS cases, (SELECT string_agg(source || '=' || n, ';' ORDER BY source) FROM c) AS charges, (SELECT string_agg(size || '=' || n, ';' ORDER BY size) FROM z) AS sizes,
           (SELECT sum(lost) FROM e)::BIGINT AS excluded, (SELECT count(*) FROM e WHERE lost > 0) AS affected, (SELECT count(*) FROM e WHERE lost > 0 AND kept > 0) AS partial, 'other=' || (SELECT count(*) FROM d WHERE doc_id % 5 = 0) AS ranks,
           (SELECT count(*) FROM d WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0) AS passed,
           'invalid=' || (SELECT count(*) FROM d WHERE doc_id % 4 <> 0 AND doc_id % 7 = 0) || ';non_target_defendant_changed=' || (SELECT count(*) FROM d WHERE doc_id % 4 = 0) || ';unchanged=' || (SELECT count(*) FROM d WHERE doc_id % 4 = 0) AS reasons,
           (SELECT count(*) FROM d WHERE doc_id % 2 = 0) AS view_records, (SELECT count(DISTINCT g) FROM d WHERE doc_id % 2 = 0) AS view_cases""")
def a14(spark, sf_dir):
    r = records_of(spark, sf_dir)
    parents, made = generate.parents(r, 900), judged(spark, sf_dir)
    ranks = r.where("i % 5 = 0").groupBy(F.lit("other").alias("reason")).agg(F.count("*").alias("n"))
    requests = parents.withColumn("generation_id", F.col("case_id"))
    out = coverage.report(parents, ranks, made, view=(requests, made.where(F.col("generation_id").cast("long") % 2 == 0)))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    p, g, v = "parents.", "generation.", "view."
    return out.select(
        F.col(p + "count").alias("records"), F.col(p + "case_count").alias("cases"), shown(p + "charges").alias("charges"), shown(p + "defendants_per_case").alias("sizes"), F.col(p + "excluded").alias("excluded"), F.col(p + "affected_cases").alias("affected"),
        F.col(p + "partial_cases").alias("partial"), shown(p + "rank_exclusions").alias("ranks"), F.col(g + "passed").alias("passed"), shown(g + "excluded_reasons").alias("reasons"), F.col(v + "records").alias("view_records"), F.col(v + "case_count").alias("view_cases"),
    )


@query("j11_strict_pairs", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'repeated' WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'other_group' ELSE 'other_truth' END AS problem
    FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 11 = 0""")
def j11(spark, sf_dir):
    """Orders against a copy in which some are repeated, missing, of another customer or of another status."""
    o, i = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey")
    other = o.withColumns({"o_custkey": F.when(i % 3 == 0, -1).otherwise(F.col("o_custkey")), "o_orderstatus": F.when(i % 11 == 0, "?").otherwise(F.col("o_orderstatus"))})
    other = other.where((i % 5 != 0) | (i % 7 == 0)).withColumn("n", F.explode(F.when(i % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n")
    return bootstrap.strict_pairs(o, other, ["o_orderkey"], "o_custkey", ["o_orderstatus"])


@query("f11_factors_match", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_orderkey % 2 = 1 WHEN 3 THEN true ELSE false END AS same FROM orders""")
def f11(spark, sf_dir):
    """Amounts a hair or a yuan apart, values that are unknown, fields that didn't change."""
    i, k = F.col("o_orderkey"), F.col("o_orderkey") % 5
    seen = F.struct(F.col("o_totalprice").alias("amount"), F.lit(None).cast("boolean").alias("surrender"), (i % 2 == 0).alias("restitution"), F.lit(True).alias("confession"), F.lit("unknown").alias("role"), F.lit("x").alias("conduct"))
    amount = F.col("o_totalprice") + F.when(k == 0, 1e-5).otherwise(1.0)
    wish = F.struct(F.when(k != 4, amount).alias("amount"), F.lit(None).cast("boolean").alias("surrender"), F.lit(False).alias("restitution"), F.lit(False).alias("confession"), F.lit("unknown").alias("role"), F.lit("x").alias("conduct"))
    changed = F.when(k.isin(0, 1, 4), F.array(F.lit("amount"), F.lit("surrender"))).when(k == 2, F.array(F.lit("restitution"), F.lit("role"))).otherwise(F.array(F.lit("conduct")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", seen.alias("seen"), wish.alias("wish"), changed.alias("changed"))
    return o.select("o_orderkey", C.factors_match(F.col("seen"), F.col("wish"), "changed").alias("same"))


@query("l04_l06_l07_l08_l09_typed_losses", f"""
    WITH {SCORED}, x AS (SELECT *, vec_id % 3 AS kind, list_sum(list_transform(p, lambda x, i: greatest(x, 0) - x * truth[i] + ln(1 + exp(-abs(x))))) AS b, list_sum(list_transform(p, lambda x, i: CASE WHEN i <= 3 THEN greatest(x, 0) - x * truth[i] + ln(1 + exp(-abs(x))) ELSE 0 END)) AS f FROM e),
         t AS (SELECT avg(b) AS charge, avg(b) FILTER (WHERE kind = 0) AS boundary, avg(greatest(0, 0.5 - (q[1] - p[1]))) FILTER (WHERE kind = 1) AS response, sum(f) / (3 * count(*)) AS factor, count(*) AS n, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1 FROM x)
    SELECT round(charge, 9) AS charge, round(boundary, 9) AS boundary, round(response, 9) AS response, round(factor, 9) AS factor, 0.0::DOUBLE AS invariant, round(charge + 0.5 * boundary + 2 * response + factor, 9) AS total, n AS n_charge, n0 AS n_boundary, n1 AS n_response, 0::BIGINT AS n_invariant, 0::BIGINT AS problems FROM t""")
def l08(spark, sf_dir):
    e, kind, yes = scored(spark, sf_dir), F.col("vec_id") % 3, F.lit(True)
    truth = F.transform("truth", lambda x: x.cast("double"))
    terms = {
        "charge": [(losses.bce("p", truth), yes)], "boundary": [(losses.bce("p", truth), kind == 0)], "response": [(losses.hinge(0.5, F.lit(1), F.get("q", F.lit(0)) - F.get("p", F.lit(0))), kind == 1)],
        "factor": [(losses.bce(F.slice("p", 1, 3), F.slice(truth, 1, 3), mean=True), yes)], "invariant": [(F.lit(1.0), kind == 7)],
    }
    out = losses.loss_problems(losses.typed_losses(e, terms, {"charge": 9.0, "boundary": 0.5, "response": 2.0}))
    return rounded(out.select("charge", "boundary", "response", "factor", "invariant", "total", "n_charge", "n_boundary", "n_response", "n_invariant", F.size("problems").cast("bigint").alias("problems")))


MACRO = f"""
    {SCORED}, g AS (SELECT DISTINCT label FROM e), i0 AS (SELECT label, row_number() OVER (ORDER BY label % 16, label) - 1 AS idx, count(*) OVER () AS groups FROM g),
    d AS (SELECT r.rep, ('0x' || substr(md5('7|' || r.rep || '|' || i0.idx), 1, 8))::BIGINT % i0.groups AS pick FROM i0, range(0, 60) r(rep)),
    w AS (SELECT rep, label, count(*)::DOUBLE AS weight FROM d JOIN i0 ON i0.idx = d.pick GROUP BY 1, 2),
    l AS (SELECT label, i, sum(hot[i] * truth[i]) AS tp, sum(hot[i] * (1 - truth[i])) AS fp, sum((1 - hot[i]) * truth[i]) AS fn FROM h, range(1, 11) t(i) GROUP BY 1, 2),
    m AS (SELECT rep, i, sum(weight * tp) AS tp, sum(weight * fp) AS fp, sum(weight * fn) AS fn FROM l JOIN w USING (label) GROUP BY 1, 2),
    f AS (SELECT rep, avg(2 * tp / (2 * tp + fp + fn)) FILTER (WHERE tp + fn > 0) AS v FROM m GROUP BY 1),
    a AS (SELECT label, sum(abs(vec_id % 50 - label)) AS err, count(*) AS n FROM e WHERE list_sum(truth) = 1 GROUP BY 1),
    y AS (SELECT rep, sum(weight * err) / sum(weight * n) AS v FROM a JOIN w USING (label) GROUP BY 1)
"""


@query("b04_b10_evaluate", f"""
    WITH {MACRO} SELECT 'charge_macro_f1' AS metric, round((SELECT avg(2 * tp / (2 * tp + fp + fn)) FILTER (WHERE tp + fn > 0) FROM c), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM f
    UNION ALL SELECT 'sentence_mae', round((SELECT sum(err) / sum(n) FROM a), 6), round(quantile_cont(v, 0.025), 6), round(quantile_cont(v, 0.975), 6) FROM y""")
def b10(spark, sf_dir):
    """Intervals of the evaluation plan; macro averages count the labels of each resample."""
    none = F.array().cast("array<string>")
    rows = scored(spark, sf_dir).select(
        F.col("vec_id").alias("case_id"), F.col("label").alias("group_id"), F.col("truth").alias("true_charges"), C.thresholded("p", 0.15).alias("predicted_charges"), none.alias("unseen_true_charge_labels"),
        F.lit(None).cast("array<int>").alias("true_articles"), F.lit(None).cast("array<int>").alias("predicted_articles"), none.alias("unseen_true_article_labels"), F.lit("fixed_term").alias("penalty_type"),
        F.lit("fixed_term").alias("predicted_penalty_type"), (F.col("vec_id") % 50).cast("double").alias("true_months"), F.col("label").cast("double").alias("predicted_months"),
    )
    return rounded(evaluate.evaluate(rows, "static", 60, 7, F.col("group_id") % 16, ["charge_macro_f1", "sentence_mae"]), 6)


@query("t18_sentences", r"""
    WITH s AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '.;!?', '。；！？'), '[^。；！？\n]+[。；！？\n]?|[。；！？\n]') AS a FROM documents),
         u AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM s), v AS (SELECT doc_id, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS start FROM u)
    SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars, sum(start)::BIGINT AS starts FROM v WHERE regexp_matches(s, '[^。；！？\n]') GROUP BY 1""")
def t18s(spark, sf_dir):
    """Sentences of every document and where they start."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(edits.sentences(F.translate(F.coalesce("text", F.lit("")), ".;!?", "。；！？"))).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x.s")).alias("chars"), F.sum("x.start").alias("starts"))


FACTS = [
    "甲某在场。甲某窃取手机，价值3500元。", "甲某在场。甲某未退赃。", "甲某在场。甲某不但退赔，而且自首。", "甲某在场。乙某退赔。甲某系从犯。",
    "甲某在场。甲某系从犯，不是主犯。", "甲某在场。甲某某自首。", "甲某在场。甲某尚未自首。", "甲某在场。",
]


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of FACTS below its whole text: (doc_id, k, text, target, co)."""
    k = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(FACTS))).cast("int")
    fact = F.get(F.array(*[F.lit(f) for f in FACTS]), k)
    body = F.translate(F.coalesce("text", F.lit("")), ".,;!?", "。，；！？")
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k"), F.concat(body, F.lit("\n"), fact).alias("text"), F.lit("甲某").alias("target"), F.array(F.lit("乙某"), F.lit("甲某某")).alias("co"))


@query("t11_t12_t13_t14_t16_t17_t19_told_factors", """
    SELECT doc_id, CASE WHEN k = 0 THEN '3500.0' ELSE '-' END AS amount, CASE k WHEN 2 THEN 'true' WHEN 6 THEN 'false' ELSE '-' END AS surrender, CASE k WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE '-' END AS restitution,
           '-' AS confession, CASE WHEN k IN (3, 4) THEN 'accessory' ELSE 'unknown' END AS role, CASE WHEN k = 0 THEN '秘密窃取' ELSE '-' END AS conduct FROM (SELECT doc_id, doc_id % 8 AS k FROM documents)""")
def t11(spark, sf_dir):
    """Denied, absorbed and far negations, other persons' sentences and longer names, below whole documents."""
    f = factors.with_factors(told(spark, sf_dir), "text", "target", "co", "f")
    return f.select("doc_id", *[F.coalesce(F.col(f"f.{c}").cast("string"), F.lit("-")).alias(c) for c in ("amount", "surrender", "restitution", "confession", "role", "conduct")])


@query("w08_t19_told_own_text", r"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '.,;!?', '。，；！？') || chr(10) || CASE doc_id % 8 WHEN 0 THEN '甲某在场。甲某窃取手机，价值3500元。' WHEN 1 THEN '甲某在场。甲某未退赃。' WHEN 2 THEN '甲某在场。甲某不但退赔，而且自首。'
                      WHEN 3 THEN '甲某在场。甲某系从犯。' WHEN 4 THEN '甲某在场。甲某系从犯，不是主犯。' WHEN 6 THEN '甲某在场。甲某尚未自首。' ELSE '甲某在场。' END AS own FROM documents)
    SELECT doc_id, array_to_string(regexp_extract_all(own, '[^，。；！？\n]+[，。；！？\n]?'), '') AS own FROM t""")
def w08t(spark, sf_dir):
    """What of a whole document is about its person: sentences that name nobody stay, others' sentences go."""
    return told(spark, sf_dir).select("doc_id", factors.own_text(F.col("text"), F.col("target"), F.col("co")).alias("own"))


@query("t05_told_conclusions", """
    SELECT doc_id, translate(coalesce(text, ''), '.,;!?', '。，；！？') || chr(10) || '甲某窃取手机。[已屏蔽]。其余不变。' AS masked, 1::BIGINT AS n_masks FROM documents""")
def t05(spark, sf_dir):
    """A conclusion below every whole document is masked to the end of its sentence, and nothing else is."""
    body = F.translate(F.coalesce("text", F.lit("")), ".,;!?", "。，；！？")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(body, F.lit("\n甲某窃取手机。本院认为甲某构成盗窃罪。其余不变。")).alias("text"))
    d = d.select("doc_id", redact.conservative("text").alias("masked"))
    return d.select("doc_id", "masked", redact.mask_count("masked").cast("bigint").alias("n_masks"))


WRITTEN = ["", "甲某\n夺取手机", "丙某夺取手机", "甲某与乙某夺取手机", "甲某窃取手机", "甲某拿着手机", "甲某夺取手机"]


@query("t27_replacement_problems", """
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'empty_replacement' WHEN 1 THEN 'replacement_not_single_sentence' WHEN 2 THEN 'replacement_missing_target' WHEN 3 THEN 'replacement_mentions_other_defendant'
                            WHEN 4 THEN 'replacement_keeps_source_conduct' WHEN 5 THEN 'replacement_missing_target_conduct' ELSE '-' END AS problem FROM orders""")
def t27(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    written = F.get(F.array(*[F.lit(w) for w in WRITTEN]), (F.col("o_orderkey") % 7).cast("int"))
    found = edits.replacement_problem(F.lit("甲某窃取手机"), written, F.lit("甲某"), F.array(F.lit("乙某")), F.lit("秘密窃取"), F.lit("趁人不备公开夺取"))
    return o.select("o_orderkey", F.coalesce(found, F.lit("-")).alias("problem"))


@query("t20_mask_counts_of_marks", "SELECT o_orderkey, o_orderkey % 3 AS crosses, o_orderkey % 4 AS masks FROM orders")
def t20(spark, sf_dir):
    i = F.col("o_orderkey")
    text = F.concat(F.repeat(F.lit("某××"), (i % 3).cast("int")), F.lit("text"), F.repeat(F.lit("[已屏蔽]。"), (i % 4).cast("int")))
    crosses, masks = edits.mask_counts(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", crosses.cast("bigint").alias("crosses"), masks.cast("bigint").alias("masks"))


@query("a24_micro_f1", f"""
    WITH {SCORED}, s AS (SELECT truth, CASE WHEN list_max(p) >= 0.5 THEN list_transform(p, lambda x: CASE WHEN x >= 0.5 THEN 1 ELSE 0 END) ELSE list_transform(p, lambda x, i: CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) END AS hot FROM e)
    SELECT 0.5::DOUBLE AS threshold, round(2.0 * sum(list_sum(list_transform(hot, lambda x, i: x * truth[i]))) / sum(list_sum(hot) + list_sum(truth)), 9)::DOUBLE AS micro_f1 FROM s""")
def a24(spark, sf_dir):
    return rounded(metrics.tune_threshold(scored(spark, sf_dir), "p", "truth", [0.5]))


@query("f10_article_gate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def f10(spark, sf_dir):
    """The gate passes the rows that have article labels, and refuses the whole table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("articles_available"))
    good = o.where("articles_available")
    evaluate.require_article_labels(good)
    try:
        evaluate.require_article_labels(o)
    except ValueError:
        return good.select("o_orderkey")
    raise AssertionError("rows without article labels passed")


@query("k04_k05_written_lines", "SELECT count(*) AS n, count(*) AS read FROM conversations")
def k05(spark, sf_dir):
    path, c = folder(spark), table(spark, sf_dir, "conversations")
    n = sinks.write_json_lines(c, path, compressed=True)
    return spark.read.json(path).agg(F.lit(n).cast("bigint").alias("n"), F.count("*").alias("read"))


@query("t32_t33_f03_kinds_proposed", """
    SELECT doc_id, (k = 0)::INT::BIGINT AS invariant, 3::BIGINT AS flips, (k IN (1, 2))::INT::BIGINT AS ranks, CASE k WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS direction, CASE WHEN k = 0 THEN 3535.0 ELSE 0.0 END::DOUBLE AS amount
    FROM (SELECT doc_id, doc_id % 8 AS k FROM documents)""")
def t32(spark, sf_dir):
    """What is proposed for a single charge with a fixed term, by the factors that were found."""
    f = factors.with_factors(told(spark, sf_dir), "text", "target", "co", "factors")
    made = f.select(F.col("doc_id").alias("case_id"), F.col("target").alias("target_defendant"), F.col("co").alias("co_defendants"), "factors", F.array(F.lit("盗窃")).alias("charges"), F.lit("fixed_term").alias("penalty_type"), F.lit(12).alias("imprisonment_months"))
    out = interventions.propose(made, [["盗窃", "诈骗", "抢夺"], ["盗窃", "抢夺", "抢劫"]])
    kind = lambda t: F.count_if(F.col("intervention_type") == t)
    return out.groupBy(F.col("parent_case_id").alias("doc_id")).agg(
        kind("invariant").alias("invariant"), kind("charge_flip").alias("flips"), kind("sentence_rank").alias("ranks"), F.coalesce(F.max("rank_direction"), F.lit(0)).cast("bigint").alias("direction"),
        F.coalesce(F.max(F.when(F.col("intervention_type") == "invariant", F.col("target_factors.amount"))), F.lit(0.0)).alias("amount"),
    )


@query("t23_t26_amount_edits", """
    SELECT doc_id, 'span_free' AS kind, replace(translate(coalesce(text, ''), '.,;!?', '。，；！？') || chr(10) || '甲某在场。甲某窃取手机，价值3500元。', '3500元', '3535元') AS edited FROM documents WHERE doc_id % 8 = 0""")
def t23(spark, sf_dir):
    """The amount's own literal is rewritten, every other character of a whole document stays."""
    t = factors.with_factors(told(spark, sf_dir).where("k = 0"), "text", "target", "co", "source_factors")
    t = t.withColumn("target_factors", F.col("source_factors").withField("amount", F.lit(3535.0)))
    spec = F.struct(F.col("target").alias("target_defendant"), F.col("co").alias("co_defendants"), F.array(F.lit("amount")).alias("changed_fields"), "source_factors", "target_factors", F.lit(None).cast("string").alias("target_charge"))
    planned = edits.plan(t.withColumn("spec", spec), "text")
    return planned.select("doc_id", F.when(F.col("plan.kind").isin("span", "skip"), F.col("plan.kind")).otherwise("span_free").alias("kind"), F.col("plan.text").alias("edited"))


@query("s17_tail", "SELECT n_nationkey || ' ' || n_name AS value FROM nation ORDER BY n_nationkey DESC LIMIT 7")
def s17(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat_ws(" ", "n_nationkey", "n_name").alias("value")).write.text(path)
    return jsonl.tail(spark, path, 7).select("value")


@query("s09_s10_s11_k03_audit", """
    WITH l AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, n_nationkey, n_name || chr(10) AS line FROM nation)
    SELECT split, count(*) AS records, sum(length(line))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY n_nationkey)) AS sha256 FROM l GROUP BY 1""")
def s11(spark, sf_dir):
    """A file a split, and what the audit says of both."""
    path, n = folder(spark), table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    for split, rest in (("train", 0), ("test", 1)):
        n.where(F.col("n_nationkey") % 2 == rest).select("n_name").write.text(f"{path}/{split}")
    return audit.audit(spark, {s: f"{path}/{s}" for s in ("train", "test")}).select("split", "records", "bytes", "sha256")


@query("a28_folder_bytes", "SELECT 'r' || r_regionkey AS folder, 1::BIGINT AS files, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a28(spark, sf_dir):
    path = folder(spark)
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("folder"), "n_name").coalesce(1)
    n.write.partitionBy("folder").text(path)
    return audit.folder_bytes(spark, path).where(F.col("folder").contains("folder=")).select(F.regexp_extract("folder", "folder=(.*)$", 1).alias("folder"), "files", "bytes")


@query("k06_x03_x04_resumed_store", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS first, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS second, count(*) AS ids FROM orders")
def k06(spark, sf_dir):
    """A third of the requests is in the store; a second run adds the rest, a third one nothing."""
    path, asked = folder(spark), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation_id"))
    store.append(asked.where("generation_id % 3 = 0").withColumn("run", F.lit(1)), path)
    for run in (2, 3):
        store.append(store.pending(asked, spark.read.parquet(path)).withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("run") == 1).alias("first"), F.count_if(F.col("run") == 2).alias("second"), F.count_distinct("generation_id").alias("ids"))


@query("k07_published", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def k07(spark, sf_dir):
    path, o = folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    store.publish(o, path)
    store.publish(o.where("o_orderkey % 2 = 0"), path)
    return store.published(spark, path)


@query("x03_stream_append", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def x03(spark, sf_dir):
    """Events come twice as files of a stream; the store has each once."""
    path, e = folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (e.where("event_id % 2 = 0"), e):
        part.write.mode("append").parquet(f"{path}/in")
        append_new(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/progress", "event_id").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("x03_bucketed_append", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def x03_bucketed(spark, sf_dir):
    """The same into a store by buckets of ids, of which a micro-batch reads its own."""
    path, e = folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (e.where("event_id % 2 = 0"), e):
        part.write.mode("append").parquet(f"{path}/in")
        append_bucketed(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/progress", "event_id", 16).awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "x01_late_rows",
    """WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events WHERE event_id % 2 = 0)
       SELECT event_id % 2 AS half, CASE WHEN event_id % 2 = 1 AND ts < mark THEN 'late' ELSE 'rows' END AS side, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events, m GROUP BY 1, 2""",
)
def x01_late(spark, sf_dir):
    """The even events come first; of the odd ones those two hours behind them are late, and kept."""
    path, e = folder(spark), table(spark, sf_dir, "events").select("event_id", "ts")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{path}/in")
        route_late(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/progress").awaitTermination()
    sides = [spark.read.parquet(f"{path}/out/{s}").select((F.col("event_id") % 2).alias("half"), F.lit(s).alias("side"), "event_id") for s in ("rows", "late")]
    return sides[0].unionByName(sides[1]).groupBy("half", "side").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("x07_resumed_batches", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS ids, true AS tight FROM orders")
def x07(spark, sf_dir):
    """Batches before a cursor and those after it, together every row once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90 + 10).cast("int").alias("size"))
    made = batches.numbered(batches.token_batches(o, "size", 2048, 32, "o_orderkey", seed=3, epoch=1))
    late = batches.resumed(made, {"seed": 3, "epoch": 1, "start": 4}, 3, 1)
    whole = made.where("place < 4").unionByName(late)
    per = whole.groupBy("place").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"), (F.max("size") * F.count("*")).alias("area"))
    return per.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), ((F.max("area") <= 2048) & (F.max("n") <= 32)).alias("tight"))
