"""Further queries: small operators over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import batches, edits, interventions, metrics, prompts, redact, splits, store
from .operators.components import dense_index
from .queries import query, table


@query("t20_mask_counts", "SELECT doc_id, len(string_split(text, 'the')) - 1 AS n_the, len(regexp_extract_all(text, '[.!?]')) AS n_ends FROM documents")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("the")).alias("n_the"), F.regexp_count("text", F.lit("[.!?]")).alias("n_ends"))


@query("t21_splice", "SELECT conv_id, turn, left(text, 3) || 'NEW' || substr(text, 8) AS edited FROM conversations WHERE length(text) > 10 AND substr(text, 7, 1) NOT IN ('。', '；', '！', '？', chr(10))")
def t21(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.length("text") > 10).where(~F.substring("text", 7, 1).isin("。", "；", "！", "？", "\n"))
    return c.select("conv_id", "turn", edits.splice(F.col("text"), F.lit(3), F.lit(7), F.lit("NEW")).alias("edited"))


@query("t34_text_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def t34(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t35_json_field", "SELECT event_id, props->>'k' AS k, json_type(props) AS kind FROM events")
def t35(spark, sf_dir):
    v = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(v).startswith("OBJECT"), "OBJECT").otherwise(F.schema_of_variant(v))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), kind.alias("kind"))


@query("t35_answers", "SELECT event_id, CASE WHEN json_type(a, '$.kind') = 'VARCHAR' THEN a->>'kind' END AS kind, CASE WHEN json_type(a, '$.n') = 'VARCHAR' THEN a->>'n' END AS n FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE json_object('kind', event_type, 'n', user_id) END AS a FROM events)")
def t35a(spark, sf_dir):
    """Every seventh answer is no JSON; a number is no text."""
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{kind: "), "event_type")).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n"))))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", prompts.answer("raw", "kind").alias("kind"), prompts.answer("raw", "n").alias("n"))


@query(
    "p17_factor_targets",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS amount, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS surrender, o_orderstatus <> 'P' AS known,
              CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END::DOUBLE AS accessory FROM orders""",
)
def p17(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    f = F.struct(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("amount"), s.alias("surrender"), F.lit(None).cast("boolean").alias("restitution"), F.lit(None).cast("boolean").alias("confession"),
        F.when(F.col("o_orderpriority").startswith("1"), "accessory").otherwise("unknown").alias("role"), F.lit(None).cast("string").alias("conduct"),
    )
    t = C.factor_targets(f)
    return o.select("o_orderkey", F.get(t["targets"], F.lit(0)).alias("amount"), F.get(t["targets"], F.lit(1)).alias("surrender"), F.get(t["mask"], F.lit(1)).alias("known"), F.get(t["targets"], F.lit(4)).alias("accessory"))


@query(
    "p13_model_input",
    """SELECT doc_id, '[DATASET]' || chr(10) || source || chr(10) || chr(10) || '[TARGET_DEFENDANT]' || chr(10) || lang || chr(10) || chr(10) || '[FACT]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN text ELSE left(text, 5) END AS shown FROM documents""",
)
def p13(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = F.struct(
        F.col("source").alias("dataset"), F.col("lang").alias("target_defendant"), F.when(F.col("doc_id") % 2 == 0, "").alias("fact_strict"),
        F.when(F.col("doc_id") % 2 == 1, F.left("text", F.lit(5))).alias("fact_conservative"), F.col("text").alias("fact_raw"), F.lit(None).cast("array<string>").alias("co_defendants"),
    )
    return d.select("doc_id", C.model_input(r, with_factors=False).alias("shown"))


@query("p22_multi_hot", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS b1, CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END AS b2, CASE WHEN p_type = 'x' THEN 1 ELSE 0 END AS x FROM part")
def p22(spark, sf_dir):
    hot = C.multi_hot(F.array("p_brand", "p_type"), ["Brand#1", "Brand#2", "x"])
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(hot, F.lit(i)).alias(n) for i, n in enumerate(("b1", "b2", "x"))])


@query("f01_reassigned", """
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 0 WHEN doc_id % 10 = 8 THEN 1 ELSE 2 END AS s, sha256(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM documents),
         c AS (SELECT k, max(s) AS m, min(k) AS g FROM d GROUP BY 1)
    SELECT doc_id, 'docs-g' || left(g, 20) AS group_id FROM d JOIN c USING (k) WHERE s = m""")
def f01(spark, sf_dir):
    from .queries_text import split_docs

    d = split_docs(spark, sf_dir)
    return splits.reassign(d, splits.split_plan(d, "docs", near=False)).select("doc_id", "group_id")


@query("f05_known_targets", "SELECT vec_id, 'c' || label AS target_charge FROM embeddings WHERE vec_id % 2 = 0 OR label < 5")
def f05(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, "invariant").otherwise("charge_flip").alias("intervention_type"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("target_charge"))
    return interventions.known_targets(e, [f"c{i}" for i in range(5)]).select("vec_id", "target_charge")


@query("f07_f08_clean_records", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND l_linenumber <> 2")
def f07(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    v = F.struct((F.col("l_linestatus") == "O").alias("valid"), F.when(F.col("l_linenumber") == 2, F.array(F.lit("article_leakage"))).otherwise(F.array(F.lit("other"))).alias("errors"))
    return store.clean_records(l.select("l_orderkey", "l_linenumber", v.alias("validation"), (F.col("l_returnflag") == "R").alias("leakage"))).select("l_orderkey", "l_linenumber")


@query("f09_version_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'o_orderstatus is ' || o_orderstatus || ', not F' END AS gate_reason FROM orders")
def f09(spark, sf_dir):
    return store.version_gate(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, raise_=False).select("o_orderkey", "gate_reason")


@query("j05_backfill", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN '-1' WHEN label < 5 THEN label::VARCHAR ELSE '' END AS idx FROM embeddings")
def j05(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.col("vec_id").cast("string"))
    rows = e.select("vec_id", "case_id", F.lit("charge_flip").alias("intervention_type"), F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")).alias("parent_charge_indices"))
    parents = e.select("case_id", F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("charges"))
    out = store.backfill_parent_labels(rows, parents, [f"c{i}" for i in range(5)])
    return out.select("vec_id", F.array_join(F.transform("parent_charge_indices", lambda x: x.cast("string")), ",").alias("idx"))


@query("j13_neighbours", """
    WITH g(id, c) AS (VALUES (1, 'N'), (1, 'R'), (2, 'R'), (2, 'A'), (2, 'N'))
    SELECT f.c AS flag, string_agg(n.c, ',' ORDER BY n.o) AS near FROM (SELECT DISTINCT l_returnflag AS c FROM lineitem) f
    JOIN (SELECT a.c AS k, b.c, min(b.id * 10 + CASE WHEN b.id = 1 THEN CASE b.c WHEN 'N' THEN 1 ELSE 2 END ELSE CASE b.c WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END END) AS o FROM g a JOIN g b ON a.id = b.id AND a.c <> b.c GROUP BY 1, 2) n ON n.k = f.c GROUP BY 1""")
def j13(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag")).distinct()
    return f.select("flag", F.array_join(interventions.neighbours(F.col("flag"), [["N", "R"], ["R", "A", "N"]]), ",").alias("near"))


@query("j04_with_parents", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j04(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return store.with_parents(o, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey").select("o_orderkey", "c_mktsegment")


@query("w09_shards", "SELECT l_orderkey % 5 AS shard, count(*) AS n FROM lineitem GROUP BY 1")
def w09(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(batches.shard_of("l_orderkey", 5).alias("shard")).agg(F.count("*").alias("n"))


@query("w11_o07_epoch_order")
def w11(spark, sf_dir):
    return batches.epoch_order(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 1)


@query(
    "w11_o07_x07_places",
    """SELECT count(*) AS n, count(*) AS places, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS came_back, count(*) - count(*) // 3 AS left_over FROM lineitem""",
)
def w11_places(spark, sf_dir):
    """Every line item's place in a pass without a sort: a bijection of dense numbers whose inverse gives them back; a cursor at a third reads what is left."""
    per = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    idx = dense_index(per, F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(64)), ["l_orderkey", "l_linenumber"])
    n = per.count()
    at = batches.placed(idx, "idx", n, 3, 1).withColumn("back", batches.permuted(F.col("place"), n, 3, 1, back=True))
    return at.agg(
        F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"),
        F.count_if(F.col("back") == F.col("idx")).alias("came_back"), F.count_if(F.col("place") >= n // 3).alias("left_over"),
    )


@query("a25_o05_stable_sample")
def a25(spark, sf_dir):
    return metrics.stable_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("a27_redaction_counts", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n_new, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1")
def a27(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("category"))).alias("r"))
    return l.select("l_orderkey", redact.redaction_counts("r", "N").alias("n_new"), redact.redaction_counts("r", "R").alias("n_returned"))


@query("a29_a30_means_and_ratios", """
    SELECT l_suppkey, round(coalesce(sum(l_discount * l_tax) / nullif(sum(l_tax), 0), -1), 9) AS mean, round(coalesce(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 0), 9) AS ratio FROM lineitem GROUP BY 1""")
def a29(spark, sf_dir):
    m = metrics.weighted_mean(F.col("l_discount"), F.col("l_tax"))
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(m.alias("m"), C.ratio(F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_linestatus") == "F")).alias("r"))
    return out.select("l_suppkey", F.round(F.when(F.isnan("m"), -1.0).otherwise(F.col("m")), 9).alias("mean"), F.round("r", 9).alias("ratio"))


@query("o01_longest_first", "SELECT p_type AS name, row_number() OVER (ORDER BY length(p_type) DESC, p_type) AS place FROM (SELECT DISTINCT p_type FROM part)")
def o01(spark, sf_dir):
    return redact.lexicon(table(spark, sf_dir, "part"), "p_type")


@query(
    "t03_o01_surface_forms",
    """WITH l AS (SELECT DISTINCT p_type, p_brand FROM part),
            n AS (SELECT DISTINCT unnest(list_concat(string_split(p_type, ' '), [replace(p_type, ' ', '、')])) || p_brand AS name FROM l)
       SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS place FROM n""",
)
def t03(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("["), F.replace("p_type", F.lit(" "), F.lit("、")), F.lit("]"), "p_brand", F.lit("罪")).alias("label"))
    return redact.lexicon(part.distinct(), "label")


@query("u01_u05_splits_of_sources", "SELECT source, string_agg(DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END, ',' ORDER BY CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END) AS splits FROM documents GROUP BY 1")
def u01(spark, sf_dir):
    from .queries_text import split_docs

    d = split_docs(spark, sf_dir)
    parts = [d.where(F.col("split") == s).select("source", "split") for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))


@query("t39_rank_scores", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > l_linenumber * 8 THEN 1.0 WHEN l_quantity = l_linenumber * 8 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM lineitem")
def t39(spark, sf_dir):
    one = F.array(F.lit(0.5))
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("sentence_rank").alias("intervention_type"), F.lit(1).alias("rank_direction"), (F.col("l_linenumber") * 8.0).alias("parent_sentence"), F.col("l_quantity").alias("counterfactual_sentence"),
        one.alias("parent_charge_probabilities"), one.alias("counterfactual_charge_probabilities"), F.array(F.lit(0)).alias("parent_charge_indices"), F.lit(0).alias("target_charge"), F.lit(0.5).alias("charge_threshold"),
    )
    return metrics.counterfactual_values(l, 0.1).select("l_orderkey", "l_linenumber", F.col("rank_score").alias("score"))
