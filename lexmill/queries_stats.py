"""Queries of metrics, bootstrap and losses over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import bootstrap, losses, metrics
from .queries import query, table
from .streaming.append import session_counts, sliding_counts, windowed_counts


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten labels an embedding; its first ten places are scores, place i is true where place i+10 is positive."""
    e = table(spark, sf_dir, "embeddings")
    d = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", F.slice(d, 1, 10).alias("p"), F.transform(F.slice(d, 11, 10), lambda x: (x > 0.1).cast("int")).alias("truth"), F.slice(d, 21, 10).alias("q"))


SCORED = """
    e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS p, list_transform(embedding[11:20], lambda x: CASE WHEN x::DOUBLE > 0.1 THEN 1 ELSE 0 END) AS truth,
                 list_transform(embedding[21:30], lambda x: x::DOUBLE) AS q FROM embeddings),
    h AS (SELECT *, CASE WHEN list_max(p) >= 0.15 THEN list_transform(p, lambda x: CASE WHEN x >= 0.15 THEN 1 ELSE 0 END)
                         ELSE list_transform(p, lambda x, i: CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) END AS hot FROM e),
    c AS (SELECT i, sum(hot[i] * truth[i])::DOUBLE AS tp, sum(hot[i] * (1 - truth[i]))::DOUBLE AS fp, sum((1 - hot[i]) * truth[i])::DOUBLE AS fn FROM h, range(1, 11) t(i) GROUP BY 1)
"""


@query(
    "a16_a19_label_metrics",
    f"""WITH {SCORED}
        SELECT round(sum(tp) / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1,
               round(avg(coalesce(tp / nullif(tp + fp, 0), 0)) FILTER (WHERE tp + fn > 0), 9) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)) FILTER (WHERE tp + fn > 0), 9) AS macro_recall,
               round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FILTER (WHERE tp + fn > 0), 9) AS macro_f1,
               round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9) AS macro_precision_all_labels, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9) AS macro_recall_all_labels,
               round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1_all_labels FROM c""",
)
def a16(spark, sf_dir):
    m = metrics.label_metrics(metrics.label_counts(scored(spark, sf_dir).withColumn("hot", C.thresholded("p", 0.15)), "truth", "hot"))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("a16_row_agreement", f"WITH {SCORED} SELECT round(avg(CASE WHEN hot = truth THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy, round(avg(list_sum(list_transform(hot, lambda x, i: CASE WHEN x = truth[i] THEN 1 ELSE 0 END)) / 10.0), 9)::DOUBLE AS hamming_accuracy FROM h")
def a16r(spark, sf_dir):
    m = metrics.row_agreement(scored(spark, sf_dir).withColumn("hot", C.thresholded("p", 0.15)), "truth", "hot")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(
    "a19_label_counts_by_group",
    f"WITH {SCORED} SELECT label AS grp, '#' || (i - 1) AS place, sum(hot[i] * truth[i])::DOUBLE AS tp, sum(hot[i] * (1 - truth[i]))::DOUBLE AS fp, sum((1 - hot[i]) * truth[i])::DOUBLE AS fn FROM h, range(1, 11) t(i) GROUP BY 1, 2",
)
def a19(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("hot", C.thresholded("p", 0.15)).withColumnRenamed("label", "grp")
    return metrics.label_counts(rows, "truth", "hot", by=["grp"]).withColumnRenamed("label", "place")


@query("o02_argmax", f"WITH {SCORED} SELECT vec_id, list_position(p, list_max(p)) - 1 AS top FROM e")
def o02(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", C.first_argmax("p").alias("top"))


@query(
    "a23_tune_threshold",
    f"""WITH {SCORED},
        g AS (SELECT 0.05 * i AS thr FROM range(1, 8) t(i)),
        s AS (SELECT round(thr, 2)::DOUBLE AS thr, truth, CASE WHEN list_max(p) >= round(thr, 2)::DOUBLE THEN list_transform(p, lambda x: CASE WHEN x >= round(thr, 2)::DOUBLE THEN 1 ELSE 0 END)
                     ELSE list_transform(p, lambda x, i: CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) END AS hot FROM e, g),
        f AS (SELECT thr AS threshold, 2.0 * sum(list_sum(list_transform(hot, lambda x, i: x * truth[i]))) / sum(list_sum(hot) + list_sum(truth)) AS f1 FROM s GROUP BY 1)
        SELECT threshold, round(f1, 9)::DOUBLE AS micro_f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""",
)
def a23(spark, sf_dir):
    best = metrics.tune_threshold(scored(spark, sf_dir), "p", "truth", [round(0.05 * k, 2) for k in range(1, 8)])
    return best.select("threshold", F.round("micro_f1", 9).alias("micro_f1"))


@query(
    "a17_class_metrics",
    """WITH x AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN n_chars > 700 THEN 'good' WHEN n_chars > 300 THEN 'bad' ELSE 'odd' END AS p FROM labels JOIN documents USING (doc_id)),
         l AS (SELECT unnest(['good', 'bad', 'odd', 'none']) AS label),
         m AS (SELECT label, count(*) FILTER (WHERE t = label AND p = label)::DOUBLE AS tp, count(*) FILTER (WHERE t = label) AS a, count(*) FILTER (WHERE p = label) AS b FROM l, x GROUP BY 1)
       SELECT round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM x), 9)::DOUBLE AS accuracy, round(avg(coalesce(tp / nullif(b, 0), 0)), 9) AS macro_precision,
              round(avg(coalesce(tp / nullif(a, 0), 0)), 9) AS macro_recall, round(avg(coalesce(2 * tp / nullif(a + b, 0), 0)), 9) AS macro_f1 FROM m""",
)
def a17(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    t = F.when(F.col("quality") == 1, "good").otherwise("bad")
    p = F.when(F.col("n_chars") > 700, "good").when(F.col("n_chars") > 300, "bad").otherwise("odd")
    m = metrics.class_metrics(j, t, p, ["good", "bad", "odd", "none"])
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(
    "a18_month_metrics",
    """WITH x AS (SELECT l_returnflag, l_quantity AS p, p_size::DOUBLE AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O')
       SELECT l_returnflag, count(*) AS eligible_count, round(avg(abs(p - t)), 6) AS mae, round(avg(abs(ln(1 + p) - ln(1 + t))), 6) AS log_mae, round(avg(CASE WHEN abs(p - t) <= 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS tolerance_accuracy
       FROM x GROUP BY 1""",
)
def a18(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    j = l.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).where("l_linestatus = 'O'")
    m = metrics.month_metrics(j, "l_quantity", "p_size", F.col("l_linestatus") == "O", by=["l_returnflag"])
    return m.select("l_returnflag", "eligible_count", *[F.round(c, 6).alias(c) for c in ("mae", "log_mae", "tolerance_accuracy")])


LEVELS = """
    r AS (SELECT l_orderkey, l_quantity < 45 AS c, l_discount < 0.09 AS a, l_quantity::INT AS tm, (l_quantity + l_linenumber % 3)::INT AS pm FROM lineitem),
    s AS (SELECT *, CASE WHEN tm <= 6 THEN 0 WHEN tm <= 12 THEN 1 WHEN tm <= 24 THEN 2 WHEN tm <= 36 THEN 3 ELSE 4 END = CASE WHEN pm <= 6 THEN 0 WHEN pm <= 12 THEN 1 WHEN pm <= 24 THEN 2 WHEN pm <= 36 THEN 3 ELSE 4 END AS m FROM r),
    g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE c) AS r1, count(*) FILTER (WHERE c AND a) AS r2, count(*) FILTER (WHERE c AND a AND m) AS r3 FROM s GROUP BY 1)
"""
LEVEL_COLUMNS = "sum(n)::BIGINT AS defendant_count, count(*) AS case_count, " + ", ".join(
    f"round(sum({r}) / sum(n)::DOUBLE, 9) AS defendant_{k}_accuracy, round(avg(CASE WHEN {r} = n THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS case_{k}_accuracy" for k, r in (("charge", "r1"), ("charge_article", "r2"), ("full", "r3"))
)


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_quantity") < 45).alias("correct"), (F.col("l_discount") < 0.09).alias("article_correct"), F.lit("fixed_term").alias("penalty_type"),
        F.lit("fixed_term").alias("predicted_penalty_type"), F.col("l_quantity").cast("int").cast("double").alias("true_months"), (F.col("l_quantity") + F.col("l_linenumber") % 3).cast("int").cast("double").alias("predicted_months"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.case_levels(level_rows(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a22_case_accuracy", f"WITH {LEVELS} SELECT {LEVEL_COLUMNS} FROM g")
def a22(spark, sf_dir):
    return rounded(metrics.case_metrics(levels(spark, sf_dir)))


@query("a22_case_strata", f"WITH {LEVELS} SELECT n AS size, {LEVEL_COLUMNS} FROM g GROUP BY n")
def a22s(spark, sf_dir):
    return rounded(metrics.case_metrics(levels(spark, sf_dir).withColumn("size", F.col("defendants")), by=["size"]))


@query(
    "a21_counterfactual_metrics",
    f"""WITH {SCORED}, k AS (SELECT *, vec_id % 3 AS kind, label % 10 + 1 AS tgt, (label + 3) % 10 + 1 AS src, list_max(list_transform(p, lambda x, i: abs(x - q[i]))) AS drift, p[1] * 100 AS a, q[1] * 100 AS b,
                             CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END AS dir FROM e)
        SELECT count(*) FILTER (WHERE kind = 0) AS flip_count, round(avg(CASE WHEN q[tgt] >= 0.1 AND q[src] < 0.1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind = 0), 9)::DOUBLE AS flip_accuracy,
               round(avg(CASE WHEN list_position(q, list_max(q)) = tgt THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind = 0), 9)::DOUBLE AS flip_top1_accuracy, round(avg(q[tgt] - q[src]) FILTER (WHERE kind = 0), 9) AS flip_margin,
               count(*) FILTER (WHERE kind = 1) AS invariant_count, round(avg(CASE WHEN list_position(p, list_max(p)) <> list_position(q, list_max(q)) OR drift > 0.25 THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind = 1), 9)::DOUBLE AS invariant_violation_rate,
               round(avg(drift) FILTER (WHERE kind = 1), 9) AS invariant_charge_drift, round(avg(abs(b - a) / greatest(a, 1.0)) FILTER (WHERE kind = 1), 6) AS invariant_sentence_drift,
               count(*) FILTER (WHERE kind = 2) AS sentence_rank_count, round(avg(CASE WHEN dir * (b - a) > 0 THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END) FILTER (WHERE kind = 2), 9)::DOUBLE AS sentence_pairwise_accuracy,
               round(avg(CASE WHEN dir * (b - a) > 1.0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind = 2), 9)::DOUBLE AS sentence_pairwise_accuracy_margin FROM k""",
)
def a21(spark, sf_dir):
    e = scored(spark, sf_dir)
    kinds = F.array(F.lit("charge_flip"), F.lit("invariant"), F.lit("sentence_rank"))
    rows = e.select(
        F.get(kinds, (F.col("vec_id") % 3).cast("int")).alias("intervention_type"), (F.col("label") % 10).alias("target_charge"), F.array((F.col("label") + 3) % 10).alias("parent_charge_indices"), F.lit(0.1).alias("charge_threshold"),
        F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1).alias("rank_direction"), F.col("p").alias("parent_charge_probabilities"), F.col("q").alias("counterfactual_charge_probabilities"),
        (F.get("p", F.lit(0)) * 100).alias("parent_sentence"), (F.get("q", F.lit(0)) * 100).alias("counterfactual_sentence"),
    )
    m = metrics.counterfactual_metrics(rows, 0.25)
    return rounded(m.drop("sentence_rank_tie_rate", "monotonicity_violation_rate").withColumn("invariant_sentence_drift", F.round("invariant_sentence_drift", 6)))


@query(
    "a15_majority_and_mean",
    """SELECT (SELECT p_brand FROM part JOIN (SELECT p_brand AS b, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1) ON p_brand = b ORDER BY n DESC, f LIMIT 1) AS label,
              (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS n, round(avg(p_size), 9) AS mean_months FROM part""",
)
def a15(spark, sf_dir):
    out = metrics.majority_and_mean(table(spark, sf_dir, "part").withColumn("labels", F.array("p_brand")), "labels", "p_size", "p_partkey")
    return out.select("label", "n", F.round("mean_months", 9).alias("mean_months"))


@query("a26_best_row", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def a26(spark, sf_dir):
    return metrics.best_row(table(spark, sf_dir, "customer"), "c_name", "c_acctbal", "c_custkey")


BOOT = """
    s AS (SELECT user_id, sum(value) AS total, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS clicks FROM events GROUP BY 1),
    i AS (SELECT user_id, row_number() OVER (ORDER BY user_id % 16, user_id) - 1 AS idx, count(*) OVER () AS groups FROM s),
    d AS (SELECT r.rep, ('0x' || substr(md5('7|' || r.rep || '|' || i.idx), 1, 8))::BIGINT % i.groups AS pick FROM i, range(0, 100) r(rep)),
    w AS (SELECT rep, user_id, count(*)::DOUBLE AS weight FROM d JOIN i ON i.idx = d.pick GROUP BY 1, 2)
"""


def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"), F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"))


PAIR = {"mean_value": ("total", "n"), "click_share": ("clicks", "n")}


@query("b05_group_weights", f"WITH {BOOT} SELECT rep, user_id, weight FROM w")
def b05(spark, sf_dir):
    return bootstrap.group_weights(user_stats(spark, sf_dir), "user_id", 100, 7, F.col("user_id") % 16)


@query(
    "b01_b04_intervals",
    f"""WITH {BOOT}, m AS (SELECT rep, sum(weight * total) / sum(weight * n) AS mean_value, sum(weight * clicks) / sum(weight * n) AS click_share FROM w JOIN s USING (user_id) GROUP BY 1)
        SELECT 'mean_value' AS metric, round((SELECT sum(total) / sum(n) FROM s), 6) AS estimate, round(quantile_cont(mean_value, 0.025), 6) AS lower, round(quantile_cont(mean_value, 0.975), 6) AS upper FROM m
        UNION ALL SELECT 'click_share', round((SELECT sum(clicks) / sum(n) FROM s), 6), round(quantile_cont(click_share, 0.025), 6), round(quantile_cont(click_share, 0.975), 6) FROM m""",
)
def b04(spark, sf_dir):
    s = user_stats(spark, sf_dir)
    w = bootstrap.group_weights(s, "user_id", 100, 7, F.col("user_id") % 16)
    return rounded(bootstrap.intervals(s, bootstrap.replicate_means(s, w, "user_id", PAIR), PAIR), 6)


@query(
    "b06_b08_paired_holm",
    f"""WITH {BOOT}, r AS (SELECT user_id, total * (1 + (user_id % 3) * 0.01) AS rt, n AS rn, clicks + user_id % 2 AS rc FROM s),
        m AS (SELECT rep, sum(weight * total) / sum(weight * n) - sum(weight * rt) / sum(weight * rn) AS a, sum(weight * clicks) / sum(weight * n) - sum(weight * rc) / sum(weight * rn) AS b FROM w JOIN s USING (user_id) JOIN r USING (user_id) GROUP BY 1),
        t AS (SELECT 'mean_value' AS metric, (SELECT sum(total) / sum(n) - sum(rt) / sum(rn) FROM s JOIN r USING (user_id)) AS difference, quantile_cont(a, 0.025) AS lower, quantile_cont(a, 0.975) AS upper,
                     least(1.0, 2 * least((count(*) FILTER (WHERE a <= 0) + 1) / (count(*) + 1.0), (count(*) FILTER (WHERE a >= 0) + 1) / (count(*) + 1.0)))::DOUBLE AS p_value FROM m
              UNION ALL SELECT 'click_share', (SELECT sum(clicks) / sum(n) - sum(rc) / sum(rn) FROM s JOIN r USING (user_id)), quantile_cont(b, 0.025), quantile_cont(b, 0.975),
                     least(1.0, 2 * least((count(*) FILTER (WHERE b <= 0) + 1) / (count(*) + 1.0), (count(*) FILTER (WHERE b >= 0) + 1) / (count(*) + 1.0)))::DOUBLE FROM m)
        SELECT metric, round(difference, 6) AS difference, round(lower, 6) AS lower, round(upper, 6) AS upper, round(p_value, 6) AS p_value,
               round(max(least(1.0::DOUBLE, (2 - rn + 1) * p_value)) OVER (ORDER BY p_value, metric ROWS UNBOUNDED PRECEDING), 6) AS adjusted
        FROM (SELECT *, row_number() OVER (ORDER BY p_value, metric) AS rn FROM t)""",
)
def b06(spark, sf_dir):
    s = user_stats(spark, sf_dir)
    r = s.select("user_id", (F.col("total") * (1 + (F.col("user_id") % 3) * 0.01)).alias("total"), "n", (F.col("clicks") + F.col("user_id") % 2).alias("clicks"))
    w = bootstrap.group_weights(s, "user_id", 100, 7, F.col("user_id") % 16)
    return rounded(bootstrap.holm(bootstrap.paired_test(s, r, w, "user_id", PAIR)), 6)


@query("b04_b05_drawn_in_place")
def b04_drawn(spark, sf_dir):
    """Intervals over replicates whose weights are drawn where the groups are."""
    s = user_stats(spark, sf_dir)
    return rounded(bootstrap.intervals(s, bootstrap.drawn_means(s, PAIR, 100, 7), PAIR), 6)


@query("b06_b08_drawn_in_place")
def b06_drawn(spark, sf_dir):
    s = user_stats(spark, sf_dir)
    r = s.select("user_id", (F.col("total") * (1 + (F.col("user_id") % 3) * 0.01)).alias("total"), "n", (F.col("clicks") + F.col("user_id") % 2).alias("clicks"))
    return rounded(bootstrap.holm(bootstrap.drawn_paired_test(s, r, "user_id", PAIR, 100, 7)), 6)


@query(
    "j10_paired_rows",
    """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT k, sum(n) AS n, count(*) AS kinds FROM l GROUP BY 1)
       SELECT sum(n)::BIGINT AS row_count, count(*) AS unique_samples, count(*) FILTER (WHERE n > 1) AS repeated_samples, (sum(n) FILTER (WHERE n > 1))::BIGINT AS repeated_rows,
              count(*) FILTER (WHERE n > 1 AND kinds > 1) AS conflicting_truth_samples, 0::BIGINT AS mismatches FROM p""",
)
def j10(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return bootstrap.paired_rows(l, l, ["l_orderkey"], "l_returnflag", [])


@query(
    "j10_paired_mismatches",
    """WITH a AS (SELECT l_orderkey AS k, l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_orderkey AS k, l_returnflag AS g, count(*) AS n FROM lineitem WHERE NOT (l_linenumber = 1 AND l_orderkey % 10 = 0) GROUP BY 1, 2),
            p AS (SELECT k, sum(n) AS n, count(*) AS kinds FROM a GROUP BY 1)
       SELECT sum(n)::BIGINT AS row_count, count(*) AS unique_samples, count(*) FILTER (WHERE n > 1) AS repeated_samples, (sum(n) FILTER (WHERE n > 1))::BIGINT AS repeated_rows,
              count(*) FILTER (WHERE n > 1 AND kinds > 1) AS conflicting_truth_samples, (SELECT count(*) FROM a FULL JOIN b USING (k, g) WHERE a.n IS DISTINCT FROM b.n) AS mismatches FROM p""",
)
def j10m(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return bootstrap.paired_rows(l, l.where(~((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 10 == 0))), ["l_orderkey"], "l_returnflag", [])


@query(
    "l01_l03_losses",
    f"""WITH {SCORED}
        SELECT vec_id, round(list_sum(list_transform(p, lambda x, i: greatest(x, 0) - x * truth[i] + ln(1 + exp(-abs(x))))), 9) AS bce,
               round(ln(list_sum(list_transform(p, lambda x: exp(x)))) - p[label % 10 + 1], 9) AS cross_entropy,
               round(CASE WHEN abs(p[1] * 20 - q[1] * 20) < 1 THEN 0.5 * (p[1] * 20 - q[1] * 20) * (p[1] * 20 - q[1] * 20) ELSE abs(p[1] * 20 - q[1] * 20) - 0.5 END, 9) AS smooth_l1,
               round(list_sum(list_transform(p, lambda x, i: (x - q[i]) * (x - q[i]))), 9) AS shift FROM e""",
)
def l01(spark, sf_dir):
    e = scored(spark, sf_dir)
    return e.select(
        "vec_id", F.round(losses.bce("p", F.transform("truth", lambda t: t.cast("double"))), 9).alias("bce"), F.round(losses.cross_entropy("p", (F.col("label") % 10).cast("int")), 9).alias("cross_entropy"),
        F.round(losses.smooth_l1(F.get("p", F.lit(0)) * 20, F.get("q", F.lit(0)) * 20), 9).alias("smooth_l1"), F.round(losses.invariant_shift("p", "q"), 9).alias("shift"),
    )


@query(
    "t37_mixture",
    f"""WITH {SCORED} SELECT vec_id, round(list_sum(list_transform(p, lambda x, i: (1 / (1 + exp(-x))) * (greatest(q[i], 0) + ln(1 + exp(-abs(q[i])))))) / list_sum(list_transform(p, lambda x: 1 / (1 + exp(-x)))), 9) AS months FROM e""",
)
def t37(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", F.round(losses.mixture("p", "q"), 9).alias("months"))


@query("l10_mean_pool", "SELECT label, i - 1 AS i, round(avg(embedding[i]::DOUBLE), 6) AS v FROM embeddings, range(1, 65) t(i) WHERE vec_id % 3 <> 0 GROUP BY 1, 2")
def l10(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 3 != 0).alias("m"))
    return losses.mean_pool(e, "label", "v", "m").select("label", F.posexplode("v").alias("i", "v")).select("label", "i", F.round("v", 6).alias("v"))


@query("x01_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x01(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "x01_sessions",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
       g AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM e)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, island""",
)
def x01_sessions(spark, sf_dir):
    return session_counts(table(spark, sf_dir, "events"), "user_id").withColumn("total", F.round("total", 6))


@query(
    "x01_sliding_counts",
    """WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS window_start, value FROM events, (SELECT unnest([0, 1]) AS k))
       SELECT window_start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1""",
)
def x01_sliding(spark, sf_dir):
    return sliding_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("p20_prediction_rows")
def p20(spark, sf_dir):
    e = scored(spark, sf_dir)
    names = [f"c{i}" for i in range(10)]
    words = F.array(*[F.lit(n) for n in names])
    records = e.select(
        F.col("vec_id").cast("string").alias("case_id"), F.col("label").cast("string").alias("group_id"), (F.col("vec_id") % 7 != 0).alias("articles_available"),
        F.array_append(F.array_compact(F.transform("truth", lambda t, i: F.when(t == 1, F.get(words, i)))), F.when(F.col("vec_id") % 11 == 0, "other").otherwise("c0")).alias("charges"),
        F.array(F.lit("c1")).alias("conviction_articles"), F.col("p").alias("charge_probabilities"), F.col("q").alias("article_probabilities"), F.lit(0).alias("penalty_index"), F.lit(3.0).alias("sentence_months"),
        F.lit("fixed_term").alias("penalty_type"), F.lit(4).alias("imprisonment_months"),
    )
    out = metrics.static_predictions(records, names, names, ["fixed_term", "life"], 0.15)
    return out.select("case_id", "articles_available", F.array_join("predicted_charge_labels", ",").alias("predicted"), F.array_join("unseen_true_charge_labels", ",").alias("unseen"), "correct", "article_correct")
