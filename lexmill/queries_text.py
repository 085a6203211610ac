"""Queries of the text operators over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import presets
from .functions import columns as C
from .operators import batches, coverage, dedup, edits, factors, interventions, metrics, redact, splits, store
from .operators.components import connected
from .queries import query, table

SPLIT_SQL = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END"
KEY_SQL = r"sha256(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))"


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "valid").otherwise("test")
    return d.withColumn("split", split).withColumn("key", C.content_key("text"))


@query("p09_content_key", f"SELECT doc_id, {KEY_SQL} AS content_key FROM documents")
def p09(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.content_key("text").alias("content_key"))


@query(
    "p05_p06_p07_labels",
    """SELECT p_partkey, 'criminal_law:' || p_size || ':' || (p_partkey % 7 + 1) AS article,
              CASE WHEN p_type LIKE '%L' THEN left(p_type, length(p_type) - 1) ELSE p_type END AS bare,
              array_to_string(list_distinct_ordered, ' ') AS words
       FROM (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered
             FROM (SELECT *, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part))""",
)
def p05(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws("-", F.lpad(F.col("p_size").cast("string"), 4, "0"), (F.col("p_partkey") % 7 + 1).cast("string"))
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " "))
    return p.select("p_partkey", C.article_label(raw).alias("article"), C.without_suffix("p_type", "L").alias("bare"), F.array_join(words, " ").alias("words"))


@query(
    "p08_p10_ids",
    """SELECT o_orderkey,
              substr(sha256('{"cust":' || o_custkey || ',"prio":"' || o_orderpriority || '"}'), 1, 20) AS case_id,
              substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 24) AS request_id
       FROM orders""",
)
def p08(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    joined = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return o.select("o_orderkey", C.canonical_id(("prio", F.col("o_orderpriority")), ("cust", F.col("o_custkey"))).alias("case_id"), F.substring(F.sha2(joined, 256), 1, 24).alias("request_id"))


@query(
    "p11_w03_other_suppliers",
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
       SELECT a.l_orderkey, a.l_suppkey, coalesce(string_agg(b.l_suppkey::VARCHAR, ',' ORDER BY b.first, b.l_suppkey), '') AS others
       FROM f a LEFT JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2""",
)
def p11(spark, sf_dir):
    f = metrics.first_group_index(table(spark, sf_dir, "lineitem").withColumn("g", F.struct("l_orderkey", "l_suppkey")), "g", "l_linenumber").select("g.*", "first")
    whole = f.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("names"))
    per = whole.select("l_orderkey", "names", F.explode("names").alias("l_suppkey"))
    return per.select("l_orderkey", "l_suppkey", F.array_join(F.transform(C.others("names", "l_suppkey"), lambda x: x.cast("string")), ",").alias("others"))


@query(
    "p01_p16_penalty_classes",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS death, l_linestatus = 'F' AS life,
                         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity::INT - 5 END AS months FROM lineitem),
         y AS (SELECT *, CASE WHEN death THEN 'death' WHEN life THEN 'life' WHEN months IS NULL OR months <= 0 THEN 'exempt' ELSE 'fixed_term' END AS penalty FROM x)
       SELECT penalty,
              CASE WHEN penalty <> 'fixed_term' THEN penalty WHEN months <= 6 THEN 'fixed_term_0_6' WHEN months <= 12 THEN 'fixed_term_7_12'
                   WHEN months <= 24 THEN 'fixed_term_13_24' WHEN months <= 36 THEN 'fixed_term_25_36' WHEN months <= 60 THEN 'fixed_term_37_60'
                   WHEN months <= 120 THEN 'fixed_term_61_120' ELSE 'fixed_term_121_plus' END AS class, count(*) AS n
       FROM y GROUP BY 1, 2""",
)
def p01(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("death"), (F.col("l_linestatus") == "F").alias("life"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int") - 5).alias("months"))
    x = x.withColumn("penalty", C.simple_penalty("death", "life", "months"))
    return x.groupBy("penalty", C.sentence_class("penalty", "months").alias("class")).agg(F.count("*").alias("n"))


@query(
    "p14_a07_length_buckets",
    """SELECT CASE WHEN n_chars < 512 THEN 'lt_512' WHEN n_chars < 1024 THEN '512_to_1023' WHEN n_chars < 2048 THEN '1024_to_2047'
                   WHEN n_chars < 4096 THEN '2048_to_4095' ELSE 'ge_4096' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
)
def p14(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(C.length_bucket("n_chars").alias("bucket")).agg(F.count("*").alias("n"))


@query("p12_first_filled", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), '') AS chosen FROM documents")
def p12(spark, sf_dir):
    i = F.col("doc_id")
    a = F.when(i % 3 == 0, "").when(i % 3 == 2, F.col("lang"))
    b = F.when(i % 2 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", C.first_filled(a, b).alias("chosen"))


@query(
    "f12_j14_t33_amounts",
    """WITH e AS (SELECT unnest([1000.0, 2000.0, 3000.0, 5000.0, 6000.0, 10000.0, 20000.0, 30000.0, 50000.0, 60000.0, 100000.0, 200000.0, 300000.0, 400000.0, 500000.0, 1000000.0, 3000000.0, 5000000.0])::DOUBLE AS edge)
       SELECT o_orderkey, (SELECT count(*) FROM e WHERE edge <= o_totalprice) AS band,
              abs(o_totalprice - (o_totalprice + (o_orderkey % 5) * 0.0005)) <= least(greatest(0.0001, greatest(abs(o_totalprice), abs(o_totalprice + (o_orderkey % 5) * 0.0005)) * 1e-8), nullif(abs(o_totalprice - (o_totalprice + 0.002)), 0) / 2) AS same
       FROM orders""",
)
def f12(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.band_of(p).cast("long").alias("band"), C.amounts_match(p, p + (F.col("o_orderkey") % 5) * 0.0005, p + 0.002).alias("same"))


@query(
    "t09_t10_amounts_in_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) * 10000 ELSE floor(o_totalprice) END AS amount, 2 AS n_amounts,
              (CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) * 10000 ELSE floor(o_totalprice) END) + o_custkey AS total FROM orders""",
)
def t09(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    unit = F.when(F.col("o_orderkey") % 3 == 0, "万元").otherwise("元")
    text = F.concat(F.lit("被告人窃取财物，价值人民币"), F.floor("o_totalprice").cast("string"), unit, F.lit("。另退还"), F.col("o_custkey").cast("string"), F.lit("元。"))
    o = o.withColumn("t", text)
    found = C.amounts_in("t")
    return o.select("o_orderkey", C.amount_in("t").alias("amount"), F.size(found).alias("n_amounts"), F.aggregate(found, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("t24_format_amount", "SELECT p_partkey, regexp_replace(printf('%.2f', p_retailprice), '\\.?0+$', '') AS shown FROM part")
def t24(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.format_amount("p_retailprice").alias("shown"))


@query(
    "u06_novel_ngrams",
    """WITH p AS (SELECT b.item_id, d.doc_id, b.text AS a, d.text AS t
                  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
         g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(t) - 6, 1)), lambda i: substr(t, i, 8))) AS own,
                      list_distinct(list_transform(range(1, greatest(length(a) - 6, 1)), lambda i: substr(a, i, 8))) AS base FROM p)
       SELECT item_id, round(CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_filter(own, lambda x: NOT list_contains(base, x)))::DOUBLE / len(own) END, 9) AS novel FROM g""",
)
def u06(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    j = b.join(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("item_id") == F.col("doc_id"))
    return j.select("item_id", F.round(C.novel_ngrams("a", "text"), 9).alias("novel"))


@query(
    "w01_first_of_each",
    "SELECT source, text_key, doc_id FROM (SELECT source, left(" + KEY_SQL + ", 12) AS text_key, doc_id, row_number() OVER (PARTITION BY source, " + KEY_SQL + " ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
)
def w01(spark, sf_dir):
    first = splits.first_of_each(split_docs(spark, sf_dir), ["source", "key"], ["doc_id"])
    return first.select("source", F.substring("key", 1, 12).alias("text_key"), "doc_id")


@query(
    "a04_drop_counts",
    f"""WITH d AS (SELECT doc_id, source, {SPLIT_SQL} AS split, {KEY_SQL} AS key FROM documents),
          c AS (SELECT key, CASE max(CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS assigned FROM d GROUP BY 1),
          p AS (SELECT split, source, count(*) AS n, count(*) FILTER (WHERE split = assigned) AS k FROM d JOIN c USING (key) GROUP BY 1, 2)
       SELECT split, sum(n)::BIGINT AS units, sum(k)::BIGINT AS kept, sum(n - k)::BIGINT AS dropped, sum(greatest(k - 1, 0))::BIGINT AS repeated_ids FROM p GROUP BY 1""",
)
def a04(spark, sf_dir):
    d = split_docs(spark, sf_dir)
    return splits.drop_counts(d, splits.split_plan(d, "docs", near=False), unit="source")


@query(
    "a01_a02_unseen_labels",
    f"""WITH d AS (SELECT doc_id, source || ':' || (doc_id % 37) AS label, {SPLIT_SQL} AS split FROM documents)
       SELECT split, count(*) AS units, count(*) FILTER (WHERE label NOT IN (SELECT label FROM d WHERE split = 'train')) AS unseen FROM d GROUP BY 1""",
)
def a01(spark, sf_dir):
    d = split_docs(spark, sf_dir).withColumn("labels", F.array(F.concat_ws(":", "source", (F.col("doc_id") % 37).cast("string"))))
    return splits.unseen_counts(d, "labels", splits.vocabulary(d, "labels"), "doc_id")


@query("a03_reason_counts", "SELECT r.reason, (SELECT count(*) FROM lineitem WHERE l_linenumber > 3 AND 'line_' || l_linenumber = r.reason) AS n FROM (VALUES ('line_4'), ('line_5'), ('line_6'), ('line_7'), ('line_9')) r(reason)")
def a03(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 3, F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))).alias("reason"))
    return splits.reason_counts(l, "reason", ["line_4", "line_5", "line_9"])


@query("s_groups_in_two_splits", "SELECT l_suppkey AS group_id, count(DISTINCT l_orderkey % 3) AS n_splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 3) > 1")
def s_groups(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group_id"), (F.col("l_orderkey") % 3).alias("split"))
    return splits.groups_in_two_splits(l)


A, B = dedup.coefficients()
NORM = r"regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')"
SIG_SQL = f"""
    n AS (SELECT DISTINCT {NORM} AS t FROM documents),
    s AS (SELECT sha256(t) AS key, list_distinct(CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 3), lambda i: list_reduce(list_transform(range(0, 5), lambda k: unicode(substr(t, i + k, 1))::BIGINT), lambda h, c: (h * 1000003 + c) % 2147483647))
                 WHEN t = '' THEN [0::BIGINT]
                 ELSE [list_reduce(list_transform(range(0, length(t)), lambda k: unicode(substr(t, k + 1, 1))::BIGINT), lambda h, c: (h * 1000003 + c) % 2147483647)] END) AS hs FROM n),
    f AS (SELECT key, unnest(hs) AS h FROM s),
    m AS (SELECT key, {', '.join(f'min((h * {a} + {b}) % 2147483647) AS m{i}' for i, (a, b) in enumerate(zip(A, B)))} FROM f GROUP BY key)
"""


@query("t02_minhash", f"WITH {SIG_SQL} SELECT key, {' || chr(44) || '.join(f'm{i}' for i in range(64))} AS signature FROM m")
def t02(spark, sf_dir):
    sig = dedup.signatures(table(spark, sf_dir, "documents"))
    return sig.select("key", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


@query("t02_minhash_native", f"WITH {SIG_SQL} SELECT key, {' || chr(44) || '.join(f'm{i}' for i in range(64))} AS signature FROM m")
def t02n(spark, sf_dir):
    sig = dedup.native_signatures(table(spark, sf_dir, "documents"))
    return sig.select("key", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


def signed(spark, sf_dir):
    d = split_docs(spark, sf_dir)
    held = d.groupBy("key").agg(F.max(splits.priority(F.col("split"))).alias("p")).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), F.col("p") + 1))
    return dedup.signatures(d).join(held.select("key", "split"), "key")


# agreement of 58 places in 64 leaves two bands of eight equal at least, so the band join is exact
PAIR_SQL = SIG_SQL + f"""    , held AS (SELECT {KEY_SQL} AS key, max(CASE WHEN doc_id % 10 < 8 THEN 0 WHEN doc_id % 10 = 8 THEN 1 ELSE 2 END) AS p FROM documents GROUP BY 1),
    z AS (SELECT key, ['train', 'valid', 'test'][p + 1] AS split, [{', '.join(f'm{i}' for i in range(64))}] AS sig FROM m JOIN held USING (key)),
    b AS (SELECT key, split, sig, i AS band, sig[i * 8 + 1:i * 8 + 8] AS block FROM z, range(0, 8) t(i)),
    pairs AS (SELECT DISTINCT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b FROM b x JOIN b y ON x.band = y.band AND x.block = y.block AND x.split < y.split
              WHERE list_sum(list_transform(x.sig, lambda v, i: CASE WHEN v = y.sig[i] THEN 1 ELSE 0 END)) / 64.0 >= 0.9),
    l2 AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(node, root) AS (SELECT a, a FROM l2 UNION SELECT l2.b, r.root FROM r JOIN l2 ON l2.a = r.node),
    roots AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
"""


@query("j01_cross_near_duplicates", f"WITH RECURSIVE {PAIR_SQL} SELECT a, b FROM pairs")
def j01(spark, sf_dir):
    return dedup.cross_near_duplicates(signed(spark, sf_dir))


@query("j02_components", f"WITH RECURSIVE {PAIR_SQL} SELECT node, root FROM roots WHERE root < node")
def j02(spark, sf_dir):
    return connected(dedup.cross_links(signed(spark, sf_dir)))


@query(
    "a05_a06_split_plan_near",
    f"""WITH RECURSIVE {PAIR_SQL}, k AS (SELECT DISTINCT {KEY_SQL} AS key, CASE WHEN doc_id % 10 < 8 THEN 0 WHEN doc_id % 10 = 8 THEN 1 ELSE 2 END AS s FROM documents),
        c AS (SELECT key, s, coalesce(root, key) AS cluster FROM k LEFT JOIN roots ON node = key)
        SELECT 'docs-g' || left(min(key), 20) AS group_id, ['train', 'valid', 'test'][max(s) + 1] AS assigned, count(DISTINCT key) AS n_keys, count(DISTINCT s) AS n_splits FROM c GROUP BY cluster""",
)
def a05(spark, sf_dir):
    plan = splits.split_plan(split_docs(spark, sf_dir), "docs")
    return plan.groupBy("group_id", "assigned").agg(F.count("*").alias("n_keys"), F.max("n_splits").alias("n_splits"))


@query(
    "j02_components_by_links",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 10 AS a, l_partkey * 10 + 1 AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 49),
       l2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
       r(node, root) AS (SELECT a, a FROM l2 UNION SELECT l2.b, r.root FROM r JOIN l2 ON l2.a = r.node)
       SELECT node, min(root) AS root FROM r GROUP BY 1 HAVING min(root) < node""",
)
def j02_links(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity >= 49")
    return connected(l.select((F.col("l_suppkey") * 10).alias("a"), (F.col("l_partkey") * 10 + 1).alias("b")))


@query("j02_components_all_links")
def j02_all(spark, sf_dir):
    """The components over every row of lineitem; j02_components_by_links takes the few links that its recursive SQL can follow."""
    l = table(spark, sf_dir, "lineitem")
    return connected(l.select((F.col("l_suppkey") * 10).alias("a"), (F.col("l_partkey") * 10 + 1).alias("b")))


@query(
    "w02_first_groups",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT conv_id, min(conv_id * 1000 + turn) AS f FROM conversations GROUP BY 1 ORDER BY f, conv_id LIMIT 25))",
)
def w02(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return splits.first_groups(c, "conv_id", "ord", 25).select("conv_id", "turn", "role")


@query(
    "t05_masked_conclusions",
    """SELECT page_id, regexp_replace(url, '(?:example|www)[^/]*', '[已屏蔽]', 'g') AS masked, len(regexp_extract_all(url, 'example|www')) AS n_marks FROM pages""",
)
def t05(spark, sf_dir):
    import re

    p = table(spark, sf_dir, "pages")
    shown = F.regexp_replace("url", "(?:example|www)[^/]*", re.escape(presets.MASK))
    return p.select("page_id", shown.alias("masked"), F.regexp_count("url", F.lit("example|www")).alias("n_marks"))


CASES = [
    (1, "公诉机关指控被告人甲窃取手机，价值3500元。本院认为其行为构成盗窃罪，应当依法惩处。", "甲", ["乙"]),
    (2, "被告人甲曾因盗窃被从重处罚，后主动投案，如实供述。依照《刑法》第二百六十四条之一判处。", "甲", []),
    (3, "甲与乙共谋。乙骗取现金2万元，甲未退赃。甲不但退赔而且认罪。", "甲", ["乙", "甲乙丙"]),
    (4, "丙因琐事随意殴打他人，致人轻伤，系从犯，尚未自首。", "丙", []),
    (5, "", "丁", []),
]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a case (doc_id, text, target, co): its whole text with the marks that end sentences here, then one of CASES in turn. The persons are named by the text's own first words."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.substring("text", 1, 400), r"[\s\p{P}]+"), lambda w: w != "")
    d = d.select("doc_id", "text", F.array_distinct(F.slice(words, 1, 6)).alias("w"))
    d = d.withColumns({"target": F.coalesce(F.get("w", F.lit(0)), F.lit("甲")), "co": F.coalesce(F.slice("w", 2, 3), F.array().cast("array<string>"))})
    facts = F.array(*[F.lit(c[1]) for c in CASES])
    fact = F.get(facts, F.coalesce(F.pmod("doc_id", F.lit(len(CASES))), F.lit(0)).cast("int"))
    fact = F.replace(F.replace(fact, F.lit("甲"), F.col("target")), F.lit("乙"), F.coalesce(F.get("co", F.lit(0)), F.lit("乙")))
    body = F.translate(F.coalesce("text", F.lit("")), ".,;!?", "。，；！？")
    return d.select("doc_id", F.concat(body, F.lit("\n"), fact).alias("text"), "target", "co")


@query("t07_redaction")
def t07(spark, sf_dir):
    out = redact.redact(cases(spark, sf_dir), names=["走私、贩卖毒品", "走私毒品", "贩卖毒品", "盗窃"], keep=["doc_id"])
    return out.select("doc_id", "fact_conservative", "fact_strict", F.size("redactions").alias("n_redactions"), F.to_json("redactions").alias("redactions"))


# rules for the prose of the tables, without look-around, so that SQL can state them as well
PROSE = presets.Rules(statement="http[^ ]*", strong="[Tt]he | la ", weak="", history="", article="[0-9]+", cued=" of [a-z]+", mentions=("NAME[,.]",), stops=".;!?\\n", pauses=",", mask="#")


@query(
    "t06_t08_redaction_of_prose",
    r"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '(?:[Tt]he | la )[^.;!?\n]*|http[^ ]*', '#', 'g') AS mild FROM documents),
             s AS (SELECT *, regexp_extract_all(t, '(?:[Tt]he | la )[^.;!?\n]*') AS c, regexp_extract_all(mild, '[0-9]+') AS a, regexp_extract_all(mild, ' of [a-z]+') AS o,
                          regexp_extract_all(mild, '(?:der|tion)[,.]') AS n FROM m)
        SELECT doc_id, mild, regexp_replace(mild, '[0-9]+|(?: of [a-z]*)?(?:der|tion)[,.]| of [a-z]+', '#', 'g') AS strict, len(c) AS n_conclusions, len(a) AS n_articles, len(o) + len(n) AS n_charges,
               CASE WHEN len(c) > 0 THEN instr(t, c[1]) - 1 ELSE -1 END AS first_start FROM s""",
)
def t06(spark, sf_dir):
    out = redact.redact(table(spark, sf_dir, "documents"), names=["tion", "der"], keep=["doc_id"], rules=PROSE)
    first = F.filter("redactions", lambda r: r["category"] == "conclusion")
    return out.select(
        "doc_id", F.col("fact_conservative").alias("mild"), F.col("fact_strict").alias("strict"), *[redact.redaction_counts("redactions", c).alias(f"n_{c}s") for c in ("conclusion", "article", "charge")],
        F.coalesce(F.get(first, F.lit(0))["start"], F.lit(-1)).alias("first_start"),
    )


@query("t05_conservative_native")
def t05n(spark, sf_dir):
    masked = cases(spark, sf_dir).select("doc_id", redact.conservative("text").alias("masked"))
    return masked.withColumn("n_masks", redact.mask_count("masked"))


@query("t11_t17_factors")
def t17(spark, sf_dir):
    return factors.with_factors(cases(spark, sf_dir), "text", "target", "co", "f").select("doc_id", "f.*")


@query("w08_own_text")
def w08(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", factors.own_text(F.col("text"), F.col("target"), F.col("co")).alias("own"))


@query("w04_focus")
def w04(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", C.focus("text", "target", "co", 30).alias("focused"))


FACTORS = "struct<amount:double,surrender:boolean,restitution:boolean,confession:boolean,role:string,conduct:string>"
EDITS = [
    ("amount", "甲窃取手机，价值3500元。案发后甲退赔。", "甲", [], ["amount"], (3500.0, None, True, None, "unknown", "秘密窃取"), (3535.0, None, True, None, "unknown", "秘密窃取"), None),
    ("restitution", "李某窃取手机，价值3500元。李某A望风，已退赔。李某未退赃。", "李某", ["李某A"], ["restitution"], (3500.0, None, False, None, "unknown", "秘密窃取"), (3500.0, None, True, None, "unknown", "秘密窃取"), None),
    ("flip", "张某因琐事与他人发生纠纷，致其轻伤二级。张某自首。", "张某", [], ["conduct"], (None, True, None, None, "unknown", "因个人纠纷定向伤害"), (None, True, None, None, "unknown", "无事生非随意殴打"), "寻衅滋事"),
    ("two places", "丁某盗走手机。丁某又盗走电脑。", "丁某", [], ["conduct"], (None, None, None, None, "unknown", "秘密窃取"), (None, None, None, None, "unknown", "趁人不备公开夺取"), "抢夺"),
    ("shared", "李某与王某共同窃取手机，案发后已退赃。", "李某", ["王某"], ["restitution"], (None, None, None, None, "unknown", "秘密窃取"), (None, None, True, None, "unknown", "秘密窃取"), None),
    ("initial", "丁某与戊某同行，丁盗走手机。", "丁某", ["戊某"], ["conduct"], (None, None, None, None, "unknown", "秘密窃取"), (None, None, None, None, "unknown", "趁人不备公开夺取"), "抢夺"),
]


@query("t18_t31_edits")
def t18(spark, sf_dir):
    made = spark.createDataFrame(EDITS, f"name string, text string, target_defendant string, co_defendants array<string>, changed_fields array<string>, source_factors {FACTORS}, target_factors {FACTORS}, target_charge string")
    spec = F.struct(*[F.col(c) for c in made.columns if c not in ("name", "text")])
    planned = edits.plan(made.withColumn("spec", spec))
    written = F.lit("张某无事生非，随意殴打他人，致其轻伤二级")
    result = F.when(F.col("plan.kind") == "span", edits.splice(F.col("plan.text"), F.col("plan.start"), F.col("plan.start") + F.length("plan.quote"), written)).otherwise(F.col("plan.text"))
    done = planned.withColumn("edited", result).withColumn("like", batches.similarity("text", "edited"))
    return edits.validate(done, "text", "edited", similarity="like", out="v").select("name", "plan.kind", "plan.reason", "edited", F.round("like", 6).alias("similarity"), F.col("v.valid").alias("valid"), F.array_join("v.errors", ",").alias("errors"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for every document: factors found in its case, a charge or two and a penalty by its id. The parent is (doc_id, text)."""
    i = F.coalesce("doc_id", F.lit(0))
    made = factors.with_factors(cases(spark, sf_dir), "text", "target", "co", "factors").select(
        F.struct("doc_id", "text").alias("case_id"), F.col("target").alias("target_defendant"), F.col("co").alias("co_defendants"), "factors",
        F.when(i % 7 == 0, F.array(F.lit("赌博"), F.lit("盗窃"))).when(i % 2 == 0, F.array(F.lit("盗窃"))).otherwise(F.array(F.lit("抢夺"))).alias("charges"),
        F.when(i % 11 == 0, "life").otherwise("fixed_term").alias("penalty_type"), F.when(i % 11 != 0, (F.pmod(i, F.lit(120)) + 1).cast("int")).alias("imprisonment_months"),
    )
    return interventions.propose(made, [["盗窃", "诈骗", "抢夺"], ["盗窃", "抢夺", "抢劫"]])


@query("t32_proposals")
def t32(spark, sf_dir):
    out = proposals(spark, sf_dir)
    return out.select(F.col("parent_case_id.doc_id").alias("parent_case_id"), "ord", "intervention_type", "target_charge", "rank_direction", "rule_id", F.col("target_factors.amount").alias("amount"), F.col("target_factors.conduct").alias("conduct"), F.col("target_factors.restitution").alias("restitution"))


@query(
    "f03_f04_rank_exclusions",
    """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'not_single_charge' WHEN o_orderstatus <> 'F' THEN 'penalty_' || o_orderstatus WHEN o_custkey % 5 = 0 THEN 'missing_months'
                   WHEN o_custkey % 7 = 0 THEN 'unknown_restitution' ELSE 'eligible' END AS reason, count(*) AS n FROM orders GROUP BY 1""",
)
def f03(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reason = C.rank_exclusion(
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))), F.when(F.col("o_orderstatus") == "F", "fixed_term").otherwise(F.col("o_orderstatus")),
        F.when(F.col("o_custkey") % 5 != 0, F.lit(3)), F.when(F.col("o_custkey") % 7 != 0, F.lit(True)),
    )
    return o.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "j08_resume",
    """WITH r AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber <= 2), s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)
       SELECT count(*) AS requested, count(DISTINCT id) FILTER (WHERE id IN (SELECT id FROM s)) AS resumed, count(*) - count(DISTINCT id) AS duplicate,
              count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT id FROM s)) AS new FROM r""",
)
def j08(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("generation_id"))
    s = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("generation_id"))
    return store.resume_counts(r, s)


@query("j08_pending", "SELECT DISTINCT l_orderkey AS generation_id FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def j08p(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("generation_id"))
    return store.pending(r, table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("generation_id")))


@query(
    "j09_view_problems",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders WHERE o_orderkey % 50 = 0),
         s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 700 = 0 THEN -1 ELSE o_custkey END AS c FROM orders WHERE o_orderkey % 300 <> 0)
       SELECT r.id AS generation_id, CASE WHEN s.id IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM r LEFT JOIN s USING (id) WHERE s.id IS NULL OR r.c <> s.c""",
)
def j09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation_id"), F.col("o_custkey").alias("c"))
    i = F.col("generation_id")
    held = o.where(i % 300 != 0).withColumn("c", F.when(i % 700 == 0, F.lit(-1).cast("long")).otherwise(F.col("c")))
    return store.view_problems(o, held, same=["c"])


@query("j04_orphans", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def j04(spark, sf_dir):
    return store.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey < 20"), "o_custkey", "c_custkey").select("o_custkey").distinct()


@query("j07_u04_shared_groups", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0 INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 1")
def j07(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return store.same_groups(l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 2 = 1"), "l_suppkey")


@query(
    "a08_a10_parent_table",
    """WITH p AS (SELECT l_orderkey, l_linenumber, length(l_returnflag || l_linestatus) * l_quantity::INT * 40 AS chars, l_returnflag, l_linenumber AS dc FROM lineitem),
         r AS (SELECT 'count' AS part, 'defendant_record' AS name FROM p
               UNION ALL SELECT 'length_bucket', CASE WHEN chars < 512 THEN 'lt_512' WHEN chars < 1024 THEN '512_to_1023' WHEN chars < 2048 THEN '1024_to_2047' WHEN chars < 4096 THEN '2048_to_4095' ELSE 'ge_4096' END FROM p
               UNION ALL SELECT 'charge', l_returnflag FROM p
               UNION ALL SELECT 'count', 'case' FROM (SELECT DISTINCT l_orderkey FROM p)
               UNION ALL SELECT 'defendants_per_case', max(dc)::VARCHAR FROM p GROUP BY l_orderkey)
       SELECT part, name, count(*) AS n FROM r GROUP BY 1, 2""",
)
def a08(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.col("l_orderkey").alias("case_group_id"), (2 * F.col("l_quantity").cast("int") * 40).alias("chars"), F.array("l_returnflag").alias("charges"), F.col("l_linenumber").alias("defendant_count"))
    return coverage.parent_table(p)


@query(
    "a10_length_exclusion",
    """SELECT sum(x)::BIGINT AS excluded, count(*) FILTER (WHERE x > 0) AS affected_cases, count(*) FILTER (WHERE x > 0 AND y > 0) AS partial_cases
       FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 30) AS x, count(*) FILTER (WHERE l_quantity <= 30) AS y FROM lineitem GROUP BY 1)""",
)
def a10(spark, sf_dir):
    return coverage.length_exclusion(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_group_id"), (F.col("l_quantity") > 30).alias("length_excluded")))


@query(
    "a11_validation_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N' THEN 'invalid' ELSE 'flag_' || l_returnflag END AS reason FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag <> 'N') GROUP BY 1""",
)
def a11(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    errors = F.when(F.col("l_returnflag") != "N", F.array(F.concat(F.lit("flag_"), "l_returnflag"))).otherwise(F.array().cast("array<string>"))
    valid = ~((F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "N"))
    return coverage.validation_reasons(l.select(F.struct(valid.alias("valid"), errors.alias("errors")).alias("validation")))


@query("w05_token_batches")
def w05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = batches.token_batches(d, "n_chars", 16384, 64, "doc_id")
    return out.groupBy("shuffle_window", "batch").agg(F.count("*").alias("n"), (F.max("n_chars") * F.count("*")).alias("padded"))


@query("w10_schedule", "SELECT l_orderkey % 100 AS step, round(CASE WHEN l_orderkey % 100 < 10 THEN (l_orderkey % 100 + 1) / 10.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (l_orderkey % 100 - 10) / 90.0))) END, 9)::DOUBLE AS rate FROM lineitem GROUP BY 1, 2")
def w10(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("step")).distinct()
    return s.select("step", F.round(C.warmup_cosine("step", 100, 10, 0.1), 9).alias("rate"))
