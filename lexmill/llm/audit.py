"""How five quality filters interact, from a histogram of failure masks.

Columns judge each text once and give a mask of the filters A to D that it fails; no text is shuffled, only its
SHA-256. Rows are summed by digest, mask, part and label (an id's rows first, which spreads large groups of equal
texts over tasks), a digest's smallest doc_id comes from those sums, and with it the fifth bit E. That leaves 32
cells a part: documents, good ones and toxic ones by mask. Every order of the five filters is then read off the
cells, and so are the Shapley sums: a document that fails k filters is removed by each of them in 120/k orders.

Filters: A under 200 words; B: 100 x distinct words < 50 x words; C: 100 x [A-Z] characters > 3 x code points; D any
of ``#$%&*|``; E a smaller doc_id has the same text. Words are maximal runs without the bytes 32 and 9 to 13.

Defined cases: null text is empty; rows of one id count one by one and are no copies of each other; a null id is no
smaller id and never fails E; null lang is the part named by the empty string; an id that several labels have is
good (toxic) if one says so; an empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and the five controls after backspace."""
    return F.array_remove(F.split(text, SPACES), "")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    w = words(text)
    n = F.size(w)
    fails = [
        n < 200,
        F.size(F.array_distinct(w)) * 100 < n * 50,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 3,
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and five-bit mask of the filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = documents.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_mask(text).alias("mask"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    thin = thin.join(said, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    of_id = thin.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    sums = of_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(named).alias("least"))
    # a digest has a row a part and label by now
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    sums = sums.withColumn("passes", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    rows = sums.select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("passes").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("passes")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return rows.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what each filter removes there: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cell = F.struct("mask", "n", "good", "toxic")
    parts = mask_cells(documents, labels).groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 cells at most
    at = F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")
    rows = parts.select("part", "cells", at).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bits = lambda letters: sum((letters.contains(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("before", bits(F.expr("left(filter_order, step - 1)"))).withColumn("own", bits(F.expr("substr(filter_order, step, 1)")))
    before, own = F.col("before"), F.col("own")

    def over(what: str, where, each=lambda x, k: x[k]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), each(x, what)).otherwise(0))

    hit = lambda m: m.bitwiseAND(own) != 0
    new = lambda m: hit(m) & (m.bitwiseAND(before) == 0)
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        over("n", new).alias("removed"),
        over("n", lambda m: hit(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        over("n", lambda m: m == own).alias("unique_fails"),
        over("good", new).alias("good_lost"),
        over("toxic", new).alias("toxic_lost"),
        over("n", hit, lambda x, k: (x[k] * F.lit(120) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE(lang, '') AS part FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, MIN(doc_id) AS least FROM docs GROUP BY text),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
failed AS (
  SELECT c.part, COALESCE(s.good, FALSE) AS good, COALESCE(s.toxic, FALSE) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(c.text, '[^A-Z]', '', 'g')) > 3 * len(c.text),
     regexp_matches(c.text, '[#$%&*|]'), c.doc_id > f.least] AS fails
  FROM cut c JOIN firsts f ON c.text = f.text LEFT JOIN said s ON c.doc_id = s.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS prior FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (
  SELECT f.part, s.filter_order, s.step, s.own, f.good, f.toxic, COALESCE(f.fails[ascii(s.own) - 64], FALSE) AS hit,
    len(list_filter(range(1, 6), lambda i: COALESCE(f.fails[i], FALSE) AND contains(s.prior, chr((64 + i)::INT)))) > 0 AS gone,
    len(list_filter(f.fails, lambda x: COALESCE(x, FALSE))) AS failing
  FROM failed f, steps s),
counted AS (
  SELECT part, filter_order, step, own, count_if(NOT hit AND NOT gone) AS kept, count_if(hit AND NOT gone) AS removed, count_if(hit AND gone) AS redundant,
    count_if(hit AND failing = 1) AS unique_fails, count_if(hit AND NOT gone AND good) AS good_lost, count_if(hit AND NOT gone AND toxic) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (SUM(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
