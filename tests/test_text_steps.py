"""Sentences, clauses and cues: the same parts as by patterns that find them all, without those patterns."""

import random
import re

from pyspark.sql import functions as F

from lexmill import presets
from lexmill.functions import columns as C
from lexmill.operators import edits, factors, redact


def made(n=300):
    rng = random.Random(5)
    pieces = ["甲某", "乙某", "甲某某", "退赃", "未", "自首", "，", "。", "\n", "；", "！", "？", "，，", "a", "不但", "的", "及时", "价值3500元", "b c", "构成", "盗窃罪", "第三条", "依法", "处罚", "可以从轻"]
    return ["", "，", "。。"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_equal_those_that_patterns_find(spark):
    df = spark.createDataFrame([(t,) for t in made()], "t string")
    both = df.select("t", edits.sentences(F.col("t")).alias("s"), edits.clauses(F.col("t")).alias("c"))
    for r in both.collect():
        for parts, pattern, keep in ((r.s, r"[^。；！？\n]+[。；！？\n]?|[。；！？\n]", r"[^。；！？\n]"), (r.c, r"[^，。；！？\n]+|[，。；！？\n]", r"[^。；！？\n]")):
            assert [(x.s, x.start) for x in parts] == [(m.group(), m.start()) for m in re.finditer(pattern, r.t) if re.search(keep, m.group())]
    assert "regexp_extract_all" not in plan_of(both)


def test_own_text_equals_its_rule(spark):
    def rule(text, target, rest):
        kept = []
        for s in re.findall(r"[^。；！？\n]+[。；！？\n]?", text):
            for c in re.findall(r"[^，。；！？\n]+[，。；！？\n]?", s):
                bare = c
                for n in rest:
                    bare = bare.replace(n, "") if target in n else bare
                if not any(n in c for n in rest) and (target in bare or not any(n in s for n in rest)):
                    kept.append(c)
        return "".join(kept) or text

    df = spark.createDataFrame([(t,) for t in made()], "t string")
    own = df.select("t", factors.own_text(F.col("t"), F.lit("甲某"), F.array(F.lit("乙某"), F.lit("甲某某"), F.lit(""))).alias("own"))
    assert [r.own for r in own.collect()] == [rule(r.t, "甲某", ["乙某", "甲某某"]) for r in own.collect()]
    assert "regexp_extract_all" not in plan_of(own)


def test_cues_of_clauses_equal_those_of_the_text(spark):
    df = spark.createDataFrame([(t,) for t in made()] + [(None,)], "t string")
    for cues in (presets.SURRENDER, presets.RESTITUTION):
        got = df.select(factors.cue_polarity("t", cues).alias("a"), factors._polarity(F.coalesce("t", F.lit("")), cues).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and {r.a for r in got} == {True, False, None}


def test_matches_hold_the_words_they_need(spark):
    conclusion = f"{presets.STRONG_CONCLUSION}|{presets.WEAK_CONCLUSION}"
    # every alternative of the lists once, and random texts
    texts = made() + ["本院认为", "检察院认为", "据此", "综上", "追究其刑事责任", "提请法院", "量刑建议", "建议判", "依照《", "应当以", "应以", "其上述行为已触犯", "依法追究", "酌情减轻、从宽处罚", "刑法第二条之一第三款第四项", "第五款", "检察院指控"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, words in [*presets.NEEDED.items(), (conclusion, presets.CONCLUSION_WORDS)]:
        rows = df.select("t", F.regexp_count("t", F.lit(pattern)).alias("n"), C.count_of(F.col("t"), pattern, words).alias("m")).collect()
        assert [r.n for r in rows] == [r.m for r in rows] and sum(r.n for r in rows)


def test_spans_only_where_a_word_is(spark):
    """A pattern isn't walked over a text without the words it needs: one that would match there finds nothing."""
    df = spark.createDataFrame([("ab",), ("a罪",), (None,)], "t string")
    got = [r.s for r in df.select(redact.found(F.col("t"), "a", "c", "m", ["罪"]).alias("s")).collect()]
    assert [None if s is None else [x.text for x in s] for s in got] == [[], ["a"], None]
