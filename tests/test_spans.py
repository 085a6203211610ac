"""Spans in linear time and large lexica, against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexmill import presets
from lexmill.functions.columns import running
from lexmill.operators import edits, redact


def test_running_sums_and_maxima(spark):
    rnd = random.Random(2)
    rows = [([rnd.randrange(100) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 7, 8, 9, 31, 64, 100)] + [(None,)]
    df = spark.createDataFrame(rows, "x array<int>").select("x", running(F.col("x")).alias("s"), running(F.col("x"), F.greatest).alias("m"))
    for r in df.collect():
        if r.x is None:
            assert r.s is None and r.m is None
        else:
            assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] and r.m == [max(r.x[: i + 1]) for i in range(len(r.x))]


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_joined_spans(spark):
    rnd = random.Random(3)
    cases = [[], [(0, 1)], [(0, 5), (5, 7)], [(0, 9), (2, 3), (4, 12), (12, 13)]] + [[(a := rnd.randrange(60), a + rnd.randrange(1, 9)) for _ in range(rnd.randrange(20))] for _ in range(40)]
    df = spark.createDataFrame([(c,) for c in cases], "x array<struct<start:int,end:int>>")
    text = F.lit("".join(chr(97 + i % 26) for i in range(80)))
    for r in df.select("x", redact.joined(F.col("x")).alias("j"), redact.masked(text, redact.joined(F.col("x")), "#").alias("m")).collect():
        want = union([tuple(x) for x in r.x])
        assert [tuple(x) for x in r.j] == want
        plain, at = "", 0
        for a, b in want:
            plain, at = plain + "".join(chr(97 + i % 26) for i in range(at, a)) + "#", b
        assert r.m == plain + "".join(chr(97 + i % 26) for i in range(at, 80))


def test_a_text_of_many_matches_takes_seconds(spark):
    n = 100_000
    df = spark.createDataFrame([("犯盗窃罪。" * n,)], "text string")
    rules = presets.LEGAL
    warm = redact.redact(spark.createDataFrame([("犯盗窃罪。",)], "text string"), names=["盗窃"], rules=rules)
    assert warm.first().fact_strict == "犯[已屏蔽]。"
    start = time.time()
    out = redact.redact(df, names=["盗窃"], rules=rules).select(F.length("fact_strict"), F.size("redactions")).first()
    assert tuple(out) == (7 * n, 2 * n) and time.time() - start < 20
    start = time.time()
    assert df.select(F.size(edits.sentences(F.col("text")))).first()[0] == n and time.time() - start < 10


@pytest.mark.parametrize("names", [["盗窃", "抢劫", "盗", "走私、贩卖毒品", "贩卖毒品", "毒品", "窃罪"], ["ab", "b", "abc", "bca", "c"]])
def test_lexicon_equals_the_pattern(names):
    names = sorted(names, key=lambda n: (-len(n), n))
    rules = presets.Rules(**{**presets.LEGAL.__dict__, "mentions": ("NAME(?:犯罪|罪|案)", "(?<=[一二]、)NAME(?=[；：c])", "NAMEb")})
    framed, rnd = redact.frames(rules), random.Random(len(names))
    pattern, lexicon = re.compile(redact.mention_pattern(names, rules)), redact.Lexicon(names)
    for _ in range(2000):
        text = "".join(rnd.choices([*"盗窃抢劫罪案一二、；abc", "犯罪", "毒品", "贩卖"], k=rnd.randrange(30)))
        assert lexicon.spans(text, framed) == [m.span() for m in pattern.finditer(text)], text


def test_redaction_by_automaton_equals_the_pattern(spark, monkeypatch):
    names = ["走私、贩卖毒品", "贩卖毒品", "走私毒品", "盗窃", "抢劫"]
    texts = ["甲犯盗窃罪，一、抢劫；二、贩卖毒品。本院认为走私、贩卖毒品罪成立。又盗窃案。", "", None, "无"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    few = redact.redact(df, names=names).collect()
    monkeypatch.setattr(redact, "MANY", 0)
    assert redact.redact(df, names=names).collect() == few and len(few[0].redactions) > 3


def test_many_names_cost_no_more_than_few():
    rnd = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    names = list({"".join(rnd.choices(letters, k=rnd.randrange(3, 7))) for _ in range(100_000)})
    text = "".join(rnd.choices(letters, k=300_000))
    framed, took = redact.frames(presets.LEGAL), []
    for some in (names[:100], names):
        lexicon = redact.Lexicon(some)
        took.append(min(timed(lambda: lexicon.spans(text, framed)) for _ in range(3)))
    assert took[1] < 4 * took[0], took


def timed(fn):
    start = time.time()
    fn()
    return time.time() - start


def test_frames_that_take_letters_before_a_name_stay_a_pattern():
    rules = presets.Rules(**{**presets.LEGAL.__dict__, "mentions": ("aNAME",)})
    assert redact.frames(rules) is None and redact.frames(presets.LEGAL) is not None
