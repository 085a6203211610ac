"""MinHash signatures: the kernel and the built-in expressions against plain integers."""

from lexmill.operators import dedup

TEXTS = ["", "a", "abcd", "abcde", "abcdefabcdefabcdef", "\U0010ffff" * 7, "x\U00010400bé\U00020000字字字字字字", "word" * 700 + "end"]


def plain(text, n=64, width=5):
    codes = [ord(c) for c in text] or [0]
    width = min(width, len(codes))
    marks = set()
    for i in range(len(codes) - width + 1):
        h = 0
        for c in codes[i : i + width]:
            h = (h * dedup.BASE + c) % dedup.PRIME
        marks.add(h)
    return [min((h * a + b) % dedup.PRIME for h in marks) for a, b in zip(*dedup.coefficients(n))]


def test_both_ways_give_the_plain_signatures(spark):
    import hashlib
    import re

    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    shown = [re.sub(r"[\W_]+", "", t) if t.isascii() else t for t in TEXTS]
    for of in (dedup.signatures, dedup.native_signatures):
        got = {r.key: list(r.sig) for r in of(df).collect()}
        for t in shown:
            if "\U0010ffff" not in t and "\U00010400" not in t:  # what counts as a letter there is left to the engine
                assert got[hashlib.sha256(t.encode()).hexdigest()] == plain(t)
    a, b = ({r.key: list(r.sig) for r in of(df).collect()} for of in (dedup.signatures, dedup.native_signatures))
    assert a == b


def test_a_shingle_is_hashed_outside_of_lambdas(spark):
    plan = dedup.native_signatures(spark.createDataFrame([("some text",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 1  # the codes; the polynomial was another

