"""Filter audit, best-fit packing and importance resampling against SQL, plain Python and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lexmill.llm import audit, bestfit, importance, queries
from lexmill.llm.spm import tokenizer_path

SF = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"


def cells(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(map(str, r)) for r in df.where(df.notna(), None).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    for c in got.columns:
        if got[c].dtype == "float64":
            got[c] = got[c].astype("Int64")
    assert cells(got) == cells(want.convert_dtypes())


# Extra columns have the names that the operators use.
DDL = "doc_id long, text string, lang string, part string, mask string, n string, digest string, id string, gain string, bucket string, size string, kind string, at string, copies string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["mine"] * 11) for r in rows], DDL)


LONG = " ".join(f"Word{i % 97}" for i in range(200_000))
ROWS = [
    (5, "same text here " * 80, "en"), (3, "same text here " * 80, "de"), (3, "same text here " * 80, "de"), (9, "same text here " * 80, "en"), (None, "same text here " * 80, "en"),
    (1, None, "en"), (2, "", None), (4, "\t\n \x0b\x0c\r", "en"), (6, "A B C | d", "en"), (7, "ÀÉ ÀÉ ÀÉ", "fr"), (8, " ".join(f"w{i}" for i in range(250)), "en"),
    (10, " ".join(f"w{i}" for i in range(199)) + " #", ""), (11, LONG, "en"), (12, LONG, "fr"), (13, "x" * 300_000, "en"), (None, None, None), (None, "", "en"), (14, "same text here " * 80, "en"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 0, 1), (8, 1, 0), (9, 1, None), (None, 1, 1), (11, None, 1), (99, 1, 1)]


def plain_audit(rows, labels):
    fails = []
    for i, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        caps = len(re.findall("[A-Z]", text))
        less = [j for j, t, _ in rows if (t or "") == text and j is not None and i is not None and j < i]
        fails.append({k for k, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 3 * len(text), bool(re.search("[#$%&*|]", text)), bool(less)]) if bad})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for _, f in own:
                if f:
                    shapley[next(x for x in order if x in f)] += 1
        for order in permutations("ABCDE"):
            for s, x in enumerate(order, 1):
                gone = [bool(f & set(order[: s - 1])) for _, f in own]
                removed = [i for (i, f), g in zip(own, gone) if x in f and not g]
                out[part, "".join(order), s] = (
                    sum(not f & set(order[:s]) for _, f in own), len(removed), sum(x in f and g for (_, f), g in zip(own, gone)), sum(f == {x} for _, f in own),
                    sum(i in good for i in removed), sum(i in toxic for i in removed), shapley[x],
                )
    return out


def test_audit_equals_plain_counting(spark):
    docs = documents(spark, ROWS).repartition(5)
    got = audit.interactions(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == plain_audit(ROWS, LABELS) and len(got) == 4 * 600
    assert audit.interactions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_counts_a_hot_group_once(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copy', concat('own ', id)) AS text", "'en' AS lang")
    n = {r["mask"]: r["n"] for r in audit.mask_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() if r["n"]}
    assert n == {1: 2001, 17: 999}


# best fit


def test_chunks_equal_the_library():
    chunks, rnd = bestfit.Chunks(tokenizer_path(VOCABULARY), memory=100), random.Random(7)
    tok = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    some = list("abcXYZ019 '  \n\t.,-éÉßſ½²ªº日🎉  　\x1c\x1f\x85​_#<|>") + ["'s", "'ll", " the", "'RE", "  ", "\r\n", "ed "]
    for i in range(3000):
        text = "".join(rnd.choices(some, k=rnd.randrange(60))) + ("<|endoftext|> x" if i % 50 == 0 else "")
        chunks.make_room()
        assert np.frombuffer(chunks.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def sequential(sizes, window):
    gaps, n = bestfit.Gaps(window), 0
    for size in sorted(sizes, reverse=True):
        if gaps.take(size) is None:
            n += 1
            gaps.add(window - size, n)
    return n


def checked(out, texts, window=2048):
    """texts: by id, distinct ids. Pieces follow the rule, their ids are the library's, sequences are gapless."""
    tok = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(i, s, n) for i, (s, n) in enumerate(bestfit.cut_sizes(len(ids), window))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
        assert all(r.length == window for r in rows[1:])
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return len(by_seq)


@pytest.mark.parametrize("per_task", [20, 1 << 14])
def test_best_fit_packs_like_the_sequential_rule(spark, per_task):
    rnd = random.Random(per_task)
    texts = {i: None if i == 5 else " ".join(rnd.choices(["the", "house", "Straße", "x1"], k=int(rnd.paretovariate(0.7) * 12) % 3000)) for i in range(700)}
    texts[800] = LONG
    docs = documents(spark, [(i, t, "en") for i, t in texts.items()]).repartition(4)
    out = bestfit.pack_best_fit(docs, VOCABULARY, rows_per_task=per_task).collect()
    used, best = checked(out, texts), sequential([r.length for r in out], 2048)
    least = -(-sum(r.length for r in out) // 2048)
    assert used <= best + (1 if per_task > 20 else 6) and best >= least


def test_best_fit_equal_sizes_and_repeated_rows(spark):
    docs = documents(spark, [(1, "a b c", "en")] * 900 + [(None, None, None)] * 100).repartition(3)
    out = bestfit.pack_best_fit(docs, VOCABULARY, rows_per_task=50).collect()
    assert Counter((r.doc_id, r.length) for r in out) == {(1, 4): 900, (None, 1): 100}
    places = [(r.sequence_id, r.offset) for r in out]
    assert len(set(places)) == 1000 and len({s for s, _ in places}) <= 20
    assert bestfit.pack_best_fit(docs.limit(0), VOCABULARY).count() == 0


def test_gaps_are_allotted_by_the_nearest_larger_range():
    # ranges: number, documents, tokens, gaps, room
    group_of, gaps_to = bestfit.allot([(0, 0, 0, 5, 50), (1, 0, 0, 2, 16), (2, 3, 21, 0, 0), (3, 10, 20, 4, 4)], 5)
    assert group_of == {2: 0, 3: 1}
    assert gaps_to == {1: [(0, 2, 0)], 0: [(4, 5, 0), (2, 4, 1)]}


# importance


def plain_importance(rows, target, percent=10, most=1, buckets=10_000, least=20, seed=2024):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    of = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(map(of, grams(text)[1]))
    for text in target:
        t.update(map(of, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text, _ in rows:
        w, g = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(of, g)]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, [r[:4] for r in fit[: percent * len(fit) // 100]]


@pytest.mark.parametrize("most,percent,least", [(1, 10, 20), (2, 40, 3), (3, 100, 0)])
def test_importance_equals_plain_counting(spark, most, percent, least):
    rnd = random.Random(most)
    rows = ROWS + [(100 + i, " ".join(rnd.choices(["alpha", "Beta", "ÉTÉ", "été", "x9", "日本"], k=rnd.randrange(60))), "en") for i in range(150)]
    target = ["alpha x9 alpha", None, "", "BETA été"]
    want, drawn = plain_importance(rows, target, percent, most, 10_000, least)
    got = importance.resample(documents(spark, rows).repartition(6), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), percent, most, least_words=least).collect()
    assert Counter(tuple(r[:4]) for r in got) == Counter(r[:4] for r in want)
    assert [tuple(r[:4]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))


def test_importance_without_rows_or_target(spark):
    docs, none = documents(spark, ROWS), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert importance.resample(docs, none).count() == len(ROWS)


def test_importance_favours_the_target(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(IF(id % 10 = 0, 'wanted words here ', 'other stuff there '), 10) AS text")
    target = spark.createDataFrame([("wanted words here " * 50,)], "text string")
    rows = importance.resample(docs, target).where("rank IS NOT NULL").collect()
    assert len(rows) == 400 and sum(r.doc_id % 10 == 0 for r in rows) > 360
