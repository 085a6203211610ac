"""The corpus operators against brute force, libraries and round trips, with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import html, kmtree, language, media, packing, quality, queries, repeats, sharding, simhash, spm

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, shard2 string"


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


ODD = ["", None, "a", "x" * 5000, "same text here", "same text here", "é́ \U0001f389 日本", " \n\t ", "The " * 400]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_on_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = df.count()
    table = {"op1_kmeans_tree": None, "op6_html": "pages", "op8_packing": None, "op11_filter_audit": None, "op12_best_fit": None, "pipeline": None}.get(name, "documents")
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0


@pytest.mark.parametrize("name", [q for q in sorted(queries.QUERIES)])
def test_query_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 768, 5000])
def test_media_round_trip(size):
    payload = random.Random(size).randbytes(size).ljust(192, b" ")
    data = media.write_avi(payload)
    avi = media.parse_avi(data)
    frames = media.read_frames(data, avi)
    assert frames.tobytes()[: len(payload)] == payload and avi["comment"] == f"payload={len(payload)}"
    assert all((media.decode_frame(data[o : o + s]) == f).all() for (o, s), f in zip(avi["frames"], frames))
    clips = media.clips_of(data)
    assert clips[0]["start_ms"] == 0 and clips[-1]["end_ms"] == len(frames) * 40
    assert all(a["end_ms"] == b["start_ms"] for a, b in zip(clips, clips[1:]))


def test_media_index_is_optional_and_cuts_are_found():
    payload = bytes([10]) * 768 * 6 + bytes([200]) * 768 * 6
    data = media.write_avi(payload)
    assert [c["first_frame"] for c in media.clips_of(data)] == [0, 6]
    cut = data[: data.rindex(b"idx1")]
    assert media.parse_avi(cut)["frames"] == media.parse_avi(data)["frames"]


def test_media_rows(spark):
    df = documents(spark, ODD)
    rows = {r.doc_id: r for r in media.avi_digest(df).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert rows[i].tail_crc32 == zlib.crc32(want[-16:])
    assert tuple(rows[4])[1:] == tuple(rows[5])[1:]
    assert media.avi_clips(media.store_avi(df)).groupBy("doc_id").count().count() == len(ODD)


# SentencePiece


def test_pieces_equal_the_library():
    path = spm.tokenizer_path("piece_bpe_32k.model")
    own, lib = spm.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab \n▁é日</s>0xA \t🎉") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["a " + "Zürich日x" * 30 + "\n" + "Zürich日x" * 30 + " b", "Zürich日x" * 30]
    for t in texts:
        want, spans = lib.encode(t), own.encode_spans(t)
        assert [s[0] for s in spans] == want and lib.decode(want) == own.decode(want)
        assert own.encode(t).ravel().tolist() == list(own._spans(t))  # stretches encoded apart are as the whole text
        assert "".join(t.encode()[a:b].decode() for a, b in dict.fromkeys((s[2], s[3]) for s in spans)) == t
        # the library's own offsets, where no byte piece shares a character
        if all(own.kinds[i] == spm.NORMAL for i in want):
            assert [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces] == [s[2:] for s in spans]
    assert own.apart and max(map(len, own.known)) <= own.known.longest


def _model(charsmap=b"", dummy=1, squeeze=1, fallback=False):
    """A tiny model of the BPE kind with a normaliser of our own."""
    def field(n, wire, body):
        return bytes([n << 3 | wire]) + body

    def block(n, body):
        size, out = len(body), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return field(n, 2, out + bytes([size]) + body)

    def piece(text, score, kind):
        import struct

        return block(1, block(1, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    pieces = [piece("<unk>", 0, 2), piece("</s>", 0, 3)] + [piece(p, -i, 1) for i, p in enumerate(["ab", "▁ab", "▁", "a", "b", "f", "i", "fi"])]
    if fallback:
        pieces += [piece(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    norm = (block(2, charsmap) if charsmap else b"") + field(3, 0, bytes([dummy])) + field(4, 0, bytes([squeeze])) + field(5, 0, b"\1")
    return b"".join(pieces) + block(2, field(3, 0, b"\2") + (b"\x98\x02\1" if fallback else b"")) + block(3, norm)


def _charsmap(entries):
    """A double array of single-path tries, written by hand: units of label, offset, leaf and value."""
    text, values = b"", {}
    for k, v in entries.items():
        values[k] = len(text)
        text += v.encode() + b"\0"
    trie = {}
    for k in entries:
        node = trie
        for b in k.encode():
            node = node.setdefault(b, {})
        node[None] = values[k]
    units = [0] * 4096
    free = [256]

    def place(node, at):
        base = free[0]
        free[0] += 256
        jump = base ^ at
        units[at] |= jump << 10
        if None in node:
            units[at] |= 1 << 8
            units[base] = node[None] | 1 << 31
        for b, child in node.items():
            if b is not None:
                units[base ^ b] = b
                place(child, base ^ b)

    place(trie, 0)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + text


def test_normalisation_takes_the_longest_prefix_and_keeps_offsets():
    blob = _model(_charsmap({"ﬁ": "fi", "Ａ": "a", "ＡＢ": "ab", "　": " "}))
    own, lib = spm.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for t in ["ＡＢ", "Ａ ＡＢ", "ﬁ  ab ", "  a　b", "ab", " ", "zＡ", "zz a日\nz zz"]:
        want = lib.encode(t)
        assert [s[0] for s in own.encode_spans(t)] == want
        assert own.normalize(t)[0] == lib.normalize(t).replace(" ", "▁")
    assert own.encode_spans("ＡＢ ﬁ") == [(3, "▁ab", 0, 6), (4, "▁", 6, 7), (9, "fi", 7, 10)] and not own.apart


def test_stretches_pass_through_the_map():
    blob = _model(_charsmap({"ﬁ": "fi", "Ａ": "a", "ＡＢ": "ab", "　": " ", "x": ""}), squeeze=0, fallback=True)
    own, lib = spm.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert own.apart
    rng = random.Random(6)
    for t in ["ＡＢ ﬁ", "x", "x ", "  x\n"] + ["".join(rng.choice("ab \nxＡＢﬁ　z日") for _ in range(rng.randint(1, 30))) for _ in range(300)]:
        spans = own.encode(t)
        assert spans[:, 0].tolist() == lib.encode(t)
        assert spans.ravel().tolist() == list(own._spans(t))
    assert own.encode("ﬁ ＡＢ").tolist() == [[4, 0, 0], [9, 0, 3], [3, 3, 10]]
    assert not spm.Model(_model(_charsmap({"a b": "ab"}), squeeze=0, fallback=True)).apart
    assert not spm.Model(_model(_charsmap({"\n": "a"}), squeeze=0, fallback=True)).apart


def test_piece_rows(spark):
    df = documents(spark, ODD)
    got = {r.doc_id: r for r in spm.sp_digest(df, "piece_bpe_32k.model").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.tokenizer_path("piece_bpe_32k.model"))
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "") + [lib.eos_id()]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        spans = [x for s in spm.load(spm.tokenizer_path("piece_bpe_32k.model")).encode_spans(t or "") for x in s[2:]]
        assert got[i].spans_sha256 == hashlib.sha256(np.array(spans, "<i8").tobytes()).hexdigest()
    back = spm.sp_decode(spm.sp_encode(df, "piece_bpe_32k.model"), "piece_bpe_32k.model")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}


# packing


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(spm.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["der", "ing's", "<|endoftext|>", "x1", "éa"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    df = documents(spark, texts).repartition(3)
    rows = packing.pack(df, "word_bpe_49k.json").toPandas()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own, at = rows[rows.doc_id == i].sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    full = 0
    for _, s in rows.groupby("sequence_id"):
        s, at = s.sort_values("offset"), 0
        for r in s.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
        full += at == 4096
    assert full >= rows.length.sum() // 4096 - 3


def test_words_are_forgotten_between_batches_only():
    rng = random.Random(4)
    path = spm.tokenizer_path("word_bpe_49k.json")
    words, all_words = packing.Words(path, memory=20, longest=8), packing.Words(path)
    for _ in range(30):
        texts = [" ".join(rng.choice(["a", "bc", "x" * 40, "q\nz"]) + str(rng.randint(0, 60)) for _ in range(25)) for _ in range(3)]
        assert list(words.encode(texts)) == list(all_words.encode(texts))
        assert len(words.known) <= 20 + 75 * 2
    list(words.encode([""]))
    assert max(map(len, words.known)) <= 8 and len(words.known) <= 21


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_have_the_librarys_ids(name):
    from tokenizers import Tokenizer

    path = spm.tokenizer_path(name)
    words, tok = packing.Words(path), Tokenizer.from_file(path)
    assert words.by_words == (name == "word_bpe_49k.json")
    rng = random.Random(8)
    texts = [t or "" for t in ODD] + ["Don't I'LL 'Tis it's3 12½ ①② ªº", "İstanbul Ünïcödé ÉCOLE ﬁ ß ẞ ŉ ſ Ø÷×", "a\u00a0b\u3000c\x1cd\x85e\u200b\x7f\0", "<|startoftext|>hi x<|endoftext|>y <| a", "ΣΑΣ Σ a__b--c!!!'s''t"]
    texts += ["".join(rng.choice("abZÉéſĲ'sdll 1½.,!_<|\n\t\x1fΣ日") for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["Wort, " * 200_000]
    for t, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_many_windows_stay_open():
    p = packing.Packer(window=10)
    for i in range(3000):
        p.add(i, bytes(4) * 6)
    assert not p.done and p.count[6] == 3000
    p.end()
    assert sorted(sum(len(x[2]) // 4 for x in w) for w in p.done)[-1799:] == [10] * 1799 and sum(len(x[2]) // 4 for w in p.done for x in w) == 18000


def test_sum_of_squares_choice():
    p = packing.Packer(window=10)
    for i, n in enumerate([7, 7, 4, 3]):
        p.add(i, b"\0\0\0\0" * n)
    # 3 fills a window of 7: no other choice lowers the squares as much
    assert [[x[0] for x in w] for w in p.done] == [[1, 3]] and p.count[7] == 1 and p.count[4] == 1


# sharding


def test_matrix_margins_and_law():
    counts, sizes = np.array([5, 0, 7, 8]), np.array([10, 6, 4])
    draws = np.stack([sharding.communication_matrix(counts, sizes, s) for s in range(3000)])
    assert (draws.sum(2) == counts).all() and (draws.sum(1) == sizes).all()
    assert abs(draws[:, 2, 0].mean() - 7 * 10 / 20) < 0.1


def test_urns_of_any_size_give_the_same_law():
    """The way for urns above numpy's limit against numpy's own draws, and against the mean and variance where numpy has none."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((40, 60, 50), (400, 100, 450), (5, 3000, 1500), (300, 300, 40)):
        own = np.array([sharding.hypergeometric(rng, good, bad, n, 0) for _ in range(6000)])
        lib = rng.hypergeometric(good, bad, n, 60000)
        for q in np.unique(lib):
            a, b = (own <= q).mean(), (lib <= q).mean()
            assert abs(a - b) < 5 * (b * (1 - b) / 6000) ** 0.5 + 2e-3
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**11
    own = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    sd = (n * 0.3 * 0.7 * (1 - n / 10**13)) ** 0.5
    assert abs(own.mean() - 0.3 * n) < 5 * sd / 3000**0.5 and abs(own.std() / sd - 1) < 0.07
    counts, sizes = np.array([5 * 10**11, 0, 7 * 10**11, 8 * 10**11]), np.array([10**12, 6 * 10**11, 4 * 10**11])
    m = sharding.communication_matrix(counts, sizes, 1)
    assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()


def test_many_partitions_and_cells(spark):
    """Small partitions, cells and urns: two levels of the matrix, exact sizes, all slots taken once."""
    df = spark.range(3001).withColumn("slot", F.lit("old"))
    rows = sharding.shuffle_into_shards(df, 7, 5, rows_per_cell=50, rows_per_part=40, groups=8, most_urn=0).toPandas()
    assert sorted(rows.id) == list(range(3001)) and rows.columns.tolist() == ["id", "shard", "slot"]
    assert sorted(zip(rows.shard, rows.slot)) == [(s, i) for s in range(7) for i in range(3001 // 7 + (s < 3001 % 7))]
    assert abs(np.corrcoef(rows.id, rows.slot)[0, 1]) < 0.1


def test_shards_are_exact(spark):
    df = spark.range(1000).select((F.col("id") % 400).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).alias("text"))
    rows = sharding.shard_rows(df).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1 and len(rows) == 1000
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert set(rows["size"]) == {8, 12} and rows.grown_shard.isna().all()


def test_shuffle_is_uniform(spark):
    hits = np.zeros((12, 3))
    for seed in range(40):
        for r in sharding.shuffle_into_shards(spark.range(12), 3, seed).collect():
            hits[r.id, r.shard] += 1
    assert hits.sum() == 480 and hits.min() > 2 and hits.max() < 28


# quality and language


def test_quality_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = quality.quality_scores(d, l).toPandas().merge(l.toPandas(), on="doc_id")
    assert p.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id]
    h = p[p.held_out]
    assert (h.predicted == h.quality).mean() > 0.95 and ((p.score >= 0.3) == (p.predicted == 1)).all()


def test_quality_scores_equal_plain_sums():
    """Scores against features found one by one in each text: words, 3- and 4-grams of characters, pairs of equal words."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab éß日🎉\n\t ") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", " ", "日本 日本 日本", "x" * 300, "a b\x1cb"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = [[] for _ in texts]
    for docs, idx in quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets):
        for d, i in zip(docs.tolist(), idx.tolist()):
            got[d].append(i)
    blank = " \t\n\r\x0b\x0c"
    u64 = (1 << 64) - 1
    for text, own in zip(texts, got):
        s = " " + "".join(" " if c in blank else c for c in text) + "  "
        want = []
        for i in range(len(s) - 2):
            a, b, c = s[i : i + 3]
            three = ord(a) | ord(b) << 21 | ord(c) << 42
            if b != " " and not (a == " " and c == " "):
                want.append((three, 3))
            if b != " " and c != " " and i + 3 < len(s):
                want.append(((three * int(quality.BASE) + ord(s[i + 3])) & u64, 4))
        words = s.split(" ")
        words = [w for w in words if w]
        for w in words:
            want.append((sum((ord(c) + 1) * int(quality.POWERS[k & 63]) for k, c in enumerate(w)) & u64, 7))
        buckets = [int(quality._index(np.array([k], np.uint64), salt)[0]) for k, salt in want]
        assert sorted(own) == sorted(buckets + [0] * sum(x == y for x, y in zip(words, words[1:])))


def test_quality_odd_rows(spark):
    l = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (7, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.quality_scores(documents(spark, ODD), l).collect()}
    assert got[0] == got[1] == got[7] and got[4] == got[5] and all(0 <= s <= 1 for s in got.values())


def test_an_id_that_many_rows_have_is_learned_once(spark):
    d = spark.createDataFrame([(1, "bb", "x"), (1, "ba", "x"), (1, None, "x"), (2, "cc", "y"), (1, "dd", "y")], "doc_id long, text string, lang string")
    samples, weight = language.learn(d)
    assert weight == {"x": 2, "y": 2} and b"ba" in samples["x"] and b"bb" not in samples["x"] and b"cc" in samples["y"] and b"dd" in samples["y"]
    l = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    kept = quality.learn(d.where("text IS NOT NULL"), l)
    once = quality.learn(spark.createDataFrame([(1, "ba"), (2, "cc")], "doc_id long, text string"), l)
    assert (kept[0] == once[0]).all() and kept[1] == once[1]


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.languages(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    h = p[p.held_out]
    assert h.held_out.sum() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id)
    assert (h.lang == h.lang_pred).mean() > 0.98


def test_language_parse_equals_plain_search():
    text = {"a": b"the cat sat on the mat", "b": b"der hund der katze"}
    parser = language.Parser(text, {})
    rng = random.Random(2)
    text["c"] = b"a" * 7 + b" the hund " * 5
    parser = language.Parser(text, {})
    docs = [language.symbols("".join(rng.choice("thecadr xZ9ß ") for _ in range(rng.randint(0, 4000)))) for _ in range(20)]
    docs += [language.symbols(x) for x in ("a" * 5000, "a" * 3 * language.BLOCK, "der hund " * 700, "the cat sat on the mat " * 200, "z" * 2500, "b" * language.BLOCK)]
    got = parser.phrases(docs)
    for d, row in zip(docs, got):
        for k, lang in enumerate(parser.langs):
            n, i, whole = 0, 0, d.tobytes()
            while i < len(whole):
                j = i
                while j < len(whole) and whole[i : j + 1] in text[lang]:
                    j += 1
                n, i = n + 1, max(j, i + 1)
            assert row[k] == n


def test_language_sample_has_whole_texts(spark):
    long, short = "lang " * 30000, "kurz und gut"
    d = spark.createDataFrame([(1, long, "x"), (2, long + "z", "x"), (3, short, "y"), (4, long, "y"), (5, "", "y")], "doc_id long, text string, lang string")
    samples, _ = language.learn(d, max_bytes=400, max_docs=3)
    assert len(samples["x"]) in (len(long) + 1, len(long) + 2) and samples["y"].split() == short.encode().split()
    assert language.learn(d.limit(0))[0] == {}


def test_foreign_text_is_beyond_the_bounds(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(d)
    bounds = language.entropy_bounds(d, model)
    assert set(bounds) == {"en", "fr", "de", "es"} and all(2 < b < 14 for b in bounds.values())
    odd = spark.createDataFrame([(-1, "これは英語の文章ではありません。" * 5, None), (-2, "Это не английский текст, а русский.", None), (-3, None, None)], "doc_id long, text string, lang string")
    got = language.predict(d.unionByName(odd), model).select("doc_id", language.within(bounds).alias("ok")).collect()
    assert {r.doc_id for r in got if not r.ok} == {-1, -2, -3}
    assert language.entropy_bounds(d.limit(0), ({}, {})) == {}


def test_language_odd_rows(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(documents(spark, ODD + ["12 34", "½ ² 12", "①② Ⅷ", "①a"])).collect()}
    assert got[10] == got[11] == ("und", 0.0) and got[12][0] == "en"
    assert got[0] == got[1] == got[7] == got[9] == ("und", 0.0) and got[4] == got[5] and got[4][0] == "en"


# SimHash


def _fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    marks = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def _components(nodes, close):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in close:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def test_fingerprints_and_groups(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(documents(spark, ODD, list(range(1000, 1000 + len(ODD)))).select("doc_id", "text"))
    rows, texts = simhash.near_duplicates(d).toPandas(), {r.doc_id: r.text for r in d.collect()}
    fps = {i: _fp(t) for i, t in texts.items()}
    assert dict(zip(rows.doc_id, rows.fingerprint)) == {i: f"{v:016x}" for i, v in fps.items()}
    ids = sorted(fps)
    root = _components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert dict(zip(rows.doc_id, rows.component_id)) == root


def test_links_with_split_buckets_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    want = _components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for most in (4096, 8):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.close_links(nodes, most)).collect()}
        assert got == {k: v for k, v in want.items() if k != v}


def test_gray_index_finds_all_close_pairs():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 10, 300, dtype=np.uint64)
    group = np.sort(rng.integers(0, 4, 300))
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    got = {(min(a, b), max(a, b)) for x, y in simhash.GrayIndex(fp, group).close_pairs(2, 64) for a, b in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for j in range(300) for i in range(j) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}


# repeats


def _removed(rows):
    key = lambda i: 1 << 62 if i is None else i
    low, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            low[b[a : a + 50]] = min(low.get(b[a : a + 50], 1 << 62), key(i))
    for i, t in rows:
        b = (t or "").encode()
        g = bytearray(len(b))
        for a in range(len(b) - 49):
            if low[b[a : a + 50]] < key(i):
                g[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((-1 if i is None else i, len(b), sum(g), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removed_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    rows = []
    for i in range(100):
        t = "The " * rng.randint(1, 200) if rng.random() < 0.2 else rng.choice(base) + rng.choice(base) + "é" * rng.randint(0, 60)
        rows.append((None if i == 77 else i // 2 if i > 90 else i, None if i == 50 else t))
    # a phrase of 30 bytes in ever other surroundings, and twice in the same
    phrase = "a phrase that is in everything"
    rows += [(200 + i, "".join(rng.choice("xyz ") for _ in range(40)) + phrase + (f" twice {i // 2} the same after it" if i % 3 else f"{i * 7919}")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, hot in ((2 << 20, 4096), (600, 4096), (600, 16), (2 << 20, 1)):
        got = repeats.removed_repeats(df, group_bytes=size, hot=hot).toPandas()
        assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == _removed(rows)


def test_pointer_refinement_orders_windows():
    text = np.frombuffer(b"abracadabra" * 30 + b"xyz" + b"abracadabra" * 8, np.uint8)
    starts = np.arange(len(text) - 49)
    got = repeats.window_classes(text, starts)
    raw = text.tobytes()
    kinds = {}
    for s, g in zip(starts.tolist(), got.tolist()):
        assert kinds.setdefault(raw[s : s + 50], g) == g
    assert len(set(got.tolist())) == len(kinds)


def test_texts_stay_whole_characters(spark):
    passage = "é" * 40
    df = documents(spark, [passage + " tail", "x" + passage[:30] + "é and more", None]).withColumn("rest", F.lit(1))
    rows = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert rows[0].text == passage + " tail" and rows[1].text == "xand more" and rows[2].text == "" and rows[1].rest == 1


# nearest neighbours


@pytest.mark.parametrize("block_rows", [128, 8])
def test_search_recall_and_ties(spark, block_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0] * 3), (None, [1.0] * 16), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = kmtree.nearest(df, df.where("vec_id % 100 = 0"), max_sample=1500, block_rows=block_rows).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 100))
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id])
        assert (sorted(zip(g.score, g.vec_id)) == list(zip(g.score, g.vec_id)))
        hits += len(set(want) & set(g.vec_id))
    assert hits / (10 * got.query_id.nunique()) >= 0.9
    assert got[got.query_id == 500].vec_id.tolist() == list(range(501, 511))


@pytest.mark.parametrize("times", [1, 2, 12])
def test_search_takes_an_id_once(spark, times):
    """Repeated rows of an id don't take its neighbours' places: the same answer however often rows repeat."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, (v + np.float32(r * 1e-4)).tolist()) for i, v in enumerate(x) for r in range(times)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 50)], df.schema)
    got = kmtree.nearest(df, asked, leaf=10_000, block_rows=1 << 20).toPandas()
    for q, g in got.groupby("query_id"):
        d = np.stack([(((x + np.float32(r * 1e-4)).astype(float) - x[q].astype(float)) ** 2).sum(1) ** 0.5 for r in range(times)]).min(0)
        d[q] = np.inf
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g.vec_id.tolist() == np.lexsort((np.arange(400), d))[:10].tolist()
        assert np.allclose(g.score, d[g.vec_id])


# html


@pytest.fixture(scope="module")
def model():
    return html.fitted()


def _text(model, source):
    page = html.Page(source)
    x, _ = html.describe([page])
    return html.main_text(page, model.odds(x))


ARTICLE = "<p>Alpha beta, gamma &amp; delta epsilon zeta.</p><p>Short.</p><p>Second paragraph with\n several <b>bold</b> words, and commas.</p>"
WANT = "Head line of it\nAlpha beta, gamma & delta epsilon zeta.\nShort.\nSecond paragraph with several bold words, and commas."


def test_html_pages(model):
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    foot = "<footer>&copy; example, all rights reserved.</footer><script>var t='</p>';</script>"
    for box in ("article", "div class='post content'", "main"):
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{menu}<!-- x --><div class=\"ad\">Buy this now please.</div><{box}><h1>Head line of it</h1>{ARTICLE}</{box.split()[0]}>{foot}</body></html>"
        assert _text(model, page) == WANT
    comments = "<div class='comments'><div class='comment'><p>I like this, really good text.</p></div><div class='comment'><p>Me too, thanks.</p></div></div>"
    assert _text(model, f"<body>{menu}<article><h1>Head line of it</h1>{ARTICLE}</article>{comments}{foot}</body>") == WANT


def test_html_raw_elements_and_open_head(model):
    page = lambda inner, head="<head><title>T</title></head><body>": f"<html>{head}<article><h1>Head line of it</h1>{inner}{ARTICLE}</article></body></html>"
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", "<script>s='<!-- x';</script>", "<style>a>b{c:'<i>'}/*<!--*/</STYLE >", "<template><template>x</template>gone</template>", "<select><option>x<option>y</select>"):
        assert _text(model, page(raw)) == WANT
    assert _text(model, page("<input list=d><datalist id=d><option value=x><option value=y></datalist>")) == WANT
    assert _text(model, page("", "<head><title>T</title><meta charset=utf-8>")) == WANT
    said = lambda source: "".join(t[1] for t in html.Page(source).text if t)
    assert said("<head><title>T</title>Bare text<p>more") == "Bare textmore"
    assert said("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> and <svg><title>t</title><desc>d</desc><text>label</text></svg> end") == "so x=2 and  label end"
    assert None not in html.Page("<p>so <math><mrow><mi>x</mi></mrow></math> end").text[1:]


def test_html_decoding_is_consistent(model):
    rng = np.random.default_rng(5)
    kept = lost = noise = total = 0
    for _ in range(60):
        page = html.Page(html.written_page(rng))
        x, _ = html.describe([page])
        text = html.main_text(page, model.odds(x))
        every = "".join(t[1] for t in page.text if t)
        kept, lost = kept + sum(c.isupper() for c in text), lost + sum(c.isupper() for c in every)
        noise, total = noise + sum(c.islower() for c in text), total + sum(c.islower() for c in every)
    assert kept / lost > 0.97 and noise / total < 0.06


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "plain <"), (5, "u", "<div" + " a" * 5000), (6, "u", "</p></body></html>"), (7, "u", "<script>x"), (8, "u", "<p>" * 3000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "repeats", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("e"))
    columns = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            assert docs.where("n_chars <> length(text)").count() == 0
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)


def test_parts_of_a_key_equal_all_pairs(spark, monkeypatch):
    """A text with ever other edits: most copies are far from each other and close to the text; blocks of any size."""
    from lexmill.llm import near

    rng = random.Random(12)
    base = [rng.randint(0, 10**6) for _ in range(40)]
    sets = [np.unique([b if rng.random() > rng.choice([0.02, 0.08, 0.5]) else rng.randint(0, 10**6) for b in base]) for _ in range(120)] + [np.zeros(0, np.int64)] * 2
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = [find(i) for i in range(len(sets))]
    assert near.close_parts(sets, at_once=7).tolist() == near.close_parts(sets).tolist() == want
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words)] + [" ".join(f"x{k}.{i}" if i in at else w for i, w in enumerate(words)) for k, at in enumerate([set(rng.sample(range(150), rng.randint(1, 9))) for _ in range(80)])]
    df = documents(spark, texts)
    whole = {tuple(r) for r in near.near_copies(df).collect()}
    monkeypatch.setattr(near, "BLOCK", 9)
    monkeypatch.setattr(near, "BLOCK_MARKS", 2000)
    assert {tuple(r) for r in near.near_copies(df).collect()} == whole
    marks = [set(near.shingles(t).tolist()) for t in texts]
    far = [i for i, m in enumerate(marks) if all(len(m & o) < 0.8 * len(m | o) for j, o in enumerate(marks) if j != i)]
    assert sorted(r[0] for r in whole) == sorted({0, *far})


def test_pipeline_near_copies(spark):
    """Copies with some words changed against all pairs of five-word shingle sets; far texts of one id all stay."""
    import corpus_pipeline as cp

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, ids = [], []
    for k in range(25):
        words = [word() for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(words))
        for share in (0.0, 0.005, 0.01, 0.02, 0.04, 0.2):
            texts.append(" ".join(word() if rng.random() < share else w for w in words))
    texts += ["", None, "  ", "one two", "One  two", "one three", texts[3] + " tail", word()]
    ids = [*range(len(texts) - 2), 3, 40]  # near text 3 of the same id; a far text of a held id
    sets = [set(zip(*[(w := (t or "").lower().split())[i:] for i in range(5)])) if len((t or "").split()) > 5 else {tuple((t or "").lower().split())} - {()} for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(find(i), []).append((ids[i], hashlib.md5((t or "").encode()).hexdigest(), t))
    want = sorted((min(g)[0], min(g)[1]) for g in groups.values())
    docs = documents(spark, [*texts, "no id", "no id"], [*ids, None, None])
    got = cp.near_duplicates(spark, docs, SF).toPandas()
    named = got[got.doc_id.notna()]
    assert len(got) - len(named) == 2
    assert sorted((int(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest()) for r in named.itertuples()) == want


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["__part", "__n", "__p", "part", "rank", "row", "to", "cell", "h1", "h2", "starts", "a.b", "shard"]
    df = spark.range(500).select("id", *[F.lit(f"mine {n}").alias(n) for n in names])
    out = sharding.shuffle_into_shards(df, 3, rows_per_cell=50, rows_per_part=20, groups=4)
    assert out.columns == ["id", *names[:-1], "shard", "slot"]
    rows = out.collect()
    assert all(r[n] == f"mine {n}" for r in rows for n in names[:-1]) and sorted(r["id"] for r in rows) == list(range(500))
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(167 if s < 2 else 166))


def test_runs_of_a_matrix_row_cover_every_rank():
    rng = np.random.default_rng(4)
    for cells, stretch in ((5, 8), (400, 8), (3, 1000)):
        row = rng.multinomial(301, rng.dirichlet(np.ones(cells) * 0.3))
        of = np.repeat(np.arange(cells), row)
        seen = 0
        for at, starts, to in sharding.runs(row, stretch):
            assert len(starts) <= stretch + 1
            for rank in range(at * stretch, min(301, (at + 1) * stretch)):
                assert to[int((starts <= rank).sum()) - 1] == of[rank]
                seen += 1
        assert seen == 301
    assert list(sharding.runs(np.zeros(4, np.int64))) == []
