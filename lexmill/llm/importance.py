"""Importance resampling towards a target text set, by hashed word n-grams, in native columns.

Texts become arrays of n-grams, which are exploded and hashed to ``buckets`` by crc32. Counts a bucket are summed
before they are shuffled; a bucket's gain is the log ratio of its smoothed shares in the target and in all
documents, and the table of gains (``buckets`` rows, a parameter) is broadcast. A document's weight is the floored
mean of its n-grams' gains, summed where it was read. Gumbel noise from a hash of the id makes a draw without
replacement proportional to exp(weight / 1000): the drawn are those of the highest scores. One distributed sort of
all documents ranks them: an id within the sorted partition, which is checkpointed, plus the rows of the partitions before.

Words are maximal runs of digits, a to z and characters beyond ASCII, of texts whose A to Z are lower-cased.

Defined cases: null text has no words; a document without n-grams has weight 0; rows of one id and text count one by
one, have one score and follow each other in rank; a null id is hashed as the empty string and comes last among ties;
an empty table gives no rows; without target texts every gain comes from smoothing; other columns take no part.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCALE = 4294967296.0


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(low, GAP), "")


def ngrams(w: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by one space."""
    runs = [w]
    for n in range(2, most + 1):
        left = F.greatest(F.size(w) - (n - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), left), F.slice(w, F.lit(n), left), lambda a, b: F.concat(a, F.lit(" "), b)))
    return runs[0] if most == 1 else F.concat(*runs)


def bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, most: int, buckets: int, text_col: str = "text") -> DataFrame:
    """bucket, n over all texts."""
    grams = texts.select(F.explode(ngrams(words(F.col(f"`{text_col}`")), most)).alias("gram"))
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(documents: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """bucket, gain of every bucket that a document or a target text meets: thousandths of the log ratio of the shares."""
    own = bucket_counts(documents, most, buckets, text_col).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    aim = bucket_counts(target, most, buckets, target_col).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = cut(own.unionByName(aim).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    all_s, all_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * (all_s + buckets) / ((F.col("s") + 1).cast("double") * (all_t + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(id_col: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / SCALE)))


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null unless it is drawn."""
    gain = F.broadcast(gains(documents, target, most, buckets, text_col, target_col))  # a row a bucket at most
    text = F.col(f"`{text_col}`")
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), words(text).alias("w"))
    # a row of an n-gram has the id and the digest beside it, never the array of words
    grams = rows.select("id", "digest", F.posexplode_outer(ngrams(F.col("w"), most)).alias("at", "gram"))
    grams = grams.withColumn("bucket", bucket(F.col("gram"), buckets))
    # the rows of a document lie together, so they are summed before they are shuffled; rows of one id and text are told apart by counting first n-grams
    whole = grams.join(gain, "bucket", "left").groupBy("id", "digest").agg(
        F.count_if(~F.contains("gram", F.lit(" "))).alias("words"), F.count("gram").alias("n"), F.sum("gain").alias("gain"), F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies")
    )
    scored = whole.select(
        "id", "digest", (F.col("words") / F.col("copies")).cast("long").alias("n_words"), (F.col("n") / F.col("copies")).cast("long").alias("n_features"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        F.when(F.col("n") > 0, F.floor(F.col("gain") / F.col("n"))).otherwise(F.lit(0)).cast("long").alias("weight"),
    )
    scored = scored.withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long")).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("digest"), F.asc("copy")]
    ranked = cut(scored.orderBy(*order).select("id", "n_features", "weight", "score", "fit", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).collect()  # a row a sorted partition
    drawn, before, start = percent * sum(r["fit"] for r in sizes) // 100, {}, 0
    for r in sorted(sizes):
        before[r["part"]], start = start, start + r["n"]
    offsets = documents.sparkSession.createDataFrame([(int(p), n) for p, n in before.items()], "part long, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranked.withColumn("part", part.cast("long")).join(F.broadcast(offsets), "part")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("fit") & (place <= drawn), place).alias("rank"))


IMPORTANCE_SQL = r"""
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i::BIGINT] || repeat([0::BIGINT], 8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
low AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (SELECT side, id, gram, COUNT(*) AS n FROM (SELECT side, id, unnest(w) AS gram FROM low) GROUP BY side, id, gram),
names AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
hashed AS (
  SELECT gram, (xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295)) % 10000 AS bucket
  FROM names, polynomial),
met AS (SELECT side, id, bucket, n FROM grams JOIN hashed USING (gram)),
counts AS (SELECT bucket, SUM(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, SUM(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM met GROUP BY bucket),
sums AS (SELECT COALESCE(SUM(s), 0)::DOUBLE AS all_s, COALESCE(SUM(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS gain FROM counts, sums),
weights AS (SELECT id, SUM(n) AS n, floor(SUM(n * gain) / SUM(n)) AS weight FROM met JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT d.doc_id, COALESCE(w.n, 0)::BIGINT AS n_features, COALESCE(w.weight, 0)::BIGINT AS weight,
    (COALESCE(w.weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.id),
placed AS (SELECT *, n_features >= 20 AS fit, ROW_NUMBER() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER (PARTITION BY n_features >= 20) AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * fits // 100 THEN place END AS rank FROM placed
"""
