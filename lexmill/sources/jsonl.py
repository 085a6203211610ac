"""Line sources of judgments: numbered lines, two nested layouts, manifests. Errors name file and line."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import PENALTY_FLAGS, PENALTY_MONTHS, PLAIN_PENALTY, article_labels, canonical_id, others, penalty_type, plain_penalty, simple_penalty, without_suffix
from . import ranges

SIMPLE = "fact string, meta struct<criminals:array<string>,accusation:array<string>,relevant_articles:array<string>,term_of_imprisonment:struct<death_penalty:boolean,life_imprisonment:boolean,imprisonment:int>>"

#: A case's parts that are read; penalties are VARIANT, or of the one kind that is right for each field.
JUDGMENTS = "array<struct<standard_accusation:string,accusation:string,article:array<string>,penalty:{0}>>"
OUTCOMES = f"array<struct<name:string,judgment:{JUDGMENTS},final_penalty:{{0}}>>"
#: A JSON number with a fraction or exponent, or over 18 digits, as text isn't what was written. It is looked for in what was
#: read, printed, which is shorter than the line; numbers elsewhere don't matter.
ODD_NUMBER = r"[{\[,:]\s*-?[0-9]+(?:[.eE]|[0-9]{18})"
#: A flag that is null is no boolean, which typed columns can't tell from a missing one. Patterns begin with rare letters, for speed.
NULL_FLAGS = ['h_penalty"\\s*:\\s*null', '_imprisonment"\\s*:\\s*null']

#: The same parts for Arrow's reader of JSON, which refuses any other kind, keys given twice and whatever is no JSON.
_PENALTY = pa.struct([(n, pa.bool_()) for n in PENALTY_FLAGS] + [(n, pa.int64()) for n in PENALTY_MONTHS])
_JUDGMENT = pa.struct([("standard_accusation", pa.string()), ("accusation", pa.string()), ("article", pa.list_(pa.string())), ("penalty", _PENALTY)])
_OUTCOME = pa.struct([("name", pa.string()), ("judgment", pa.list_(_JUDGMENT)), ("final_penalty", _PENALTY)])
EXPECTED = pa.schema([("fact", pa.string()), ("defendants", pa.list_(pa.string())), ("outcomes", pa.list_(_OUTCOME))])


def lines(spark: SparkSession, path: str, split: int = ranges.SPLIT, across: bool = False) -> DataFrame:
    """Rows (path, line_no, value) with line numbers from 1 in each file, or with across in each folder; see ``ranges`` for how they are found."""
    files = ranges.listing([path])
    return _spark_lines(spark, path, across) if files is None else ranges.numbered(spark, files, split, across)


def folder_of(path: str) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def _spark_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """The same by Spark's own reader, for patterns and stores that only Spark reads: lines are counted a split and moved by
    the counts of the splits before; a row a split is joined, broadcast where Spark finds that small enough."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    spans = raw.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy(folder_of("path") if across else "path").orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("path", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.join(spans, ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, on_error: str = "fail") -> DataFrame:
    """JSON lines without blank ones: on_error is ``fail`` (raise with the place), ``drop`` or ``quarantine`` (keep with null record)."""
    src = lines(spark, path).where(F.trim("value") != "")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = src.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if on_error == "fail":
        place = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": invalid JSON line"))
        parsed = parsed.where(F.when(~bad, F.lit(True)).otherwise(F.raise_error(place).cast("boolean")))
    elif on_error == "drop":
        parsed = parsed.where(~bad)
    else:
        return parsed.select("path", "line_no", "value", F.when(~bad, F.col("r").dropFields("_bad")).alias("record"))
    return parsed.select("path", "line_no", F.col("r").dropFields("_bad").alias("record"))


def _guard(test: Column, message: str) -> Column:
    place = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(f": {message}"))
    return F.when(F.coalesce(test, F.lit(False)), F.lit(True)).otherwise(F.raise_error(place).cast("boolean"))


def simple_cases(parsed: DataFrame, split: str, dataset: str = "cail") -> DataFrame:
    """One case a line of the flat layout (record of SIMPLE); exactly one defendant is required."""
    r, m = F.col("record"), F.col("record.meta")
    term = m["term_of_imprisonment"]
    penalty = simple_penalty(term["death_penalty"], term["life_imprisonment"], term["imprisonment"])
    articles = article_labels(F.coalesce(m["relevant_articles"], F.array().cast("array<string>")))
    case = parsed.where(_guard(F.size(m["criminals"]) == 1, "exactly one defendant is required")).select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit(f"{dataset}-"), canonical_id(("criminals", m["criminals"]), ("fact", r["fact"]))).alias("case_id"),
        F.get(m["criminals"], F.lit(0)).alias("target_defendant"), r["fact"].alias("fact_raw"), F.transform(m["accusation"], lambda c: without_suffix(c)).alias("charges"), penalty.alias("penalty_type"),
        F.when(penalty == "fixed_term", term["imprisonment"]).alias("imprisonment_months"), F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string")).alias("source_path"),
        articles.alias("conviction_articles"), F.array().cast("array<string>").alias("sentencing_articles"), F.array().cast("array<string>").alias("co_defendants"),
        F.lit(False).alias("mask_penalty"), F.lit(None).cast("string").alias("penalty_exclusion"), m["relevant_articles"].isNotNull().alias("articles_available"), F.lit(None).cast("string").alias("penalty_fallback"),
        "path", "line_no",
    )
    return checked(case.withColumn("group_id", F.col("case_id")))


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, line_no, value, and those of EXPECTED): lines of the expected kinds as typed columns, without value; others as value alone."""
    for b in batches:
        todo = [b.slice(at, 1024) for at in range(0, b.num_rows, 1024)][::-1]
        while todo:
            part = todo.pop()
            n, read = part.num_rows, _plain(part.column(2))
            if read is None and n > 128:  # one odd line doesn't hold up all
                todo += [part.slice(n // 2), part.slice(0, n // 2)]
                continue
            value = part.column(2) if read is None else pa.nulls(n, part.column(2).type)
            rest = [pa.nulls(n, f.type) for f in EXPECTED] if read is None else read.columns
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), value, *rest], names=["path", "line_no", "value", *EXPECTED.names])


def _plain(value: pa.Array) -> pa.RecordBatch | None:
    """Lines read by Arrow, or None where one is not of the expected kinds. A line from brace to brace holds one object or more, so
    as many rows as lines are one each. Arrow takes bare NaN and Inf for numbers, and a null flag is not told from a missing one."""
    whole = pc.and_(pc.starts_with(value, "{"), pc.ends_with(value, "}"))
    odd = pc.match_substring_regex(value, "NaN|Inf|" + "|".join(NULL_FLAGS))
    if value.null_count or not pc.all(whole).as_py() or pc.any(odd).as_py():
        return None
    text = pc.binary_join_element_wise(value, pa.scalar("", value.type), pa.scalar("\n", value.type)).buffers()[2]
    if text.size >= (1 << 31) - 1:
        return None
    try:
        read = pj.read_json(pa.BufferReader(text), pj.ReadOptions(use_threads=False, block_size=text.size + 1), pj.ParseOptions(explicit_schema=EXPECTED, unexpected_field_behavior="ignore"))
    except pa.ArrowInvalid:
        return None
    return read.combine_chunks().to_batches()[0] if read.num_rows == len(value) else None


def joint_cases(src: DataFrame, split: str, dataset: str = "cmdl") -> DataFrame:
    """One case per defendant of the nested layout; src has (path, line_no, value), value being JSON.

    JSON kinds of penalties carry meaning. Lines whose parts all are of the expected kinds, most by far, are parsed straight into
    typed columns, by Arrow where a stretch of lines is of those kinds with texts as strings and keys given once, else by Spark (of a key
    given twice, the last counts); any other line is read as VARIANT. Charges and articles come from every judgment."""
    kinds = OUTCOMES.format(PLAIN_PENALTY)
    typed = src.select("path", "line_no", "value").mapInArrow(_typed, f"path string, line_no long, value string, fact string, defendants array<string>, outcomes {kinds}")
    expected = T.StructType.fromDDL(f"fact string, defendants array<string>, outcomes {kinds}, _bad string")
    r = F.from_json("value", expected, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    parsed = typed.select("*", r.alias("r"))
    plain = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.ltrim("value").startswith("{") & ~F.col("r").cast("string").rlike(ODD_NUMBER) & ~F.col("value").rlike(NULL_FLAGS[0]) & ~F.col("value").rlike(NULL_FLAGS[1])
    text = F.col("value").isNotNull()
    parsed = parsed.select("path", "line_no", *[F.when(text, F.col(f"r.{n}")).otherwise(F.col(n)).alias(n) for n in EXPECTED.names], F.when(text & ~F.coalesce(plain, F.lit(False)), F.parse_json("value")).alias("v"))
    v, odd = F.col("v"), F.col("v").isNotNull()
    kinds = OUTCOMES.format("variant")
    listed = F.coalesce(F.try_variant_get(v, "$.outcomes", kinds), F.variant_get(v, "$.outcomes", kinds))  # the second raises where they are no array
    judgment = lambda j: F.struct(j["standard_accusation"].alias("standard_accusation"), j["accusation"].alias("accusation"), j["article"].alias("article"), plain_penalty(j["penalty"]).alias("penalty"))
    typed = lambda o: F.struct(o["name"].alias("name"), F.transform(o["judgment"], judgment).alias("judgment"), plain_penalty(o["final_penalty"]).alias("final_penalty"))
    given = lambda o: o["final_penalty"].isNotNull() & ~F.is_variant_null(o["final_penalty"])
    base = parsed.select(
        "path", "line_no", F.when(odd, F.try_variant_get(v, "$.fact", "string")).otherwise(F.col("fact")).alias("fact"), F.when(odd, F.try_variant_get(v, "$.defendants", "array<string>")).otherwise(F.col("defendants")).alias("listed"),
        F.when(odd, F.transform(listed, typed)).otherwise(F.col("outcomes")).alias("outcomes"), F.when(odd, F.transform(listed, given)).alias("odd_given"),
    )
    base = base.withColumn("names", F.col("outcomes")["name"]).withColumn("case", canonical_id(("defendants", F.coalesce("listed", "names")), ("fact", F.col("fact"))))
    # of a bare column Spark would infer a filter that parses every line once more
    one = base.select("*", F.posexplode(F.coalesce("outcomes", F.array().cast(OUTCOMES.format(PLAIN_PENALTY)))).alias("pos", "x"))
    said = lambda j: without_suffix(F.coalesce(F.nullif(j["standard_accusation"], F.lit("")), j["accusation"], F.lit("")))
    one = one.select("*", F.col("x.name").alias("name"), F.coalesce("x.judgment", F.array().cast(JUDGMENTS.format(PLAIN_PENALTY))).alias("j"), F.col("x.final_penalty").alias("final_penalty"))
    n, nth = F.size("j"), lambda i: F.get("j", F.lit(i))
    # up to two judgments need no lambda, which Spark interprets
    charges = F.when(n == 1, F.array(said(nth(0)))).when(n == 2, F.array(said(nth(0)), said(nth(1)))).otherwise(F.transform("j", said))
    own = F.when(n == 1, nth(0)["penalty"])
    one = one.select(
        "path", "line_no", "fact", "names", "case", "pos", "name", "final_penalty", n.alias("n"), F.flatten(F.col("j")["article"]).alias("listed"), own.alias("own_penalty"),
        F.struct(penalty_type(F.col("final_penalty")).alias("final"), penalty_type(own).alias("own"), F.array_remove(charges, "").alias("charges")).alias("made"),
        F.when(F.col("odd_given").isNull(), F.col("final_penalty").isNotNull()).otherwise(F.get("odd_given", "pos")).alias("given"),
    )
    # what is tested below are fields of a row of their own, not their expressions once more
    one = one.select("*", F.inline(F.array("made")))
    one = one.withColumn("articles_available", (F.col("n") > 0) & F.col("listed").isNotNull())  # flattened lists are null where one is
    penalty = F.coalesce("final", "own", F.lit("unknown"))
    months = F.when(penalty == "fixed_term", F.when(F.col("final").isNotNull(), F.col("final_penalty.imprisonment")).otherwise(F.col("own_penalty.imprisonment")).cast("int"))
    masked = F.col("final").isNull() & F.col("own").isNull()
    exclusion = F.when(masked, F.when(F.col("n") > 1, "missing_final_penalty").otherwise("missing_penalty_fields"))
    nth = F.when(F.col("pos") < 1000, F.lpad(F.col("pos").cast("string"), 3, "0")).otherwise(F.col("pos").cast("string"))
    case = one.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit(f"{dataset}-"), "case", F.lit("-d"), nth).alias("case_id"), F.concat(F.lit(f"{dataset}-"), "case").alias("group_id"),
        F.col("name").alias("target_defendant"), F.col("fact").alias("fact_raw"), "charges", penalty.alias("penalty_type"), months.alias("imprisonment_months"),
        F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string")).alias("source_path"),
        F.when(F.col("articles_available"), article_labels("listed")).otherwise(F.array().cast("array<string>")).alias("conviction_articles"), F.array().cast("array<string>").alias("sentencing_articles"),
        others("names", "name").alias("co_defendants"), masked.alias("mask_penalty"), exclusion.alias("penalty_exclusion"), "articles_available",
        F.when(F.col("final").isNull() & F.col("own").isNotNull() & F.col("given"), "unusable_final_penalty_fallback").alias("penalty_fallback"), "path", "line_no",
    )
    return checked(case)


def checked(cases: DataFrame) -> DataFrame:
    """Cases that hold the rules of a case, else an error with the place: ids, charges, penalty kinds, months, masks."""
    c = F.col
    rules = [
        ((c("case_id") != "") & (c("target_defendant") != ""), "ids must not be empty"),
        ((F.size("charges") > 0) & ~F.exists("charges", lambda x: F.trim(x) == ""), "a charge is required"),
        ((c("penalty_type") == "fixed_term") == c("imprisonment_months").isNotNull(), "months go with fixed terms only"),
        (F.coalesce(c("imprisonment_months"), F.lit(0)) >= 0, "months must not be negative"),
        (c("penalty_exclusion").isNull() | (c("mask_penalty") & (c("penalty_type") == "unknown")), "excluded penalties are masked and unknown"),
    ]
    out = cases
    for test, message in rules:
        out = out.where(_guard(test, message))
    return out.drop("path", "line_no")


def manifest(spark: SparkSession, paths: list[str], across: bool = False) -> DataFrame:
    """Rows (path, bytes, sha256, records). A task streams each file, of any size, or with across each folder's files in the order of
    their names as one; a path that only Spark reads is hashed from whole files, which end at 2 GB each."""
    if (known := ranges.listing(paths)) is not None:
        return ranges.digests(spark, known, across)
    raw = spark.read.format("binaryFile").load(paths)
    files = raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if across:
        files = raw.select(folder_of("path").alias("folder"), "path", "content").repartition("folder").sortWithinPartitions("folder", "path").mapInArrow(_chained, "path string, bytes long, sha256 string")
    counts = spark.read.text(paths).select(F.col("_metadata.file_path").alias("__p")).groupBy((folder_of("__p") if across else F.col("__p")).alias("__p")).agg(F.count("*").alias("records"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(counts, plain(files["path"]) == plain(counts["__p"]), "left").select("path", "bytes", "sha256", F.coalesce("records", F.lit(0)).alias("records"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a folder from its files, which come in order."""
    row = lambda: pa.RecordBatch.from_arrays([pa.array([folder], pa.string()), pa.array([size]), pa.array([digest.hexdigest()])], names=["path", "bytes", "sha256"])
    folder, size, digest = None, 0, hashlib.sha256()
    for b in batches:
        for own, content in zip(b.column(0).to_pylist(), b.column(2)):
            if own != folder and folder is not None:
                yield row()
                size, digest = 0, hashlib.sha256()
            folder, size = own, size + len(content.as_buffer())
            digest.update(content.as_buffer())
    if folder is not None:
        yield row()


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines of a file."""
    return lines(spark, path).orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
