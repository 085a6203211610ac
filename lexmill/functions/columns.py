"""Column expressions: normalisation, identifiers, classes, tolerances. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used: in lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after(text: Column, marks: str) -> Column:
    """The stretches of a text that end behind each of some marks, in order. A split takes a sixth of the time of finding all of them."""
    return F.split(text, f"(?<=[{marks}])")


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of some words: byte searches, much cheaper than a pattern of alternatives."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]) if words else F.lit(False)


def normalize_text(text: C) -> Column:
    """Letters and numbers only."""
    return F.regexp_replace(col(text), r"[^\p{L}\p{N}]+", "")


def content_key(text: C) -> Column:
    return F.sha2(normalize_text(text), 256)


def first_filled(*texts: C) -> Column:
    """The first text that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.nullif(col(t), F.lit("")) for t in texts], F.lit(""))


def without_suffix(text: C, suffix: str = "罪") -> Column:
    t = col(text)
    return F.when(t.endswith(suffix), F.substring(t, F.lit(1), F.length(t) - len(suffix))).otherwise(t)


def article_label(value: C, statute: str = "criminal_law") -> Column:
    """``303-2`` as ``criminal_law:303:2``; null where a part is no positive number."""
    v = F.trim(col(value).cast("string"))
    parts = F.split(v, "[-:./]")
    fine = v.rlike(r"^[0-9]+([-:./][0-9]+)*$") & F.forall(parts, lambda p: p.rlike("[1-9]"))
    # leading zeros go by text, so that any length fits
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    # most are one number without leading zeros, and need no parts
    return F.when(v.rlike("^[1-9][0-9]*$"), F.concat(F.lit(statute + ":"), v)).when(fine, F.concat(F.lit(statute + ":"), F.array_join(bare, ":")))


def article_labels(values: C, statute: str = "criminal_law") -> Column:
    """Normalised labels of an array, each once, in order; invalid ones raise."""
    listed = col(values).cast("array<string>")
    made = F.transform(listed, lambda v: F.coalesce(article_label(v, statute), F.raise_error(F.concat(F.lit("invalid article label: "), v)).cast("string")))
    # most are numbers without leading zeros, which need no lambda; a comma inside of one would show in their number
    joined = F.array_join(listed, ",", "?")
    split = F.split(F.concat(F.lit(f"{statute}:"), F.replace(joined, F.lit(","), F.lit(f",{statute}:"))), ",")
    plain = joined.rlike("^[1-9][0-9]*(,[1-9][0-9]*)*\\z") & (F.size(split) == F.size(listed))
    return F.array_distinct(F.when(plain, split).otherwise(made))


def canonical_id(*fields: tuple[str, Column], length: int = 20) -> Column:
    """The start of the sha256 of canonical JSON; fields are put in the order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])])), 256), 1, length)


def request_id(*fields: C, length: int = 24) -> Column:
    """The start of the sha256 of the fields joined by NUL; nulls are empty, so that every place counts."""
    joined = F.concat_ws("\0", *[F.coalesce(col(f).cast("string"), F.lit("")) for f in fields])
    return F.substring(F.sha2(joined, 256), 1, length)


def others(names: C, own: C) -> Column:
    """Distinct names in order but one's own."""
    return F.array_remove(F.array_distinct(col(names)), col(own))


def step_class(value: C, bins: Sequence[tuple[float, str]], top: str, inclusive: bool) -> Column:
    """The name of the first bin whose upper bound holds the value."""
    v, out = col(value), None
    for bound, name in bins:
        test = v <= bound if inclusive else v < bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(top)


def length_bucket(chars: C) -> Column:
    return step_class(chars, presets.LENGTH_BUCKETS, presets.LENGTH_TOP, inclusive=False)


def sentence_class(penalty: C, months: C) -> Column:
    """Month bins for fixed terms, other known penalties as they are, else ``unknown``."""
    p, m = col(penalty), col(months).cast("double")
    usable = m.isNotNull() & ~F.isnan(m) & (m >= 0) & (m < float("inf"))
    other = [x for x in presets.PENALTIES if x != "fixed_term"]
    return F.when((p == "fixed_term") & usable, step_class(m, presets.SENTENCE_BINS, presets.SENTENCE_TOP, inclusive=True)).when(p.isin(other), p).otherwise("unknown")


def simple_penalty(death: C, life: C, months: C) -> Column:
    """Flat sentence: death, then life, then no or missing months as exempt, else a fixed term."""
    m = col(months)
    return F.when(F.coalesce(col(death), F.lit(False)), "death").when(F.coalesce(col(life), F.lit(False)), "life").when(m.isNull() | (m <= 0), "exempt").otherwise("fixed_term")


PENALTY_FLAGS, PENALTY_MONTHS = ["death_penalty", "life_imprisonment"], ["imprisonment", "detention", "surveillance"]
PLAIN_PENALTY = f"struct<{','.join([*[f'{n}:boolean' for n in PENALTY_FLAGS], *[f'{n}:bigint' for n in PENALTY_MONTHS]])}>"


def read_penalty(obj: C) -> Column:
    """(type, months) of a penalty object given as VARIANT, null where it is missing or unusable.

    JSON kinds carry meaning: null and "" are no value; a flag that is no boolean or months that are no
    integer make the object unusable; exemption needs all three month fields to be the integer zero."""
    made = lambda x, kind: F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.when(kind == "fixed_term", x["imprisonment"].cast("int")).alias("months")))
    return bound(plain_penalty(obj), lambda x: bound(penalty_type(x), lambda kind: made(x, kind)))


def plain_penalty(obj: C) -> Column:
    """A VARIANT penalty as PLAIN_PENALTY, null where it is no object or a field's JSON kind makes it unusable."""
    fields = PENALTY_FLAGS + PENALTY_MONTHS
    # the object is opened once, and each field's kind is read once; what is no object gives no struct
    whole = F.try_variant_get(col(obj), "$", f"struct<{','.join(f'{n}:variant' for n in fields)}>")
    read = lambda w: F.struct(*[w[n].alias(n) for n in fields], *[F.schema_of_variant(w[n]).alias(f"kind_{n}") for n in fields])
    return bound(whole, lambda w: F.when(w.isNotNull(), bound(read(w), _plain)))


def _plain(x: Column) -> Column:
    kind = lambda n: F.coalesce(x[f"kind_{n}"], F.lit("VOID"))
    empty = lambda n: (kind(n) == "VOID") | ((kind(n) == "STRING") & (F.coalesce(F.try_variant_get(x[n], "$", "string"), F.lit("x")) == ""))
    fine = [x[n].isNull() | (kind(n) == "BOOLEAN") for n in PENALTY_FLAGS] + [empty(n) | (kind(n) == "BIGINT") for n in PENALTY_MONTHS]
    flags = [F.try_variant_get(x[n], "$", "boolean").alias(n) for n in PENALTY_FLAGS]
    months = [F.when(kind(n) == "BIGINT", F.try_variant_get(x[n], "$", "bigint")).alias(n) for n in PENALTY_MONTHS]
    return F.when(reduce(lambda a, b: a & b, fine), F.struct(*flags, *months))


def penalty_type(x: Column) -> Column:
    """The type of a PLAIN_PENALTY, whose months go with a fixed term; months beyond 32 bits are none. Without lambdas and
    short, so that it is compiled where it is a column's."""
    negative = lambda n: F.raise_error(F.lit(f"{n} months must not be negative")).cast("boolean")
    some = lambda n: F.when((x[n] < 0) & (x[n] >= -(1 << 31)), negative(n)).otherwise((x[n] > 0) & (x[n] < 1 << 31))
    return (
        F.when(x["death_penalty"], "death").when(x["life_imprisonment"], "life")
        .when(some("imprisonment"), "fixed_term").when(some("detention"), "detention").when(some("surveillance"), "control")
        .when((x["imprisonment"] == 0) & (x["detention"] == 0) & (x["surveillance"] == 0), "exempt")
    )


def rank_exclusion(charges: C, penalty: C, months: C, restitution: C) -> Column:
    """Why a case can't be ranked by months, or null; the first failing test names it."""
    m = col(months).cast("double")
    return (
        F.when(F.coalesce(F.size(col(charges)), F.lit(0)) != 1, "not_single_charge")
        .when(~F.coalesce(col(penalty) == "fixed_term", F.lit(False)), F.concat(F.lit("penalty_"), F.coalesce(F.nullif(col(penalty), F.lit("")), F.lit("missing"))))
        .when(m.isNull() | F.isnan(m) | (m < 0), "missing_months")
        .when(col(restitution).isNull(), "unknown_restitution")
    )


def amounts_match(left: C, right: C, distinct_from: C | None = None) -> Column:
    """Equality within a relative tolerance that never reaches half way to an amount it must differ from."""
    a, b = col(left), col(right)
    tolerance = F.greatest(F.lit(1e-4), F.greatest(F.abs(a), F.abs(b)) * 1e-8)
    if distinct_from is not None:
        tolerance = F.least(tolerance, F.nullif(F.abs(a - col(distinct_from)), F.lit(0.0)) / 2)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.coalesce(finite & (F.abs(a - b) <= tolerance), F.lit(False))


def factors_match(observed: Column, wanted: Column, changed: C) -> Column:
    """Whether every changed field has the wanted value: null only equals null, and amounts agree within their tolerance. Without changed fields it holds."""
    named = F.coalesce(col(changed), F.array().cast("array<string>"))
    ok = F.lit(True)
    for n in ("amount", "surrender", "restitution", "confession", "role", "conduct"):
        same = observed[n].eqNullSafe(wanted[n])
        if n == "amount":
            same = F.when(observed[n].isNull() | wanted[n].isNull(), same).otherwise(amounts_match(observed[n], wanted[n]))
        ok = ok & (~F.array_contains(named, n) | same)
    return ok


def band_of(amount: C, edges: Sequence[float] = presets.AMOUNT_EDGES) -> Column:
    """How many edges are at or under the amount."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= col(amount)))


def same_band_amount(amount: C, edges: Sequence[float] = presets.AMOUNT_EDGES) -> Column:
    """The amount one per cent up, else down, that stays in its band; rounding is Spark's, half up on decimals."""
    a = col(amount)
    out = F.lit(None).cast("double")
    for factor in (0.99, 1.01):
        c = F.round(a * factor, 2)
        out = F.when((c != a) & (band_of(c, edges) == band_of(a, edges)), c).otherwise(out)
    return F.when(a.isNotNull(), out)


def format_amount(amount: C) -> Column:
    return F.regexp_replace(F.format_string("%.2f", col(amount)), r"\.?0+$", "")


def may_match(text: Column, pattern: str, words: Sequence[str] = ()) -> Column:
    """Whether a text holds one of the words that every match of a pattern holds, where they are given or the presets tell them."""
    words = words or presets.NEEDED.get(pattern)
    return has_any(text, words) if words else F.lit(True)


def count_of(text: Column, pattern: str, words: Sequence[str] = ()) -> Column:
    """How often a pattern matches; texts without the words it needs aren't searched."""
    return F.when(may_match(text, pattern, words), F.regexp_count(text, F.lit(pattern))).when(text.isNotNull(), 0)


def amount_in(text: C, pattern: str = presets.AMOUNT) -> Column:
    """The first amount after a cue, in yuan."""
    t = col(text)
    number = F.regexp_extract(t, pattern, 1)
    value = F.regexp_replace(number, "[,，]", "").try_cast("double") * F.when(F.regexp_extract(t, pattern, 2) == "万", 10000.0).otherwise(1.0)
    return F.when(may_match(t, pattern) & (number != ""), value)


def amounts_in(text: C, pattern: str = presets.ANY_AMOUNT) -> Column:
    """Every amount in a text, in order."""
    t = col(text)
    numbers, units = (F.when(may_match(t, pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(i))).when(t.isNotNull(), F.array().cast("array<string>")) for i in (1, 2))
    return F.zip_with(numbers, units, lambda n, u: F.regexp_replace(n, "[,，]", "").cast("double") * F.when(u == "万", 10000.0).otherwise(1.0))


def novel_ngrams(parent: C, text: C, n: int = 8) -> Column:
    """Share of the text's distinct character n-grams that the parent lacks; 0 where it has none."""

    def grams(t: Column) -> Column:
        # a look-ahead finds overlapping stretches in one pass
        return F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))

    own = grams(col(text))
    return F.coalesce(F.try_divide(F.size(F.array_except(own, grams(col(parent)))), F.size(own)), F.lit(0.0))


def factor_targets(factors: C) -> Column:
    """Targets and mask of (amount, surrender, restitution, confession, accessory): unknown values are masked."""
    f = col(factors)
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    flags = [f.getField(n) for n in ("surrender", "restitution", "confession")]
    role = f.getField("role")
    return F.struct(
        F.array(one(f.getField("amount").isNotNull()), *[one(x) for x in flags], one(role == "accessory")).alias("targets"),
        F.array(F.lit(True), *[x.isNotNull() for x in flags], F.coalesce(role.isin("principal", "accessory"), F.lit(False))).alias("mask"),
    )


def focus(text: C, target: C, co: C, most: int) -> Column:
    """Sentences about the target, then those that name nobody, while they fit a budget, in their order.

    A sentence that doesn't fit is passed over and later ones may still fit, so the budget is carried
    through a fold and isn't a running sum."""
    t, who = col(text), F.coalesce(col(target), F.lit(""))
    rest = F.filter(F.coalesce(col(co), F.array().cast("array<string>")), lambda n: (n != "") & (n != who))
    sentences = F.regexp_extract_all(t, F.lit(r"([^。；！？\n]*[。；！？\n]|[^。；！？\n]+)"), F.lit(1))
    longer = F.filter(rest, lambda n: n.contains(who))
    bare = lambda s: F.aggregate(longer, s, lambda acc, n: F.replace(acc, n, F.lit("")))
    tier = lambda s: F.when((who != "") & bare(s).contains(who), 0).when(~F.exists(rest, lambda n: s.contains(n)), 1).otherwise(2)
    # a value that a lambda uses is bound first, or it would be worked out for every sentence
    marks = F.transform(sentences, lambda s, i: F.struct(tier(s).alias("tier"), i.alias("at"), s.alias("s")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda acc, x: acc["used"] + F.length(x["s"]) <= most

    def chosen(marked: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.filter(marked, lambda x: x["tier"] < 2)), start,
            lambda acc, x: F.struct(
                F.when(fits(acc, x), acc["used"] + F.length(x["s"])).otherwise(acc["used"]).alias("used"),
                F.when(fits(acc, x), F.array_append(acc["kept"], x["at"])).otherwise(acc["kept"]).alias("kept"),
            ),
        )["kept"]

    told = bound(marks, lambda m: bound(chosen(m), lambda c: F.array_join(F.transform(F.filter(m, lambda x: F.array_contains(c, x["at"])), lambda x: x["s"]), "")))
    joined = F.when(F.length(t) > most, told)
    return F.when(F.length(t) <= most, t).otherwise(F.substring(F.coalesce(F.nullif(joined, F.lit("")), t), 1, most))


def model_input(record: C, with_factors: bool, most: int | None = None) -> Column:
    """Sectioned model input of a processed record (a struct)."""
    r = col(record)
    fact = first_filled(r["fact_strict"], r["fact_conservative"], r["fact_raw"])
    if most is not None:
        fact = focus(fact, r["target_defendant"], r["co_defendants"], most)
    parts = [F.concat(F.lit("[DATASET]\n"), r["dataset"]), F.concat(F.lit("[TARGET_DEFENDANT]\n"), r["target_defendant"]), F.concat(F.lit("[FACT]\n"), fact)]
    if with_factors:
        f = r["factors"]
        names = ["amount", "conduct", "confession", "restitution", "role", "surrender"]
        parts.append(F.concat(F.lit("[FACTORS]\n"), F.coalesce(F.to_json(F.struct(*[f[n].alias(n) for n in names]), {"ignoreNullFields": "false"}), F.lit("{}"))))
    return F.concat_ws("\n\n", *parts)


def multi_hot(labels: C, vocabulary: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(col(labels), v).cast("int"))


def first_argmax(values: C) -> Column:
    """The place of the first largest value, from 0."""
    v = col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def thresholded(probabilities: C, threshold: float) -> Column:
    """1 where a probability reaches the threshold; if none does, the first largest one."""
    p = col(probabilities)
    hit = F.transform(p, lambda x: (x >= threshold).cast("int"))
    return F.when(F.array_max(hit) == 1, hit).otherwise(F.transform(p, lambda x, i: (i == first_argmax(p)).cast("int")))


def sigmoid(x: C) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def softplus(x: C) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ratio(n: C, d: C) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(col(n).cast("double"), col(d).cast("double")), F.lit(0.0))


def warmup_cosine(step: C, total: int, warmup: int, floor: float) -> Column:
    s = col(step)
    done = F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup))
    return F.when(s < warmup, (s + 1) / max(1, warmup)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(done * 3.141592653589793)))


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b, least: int = 0) -> Column:
    """Sums of an array's values up to each place, or another associative step with ``least`` as what changes nothing.

    By doubling: after round k a place has taken in the 2^k before it, so the rounds are the logarithm of the array's
    size and each is one pass. A fold that appends would copy the array a value."""

    def double(acc: Column, k: Column) -> Column:
        back = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(least), back), F.slice(acc, F.lit(1), F.size(acc) - back)), lambda a, b: step(a, b))

    rounds = lambda v: F.sequence(F.lit(0), F.greatest(F.length(F.bin(F.size(v))) - 1, F.lit(0)))
    return bound(values, lambda v: F.aggregate(rounds(v), v, double))
