"""Controlled edits of a case's text: where an edit may go, how it is made, and whether a result holds.

Columns throughout. Offsets count code points from 0. What holds of a sentence or clause is a field beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import after, amount_in, amounts_in, amounts_match, bound, count_of, format_amount, has_any, novel_ngrams, running
from .factors import _any, conducts, cue_polarity, factors, mentions, own_text

ENDS = "。；！？\n"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _parts(found: Column) -> Column:
    """Stretches that tile a text with their starts, those that don't begin with an end."""

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, F.length))
        return F.zip_with(found, ends, lambda s, e: F.struct(s.alias("s"), (e - F.length(s)).alias("start")))

    return F.filter(bound(found, placed), lambda x: (x["s"] != "") & ~F.left(x["s"], F.lit(1)).isin(*ENDS))


def sentences(text: Column) -> Column:
    """Sentences with their ends: (s, start)."""
    return _parts(after(text, ENDS))


def clauses(text: Column) -> Column:
    """Clauses without their ends; a comma is one of its own."""
    return _parts(F.split(text, f"(?<=[，{ENDS}])|(?=[，{ENDS}])"))


def others_of(target: Column, co: Column) -> Column:
    return F.filter(F.coalesce(co, _empty()), lambda n: (n != "") & (n != target))


def _named(spans: Column, target: Column, others: Column, exact: bool = False) -> Column:
    """Spans with whether they name the target and somebody else; exact looks for the bare name, else longer names are taken out first."""
    has = (lambda s: s.contains(target)) if exact else (lambda s: mentions(s, target, others))
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["start"].alias("start"), has(x["s"]).alias("own"), F.exists(others, lambda n: F.contains(x["s"], n)).alias("other")))


def scope(text: Column, target: Column, co: Column, exact: bool = False) -> Column:
    """Clauses that are about the target: naming them alone, or naming nobody in a sentence that names them alone."""
    def mine(others: Column) -> Column:
        # where the target's name isn't, neither a sentence nor its clauses are theirs
        theirs = _named(F.filter(sentences(text), lambda s: s["s"].contains(target)), target, others, exact)
        inner = F.transform(theirs, lambda s: F.transform(_named(clauses(s["s"]), target, others, exact), lambda c: F.struct(
            c["s"].alias("s"), (s["start"] + c["start"]).alias("start"), c["own"].alias("own"), c["other"].alias("other"), (s["own"] & ~s["other"]).alias("alone"))))
        return F.filter(F.flatten(inner), lambda x: ~x["other"] & (x["own"] | x["alone"]))

    others = others_of(target, co)
    alone = F.transform(clauses(text), lambda c: F.struct(c["s"].alias("s"), c["start"].alias("start"), mentions(c["s"], target, others).alias("own"), F.lit(False).alias("other"), F.lit(True).alias("alone")))
    return F.when(F.size(others) == 0, alone).otherwise(bound(others, mine))


def _replace(text: Column, start: Column, end: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def splice(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """The text with one span replaced: a sentence keeps exactly one end, a clause gets none."""
    last = F.right(F.substring(text, start + 1, end - start), F.lit(1))
    body = F.trim(replacement)
    own_end = F.right(body, F.lit(1)).rlike(f"[{ENDS}]")
    whole = F.when(own_end, body).otherwise(F.concat(body, last))
    return _replace(text, start, end, F.when(last.rlike(f"[{ENDS}]"), whole).otherwise(F.regexp_replace(body, f"[{ENDS}]+$", "")))


def restitution_edit(text: Column, spans: Column, target: Column, co: Column, wanted: Column) -> Column:
    """Every restitution clause of the target made one canonical clause; without any it follows the first clause. Null without a clause."""
    cue = _any(presets.RESTITUTION)
    clause = F.when(wanted, presets.RESTITUTION_CLAUSE[True]).otherwise(presets.RESTITUTION_CLAUSE[False])
    new = F.concat(F.when(F.size(others_of(target, co)) > 0, target).otherwise(""), clause)
    told = F.filter(spans, lambda x: x["s"].rlike(cue))
    made = F.aggregate(F.reverse(told), text, lambda acc, x: _replace(acc, x["start"], x["start"] + F.length(x["s"]), new))
    first = F.get(spans, F.lit(0))
    added = _replace(text, first["start"], first["start"] + F.length(first["s"]), F.concat(first["s"], F.lit("，"), new))
    return F.when(wanted.isNotNull() & (F.size(spans) > 0), F.when(F.size(told) > 0, made).otherwise(added))


def amount_edit(text: Column, spans: Column, source: Column, wanted: Column) -> Column:
    """The target's amount literal made the wanted one, in yuan: the first cued clause whose literal is the source amount, else a clause that names the target. Null without one."""
    is_source = lambda s, p: source.isNull() | F.coalesce(amounts_match(amount_in(s, p), source), F.lit(False))
    literal = F.concat(format_amount(wanted), F.lit("元"))

    def rewrite(x: Column, pattern: str) -> Column:
        at = pattern.index("([0-9]")  # what stands before the number stays
        head, tail = pattern[:at], pattern[at:]
        return F.regexp_replace(x["s"], F.lit(f"^([\\s\\S]*?{head}){tail}"), F.concat(F.lit("$1"), literal))

    cued = F.get(F.filter(spans, lambda x: x["s"].contains("元") & x["s"].rlike(presets.CUED_AMOUNT) & is_source(x["s"], presets.CUED_AMOUNT)), F.lit(0))
    plain = F.get(F.filter(spans, lambda x: x["own"] & x["s"].contains("元") & x["s"].rlike(presets.ANY_AMOUNT) & is_source(x["s"], presets.ANY_AMOUNT)), F.lit(0))
    put = lambda x, p: _replace(text, x["start"], x["start"] + F.length(x["s"]), rewrite(x, p))
    return F.when(wanted.isNotNull(), F.when(cued.isNotNull(), put(cued, presets.CUED_AMOUNT)).when(plain.isNotNull(), put(plain, presets.ANY_AMOUNT)))


def _by_conduct(conduct: Column, table: dict[str, list[str]]) -> Column:
    out = None
    for k, words in table.items():
        words = F.array(*[F.lit(w) for w in words])
        out = F.when(conduct == k, words) if out is None else out.when(conduct == k, words)
    return out


def flip_span(df: DataFrame, text: str, target: Column, co: Column, conduct: Column) -> DataFrame:
    """The rows with __flip (s, start, reason): the one sentence that tells the conduct, or why there is none to rewrite."""
    others, t = others_of(target, co), F.col(text)
    said = bound(others, lambda o: _named(sentences(t), target, o))
    initials = F.concat_ws("|", F.transform(F.array_distinct(F.transform(F.concat(F.array(target), others), lambda n: F.left(n, F.lit(1)))), lambda i: F.concat(F.lit("\\Q"), i, F.lit("\\E"))))
    bare = F.concat(F.lit("(?:由|被告人|，|。|；|、|和|与|及|^)(?:"), initials, F.lit(f")(?=[{presets.INITIAL_VERBS}])"))
    verbs = F.coalesce(_by_conduct(conduct, presets.VERBS), _empty())
    steps = df.withColumn("__verbs", verbs).withColumn("__said", said)
    told = F.filter("__said", lambda x: F.exists("__verbs", lambda v: F.contains(x["s"], v)) & (x["own"] | ~x["other"]) & ~has_any(x["s"], presets.SUMMARIES))
    steps = steps.withColumn("__told", told)
    n = F.size("__told")
    reason = F.when(F.regexp_like(t, bare), "abbreviated_ambiguous").when((F.size("__verbs") == 0) | (n == 0), "no_target_span").when(n > 1, "incomplete_flip")
    steps = steps.withColumn("__why", reason)
    one = F.when(F.col("__why").isNull(), F.get("__told", F.lit(0)))
    return steps.withColumn("__flip", F.struct(one["s"].alias("s"), one["start"].alias("start"), F.col("__why").alias("reason"))).drop("__verbs", "__said", "__told", "__why")


def plan(df: DataFrame, text: str = "text", spec: str = "spec", out: str = "plan") -> DataFrame:
    """The rows with (kind, text, quote, start, reason): ``deterministic`` edits are made, a ``span`` needs one sentence written, ``skip`` can't be done.

    spec is a struct of target_defendant, co_defendants, changed_fields, source_factors and target_factors. Each
    step is a column of its own, so that none is worked out twice."""
    s, t = F.col(spec), F.col(text)
    who, co, fields = s["target_defendant"], s["co_defendants"], s["changed_fields"]
    has = lambda n: F.array_contains(fields, n)
    steps = df.withColumn("__scope", scope(t, who, co))
    steps = steps.withColumn("__turned", F.when(has("restitution"), restitution_edit(t, F.col("__scope"), who, co, s["target_factors"]["restitution"])).otherwise(t))
    steps = steps.withColumn("__scope", scope(F.col("__turned"), who, co))
    steps = steps.withColumn("__valued", F.when(has("amount"), amount_edit(F.col("__turned"), F.col("__scope"), s["source_factors"]["amount"], s["target_factors"]["amount"])).otherwise(F.col("__turned")))
    steps = flip_span(steps, "__valued", who, co, s["source_factors"]["conduct"])
    reason = (
        F.when(F.col("__turned").isNull(), "no_restitution_span").when(F.col("__valued").isNull(), "no_amount_span")
        .when(has("conduct"), F.col("__flip.reason")).when(F.col("__valued") == t, "no_supported_field")
    )
    steps = steps.withColumn("__reason", reason).withColumn("__kind", F.when(F.col("__reason").isNotNull(), "skip").when(has("conduct"), "span").otherwise("deterministic"))
    span = F.col("__kind") == "span"
    made = F.struct(
        F.col("__kind").alias("kind"), F.when(F.col("__kind") == "skip", t).otherwise(F.col("__valued")).alias("text"), F.when(span, F.col("__flip.s")).alias("quote"),
        F.when(span, F.col("__flip.start")).alias("start"), F.col("__reason").alias("reason"),
    )
    return steps.withColumn(out, made).drop("__scope", "__turned", "__valued", "__flip", "__reason", "__kind")


def mask_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(re.escape(m))) for m in presets.MASKS]


def _cues(conduct: Column) -> Column:
    return F.coalesce(_by_conduct(conduct, dict(presets.CONDUCT)), _empty())


def replacement_problem(original: Column, replacement: Column, target: Column, co: Column, source_conduct: Column, target_conduct: Column) -> Column:
    """The first thing wrong with a written sentence, or null."""
    body, others = F.trim(F.coalesce(replacement, F.lit(""))), others_of(target, co)
    count = lambda s: F.aggregate(others, F.lit(0), lambda acc, n: acc + F.size(F.split(s, F.concat(F.lit("\\Q"), n, F.lit("\\E")))) - 1)
    d_source, d_target = (_by_conduct(c, presets.DISCRIMINATORS) for c in (source_conduct, target_conduct))
    shared = d_source.isNotNull() & d_target.isNotNull()
    source_cues, target_cues = F.when(shared, d_source).otherwise(_cues(source_conduct)), F.when(shared, d_target).otherwise(_cues(target_conduct))
    any_in = lambda cues: F.exists(cues, lambda c: F.contains(body, c))
    before, after = mask_counts(original), mask_counts(body)
    return (
        F.when(body == "", "empty_replacement").when(body.contains("\n"), "replacement_not_single_sentence")
        .when(~mentions(body, target, others), "replacement_missing_target").when(count(body) > count(original), "replacement_mentions_other_defendant")
        .when(source_conduct.isNotNull() & ~source_conduct.eqNullSafe(target_conduct) & any_in(source_cues), "replacement_keeps_source_conduct")
        .when((F.size(target_cues) > 0) & ~any_in(target_cues), "replacement_missing_target_conduct").when((after[0] < before[0]) | (after[1] < before[1]), "replacement_restores_mask")
    )


def change_appears(part: Column, spec: Column) -> Column:
    """Whether the target's part of a text shows every changed field as wanted, and the old value no more."""
    fields, old, new = spec["changed_fields"], spec["source_factors"], spec["target_factors"]
    ok = F.lit(True)
    for name, cues in (("restitution", presets.RESTITUTION), ("surrender", presets.SURRENDER), ("confession", presets.CONFESSION)):
        ok = ok & (~F.array_contains(fields, name) | new[name].isNull() | F.coalesce(cue_polarity(part, cues) == new[name], F.lit(False)))
    d_new, d_old = _by_conduct(new["conduct"], presets.DISCRIMINATORS), F.coalesce(_by_conduct(old["conduct"], presets.DISCRIMINATORS), _empty())
    any_in = lambda cues: F.exists(cues, lambda c: F.contains(part, c))
    other = ~new["conduct"].eqNullSafe(old["conduct"])
    by_word = any_in(d_new) & ~(other & any_in(d_old))
    by_cue = F.array_contains(conducts(part), new["conduct"]) & ~(other & F.coalesce(F.array_contains(conducts(part), old["conduct"]), F.lit(False)))
    ok = ok & (~F.array_contains(fields, "conduct") | new["conduct"].isNull() | F.when(d_new.isNotNull(), by_word).otherwise(by_cue))
    got = amount_in(part)
    gone = old["amount"].isNull() | amounts_match(old["amount"], new["amount"]) | ~F.exists(amounts_in(part), lambda a: amounts_match(a, old["amount"], new["amount"]))
    return ok & (~F.array_contains(fields, "amount") | new["amount"].isNull() | (F.coalesce(amounts_match(got, new["amount"], old["amount"]), F.lit(False)) & gone))


def supports(clause: Column, spec: Column) -> Column:
    """Whether one clause alone shows every changed field as wanted."""
    fields, old, new = spec["changed_fields"], spec["source_factors"], spec["target_factors"]
    ok = F.lit(True)
    for name, cues in (("restitution", presets.RESTITUTION), ("surrender", presets.SURRENDER), ("confession", presets.CONFESSION)):
        ok = ok & (~F.array_contains(fields, name) | new[name].isNull() | F.coalesce(cue_polarity(clause, cues) == new[name], F.lit(False)))
    words = _by_conduct(new["conduct"], presets.DISCRIMINATORS)
    told = F.when(words.isNotNull(), F.exists(words, lambda w: F.contains(clause, w))).otherwise(F.array_contains(conducts(clause), new["conduct"]))
    ok = ok & (~F.array_contains(fields, "conduct") | new["conduct"].isNull() | told)
    return ok & (~F.array_contains(fields, "amount") | new["amount"].isNull() | F.exists(amounts_in(clause), lambda a: amounts_match(a, new["amount"], old["amount"])))


def attributed(text: Column, target: Column, others: Column) -> Column:
    """All clauses with whom they name (own, other); those that name nobody take it from their sentence."""
    inner = lambda o: F.transform(_named(sentences(text), target, o, True), lambda s: F.transform(_named(clauses(s["s"]), target, o, True), lambda c: F.struct(
        c["s"].alias("s"), F.when(c["own"] | c["other"], c["own"]).otherwise(s["own"]).alias("own"), F.when(c["own"] | c["other"], c["other"]).otherwise(s["other"]).alias("other"))))
    return F.flatten(bound(others, inner))


def names_overlap(target: Column, others: Column) -> Column:
    """Whether one person's name holds another's."""
    everybody = F.concat(F.array(target), others)
    return F.exists(everybody, lambda a: F.exists(others, lambda b: (a != b) & (F.contains(a, b) | F.contains(b, a))))


def drift(before: Column, after: Column, spec: Column) -> Column:
    """Codes of the target's factors that differ from what they should be: changed ones from the wanted value, others from the parent."""
    fields, new, codes = spec["changed_fields"], spec["target_factors"], []
    for n in ("amount", "surrender", "restitution", "confession", "role", "conduct"):
        changed = F.array_contains(fields, n)
        if n not in ("amount", "role"):
            wrong = ~after[n].eqNullSafe(new[n]) & (new[n].isNotNull() if n == "conduct" else F.lit(True))
            codes.append(F.when(changed & wrong, f"factor_mismatch:{n}"))
        codes.append(F.when(~changed & ~after[n].eqNullSafe(before[n]), f"non_target_changed:{n}"))
    return F.array_compact(F.array(*codes))


def leakage(parent: Column, text: Column, target_charge: Column, names: str | None = None) -> Column:
    """Codes of label or outcome talk that the text has more of than its parent; names is a lexicon's pattern."""
    more = lambda p, words=(): count_of(text, p, words) > count_of(parent, p, words)
    # the word is looked for before what stands behind it: the look-behind alone tries 200 places at every character
    charge = more(presets.CUED_CHARGE) | (more(names) if names else F.lit(False))
    conclusion = more(f"(?:{presets.STRONG_CONCLUSION}|(?={presets.WEAK_CONCLUSION})(?<!{presets.HISTORY}[^，,、。；！？\\n]{{0,200}})(?:{presets.WEAK_CONCLUSION}))[^。；！？\\n]*", presets.CONCLUSION_WORDS) | more(presets.RESULT_STATEMENT)
    label = F.concat(F.lit("\\Q"), target_charge, F.lit("罪\\E"))
    before, after = mask_counts(parent), mask_counts(text)
    return F.array_compact(F.array(
        F.when(charge, "label_leakage"), F.when(more(presets.ARTICLE), "article_leakage"), F.when(conclusion, "conclusion_leakage"),
        F.when(target_charge.isNotNull() & (F.size(F.split(text, label)) > F.size(F.split(parent, label))), "target_label_leakage"),
        F.when(more(presets.PENALTY_TALK), "sentence_leakage"), F.when((after[0] < before[0]) | (after[1] < before[1]), "mask_restored"),
    ))


def validate(df: DataFrame, parent: str, text: str, spec: str = "spec", similarity: str = "similarity", least: float = 0.5, names: str | None = None, out: str = "validation") -> DataFrame:
    """The rows with (valid, errors, novel_ratio) of an edited text. The parts that belong to the target and to everybody else are columns first."""
    s, p, t = F.col(spec), F.col(parent), F.col(text)
    who, co = s["target_defendant"], s["co_defendants"]
    others = others_of(who, co)
    steps = df.withColumns({
        "__part": F.when(F.size(others) == 0, t).otherwise(F.array_join(F.transform(scope(t, who, co, exact=True), lambda x: x["s"]), "")),
        "__before": own_text(p, who, co), "__after": own_text(t, who, co), "__all": F.concat(F.array(who), others),
    })
    steps = steps.withColumns({"__said": attributed(t, who, others), "__overlap": names_overlap(who, others)})
    shared = F.exists("__said", lambda x: (x["own"] == x["other"]) & F.coalesce(supports(x["s"], s), F.lit(False)))
    steps = steps.withColumn("__unclear", (F.size(others) > 0) & (F.col("__overlap") | shared))
    steps = steps.withColumns({"__their_before": F.transform(others, lambda o: own_text(p, o, F.col("__all"))), "__their_after": F.transform(others, lambda o: own_text(t, o, F.col("__all")))})
    steps = steps.withColumns({"__before": factors("__before"), "__after": factors("__after")})
    same = F.zip_with("__their_before", "__their_after", lambda a, b: factors(a).eqNullSafe(factors(b)))
    moved = F.array_compact(F.zip_with(others, same, lambda o, ok: F.when(~ok, F.concat(F.lit("non_target_defendant_changed:"), o))))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    rest = F.array_compact(F.array(
        F.when(~t.contains(who), "identity_not_preserved"), F.when(F.col("__unclear"), "attribution_ambiguous").when(~change_appears(F.col("__part"), s), "target_change_missing"),
        F.when(bare(t) == bare(p), "unchanged").when(F.col(similarity) < least, "excessive_rewrite"),
    ))
    errors = F.array_distinct(F.concat(rest, drift(F.col("__before"), F.col("__after"), s), moved, leakage(p, t, s["target_charge"], names)))
    errors = F.when(F.trim(F.coalesce(t, F.lit(""))) == "", F.array(F.lit("missing_counterfactual_text"))).otherwise(errors)
    steps = steps.withColumn("__errors", errors)
    made = F.struct((F.size("__errors") == 0).alias("valid"), F.col("__errors").alias("errors"), novel_ngrams(p, t).alias("novel_ratio"))
    return steps.withColumn(out, made).drop("__part", "__before", "__after", "__all", "__their_before", "__their_after", "__said", "__overlap", "__unclear", "__errors")
