"""Rule-based factors of a case: amount, three polarities, role, conduct. Native columns throughout.

A negation right before a cue (with a word of manner in between at most) denies it; a negation further back in
the clause leaves the factor unknown; negations inside other words don't count. Cues are taken longest first,
which for one leftmost-longest regular expression is the order of its alternatives."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import after, amount_in, bound, factors_match, has_any

HOLD, DENIED, DOUBTFUL = "\ue000", "\ue001", "\ue002"  # private characters: part of a word that holds a negation, a cue denied, a cue in doubt


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


MARKS = "，。；！？\n"  # they end a clause


def cue_polarity(text: Column | str, cues: Sequence[str]) -> Column:
    """True, False, or null when cues are absent, doubtful or contradict each other. Only clauses with a cue are looked at."""
    t = F.col(text) if isinstance(text, str) else text
    if any(m in c for c in cues for m in MARKS):
        return _polarity(F.coalesce(t, F.lit("")), cues)
    told = F.array_join(F.filter(F.split(t, f"[{MARKS}]"), lambda c: has_any(c, cues)), "，")
    return F.when(has_any(t, cues), bound(told, lambda c: _polarity(c, cues)))


def _polarity(t: Column, cues: Sequence[str]) -> Column:
    # words that hold a negation are blanked, one placeholder a character, so that distances stay
    for word in sorted(presets.ABSORBED, key=len, reverse=True):
        t = F.replace(t, F.lit(word), F.lit(HOLD * len(word)))
    negation, gap, cue = _any(presets.NEGATIONS), _any([g for g in presets.NEGATION_GAPS if g]), _any(cues)
    denied = f"(?={cue})(?<={negation}{gap}?){cue}"
    doubtful = f"(?={cue})(?<={negation}[^{MARKS}]{{0,11}}){cue}"

    def told(marked: Column) -> Column:
        has_no, has_doubt, has_yes = marked.contains(DENIED), marked.contains(DOUBTFUL), marked.rlike(cue)
        return F.when(has_doubt, F.lit(None).cast("boolean")).when(has_yes & ~has_no, True).when(has_no & ~has_yes, False)

    return bound(F.regexp_replace(F.regexp_replace(t, denied, DENIED), doubtful, DOUBTFUL), told)


def conduct(text: Column | str) -> Column:
    """The first conduct one of whose cues appears."""
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for name, cues in presets.CONDUCT:
        out = F.when(has_any(t, cues), name) if out is None else out.when(has_any(t, cues), name)
    return out


def conducts(text: Column | str) -> Column:
    """All conducts whose cues appear."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(has_any(t, c), n) for n, c in presets.CONDUCT]))


def role(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.contains("从犯"), "accessory").when(t.contains("主犯"), "principal").otherwise("unknown")


def mentions(text: Column, name: Column, names: Column) -> Column:
    """Whether a text names someone outside longer names that hold theirs."""
    longer = F.filter(names, lambda n: n.contains(name) & (n != name))
    # longer names hold the name: a text without it doesn't get it by their going
    return text.contains(name) & F.aggregate(longer, text, lambda acc, n: F.replace(acc, n, F.lit(""))).contains(name)


def own_text(text: Column, target: Column, co: Column) -> Column:
    """The clauses that are about the target: those naming them alone, and those naming nobody in sentences that don't name others only."""
    rest = F.filter(F.coalesce(co, F.array().cast("array<string>")), lambda n: (n != "") & (n != target))
    # a mark that nothing stands before is no part
    filled = lambda parts: F.filter(parts, lambda p: (p != "") & ~F.left(p, F.lit(1)).isin(*MARKS))
    sentences = F.filter(after(text, MARKS[1:]), lambda s: (s != "") & ~F.left(s, F.lit(1)).isin(*MARKS[1:]))
    clauses = lambda s: filled(after(s, MARKS))

    def kept(others: Column) -> Column:
        names_other = lambda s: F.exists(others, lambda n: s.contains(n))
        # a sentence that names no other stays but for marks behind marks; in the rest a clause has to name the target
        plain = lambda s: F.when(s.rlike("^，|，[，。；！？\\n]"), F.array_join(clauses(s), "")).otherwise(s)
        own = lambda s: F.array_join(F.filter(clauses(s), lambda c: c.contains(target) & ~names_other(c) & mentions(c, target, others)), "")
        # what holds of a sentence is a field beside it: two tests alike but for their lambda variable may be taken for one
        marked = F.transform(sentences, lambda s: F.struct(s.alias("s"), names_other(s).alias("other")))
        parts = F.transform(marked, lambda x: F.when(~x["other"], plain(x["s"])).when(x["s"].contains(target), own(x["s"])).otherwise(""))
        return bound(F.array_join(parts, ""), lambda j: F.when(j == "", text).otherwise(j))

    whole = (F.coalesce(target, F.lit("")) == "") | (F.size(rest) == 0)
    return F.when(whole, text).otherwise(bound(rest, kept))


def factors(text: Column | str) -> Column:
    """The struct of six factors of a text that is about one person; unknown values are null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(
        amount_in(t).alias("amount"), cue_polarity(t, presets.SURRENDER).alias("surrender"), cue_polarity(t, presets.RESTITUTION).alias("restitution"),
        cue_polarity(t, presets.CONFESSION).alias("confession"), role(t).alias("role"), conduct(t).alias("conduct"),
    )


def with_factors(df: DataFrame, text: str = "fact_strict", target: str = "target_defendant", co: str = "co_defendants", out: str = "factors") -> DataFrame:
    """The rows with the factors of their target; the target's clauses are a column first, so that they are found once."""
    own = df.withColumn("__own", own_text(F.col(text), F.col(target), F.col(co)))
    return own.withColumn(out, factors("__own")).drop("__own")


def observed(df: DataFrame, text: str, wanted: str = "target_factors", changed: str = "changed_fields", target: str = "target_defendant", co: str = "co_defendants", out: str = "observed_factors") -> DataFrame:
    """The rows with the factors that their text shows, null where it doesn't show what was to change; the wish itself is no observation."""
    read = with_factors(df, text, target, co, "__seen")
    named = F.size(F.coalesce(F.col(changed), F.array().cast("array<string>"))) > 0
    ok = F.when(named, F.col(wanted).isNotNull() & factors_match(F.col("__seen"), F.col(wanted), changed)).otherwise(F.lit(True))
    return read.withColumn(out, F.when(ok, F.col("__seen"))).drop("__seen")
