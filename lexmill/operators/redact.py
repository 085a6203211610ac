"""Label-agnostic redaction: conclusions first, then articles and charge names on what is left. All of it is columns.

Spans are found by one pattern each, walked from match to match: what lies before a match and the match itself
alternate, so their lengths add up to the offsets, which count code points. Null text is empty; a text without
a match has no spans. Offsets are running sums and overlaps are joined by running maxima, a few passes over a text's
spans however many there are; masks are put in by an Arrow kernel in one pass over the text. Large lexica are looked up
by an automaton (``mentions``) in place of a pattern that names them all.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import may_match, running
from ..presets import Rules

SPAN = "struct<category:string,text:string,start:int,end:int,mode:string>"


def surface_forms(label: Column | str) -> Column:
    """Names of a label: of a bracketed list one item, or the list without brackets, and all ways to choose."""
    bare = F.regexp_replace(F.trim(F.col(label) if isinstance(label, str) else label), "罪$", "")
    pieces = F.regexp_extract_all(bare, F.lit(r"\[[^\[\]]+\]|\[|[^\[]+"), F.lit(0))
    items = lambda p: F.filter(F.split(F.substr(p, F.lit(2), F.length(p) - 2), "、"), lambda x: x != "")
    choices = lambda p: F.when(p.rlike(r"^\[[^\[\]]+\]$"), F.concat(items(p), F.array(F.array_join(items(p), "、")))).otherwise(F.array(p))
    longer = lambda names, p: F.flatten(F.transform(names, lambda n: F.transform(choices(p), lambda c: F.concat(n, c))))
    return F.array_distinct(F.aggregate(pieces, F.array(F.lit("")), longer))


def lexicon(labels: DataFrame, label: str) -> DataFrame:
    """name and place of every surface form of two characters or more: longest first, then by name. A vocabulary, ranked in one task."""
    names = labels.select(F.explode(surface_forms(label)).alias("name")).where(F.length("name") > 1).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.length("name")), "name")).cast("long"))


def lexicon_names(labels: DataFrame, label: str) -> list[str]:
    """The lexicon's names in their order, for patterns."""
    return [r[0] for r in lexicon(labels, label).orderBy("place").select("name").collect()]


def mention_pattern(names: Iterable[str], rules: Rules = presets.LEGAL) -> str | None:
    """One pattern for all places where a rule's frames hold a name."""
    any_name = "|".join(map(re.escape, names))
    return "|".join(f.replace("NAME", f"(?:{any_name})") for f in rules.mentions) if any_name else None


class Lexicon:
    """An automaton over names: one pass over a text finds every place of every name.

    A state is a beginning of a name; ``fail`` is the longest ending of it that is a beginning as well, ``ends`` the
    name that ends here, ``shorter`` the next state down the fail links at which one does."""

    def __init__(self, names: list[str]):
        self.names = names
        self.go: list[dict[str, int]] = [{}]
        self.ends, self.fail, self.shorter = [-1], [0], [0]
        for place, name in enumerate(names):
            at = 0
            for c in name:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.ends.append(-1)
                at = self.go[at][c]
            if self.ends[at] < 0:  # of equal names the first counts
                self.ends[at] = place
        self.fail, self.shorter = [0] * len(self.go), [0] * len(self.go)
        level = list(self.go[0].values())
        while level:
            deeper = []
            for state in level:
                for c, to in self.go[state].items():
                    down = self.fail[state]
                    while down and c not in self.go[down]:
                        down = self.fail[down]
                    self.fail[to] = self.go[down].get(c, 0)
                    f = self.fail[to]
                    self.shorter[to] = f if self.ends[f] >= 0 else self.shorter[f]
                    deeper.append(to)
            level = deeper

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, name's place in the lexicon) of every occurrence, overlaps included."""
        go, fail, ends, shorter, names, state = self.go, self.fail, self.ends, self.shorter, self.names, 0
        for i, c in enumerate(text, 1):
            while state and c not in go[state]:
                state = fail[state]
            state = go[state].get(c, 0)
            hit = state if ends[state] >= 0 else shorter[state]
            while hit:
                yield i - len(names[ends[hit]]), ends[hit]
                hit = shorter[hit]

    def spans(self, text: str, framed: list[tuple[re.Pattern, re.Pattern]]) -> list[tuple[int, int]]:
        """What the pattern of all names finds: from left to right, at a place the first frame that holds, in it the first name."""
        best: dict[int, tuple[int, int, int]] = {}
        for start, place in self.places(text):
            for k, (before, after) in enumerate(framed):
                if (now := best.get(start)) is not None and now[:2] <= (k, place):
                    break
                if before.match(text, start) and (m := after.match(text, start + len(self.names[place]))):
                    best[start] = (k, place, m.end())
                    break
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                at = best[start][2]
                out.append((start, at))
        return out


# From so many names on the automaton is used; beyond so many letters its copy in each worker would be too large.
MANY, MOST_LETTERS = 64, 20_000_000


def frames(rules: Rules) -> list[tuple[re.Pattern, re.Pattern]] | None:
    """What stands before and behind a name, by frame; None if what stands before takes up letters or a pattern is none of Python's."""
    out = []
    for frame in rules.mentions:
        before, _, after = frame.partition("NAME")
        try:
            out.append((re.compile(before), re.compile(after)))
        except re.error:
            return None
        if before and not re.fullmatch(r"(\(\?<[=!](?:[^()\\]|\\.)*\))+", before):
            return None
    return out


def mentions(text: Column, names: list[str], category: str, mode: str, rules: Rules = presets.LEGAL) -> Column:
    """``found`` with the pattern of all names, through an automaton that each worker builds once from the names."""
    names, framed, number = list(names), frames(rules), uuid.uuid4().hex

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series) -> pd.Series:
        if number not in _LEXICA:
            _LEXICA.clear()
            _LEXICA[number] = Lexicon(names)
        lexicon = _LEXICA[number]
        rows = [[{"category": category, "text": t[a:b], "start": a, "end": b, "mode": mode} for a, b in lexicon.spans(t, framed)] if t else [] for t in texts]
        return pd.Series(rows, dtype=object)

    return run(text)


_LEXICA: dict[str, Lexicon] = {}


def _conclusion(rules: Rules) -> str:
    """From a marker to the end of its sentence; weak markers under a past cue of their clause don't count."""
    past = f"(?<!{rules.history}[^{rules.pauses}{rules.stops}]{{0,200}})" if rules.history else ""
    marks = [rules.strong, *([f"(?={rules.weak}){past}(?:{rules.weak})"] if rules.weak else [])]
    return f"(?:{'|'.join(marks)})[^{rules.stops}]*"


def conservative(text: Column | str, rules: Rules = presets.LEGAL) -> Column:
    """The text with result statements and conclusions masked, in one pass."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(t, f"{_conclusion(rules)}|{rules.statement}(?!认为)", re.escape(rules.mask))


def found(text: Column, pattern: str, category: str, mode: str, words: Sequence[str] = ()) -> Column:
    """The pattern's matches as an array of SPAN. Texts without any of the words that a match needs, if told, aren't walked."""
    walk = F.lit(f"\\G((?s:.*?))({pattern})")
    gaps, hits = F.regexp_extract_all(text, walk, F.lit(1)), F.regexp_extract_all(text, walk, F.lit(2))
    ends = running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
    span = lambda h, e: F.struct(F.lit(category).alias("category"), h.alias("text"), (e - F.length(h)).alias("start"), e.alias("end"), F.lit(mode).alias("mode"))
    return F.when(may_match(text, pattern, words), F.zip_with(hits, ends, span)).when(text.isNotNull(), F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """Spans (start, end) in order, those that overlap as one; spans that touch stay apart."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    reach = running(F.transform(in_order, lambda s: s["end"]), F.greatest)
    # a span is a head if nothing before it reaches into it
    marked = F.zip_with(in_order, F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.greatest(F.size(reach) - 1, F.lit(0)))), lambda s, r: F.struct(s["start"].alias("start"), r.alias("before"), (s["start"] >= r).alias("head")))
    heads = F.filter(marked, lambda m: m["head"])
    ends = F.concat(F.transform(F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), lambda m: m["before"]), F.slice(reach, F.greatest(F.size(reach), F.lit(1)), F.lit(1)))
    return F.zip_with(heads, ends, lambda m, e: F.struct(m["start"].alias("start"), e.alias("end")))


def _masked(text: pd.Series, starts: pd.Series, ends: pd.Series, mask: pd.Series) -> pd.Series:
    def one(t: str, low: np.ndarray, high: np.ndarray, m: str) -> str:
        return m.join([t[a:b] for a, b in zip([0, *high], [*low, len(t)])])

    return pd.Series([None if t is None else one(t, a, b, m) for t, a, b, m in zip(text, starts, ends, mask)], dtype=object)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of the joined spans as one mask."""
    return F.pandas_udf(_masked, "string")(text, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]), F.lit(mask))


def redact(df: DataFrame, text: str = "text", names: Iterable[str] = (), keep: list[str] = (), rules: Rules = presets.LEGAL) -> DataFrame:
    """Rows (*keep, fact_raw, fact_conservative, fact_strict, redactions); strict spans are places in the conservative text."""
    raw, mild = F.coalesce("fact_raw", F.lit("")), F.col("fact_conservative")
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("fact_raw"))
    out = out.withColumn("fact_conservative", conservative(raw, rules))
    names = list(names)
    many = len(names) > MANY and sum(map(len, names)) <= MOST_LETTERS and frames(rules) is not None
    strict = [("article", rules.article), ("charge", None if many else mention_pattern(names, rules)), ("charge", rules.cued)]
    first = [found(raw, rules.statement, "result_statement", "conservative"), found(raw, _conclusion(rules), "conclusion", "conservative", presets.CONCLUSION_WORDS if rules == presets.LEGAL else ())]
    spans = [found(mild, p, c, "strict") for c, p in strict if p]
    if many:
        spans.insert(1, mentions(mild, names, "charge", "strict", rules))
    out = out.withColumn("__strict", F.concat(*spans, F.array().cast(f"array<{SPAN}>")))
    out = out.withColumn("__joined", joined(F.col("__strict")))
    return out.select(*[F.col(f"`{c}`") for c in keep], "fact_raw", "fact_conservative", masked(mild, F.col("__joined"), rules.mask).alias("fact_strict"), F.concat(*first, "__strict").alias("redactions"))


def redaction_counts(redactions: Column | str, category: str) -> Column:
    return F.size(F.filter(redactions, lambda r: r["category"] == category))


def mask_count(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(t, F.lit(re.escape(presets.MASK)))
