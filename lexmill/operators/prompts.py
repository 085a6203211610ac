"""Messages for a writer of sentences, and reading of its answers. Facts only: no charge, rule or direction is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import format_amount

SYSTEM = "请只改写所指明的事实，其他内容逐字保留；遮蔽标记原样保留；不得出现罪名、法条或刑罚。"
SENTENCE = SYSTEM + "只改写给出的一句，句中须有该被告人的姓名，以 JSON 返回 replacement_sentence。"


def edit_wishes(spec: Column) -> Column:
    """What is to change, in words, in the order of changed_fields."""
    new, who = spec["target_factors"], spec["target_defendant"]
    cues = F.lit(None).cast("string")
    for name, words in presets.CONDUCT:
        cues = F.when(new["conduct"] == name, "、".join(words)).otherwise(cues)

    def wish(field: Column) -> Column:
        return (
            F.when(field == "amount", F.concat(who, F.lit("的涉案金额改为"), format_amount(new["amount"]), F.lit("元")))
            .when(field == "restitution", F.concat(who, F.when(new["restitution"], "案发后已退赃或退赔").otherwise("案发后未退赃或未退赔")))
            .when(field == "conduct", F.concat(who, F.lit("的行为改为："), new["conduct"], F.lit("，可用表述："), F.coalesce(cues, F.lit(""))))
        )

    return F.array_compact(F.transform(spec["changed_fields"], wish))


def messages(spec: Column, text: Column, quote: Column | None = None) -> Column:
    """The messages of one request as JSON; with a quote, the protocol of one sentence."""
    source = F.struct(
        *([text.alias("source_text")] if quote is None else [quote.alias("source_sentence")]), spec["target_defendant"].alias("target_defendant"),
        F.coalesce(spec["co_defendants"], F.array().cast("array<string>")).alias("other_defendants"), edit_wishes(spec).alias("edits"),
    )
    system = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM if quote is None else SENTENCE).alias("content"))
    return F.to_json(F.array(system, F.struct(F.lit("user").alias("role"), F.to_json(source).alias("content"))))


def answer(raw: Column | str, field: str = "replacement_sentence") -> Column:
    """A text field of a JSON answer; null where the answer is no JSON object or the field no text."""
    v = F.try_parse_json(raw)
    one = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
