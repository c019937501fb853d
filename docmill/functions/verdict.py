"""Parse a model's verdict reply into a marker and a confidence.

A reply is either JSON (the whole reply, or its first ``{`` to last ``}``) or
free text. JSON that cannot be used gives UNVERIFIED, no confidence and an
error. A status *containing* LEGAL counts as legal, so ILLEGAL does too: that is
the rule being reproduced, not an oversight here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmill.fixed_values import MARKER_LEGAL, MARKER_UNVERIFIED
from docmill.functions.text import SPACE, bind, strip

# spellings of a finite decimal number; digits may be grouped by underscores
_NUMBER = (
    rf"(?U)\A{SPACE}*[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    rf"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?{SPACE}*\z"
)


def _marker(says_legal: Column) -> Column:
    return F.when(says_legal, MARKER_LEGAL).otherwise(MARKER_UNVERIFIED)


def _number(text: Column) -> Column:
    digits = F.when(text.rlike(_NUMBER), F.regexp_replace(strip(text), "_", ""))
    value = digits.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _verdict(marker: Column, confidence: Column, raw: Column, error: Column) -> Column:
    return F.struct(
        marker.alias("marker"),
        confidence.cast("int").alias("ai_confidence"),
        raw.alias("raw"),
        error.cast("string").alias("error"),
    )


def _from_json(raw: Column, json: Column) -> Column:
    # Inside brackets the parser must read to the very end, so trailing text fails.
    parsed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))

    def judge(doc: Column) -> Column:
        status_type = F.schema_of_variant(F.try_variant_get(doc, "$[0].status", "variant"))
        status = F.when(
            status_type.isNull(), F.lit("UNVERIFIED")
        ).when(status_type == "STRING", F.try_variant_get(doc, "$[0].status", "string"))
        conf_type = F.schema_of_variant(F.try_variant_get(doc, "$[0].confidence", "variant"))
        conf_text = F.try_variant_get(doc, "$[0].confidence", "string")
        confidence = (
            F.when(conf_type.isNull(), F.lit(0.0))
            .when(conf_type == "BOOLEAN", F.when(conf_text == "true", 1.0).otherwise(0.0))
            .when(conf_type.isin("VOID", "ARRAY<VARIANT>") | conf_type.startswith("OBJECT")
                  | conf_type.startswith("ARRAY"), F.lit(None).cast("double"))
            .otherwise(_number(conf_text))
        )
        one_object = (
            F.try_variant_get(doc, "$[0]", "variant").isNotNull()
            & F.try_variant_get(doc, "$[1]", "variant").isNull()
        )
        usable = one_object & status.isNotNull() & confidence.isNotNull()
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence))
        return F.when(
            F.coalesce(usable, F.lit(False)),
            _verdict(_marker(F.contains(F.upper(status), F.lit("LEGAL"))), clamped, raw,
                     F.lit(None)),
        ).otherwise(_verdict(
            F.lit(MARKER_UNVERIFIED), F.lit(None), raw, F.lit("unusable JSON reply")
        ))

    return bind(parsed, judge)


def _from_text(raw: Column) -> Column:
    percent = F.regexp_extract(raw, rf"(?U)(\d{{1,3}}){SPACE}*%", 1)
    return _verdict(
        _marker(F.contains(F.upper(raw), F.lit("LEGAL"))),
        percent.try_cast("int"),
        raw,
        F.lit(None),
    )


def parse_verdict(reply: Column) -> Column:
    """``struct<marker, ai_confidence, raw, error>`` of one reply.

    No reply at all (null) is UNVERIFIED without confidence.
    """
    def judge(raw: Column) -> Column:
        braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
        json = F.when(raw.startswith("{"), raw).otherwise(braces)
        return (
            F.when(raw.isNull(), _verdict(
                F.lit(MARKER_UNVERIFIED), F.lit(None), raw, F.lit("no reply")))
            .when(json != "", _from_json(raw, json))
            .otherwise(_from_text(raw))
        )

    return bind(strip(reply), judge)
