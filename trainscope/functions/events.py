"""Expressions over events and their payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainscope.functions.logs import _lookup
from trainscope.functions.text import _c
from trainscope.schemas import SEVERITIES


def severity_code(name: Column | str) -> Column:
    """Severity number; empty means INFO, an unknown name gives NULL."""
    text = F.coalesce(_c(name), F.lit(""))
    return F.when(text == "", F.lit(SEVERITIES["INFO"])).otherwise(_lookup(text, SEVERITIES))


def severity_value(name: str | None) -> int:
    """The same for an argument; an unknown name is an error."""
    if not name:
        return SEVERITIES["INFO"]
    if name not in SEVERITIES:
        raise ValueError(f"invalid severity level: {name}")
    return SEVERITIES[name]


def severity_name(code: Column | str) -> Column:
    number = _c(code)
    named = F.coalesce(*[F.when(number == v, F.lit(k)) for k, v in SEVERITIES.items()])
    return F.coalesce(named, number.cast("string"))


def payload_text(payload: Column | str) -> Column:
    """Text of a posted message; NULL marks a payload to reject.

    Absent and null members count as empty text; a member of another type makes
    the payload bad, as does text that is not JSON.  Names count in any case, and of
    doubled ones the last does.
    """
    named = _c(payload)
    for name in ("msg_type", "content", "text"):  # a quote that is not escaped begins or ends a string, and only a name has a colon after it
        named = F.regexp_replace(named, rf'(?<!\\)"(?i:{name})"(?=\s*:)', f'"{name}"')
    doc = F.try_parse_json(named)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit("VOID"))

    def text_or_void(path: str) -> Column:
        return kind(path).isin("STRING", "VOID")

    def object_or_void(path: str) -> Column:
        return kind(path).startswith("OBJECT") | (kind(path) == "VOID")

    good = (doc.isNotNull() & object_or_void("$") & object_or_void("$.content")
            & text_or_void("$.msg_type") & text_or_void("$.content.text"))
    return F.when(good, F.coalesce(F.try_variant_get(doc, "$.content.text", "string"), F.lit("")))


def alert_payload(text: Column | str) -> Column:
    """Chat message body for one notification text."""
    return F.to_json(F.struct(F.lit("text").alias("msg_type"),
                              F.struct(_c(text).alias("text")).alias("content")))
