"""Named text parsers: a parser turns a text column into an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from trainscope.functions.logs import log_entry
from trainscope.functions.stacks import parse_stack_dump

Parser = Callable[[Column], Column]

_parsers: dict[str, Parser] = {"log": log_entry, "stack": parse_stack_dump}


def register_parser(name: str, parser: Parser) -> None:
    _parsers[name] = parser


def parse_with(df: DataFrame, name: str, column: str, into: str = "parsed") -> DataFrame:
    if name not in _parsers:
        raise ValueError(f"no parser named {name}")
    return df.withColumn(into, _parsers[name](df[column]))
