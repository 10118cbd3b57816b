"""Answers that come as numbered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import trim_space

_NUMBER = "\\A(\\d+)[.:)]\\s*"


def _items(text: Column) -> Column:
    """Items of a numbered list: a line with a new number starts one, other lines continue it."""

    def state(items: Column, number: Column, lines: Column) -> Column:
        return F.struct(items.alias("items"), number.cast("string").alias("number"), lines.alias("lines"))

    empty = F.array().cast("array<string>")

    def closed(acc: Column) -> Column:
        item = trim_space(F.array_join(acc["lines"], "\n"))
        return F.when(F.size(acc["lines"]) > 0, F.concat(acc["items"], F.array(item))).otherwise(acc["items"])

    def step(acc: Column, line: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(line, _NUMBER, 1), "\\A0+(?=\\d)", "")
        rest = trim_space(F.regexp_replace(line, _NUMBER, ""))
        more = F.when(rest != "", F.array(rest)).otherwise(empty)
        fresh = (number != "") & (number != acc["number"])
        return (
            F.when(fresh, state(closed(acc), number, more))
            .when(number != "", state(acc["items"], acc["number"], F.concat(acc["lines"], more)))
            .when(acc["number"] != "0", state(acc["items"], acc["number"], F.concat(acc["lines"], more)))
            .otherwise(acc)
        )

    return F.aggregate(F.split(text, "\n", -1), state(empty, F.lit("0"), empty), step, closed)


def has_surplus(response: Column, expected: Column) -> Column:
    """Whether ``parse_numbered`` leaves text out: blocks beyond those that were asked for."""
    items = _items(response)
    counted = (F.size(items) > 0) & (F.size(items) == expected.cast("int"))
    return ~counted & (F.size(F.split(response, "\\n\\n+", -1)) > expected)


def parse_numbered(response: Column, expected: Column) -> Column:
    """Exactly ``expected`` texts out of a response.

    The items of its numbered list when their number is right, else its first blocks between blank
    lines when there are enough, else the whole text for each. ``has_surplus`` marks responses with more
    blocks than that.
    """
    expected = expected.cast("int")
    items = _items(response)
    blocks = F.split(response, "\\n\\n+", -1)
    whole = F.array_repeat(trim_space(response), expected)
    return (
        F.when((F.size(items) > 0) & (F.size(items) == expected), items)
        .when(F.size(blocks) >= expected, F.transform(F.slice(blocks, 1, expected), trim_space))
        .otherwise(whole)
    )
