"""Column expressions over arrays in time linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that grow one array together.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], first: Column) -> Column:
    """array<kind> of what ``step(state, item)`` = (next state, out) gives item by item, from ``first``.

    An array grows by being copied, so it grows block by block and the blocks are joined once.
    """
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def of_block(part: Column, state: Column) -> Column:
        def grown(done: Column, item: Column) -> Column:
            after, out = step(done["state"], item)
            return F.struct(after.alias("state"), F.concat(done["out"], F.array(out)).alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), grown)

    def joined(done: Column, part: Column) -> Column:
        return bound(
            of_block(part, done["state"]),
            lambda b: F.struct(b["state"].alias("state"), F.concat(done["out"], F.array(b["out"])).alias("out")),
        )

    def whole(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int") - 1)
        blocks = F.transform(numbers, lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(first.alias("state"), no_blocks.alias("out"))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(blocks, start, joined, lambda done: done["out"]))).otherwise(none)

    return bound(items, whole)


def pieces(text: Column, use: Callable[[Callable[[Column, Column], Column], Column], Column]) -> Column:
    """``use(piece)``, where ``piece(start, size)`` is a stretch of the text cut without walking to it."""
    return bound(F.split(text, ""), lambda chars: use(lambda start, size: F.array_join(F.slice(chars, start + 1, size), "")))
