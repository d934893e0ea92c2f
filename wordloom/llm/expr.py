"""Column helpers: bind a value once, positions of matches, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a prefix sum adds up in one piece.
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")) + x)))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs. Pieces of fixed length keep it near linear."""

    def pieces(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int")), lambda i: F.slice(v, i * PIECE + 1, F.lit(PIECE)))
        return let(F.transform(cut, _running), carried)

    def carried(runs: Column) -> Column:
        ends = _running(F.transform(runs, lambda r: F.element_at(r, -1)))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).when(F.size(v) <= PIECE, _running(v)).otherwise(pieces(v)))


def found_spans(text: Column, pattern: str, with_left: bool = False) -> Column:
    """The leftmost non-overlapping matches of a Java pattern, as structs (s, e, m): start and end
    in code points, end exclusive, and the matched text. Matches must not be empty. With
    ``with_left`` also l: the characters from the start of the match before, or of the text."""

    def placed(hits: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda g: led(hits, g)) if with_left else plain(hits, F.split(text, pattern, -1))

    def led(hits: Column, cuts: Column) -> Column:
        before = F.transform(hits, lambda m, i: F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(cuts, i)))
        return F.zip_with(plain(hits, cuts), before, lambda x, b: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), b.alias("l")))

    def plain(hits: Column, cuts: Column) -> Column:
        gaps = F.slice(F.transform(cuts, lambda g: F.length(g).cast("bigint")), F.lit(1), F.size(hits))
        sizes = F.transform(hits, lambda m: F.length(m).cast("bigint"))
        ends = F.zip_with(prefix_sums(gaps), prefix_sums(sizes), lambda g, n: g + n)
        return F.zip_with(hits, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,l:string>>" if with_left else "array<struct<s:bigint,e:bigint,m:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits)))
