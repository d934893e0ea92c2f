"""Alignment of symbol sequences and error rates.

The best alignment has the fewest edits and, of those, the fewest substitutions; this fixes the
numbers of insertions, deletions, substitutions and correct symbols. A cost is one integer, edits in
the high bits and substitutions in the low ones, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import ship_package

LOW = 32
INSERT = DELETE = 1 << LOW
SUBSTITUTE = (1 << LOW) + 1
#: Cells of the cost table that tracing back holds at a time, unless a row has more.
CELLS = 1 << 20


def unpack(cost: int) -> tuple[int, int]:
    """(edits, substitutions)."""
    return cost >> LOW, cost & ((1 << LOW) - 1)


def _coded(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    return tuple(np.fromiter((ids.setdefault(x, len(ids)) for x in s), np.int64, len(s)) for s in (ref, hyp))


def _first_row(n: int) -> np.ndarray:
    return np.arange(n + 1, dtype=np.int64) * INSERT


def _next_row(row: np.ndarray, symbol: int, found: np.ndarray) -> np.ndarray:
    """The row below one of the cost table, which has a row per prefix of ref; ``found`` are the
    symbols of as many columns."""
    steps = np.arange(len(row), dtype=np.int64) * INSERT
    new = row + DELETE
    new[1:] = np.minimum(new[1:], row[:-1] + np.where(found[: len(row) - 1] == symbol, 0, SUBSTITUTE))
    return np.minimum.accumulate(new - steps) + steps


def counts(ref, hyp) -> tuple[int, int, int, int]:
    """(insertions, deletions, substitutions, correct) in memory linear in hyp."""
    a, b = _coded(ref, hyp)
    row = _first_row(len(b))
    for x in a:
        row = _next_row(row, x, b)
    edits, subs = unpack(int(row[-1]))
    ins = (edits - subs + len(hyp) - len(ref)) // 2
    gone = edits - subs - ins
    return ins, gone, subs, len(ref) - gone - subs


def operations(ref, hyp) -> list[tuple[str, str | None, str | None]]:
    """(op, reference symbol, found symbol) with op c, s, d or i, traced back from the end: of equal ways
    a pair first, then a deletion. Memory grows with the sum of the lengths: a range of rows that is too large
    to hold is halved, its lower half traced first and the upper half computed again up to where that began."""
    a, b = _coded(ref, hyp)
    j, out = len(b), []
    ranges = [(0, len(a), _first_row(len(b)))]
    while ranges:
        low, high, first = ranges.pop()
        first = first[: j + 1]
        if high - low > 1 and (high - low) * (j + 1) > CELLS:
            middle, row = (low + high) // 2, first
            for x in a[low:middle]:
                row = _next_row(row, x, b)
            ranges += [(low, middle, first), (middle, high, row)]
            continue
        table = [first]
        for x in a[low:high]:
            table.append(_next_row(table[-1], x, b))
        i = high
        while i > low:
            above, here = table[i - 1 - low], table[i - low][j]
            same = j > 0 and a[i - 1] == b[j - 1]
            if j and here == above[j - 1] + (0 if same else SUBSTITUTE):
                out.append(("c" if same else "s", ref[i - 1], hyp[j - 1]))
                i, j = i - 1, j - 1
            elif here == above[j] + DELETE:
                out.append(("d", ref[i - 1], None))
                i -= 1
            else:
                out.append(("i", None, hyp[j - 1]))
                j -= 1
    out += [("i", None, symbol) for symbol in hyp[:j][::-1]]
    return out[::-1]


def align(pairs: DataFrame) -> DataFrame:
    """Adds n_ins, n_del, n_sub, n_cor, n_found and n_ref to (key columns, ref, hyp), both arrays."""
    ship_package(pairs.sparkSession)
    keys = [f for f in pairs.schema.fields if f.name not in ("ref", "hyp")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    names = ["n_ins", "n_del", "n_sub", "n_cor", "n_found", "n_ref"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*counts(r, h), len(h), len(r)) for r, h in zip(pdf["ref"], pdf["hyp"])]
            out = pdf[[f.name for f in keys]].copy()
            for k, n in enumerate(names):
                out[n] = [x[k] for x in rows]
            yield out

    return pairs.mapInPandas(work, f"{schema}, " + ", ".join(f"{n} bigint" for n in names))


def edit_operations(pairs: DataFrame) -> DataFrame:
    """(key columns, pos, op, ref_symbol, found_symbol)."""
    ship_package(pairs.sparkSession)
    keys = [f for f in pairs.schema.fields if f.name not in ("ref", "hyp")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*key, n, *op) for *key, r, h in pdf[[*(f.name for f in keys), "ref", "hyp"]].itertuples(index=False) for n, op in enumerate(operations(r, h))]
            yield pd.DataFrame(rows, columns=[*(f.name for f in keys), "pos", "op", "ref_symbol", "found_symbol"])

    return pairs.mapInPandas(work, f"{schema}, pos bigint, op string, ref_symbol string, found_symbol string")


def rates(aligned: DataFrame) -> DataFrame:
    """One row of sums, error rate, precision, recall and F; null where a rate has no ground."""
    sums = aligned.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_ins", "n_del", "n_sub", "n_cor", "n_found", "n_ref")))
    safe = lambda a, b: a / F.nullif(b, F.lit(0))
    p, r = safe(F.col("n_cor"), F.col("n_found")), safe(F.col("n_cor"), F.col("n_ref"))
    return sums.select("*", safe(F.col("n_ins") + F.col("n_del") + F.col("n_sub"), F.col("n_ref")).alias("error_rate"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f_score"))
