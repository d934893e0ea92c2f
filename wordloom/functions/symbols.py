"""Symbols, spellings and score columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reserved symbols by id, and the labels that stand for silence.
RESERVED = ("<eps>", "<phi>", "<unk>", "</unk>", "<s>", "</s>")
SILENCE = ("!SENT_START", "!SENT_END", "!NULL", "sil", "!ENTER", "!EXIT", "NSN", "<s>", "</s>")
FIRST_ID = len(RESERVED)
EPS, PHI, UNK, WORD_END, SENT_START, SENT_END = range(FIRST_ID)
NOT_FOUND = -1


def letters(text: Column) -> Column:
    """The ASCII letters of a text in lower case, as one string."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def symbol_array(text: Column) -> Column:
    """The characters of a string as an array; empty for the empty string."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def words(text: Column) -> Column:
    """The ASCII words of a text in lower case, as an array."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " "))
    return F.array_remove(F.split(kept, " "), "")


def symbol_table(occurrences: DataFrame) -> DataFrame:
    """(sym, id, reserved): the reserved symbols, then others by first appearance.

    ``occurrences``: sym and any number of columns that order its appearances. Only the distinct
    symbols meet in one task, to be numbered.
    """
    order = [c for c in occurrences.columns if c != "sym"]
    spark = occurrences.sparkSession
    known = spark.createDataFrame([(s, i, True) for i, s in enumerate(RESERVED)], "sym string, id int, reserved boolean")
    first = occurrences.where(~F.col("sym").isin(*RESERVED)).groupBy("sym").agg(F.min(F.struct(*order)).alias("at"))
    ids = (F.row_number().over(Window.orderBy("at")) + FIRST_ID - 1).cast("int")
    return known.unionByName(first.select("sym", ids.alias("id"), F.lit(False).alias("reserved")))


def lookup(rows: DataFrame, table: DataFrame, column: str = "sym", out: str = "id") -> DataFrame:
    """Adds the id of a symbol column, NOT_FOUND for unknown ones."""
    keys = table.select(F.col("sym").alias("_sym"), F.col("id").alias("_id"))
    return rows.join(keys, F.col(column) == F.col("_sym"), "left").withColumn(out, F.coalesce("_id", F.lit(NOT_FOUND))).drop("_sym", "_id")


def reverse_lookup(rows: DataFrame, table: DataFrame, column: str = "id", out: str = "sym") -> DataFrame:
    keys = table.select(F.col("id").alias("_id"), F.col("sym").alias("_sym"))
    return rows.join(keys, F.col(column) == F.col("_id"), "left").withColumn(out, F.col("_sym")).drop("_sym", "_id")


def silence_to_eps(label: Column) -> Column:
    return F.when(label.isin(*SILENCE), F.lit(RESERVED[EPS])).otherwise(label)


def acoustic_weight(am: Column, lm: Column, am_shift: float, lm_scale: float) -> Column:
    """Arc weight from base-e log scores, as -log10 sums."""
    return -(am + F.lit(am_shift)) / F.lit(math.log(10)) + F.lit(lm_scale) * (-lm) / F.lit(math.log(10))


def scaled(weight: Column, scale: float) -> Column:
    """Scale a weight; the semiring's zero (infinity) stays."""
    return F.when(weight == F.lit(float("inf")), weight).otherwise(weight * F.lit(scale))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do that scale, round half away from zero and scale back: also of
    numbers that have more digits than a double tells apart, and with the sign of a zero (``round`` drops it)."""
    power = F.lit(10.0**digits)
    out = F.round(x * power) / power
    out = F.when(out == 0, x * F.lit(0.0)).otherwise(out)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def spelling(word: Column) -> Column:
    """A word (array of symbols) as one string."""
    return F.array_join(word, "")


def separated(word: Column) -> Column:
    """The word's symbols with the final word end."""
    return F.array_append(word, F.lit(RESERVED[WORD_END]))


def padded(symbols: Column, order: int, pad: int = SENT_END) -> Column:
    """(order - 1) pads, the symbols, and for sentences the closing pad."""
    return F.concat(F.array_repeat(F.lit(RESERVED[pad]), order - 1), symbols)


def stripped(symbols: Column, order: int) -> Column:
    """Undo ``padded`` and drop the closing sentence end."""
    return F.slice(symbols, F.lit(order), F.greatest(F.size(symbols) - order, F.lit(0)))


def after_separator(text: Column) -> Column:
    """What follows the first '='."""
    return F.regexp_extract(text, r"^[^=]*=(.*)$", 1)


def poisson_pmf(length: Column, mean: Column) -> Column:
    """Poisson shifted by two: the chance of a length of 2 or more (the word end counts)."""
    k = length - 2
    log_factorial = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.log(i))
    power = F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(mean - 2))
    return F.when(k < 0, F.lit(0.0)).otherwise(F.exp(-(mean - 2) + power - log_factorial))
