"""n-gram counts and the interpolated predictive distribution with one table per dish.

``counts(w, ctx)`` at the highest order are token counts; with the *minimal seating* (one table per
word and restaurant) a lower level counts in how many longer contexts a word occurs. The predictive
probability then needs counts alone:

    P(w | u) = (max(c_uw - d, 0) + (theta + d * t_u) * P(w | u')) / (theta + c_u),   t_u = distinct words

Contexts are strings of fixed-length symbols, oldest first; the parent context drops the oldest.
Joins are equi-joins on context and word; vocabularies and contexts are never crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import stored

DISCOUNT, STRENGTH = 0.5, 0.1


def char_ngrams(rows: DataFrame, text: Column, order: int, pad: str = "^") -> DataFrame:
    """(ctx, w, n): counts of each letter after its ``order - 1`` predecessors, padded at the start.
    Partial counts are combined before the shuffle."""
    body = F.concat(F.lit(pad * (order - 1)), text)
    # a look-ahead matches at every place and takes no letters
    grams = F.regexp_extract_all(body, F.lit(f"(?s)(?=(.{{{order}}}))"), F.lit(1))
    one = rows.where(F.length(text) > 0).select(F.explode(grams).alias("g"))
    counted = one.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.expr(f"substring(g, 1, {order - 1})").alias("ctx"), F.expr(f"substring(g, {order})").alias("w"), "n")


def word_ngrams(rows: DataFrame, words: Column, order: int) -> DataFrame:
    """(ctx, w, n) with blanks between the words of a context; sentences end and begin with </s>."""
    body = F.concat(F.array_repeat(F.lit("</s>"), order - 1), words, F.array(F.lit("</s>")))
    chars, grams = body, body
    for k in range(1, order):
        grams = F.zip_with(F.slice(grams, F.lit(1), F.size(grams) - 1), F.slice(chars, F.lit(1 + k), F.size(chars) - k), lambda a, b: F.concat(a, F.lit(" "), b))
    counted = rows.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.regexp_extract("g", r"^(.*?) ?[^ ]+$", 1).alias("ctx"), F.regexp_extract("g", r"([^ ]+)$", 1).alias("w"), "n")


#: The parent of a context: without its oldest letter, or its oldest word.
LETTER_PARENT = "substring(ctx, 2)"
WORD_PARENT = "regexp_replace(ctx, '^[^ ]* ?', '')"


def lower(level: DataFrame, parent: str = LETTER_PARENT) -> DataFrame:
    """The level below: parent context, word, number of contexts that the word occurs in."""
    return level.groupBy(F.expr(parent).alias("ctx"), "w").agg(F.count(F.lit(1)).alias("n"))


def levels(top: DataFrame, order: int, parent: str = LETTER_PARENT) -> list[DataFrame]:
    """Counts by level, the highest order first, the empty context last. The highest counts are
    written once, since every level and total derives from them; texts are read once."""
    out = [stored(top, "ngrams")]
    for _ in range(order - 1):
        out.append(lower(out[-1], parent))
    return out


def totals(level: DataFrame) -> DataFrame:
    """(ctx, c_u, t_u) of a level."""
    return level.groupBy("ctx").agg(F.sum("n").alias("c_u"), F.count(F.lit(1)).alias("t_u"))


def back_off(discount: float, strength: float) -> Column:
    """The mass that a context leaves to its parent."""
    return (F.lit(strength) + F.lit(discount) * F.col("t_u")) / (F.lit(strength) + F.col("c_u"))


def predictive(all_levels: list[DataFrame], discount: float = DISCOUNT, strength: float = STRENGTH, base: Column | None = None, parent: str = LETTER_PARENT) -> DataFrame:
    """(ctx, w, n, p) for the seen n-grams of the highest level; ``base`` is the probability of a
    word under the base measure (by default uniform over the words of the lowest level plus one)."""
    lowest = all_levels[-1]
    if base is None:
        rows = lowest.withColumn("base", F.lit(1.0 / (lowest.count() + 1)))
    else:
        rows = lowest.withColumn("base", base)
    probs = None
    for level in reversed(all_levels):
        own = level if level is not lowest else rows
        own = own.join(totals(level), "ctx")
        if probs is not None:
            own = own.withColumn("parent", F.expr(parent)).join(probs.select(F.col("ctx").alias("parent"), "w", F.col("p").alias("base")), ["parent", "w"]).drop("parent")
        p = (F.col("n") - F.lit(discount) + (F.lit(strength) + F.lit(discount) * F.col("t_u")) * F.col("base")) / (F.lit(strength) + F.col("c_u"))
        probs = own.select("ctx", "w", "n", p.alias("p"))
    return probs


def transitions(level: DataFrame, probs: DataFrame, discount: float = DISCOUNT, strength: float = STRENGTH) -> DataFrame:
    """Arcs of a context: (ctx, w, next_ctx, p), with a back-off arc <phi> to the parent."""
    width = F.length("ctx")
    words = probs.select("ctx", "w", F.when(width == 0, F.lit("")).otherwise(F.expr("concat(substring(ctx, 2), w)")).alias("next_ctx"), "p")
    phi = totals(level).where(F.length("ctx") > 0).select("ctx", F.lit("<phi>").alias("w"), F.expr("substring(ctx, 2)").alias("next_ctx"), back_off(discount, strength).alias("p"))
    return words.unionByName(phi)


def longest_contexts(queries: DataFrame, contexts: DataFrame, longest: int) -> DataFrame:
    """Adds found, the longest suffix of ``ctx`` that is a context. One join on all suffixes."""
    suffixes = F.array(*(F.expr(f"right(ctx, {k})") for k in range(longest + 1)))
    wide = queries.withColumn("_suffix", F.explode(F.array_distinct(suffixes)))
    known = contexts.select(F.col("ctx").alias("_suffix")).distinct()
    best = wide.join(known, "_suffix", "left_semi").groupBy(*queries.columns).agg(F.max_by("_suffix", F.length("_suffix")).alias("found"))
    return best


def missing_symbols(available: DataFrame, lowest: DataFrame) -> DataFrame:
    """Symbols that the root restaurant doesn't hold."""
    return available.join(lowest.select(F.col("w").alias("sym")), "sym", "left_anti")
