"""Lexicons: built from words, compared with a reference, and their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.symbols import poisson_pmf


def build(words: DataFrame) -> DataFrame:
    """(word, n, len) of the words in a column ``word``; empty words don't count."""
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("len", F.length("word").cast("bigint"))


def scores(found: DataFrame, reference: DataFrame) -> DataFrame:
    """n_found, n_ref, n_correct, precision, recall and F of two columns ``word``, as sets."""
    both = found.select("word").distinct().withColumn("f", F.lit(1)).join(reference.select("word").distinct().withColumn("r", F.lit(1)), "word", "full")
    sums = both.agg(F.count("f").alias("n_found"), F.count("r").alias("n_ref"), F.count(F.when(F.col("f").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_correct"))
    safe = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    p, r = safe("n_correct", "n_found"), safe("n_correct", "n_ref")
    return sums.select("*", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f_score"))


def length_histogram(lexicon: DataFrame) -> DataFrame:
    """(length, n, share), the length counting the word end, weighted by n."""
    rows = lexicon.groupBy((F.col("len") + 1).alias("length")).agg(F.sum("n").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # as many rows as there are lengths


def mean_length(histogram: DataFrame) -> DataFrame:
    return histogram.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean"))


def length_scale(observed_mean: Column, generated: DataFrame) -> DataFrame:
    """(length, scale): the shifted Poisson of the observed mean over the generated share; lengths
    without a generated share get 0."""
    target = poisson_pmf(F.col("length"), observed_mean)
    return generated.select("length", F.coalesce(target / F.nullif(F.col("share"), F.lit(0.0)), F.lit(0.0)).alias("scale"))


def disambiguated(pronunciations: DataFrame) -> DataFrame:
    """From (line, word, phones): the first pronunciation of each word; words that sound alike get a
    closing #k, k counting from 1 after the first of them by line. Groups are homophones."""
    first = pronunciations.groupBy("word").agg(F.min(F.struct("line", "phones")).alias("x")).select("word", F.col("x.line").alias("line"), F.col("x.phones").alias("phones"))
    k = F.row_number().over(Window.partitionBy("phones").orderBy("line", "word")) - 1
    ranked = first.select("line", "word", "phones", k.alias("k"))
    return ranked.select("line", "word", F.when(F.col("k") > 0, F.array_append("phones", F.concat(F.lit("#"), F.col("k").cast("string")))).otherwise(F.col("phones")).alias("phones"), "k")


def unknown_words(words: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """Distinct words without a pronunciation."""
    return words.select("word").distinct().join(pronunciations.select("word"), "word", "left_anti")


def active(lexicon: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of a lexicon whose word occurs as a substring of a text."""
    from wordloom.operators.sampler import active_words

    lengths = [r[0] for r in lexicon.select(F.length("word")).distinct().collect()]  # as many as word lengths
    return lexicon.join(active_words(texts, None, lengths=sorted(lengths) or [1]).withColumnRenamed("w", "word"), "word", "left_semi")
