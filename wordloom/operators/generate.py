"""Words drawn from a letter n-gram model; each letter of each drawn row has its own random number,
taken from a digest of (seed, row, place), so that any engine can draw the same words."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import ship_package, stored

#: A letter model has at most alphabet ** order rows; above this it isn't broadcast.
MODEL_ROWS = 2_000_000


def uniform(seed: int, no: int, place: int) -> float:
    """A number from 0 to 1: 52 bits of the digest."""
    return int(hashlib.md5(f"{seed}-{no}-{place}".encode()).hexdigest()[:13], 16) / 2.0**52


def words(probs: DataFrame, order: int, n: int, seed: int, end: str = "$", pad: str = "^", longest: int = 200) -> DataFrame:
    """(no, word): ``probs`` holds (ctx, w, p) of the seen n-grams; their shares are normalised."""
    spark = probs.sparkSession
    ship_package(spark)
    found = probs.limit(MODEL_ROWS + 1).toPandas()
    if len(found) > MODEL_ROWS:
        raise ValueError("the letter model is too large to broadcast; lower the order")
    model: dict[str, tuple[list[str], list[float]]] = {}
    for ctx, own in found.sort_values(["ctx", "w"]).groupby("ctx"):
        model[ctx] = (own["w"].tolist(), np.cumsum(own["p"].to_numpy()).tolist())
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = shared.value
        for pdf in batches:
            out = []
            for no in pdf["id"]:
                ctx, word = pad * (order - 1), ""
                while len(word) < longest and ctx in letters:
                    choice, mass = letters[ctx]
                    c = choice[min(bisect.bisect_right(mass, uniform(seed, int(no), len(word)) * mass[-1]), len(choice) - 1)]
                    if c == end:
                        break
                    word += c
                    ctx = (ctx + c)[1:] if order > 1 else ""
                out.append(word)
            yield pd.DataFrame({"no": pdf["id"], "word": out})

    return spark.range(n).mapInPandas(work, "no bigint, word string")


def sentences(probs: DataFrame, n: int, seed: int, end: str = "</s>", longest: int = 100, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(no, words): sentences drawn from a word bigram model (ctx, w, p) over its words, none of them
    new; a sentence begins after ``end`` and ends with it. A model of more than ``model_rows`` rows is
    joined to the sentences word by word."""
    spark = probs.sparkSession
    ship_package(spark)
    probs = stored(probs.select("ctx", "w", "p"), "bigrams")
    if probs.count() > model_rows:
        return _joined_sentences(probs, n, seed, end, longest)
    found = probs.toPandas()
    model = {ctx: (own["w"].tolist(), np.cumsum(own["p"].to_numpy()).tolist()) for ctx, own in found.sort_values(["ctx", "w"]).groupby("ctx")}
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = shared.value
        for pdf in batches:
            out = []
            for no in pdf["id"]:
                ctx, drawn = end, []
                while len(drawn) < longest and ctx in after:
                    choice, mass = after[ctx]
                    ctx = choice[min(bisect.bisect_right(mass, uniform(seed, int(no), len(drawn)) * mass[-1]), len(choice) - 1)]
                    if ctx == end:
                        break
                    drawn.append(ctx)
                out.append(drawn)
            yield pd.DataFrame({"no": pdf["id"], "words": out})

    return spark.range(n).mapInPandas(work, "no bigint, words array<string>")


#: Words of a context that share a range of the numbers drawn.
RANGE_WORDS = 64


def _ranges(probs: DataFrame) -> DataFrame:
    """(ctx, part, whole, highs, words): by context and part of its numbers the words drawn there, in order,
    up to which number of whole, and blank-separated; a word that spans parts is in each. In front of a
    word the parts of the context that it makes, 0 if there is none."""
    by_ctx = Window.partitionBy("ctx")
    so_far = by_ctx.orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = probs.select("ctx", "w", F.sum("p").over(so_far).alias("high"), F.row_number().over(by_ctx.orderBy("w")).alias("r"))
    rows = rows.select("*", F.lag("high", 1, 0.0).over(by_ctx.orderBy("w")).alias("low"))
    sizes = stored(rows.groupBy("ctx").agg(F.max("r").alias("last"), F.max("high").alias("whole"), F.ceil(F.max("r") / RANGE_WORDS).alias("n_parts")), "sizes")
    rows = rows.join(sizes, "ctx").join(sizes.select(F.col("ctx").alias("w"), F.col("n_parts").alias("parts")), "w", "left")
    place = lambda mass, more: F.least(F.greatest(F.floor(F.col(mass) / F.col("whole") * F.col("n_parts") + F.lit(more)), F.lit(0)), F.col("n_parts") - 1)
    span = F.sequence(place("low", -1e-9), F.when(F.col("r") == F.col("last"), F.col("n_parts") - 1).otherwise(place("high", 1e-9)))
    marked = F.concat(F.coalesce("parts", F.lit(0)).cast("string"), F.lit(":"), "w")
    rows = rows.select("ctx", F.explode(span).alias("part"), "whole", F.struct("r", "high", marked.alias("w")).alias("x"))
    rows = rows.groupBy("ctx", "part").agg(F.first("whole").alias("whole"), F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("ctx", "part", "whole", F.col("x.high").alias("highs"), F.array_join("x.w", " ").alias("words_there"))


def _joined_sentences(probs: DataFrame, n: int, seed: int, end: str, longest: int) -> DataFrame:
    """A round of joins a word: sentences that go on, as (no, ctx, parts), with the words of their context
    around the number drawn. Each round is written; a sentence is in the round that ends it."""
    spark = probs.sparkSession
    ranges = stored(_ranges(probs).repartition(2 * spark.sparkContext.defaultParallelism, "ctx", "part"), "ranges")
    first = ranges.where(F.col("ctx") == end).agg(F.max("part").alias("part")).first()["part"]
    blank = F.array().cast("array<string>")
    front = spark.range(n).select(F.col("id").alias("no"), F.lit(end).alias("ctx"), F.lit(0 if first is None else first + 1).cast("bigint").alias("parts"), blank.alias("words"))
    if first is None or longest < 1:
        return front.select("no", "words")
    paths = []
    for k in range(longest):
        bits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("no").cast("string"), F.lit(str(k)))), 1, 13), 16, 10)
        drawn = front.withColumn("u", bits.cast("bigint") / F.lit(2.0**52)).withColumn("part", F.least(F.floor(F.col("u") * F.col("parts")), F.col("parts") - 1))
        hits = drawn.drop("parts").join(ranges, ["ctx", "part"]).withColumn("x", F.col("u") * F.col("whole"))
        before = F.size(F.filter("highs", lambda high: high <= F.col("x")))
        hits = hits.select("no", "words", F.element_at(F.split("words_there", " "), F.least(before + 1, F.size("highs"))).alias("w"))
        hits = hits.select("no", "words", F.substring_index("w", ":", 1).cast("bigint").alias("parts"), F.regexp_replace("w", "^[0-9]+:", "").alias("ctx"))
        words = F.when(F.col("ctx") == end, F.col("words")).otherwise(F.array_append("words", F.col("ctx")))
        over = (F.col("ctx") == end) | (F.col("parts") == 0) | F.lit(k + 1 == longest)
        rows = stored(hits.select("no", "ctx", "parts", words.alias("words"), over.alias("over")), "drawn")
        paths.append(rows.stored_path)
        front = rows.where("NOT over").drop("over")
        if k % 10 == 9 and front.isEmpty():
            break
    return spark.read.schema(rows.schema).parquet(*paths).where("over").select("no", "words")


def length_shares(drawn: DataFrame) -> DataFrame:
    """(length, n, share) of drawn words, the length counting the word end."""
    from wordloom.operators.lexicon import length_histogram

    return length_histogram(drawn.select(F.length("word").cast("bigint").alias("len"), F.lit(1).alias("n")))
