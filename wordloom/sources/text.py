"""Text inputs: file lists, unsegmented text, transcriptions, symbol files, dictionaries."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.symbols import RESERVED, WORD_END


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list names, one a line, in order. Lists are short; texts are not read here."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def qualified(spark: SparkSession, path: str) -> str:
    """A path in the form in which rows name their file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getPath()
    return re.sub("^file:/+", "file:///", found.toUri().toString())


def file_column() -> Column:
    """The file of a row, with local files in one form."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value) with the line counted from 1 within its file. Files are read in splits: a
    line's number is its place in its split and the number of lines in the splits before it."""
    split = ["file", "block"]
    rows = spark.read.text(paths).select(file_column().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = rows.groupBy(*split).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*split, (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, split).select("file", (F.col("id") + F.col("shift")).cast("int").alias("line"), "value")


def numbered(rows: DataFrame, spark: SparkSession, paths: list[str]) -> DataFrame:
    """Adds place, a line's number over all files in the order of ``paths``: the lines of the files
    before it are added. One row a file reaches the driver."""
    counts = {r.file: r.n for r in rows.groupBy("file").agg(F.max("line").alias("n")).collect()}
    offset, offsets = 0, []
    for path in dict.fromkeys(qualified(spark, p) for p in paths):
        offsets.append((path, offset))
        offset += counts.get(path, 0)
    return rows.join(F.broadcast(spark.createDataFrame(offsets, "file string, _offset int")), "file").withColumn("place", F.col("line") + F.col("_offset")).drop("_offset")


def sentences(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(file, line, name, symbols) from (file, line, value); an empty line is an error, or is left
    out if not strict."""
    symbols = F.array_remove(F.split(F.trim("value"), r"\s+"), "")
    out = rows.select("file", "line", F.concat("file", F.lit("_Line_"), F.col("line").cast("string")).alias("name"), symbols.alias("symbols"))
    if not strict:
        return out.where(F.size("symbols") > 0)
    fault = F.raise_error(F.concat(F.lit("empty line "), F.col("name")))
    return out.withColumn("symbols", F.when(F.size("symbols") == 0, fault.cast("array<string>")).otherwise(F.col("symbols")))


def transcription(rows: DataFrame) -> DataFrame:
    """Adds words (array of arrays): the symbols between word ends, without the closing sentence end."""
    body = F.array_join(F.filter("symbols", lambda s: s != RESERVED[5]), " ")
    words = F.transform(F.split(body, RESERVED[WORD_END]), lambda w: F.array_remove(F.split(F.trim(w), r"\s+"), ""))
    return rows.withColumn("words", F.filter(words, lambda w: F.size(w) > 0))


def arcs_of(rows: DataFrame) -> DataFrame:
    """A chain lattice of weight zero for each (utt, symbols)."""
    return rows.select("utt", F.posexplode("symbols").alias("src", "label")).select("utt", F.col("src").cast("bigint").alias("src"), (F.col("src") + 1).cast("bigint").alias("dst"), "label", F.lit(0.0).alias("weight"))


def symbol_file(spark: SparkSession, path: str) -> DataFrame:
    """(sym, id): ids follow the order of lines; the first must be the reserved symbols."""
    rows = lines(spark, [path]).where(F.length(F.trim("value")) > 0).select((F.col("line") - 1).alias("id"), F.split(F.trim("value"), r"\s+")[0].alias("sym"))
    head = [r.sym for r in rows.where(F.col("id") < len(RESERVED)).orderBy("id").collect()]
    if head != list(RESERVED):
        raise ValueError(f"{path}: the first symbols must be {' '.join(RESERVED)}")
    return rows.select("sym", "id")


def arc_infos(spark: SparkSession, path: str) -> DataFrame:
    """(ilabel, label, start_t, end_t), the row number being the arc's input label."""
    rows = lines(spark, [path]).where(F.length(F.trim("value")) > 0)
    part = F.split(F.trim("value"), r"\s+")
    return rows.select((F.col("line") - 1).alias("ilabel"), part[0].cast("int").alias("label"), part[1].cast("double").alias("start_t"), part[2].cast("double").alias("end_t"))


def pronunciations(rows: DataFrame) -> DataFrame:
    """(line, word, phones) from (line, value): the word, then its phones."""
    part = F.array_remove(F.split(F.trim("value"), r"\s+"), "")
    return rows.where(F.length(F.trim("value")) > 0).select("line", F.get(part, 0).alias("word"), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))).alias("phones"))


def spoken(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(utt, words, symbols): (utt, words) by their phones, each word closed by a word end. A word
    without a pronunciation is an error."""
    placed = rows.select("utt", F.posexplode("words").alias("pos", "word"))
    joined = placed.join(dictionary.select("word", "phones"), "word", "left")
    phones = F.when(F.col("phones").isNull(), F.raise_error(F.concat(F.lit("no pronunciation for "), F.col("word"))).cast("array<string>")).otherwise(F.array_append("phones", F.lit(RESERVED[WORD_END])))
    by_utt = joined.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("pos", "word", phones.alias("phones")))).alias("x"))
    return by_utt.select("utt", F.transform("x", lambda x: x["word"]).alias("words"), F.flatten(F.transform("x", lambda x: x["phones"])).alias("symbols"))


def files_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(utt, content) of text files, one utterance a file."""
    return spark.read.text(paths, wholetext=True).select(file_column().alias("utt"), F.col("value").alias("content"))


def read_input(spark: SparkSession, kind: str, paths: list[str], symbols: DataFrame | None = None, times: DataFrame | None = None, node_times: bool = False, **options) -> DataFrame:
    """Dispatch by lattice type: arcs (utt, src, dst, label, weight), start_t and end_t too if the
    input has times: ``node_times`` reads those of HTK nodes, ``times`` (ilabel, label, start_t,
    end_t) gives those of OpenFST input labels. Final weights become <eps> arcs."""
    from wordloom.operators.lattice import with_final_arcs
    from wordloom.sources import lattices

    if kind == "text":
        return arcs_of(sentences(lines(spark, paths)).select(F.col("name").alias("utt"), "symbols"))
    if kind == "htk":
        return lattices.slf(files_of(spark, paths), node_times=node_times, **options)
    if kind == "openfst":
        arcs, finals = lattices.openfst(spark.read.format("binaryFile").load(paths).select(file_column().alias("utt"), "content"))
        named = lattices.named(arcs, symbols)
        if times is not None:
            named = named.join(F.broadcast(times.select("ilabel", "start_t", "end_t")), "ilabel", "left")
        return with_final_arcs(named.drop("ilabel"), finals)
    if kind == "att":
        return with_final_arcs(*lattices.att(files_of(spark, paths)))
    raise ValueError(f"lattice type {kind!r} isn't supported")


def parse_prune(text: str) -> float:
    return math.inf if text.lower() in ("inf", "infinity") else float(text)
