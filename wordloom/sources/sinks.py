"""Result files in the customary text forms, and lattices as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.symbols import RESERVED


def sentence_lines(words: Column, order: int) -> Column:
    """A sentence as a line: (order - 1) sentence ends, the words, a sentence end."""
    end = F.lit(RESERVED[5])
    return F.array_join(F.concat(F.array_repeat(end, order - 1), words, F.array(end)), " ")


def write_sentences(rows: DataFrame, path: str, order: int) -> None:
    rows.sort("utt").select(sentence_lines(F.col("words"), order).alias("value")).write.text(path)


def write_timed(rows: DataFrame, path: str) -> None:
    """Lines ``utt word start end``, in order."""
    line = F.concat_ws(" ", F.col("utt").cast("string"), "word", F.col("start_t").cast("string"), F.col("end_t").cast("string"))
    rows.sort("utt", "word_no").select(line.alias("value")).write.text(path)


def operation_lines(ops: DataFrame, symbols: DataFrame) -> DataFrame:
    """(utt, value): ``op:[ref id,ref --> found id,found]`` of each operation, by place."""
    ids = symbols.select(F.col("sym"), F.col("id").cast("string").alias("id"))
    named = ops.join(ids.toDF("ref_symbol", "ref_id"), "ref_symbol", "left").join(ids.toDF("found_symbol", "found_id"), "found_symbol", "left")
    side = lambda i, s: F.concat(F.coalesce(i, F.lit("0")), F.lit(","), F.coalesce(s, F.lit(RESERVED[0])))
    part = F.concat("op", F.lit(":["), side("ref_id", "ref_symbol"), F.lit(" --> "), side("found_id", "found_symbol"), F.lit("]"))
    joined = named.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).alias("x"))
    return joined.select("utt", F.array_join(F.transform("x", lambda x: x["p"]), " ").alias("value"))


def write_symbols(symbols: DataFrame, path: str, with_ids: bool = False) -> None:
    name = F.concat("sym", F.lit("["), F.col("id").cast("string"), F.lit("]")) if with_ids else F.col("sym")
    symbols.sort("id").select(F.concat_ws("\t", name, F.col("id").cast("string")).alias("value")).coalesce(1).write.text(path)  # a symbol table is small


def write_arc_infos(arcs: DataFrame, path: str) -> None:
    """Lines ``label start end`` of arcs with times."""
    arcs.sort("utt", "src", "dst", "label").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("label", "start_t", "end_t"))).alias("value")).write.text(path)


def write_lattices(arcs: DataFrame, symbols: DataFrame, path: str) -> None:
    """A folder with the arcs as Parquet, each lattice in OpenFST form (utt, content) and the symbol
    table, and the arcs' times if they have any."""
    from wordloom.sources.lattices import to_openfst

    arcs.write.parquet(f"{path}/arcs")
    to_openfst(arcs, symbols).write.parquet(f"{path}/fst")
    write_symbols(symbols, f"{path}/symbols")
    if "start_t" in arcs.columns:
        write_arc_infos(arcs, f"{path}/input_arcs")


def iteration_path(folder: str, what: str, iteration: int) -> str:
    return f"{folder}{what}_Iter_{iteration}"
