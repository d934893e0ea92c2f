"""Lattice formats: HTK SLF, AT&T text and the public OpenFST vector format over log arcs."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.symbols import acoustic_weight, silence_to_eps
from wordloom.operators.lattice import arrow_schema, merge_parallel, whole_groups
from wordloom.session import ship_package

# Fixed values of the OpenFST vector format.
FST_MAGIC = 2125659606
FST_VERSION = 2
NO_STATE = -1
STATE, STATE_SIZE = "<fq", struct.calcsize("<fq")
ARC = np.dtype([("ilabel", "<i4"), ("olabel", "<i4"), ("weight", "<f4"), ("dst", "<i4")])


def _fields(line: Column) -> Column:
    """The fields of an SLF line by name; a field given twice is an error."""
    return F.str_to_map(F.trim(line), F.lit(r"\s+"), F.lit("="))


def slf_links(files: DataFrame) -> DataFrame:
    """(utt, link, src, dst, label, am, lm) of SLF texts (utt, content). Fields of a link may come in
    any order; quotes around a label go; a missing score is 0."""
    rows = files.select("utt", F.explode(F.split("content", r"\r?\n")).alias("l")).where(F.col("l").rlike(r"^J="))
    rows = rows.select("utt", _fields(F.col("l")).alias("f"))
    field = lambda k: F.try_element_at("f", F.lit(k))
    number = lambda k: F.coalesce(field(k).cast("double"), F.lit(0.0))
    label = F.regexp_replace(F.coalesce(field("W"), F.lit("")), r'^"(.*)"$', "$1")
    return rows.select("utt", field("J").cast("bigint").alias("link"), field("S").cast("bigint").alias("src"), field("E").cast("bigint").alias("dst"), label.alias("label"), number("a").alias("am"), number("l").alias("lm"))


def slf_nodes(files: DataFrame) -> DataFrame:
    """(utt, node, t) of SLF texts."""
    rows = files.select("utt", F.explode(F.split("content", r"\r?\n")).alias("l")).where(F.col("l").rlike(r"^I="))
    rows = rows.select("utt", _fields(F.col("l")).alias("f"))
    return rows.select("utt", F.try_element_at("f", F.lit("I")).cast("bigint").alias("node"), F.try_element_at("f", F.lit("t")).cast("double").alias("t"))


def slf_name(files: DataFrame) -> DataFrame:
    """(utt, name): the utterance named in the second line."""
    return files.select("utt", F.regexp_extract("content", r"(?m)^UTTERANCE=(.*?)\s*$", 1).alias("name"))


def slf(files: DataFrame, am_shift: float = 0.0, lm_scale: float = 0.0, node_times: bool = False) -> DataFrame:
    """Arcs of SLF texts: scores to weights, silence to <eps>, parallel arcs merged. With
    ``node_times`` also start_t and end_t, the times of an arc's nodes (of merged arcs the first's)."""
    rows = slf_links(files).select("utt", "link", "src", "dst", silence_to_eps(F.col("label")).alias("label"), acoustic_weight(F.col("am"), F.col("lm"), am_shift, lm_scale).alias("weight"))
    if not node_times:
        return merge_parallel(rows.drop("link"))
    nodes = slf_nodes(files)
    ends = lambda c, t: nodes.select("utt", F.col("node").alias(c), F.col("t").alias(t))
    timed = rows.join(ends("src", "start_t"), ["utt", "src"], "left").join(ends("dst", "end_t"), ["utt", "dst"], "left")
    return merge_parallel(timed, "link").drop("link")


def to_slf(arcs: DataFrame) -> DataFrame:
    """(utt, content): arcs as SLF text, a weight w as the score a = -w * ln 10."""
    ordered = F.array_sort(F.collect_list(F.struct("src", "dst", "label", "weight")))
    grouped = arcs.groupBy("utt").agg(ordered.alias("x"), F.max(F.greatest("src", "dst")).alias("last"))
    line = F.transform("x", lambda x, i: F.format_string("J=%d S=%d E=%d W=%s a=%s l=0", i, x["src"], x["dst"], x["label"], (-x["weight"] * F.log(F.lit(10.0))).cast("string")))
    nodes = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda n: F.format_string("I=%d", n))
    head = F.format_string("VERSION=1.0\nUTTERANCE=%s\nN=%d L=%d\n", F.col("utt").cast("string"), F.col("last") + 1, F.size("x"))
    return grouped.select("utt", F.concat(head, F.array_join(nodes, "\n"), F.lit("\n"), F.array_join(line, "\n"), F.lit("\n")).alias("content"))


def att(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) of AT&T texts: ``src dst in out [weight]`` and ``state [weight]`` lines."""
    part = F.split(F.trim("l"), r"\s+")
    rows = files.select("utt", F.explode(F.split("content", r"\r?\n")).alias("l")).where(F.length(F.trim("l")) > 0).select("utt", part.alias("p"))
    weight = lambda k: F.coalesce(F.get("p", k).cast("double"), F.lit(0.0))
    arcs = rows.where(F.size("p") >= 4).select("utt", F.get("p", 0).cast("bigint").alias("src"), F.get("p", 1).cast("bigint").alias("dst"), F.get("p", 3).alias("label"), weight(4).alias("weight"))
    return arcs, rows.where(F.size("p") <= 2).select("utt", F.get("p", 0).cast("bigint").alias("state"), weight(1).alias("weight"))


def att_text(arcs: Column) -> Column:
    """An utterance's arcs (array of src, dst, label, weight) as AT&T text; states without arcs are final."""
    line = lambda x: F.format_string("%d %d %s %s %s", x["src"], x["dst"], x["label"], x["label"], x["weight"].cast("string"))
    lines = F.transform(F.array_sort(F.transform(arcs, lambda x: F.struct(x["src"], x["dst"], x["label"], line(x).alias("line")))), lambda x: x["line"])
    ends = F.array_sort(F.array_except(F.transform(arcs, lambda x: x["dst"]), F.transform(arcs, lambda x: x["src"])))
    return F.concat(F.array_join(F.concat(lines, F.transform(ends, lambda s: s.cast("string"))), "\n"), F.lit("\n"))


def to_att(arcs: DataFrame) -> DataFrame:
    """(utt, content): arcs meet once, by utterance."""
    both = arcs.groupBy("utt").agg(F.collect_list(F.struct("src", "dst", "label", "weight")).alias("x"))
    return both.select("utt", att_text(F.col("x")).alias("content"))


def encode_fst(start: int, finals: dict[int, float], arcs: dict[int, list[tuple[int, int, float, int]]], n: int, sizes: tuple[int, int] | None = None) -> bytes:
    """OpenFST vector bytes; an arc is (in label, out label, weight, next state). With ``sizes``, numbers of
    states and arcs, the head of what others write."""
    text = lambda s: struct.pack("<i", len(s)) + s
    head = struct.pack("<i", FST_MAGIC) + text(b"vector") + text(b"log") + struct.pack("<iiQqqq", FST_VERSION, 0, 0, start, *(sizes or (n, sum(map(len, arcs.values())))))
    body = []
    for s in range(n):
        own = arcs.get(s, [])
        body.append(struct.pack("<fq", finals.get(s, float("inf")), len(own)))
        body += [struct.pack("<iifi", *a) for a in own]
    return head + b"".join(body)


def _arcs_of(data: bytes) -> tuple[int, dict[int, float], np.ndarray, np.ndarray]:
    """(start, final weights, source by arc, arcs as ARC): states one by one, arcs by their places."""
    def text(at: int) -> tuple[bytes, int]:
        (n,) = struct.unpack_from("<i", data, at)
        return data[at + 4 : at + 4 + n], at + 4 + n

    if struct.unpack_from("<i", data)[0] != FST_MAGIC:
        raise ValueError("not an OpenFST file")
    kind, at = text(4)
    arc, at = text(at)
    if kind != b"vector" or arc not in (b"log", b"standard"):
        raise ValueError(f"{kind.decode()} over {arc.decode()} arcs isn't supported")
    _, flags, _, start, n, _ = struct.unpack_from("<iiQqqq", data, at)
    at += struct.calcsize("<iiQqqq")
    if flags & 3:
        raise ValueError("embedded symbol tables aren't supported")
    finals, counts, body = {}, [0] * n, at
    for s in range(n):
        weight, counts[s] = struct.unpack_from(STATE, data, at)
        at += STATE_SIZE + ARC.itemsize * counts[s]
        if weight != math.inf:
            finals[s] = weight
    if at > len(data):
        raise ValueError("an OpenFST file ends early")
    src = np.repeat(np.arange(n), counts)
    places = body + STATE_SIZE * (src + 1) + ARC.itemsize * np.arange(len(src))
    arcs = np.frombuffer(data, np.uint8)[places[:, None] + np.arange(ARC.itemsize)]
    return start, finals, src, np.ascontiguousarray(arcs).view(ARC).reshape(-1)


def decode_fst(data: bytes) -> tuple[int, dict[int, float], list[tuple[int, int, int, int, float]]]:
    """(start, final weights, arcs (src, dst, in label, out label, weight))."""
    start, finals, src, arcs = _arcs_of(data)
    return start, finals, list(zip(src.tolist(), *(arcs[c].tolist() for c in ("dst", "ilabel", "olabel", "weight"))))


#: Rows of lattices that leave a task together.
ROWS = 200_000


def openfst(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) of OpenFST contents (utt, content): (utt, src, dst, ilabel, olabel, weight) and
    (utt, state, weight)."""
    ship_package(files.sparkSession)
    kind = files.schema["utt"].dataType.simpleString()
    schema = f"utt {kind}, src bigint, dst bigint, ilabel int, olabel int, weight double"
    out_schema = arrow_schema(schema)

    def columns(data: bytes) -> list[np.ndarray]:
        start, finals, src, arcs = _arcs_of(data)
        number = lambda s: np.where(s == start, 0, np.where(s == 0, start, s))  # noqa: E731  state 0 is the start
        ends = np.fromiter(finals, np.int64, len(finals))
        none = np.zeros(len(ends), np.int32)
        weights = np.fromiter(finals.values(), np.float64, len(finals))
        rows = zip((number(src), number(arcs["dst"].astype(np.int64)), arcs["ilabel"], arcs["olabel"], arcs["weight"].astype(np.float64)), (number(ends), np.full(len(ends), NO_STATE), none, none, weights))
        return [np.concatenate(x) for x in rows]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, owner, n = [], [], 0
            for i in range(batch.num_rows):
                held.append(columns(batch.column("content")[i].as_py()))
                owner.append(np.full(len(held[-1][0]), i))
                n += len(owner[-1])
                if n >= ROWS or i == batch.num_rows - 1:
                    utts = batch.column("utt").take(pa.array(np.concatenate(owner)))
                    parts = [pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*held), list(out_schema)[1:])]
                    yield pa.RecordBatch.from_arrays([utts, *parts], schema=out_schema)
                    held, owner, n = [], [], 0

    rows = files.select("utt", "content").mapInArrow(work, schema)
    return rows.where(F.col("dst") != NO_STATE), rows.where(F.col("dst") == NO_STATE).select("utt", F.col("src").alias("state"), "weight")


def named(arcs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Arcs with labels in place of output ids; an unknown id is an error. Symbols are few: they are
    broadcast, never the arcs, whatever sizes Spark takes both for."""
    names = F.broadcast(symbols.select(F.col("id").alias("olabel"), F.col("sym").alias("label")))
    label = F.coalesce("label", F.raise_error(F.concat(F.lit("no symbol "), F.col("olabel").cast("string"))).cast("string"))
    return arcs.join(names, "olabel", "left").select("utt", "src", "dst", label.alias("label"), "weight", "ilabel")


def to_openfst(arcs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(utt, content): arcs as OpenFST bytes; states without arcs are final."""
    ship_package(arcs.sparkSession)
    kind = arcs.schema["utt"].dataType.simpleString()
    coded = arcs.join(F.broadcast(symbols.select(F.col("sym").alias("label"), "id")), "label").select("utt", "src", "dst", "id", "weight")

    schema = f"utt {kind}, content binary"
    out_schema = arrow_schema(schema)

    def content(src: np.ndarray, dst: np.ndarray, label: np.ndarray, weight: np.ndarray) -> bytes:
        n = int(max(src.max(), dst.max())) + 1
        counts = np.bincount(src, minlength=n)
        ends = np.setdiff1d(dst, src)
        states = np.zeros(n, [("weight", "<f4"), ("count", "<i8")])
        states["weight"], states["count"] = np.inf, counts
        states["weight"][ends] = 0.0
        arcs = np.empty(len(src), ARC)
        arcs["ilabel"] = arcs["olabel"] = label
        arcs["weight"], arcs["dst"] = weight, dst
        body = np.empty(STATE_SIZE * n + ARC.itemsize * len(src), np.uint8)
        places = STATE_SIZE * np.arange(n) + ARC.itemsize * (np.cumsum(counts) - counts)
        body[places[:, None] + np.arange(STATE_SIZE)] = states.view(np.uint8).reshape(n, -1)
        places = STATE_SIZE * (src + 1) + ARC.itemsize * np.arange(len(src))
        body[places[:, None] + np.arange(ARC.itemsize)] = arcs.view(np.uint8).reshape(len(src), -1)
        return encode_fst(0, {}, {}, 0, (n, len(src))) + body.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            src, dst, label, weight = (table.column(c).to_numpy() for c in ("src", "dst", "id", "weight"))
            made = [content(src[a:b], dst[a:b], label[a:b], weight[a:b]) for a, b in zip(starts, [*starts[1:], table.num_rows])]
            utts = table.column("utt").take(pa.array(starts, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([utts, pa.array(made, out_schema.field("content").type)], schema=out_schema)

    rows = coded.select("utt", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("id").cast("int").alias("id"), F.col("weight").cast("double").alias("weight"))
    return rows.repartition("utt").sortWithinPartitions("utt", "src", "id", "dst").mapInArrow(work, schema)
