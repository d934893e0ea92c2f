"""A trie of conversations by shared openings, as a burst trie.

A turn is known by 16 bytes of its role and text, a conversation by the bytes of its turns in a row, so
that sorting bytes walks the trie in order. Equal conversations are one row with a count. All rows
start in one container under the root. A container of more than ``CONTAINER_ROWS`` rows (or
``CONTAINER_TURNS`` turns) bursts: its head takes over what all its rows share, rows that end there
stay with the head, and the others fall into new containers by their next turn id. Containers that
are small enough are sorted and swept into nodes in one pass; heads are summed from the last round of
bursts to the first. A burst leaves each new container with less than it had itself, so rounds end.

A conversation's turn ids (20 bytes a turn, no texts) are held by one task; a node's ends are hashed as
a stream of chunks, so equal conversations may be many.

Defined cases: turns are ordered by number, null first, repeated numbers by the bytes of role and text;
a null role or text counts as an empty one; rows without a conv_id belong to no conversation and are left
out; a conversation without turns ends in the root; repeated rows are turns like any others; texts of
any length are hashed whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import discard, ship_package, stored

CONTAINER_ROWS, CONTAINER_TURNS = 1024, 65_536
#: Bytes of a turn id; conversation ids that are hashed in one piece.
ID, PIECE = 16, 8192
#: Turns at most that an opening lends, and how many conversations share one.
OPENING, SHARED = 5, 100
NODE = "head string, up string, top boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (id, chars) in order of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.length(text).alias("chars"))
    grouped = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def opening_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (OPENING + 1)).cast("int")


def with_shared_openings(lists: DataFrame) -> DataFrame:
    """Each conversation with its first turns, as many as its id says, from the first conversation of
    its hundred (fewer or none if that has fewer or isn't there)."""
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).withColumn("h", opening_length(F.col("conv_id")))
    lent = lists.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, OPENING).alias("opening"))
    joined = own.join(lent, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("opening").isNull(), rest).otherwise(F.concat(F.slice("opening", F.lit(1), F.col("h")), rest)).alias("turns"))


def end_hashes(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the conv_ids of a key, ascending, joined by commas. Ranges of
    (key, conv_id) make pieces of text, so that no task reads all rows of a frequent key."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or len(ids) == PIECE:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            if out:
                yield _batch(out, pieces_schema)
                out = []
        if ids:
            yield _batch([(key, ids[0], ",".join(map(str, ids)))], pieces_schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            if out:
                yield _batch(out, hashes_schema)
        if state is not None:
            yield _batch([(key, state.hexdigest())], hashes_schema)

    pieces_schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    hashes_schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
    cut = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key string, first bigint, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key string, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_NODES = pa.schema([("head", pa.string()), ("up", pa.string()), ("top", pa.bool_()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])


def swept(seqs: list[tuple[bytes, np.ndarray, int, int, str]], p: int) -> list[list]:
    """Nodes of a container whose rows (turn ids, lengths, count, smallest id, ends) are sorted and
    share their first ``p`` turns: [conv_id, depth, place of its parent, n_convs, n_children, n_leaves,
    saved, ends], the container's top first."""
    nodes: list[list] = []
    path: list[int] = []  # places of the open nodes of depths p, p + 1, ...
    chars: list[int] = []

    def close(keep: int) -> None:
        while len(path) > keep:
            own = nodes[path.pop()]
            own[5] = own[5] or 1
            own[6] += (own[3] - 1) * chars.pop()
            if path:
                up = nodes[path[-1]]
                up[0] = own[0] if up[0] is None else min(up[0], own[0])
                up[3] += own[3]
                up[4] += 1
                up[5] += own[5]
                up[6] += own[6]

    before = b""
    for seq, lengths, count, first, ends in seqs:
        shared = p
        if nodes:
            most = min(len(seq), len(before)) // ID
            while shared < most and seq[ID * shared : ID * shared + ID] == before[ID * shared : ID * shared + ID]:
                shared += 1
            close(shared - p + 1)
        else:
            shared = p - 1
        for depth in range(shared + 1, len(seq) // ID + 1):
            nodes.append([None, depth, path[-1] if path else -1, 0, 0, 0, 0, None])
            path.append(len(nodes) - 1)
            chars.append(int(lengths[depth - 1]))
        end = nodes[path[-1]]
        end[0], end[3], end[7] = first, end[3] + count, ends  # nothing lies below it yet
        before = seq
    close(0)
    return nodes


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers from rows sorted by container and turn ids."""
    at, held = None, []

    def rows() -> list[tuple]:
        nodes = swept(held, at[2])
        return [(at[0], at[1], up < 0, first, depth, nodes[up][0] if up >= 0 else None, n, kids, leaves, saved, ends) for first, depth, up, n, kids, leaves, saved, ends in nodes]

    for batch in batches:
        out: list[tuple] = []
        for head, up, p, seq, chars, n, first, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or head != at[0]:
                if at is not None:
                    out += rows()
                at, held = (head, up, p), []
            held.append((seq, chars, n, first, ends))
        if out:
            yield _batch(out, _NODES)
    if held:
        yield _batch(rows(), _NODES)


def _head_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of burst heads, one for each turn that all of a head's rows share."""
    for batch in batches:
        out: list[tuple] = []
        for head, up, p, chars, n, first, ends, kids, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            below = saved + np.cumsum(np.array(chars[::-1], np.int64))[::-1] * (n - 1)
            last = len(chars) - 1
            for i in range(len(chars)):
                out.append((head, up, i == 0, first, p + i, first if i else None, n, kids if i == last else 1, max(leaves, 1), int(below[i]), ends if i == last else None))
        if out:
            yield _batch(out, _NODES)


def prefix_trie(lists: DataFrame, container_rows: int = CONTAINER_ROWS, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes of the trie over (conv_id, turns): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves (childless nodes below or at it), saved_tokens (code points that
    members share beyond their first, over the subtree), ends_sha256 (of the members that end here)."""
    ship_package(lists.sparkSession)
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = lists.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    rows = stored(rows.withColumn("key", F.md5("seq")), "trie-rows")
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first(F.struct("seq", "chars")).alias("s"))
    distinct = same.join(end_hashes(rows), "key").select("s.*", "n", "first", F.col("ends_sha256").alias("ends"))
    open_rows = stored(distinct.select(F.lit("root").alias("head"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("p"), "*"), "trie-open")
    discard(rows)
    columns = open_rows.columns
    depth = F.size("chars")
    heads: list[DataFrame] = []
    settled: list[DataFrame] = []
    opened = [open_rows]
    while True:
        sizes = open_rows.groupBy("head", "up", "p").agg(F.count(F.lit(1)).alias("rows"), F.sum(depth - F.col("p")).alias("turns"), F.min("seq").alias("least"), F.max("seq").alias("most"), F.min_by("chars", "seq").alias("chars"), F.sum("n").alias("n"), F.min("first").alias("first"))
        if heads:  # the root always is a head
            sizes = sizes.where((F.col("rows") > container_rows) | (F.col("turns") > container_turns))
        shared = F.filter(F.sequence("p", F.size("chars")), lambda i: (i > F.col("p")) & (F.substring("least", F.lit(1), i * ID) == F.substring("most", F.lit(1), i * ID)))
        large = sizes.withColumn("q", F.col("p") + F.size(shared))
        # what the head's own nodes weigh; the root has no text
        own = F.when(F.col("p") == 0, F.concat(F.array(F.lit(0)), F.slice("chars", F.lit(1), F.col("q")))).otherwise(F.slice("chars", F.greatest("p", F.lit(1)), F.col("q") - F.col("p") + 1))
        large = stored(large.select("head", "up", "p", "q", own.alias("chars"), "n", "first"), "trie-heads")
        if large.isEmpty():
            settled.append(open_rows)
            discard(large)
            break
        settled.append(open_rows.join(large.select("head"), "head", "left_anti").select(*columns))
        inside = open_rows.join(large.select("head", "q"), "head")
        ends = inside.where(depth == F.col("q")).select("head", "ends")
        heads.append(large.join(ends, "head", "left"))
        opened.append(large)
        fallen = inside.where(depth > F.col("q")).select(F.md5(F.substring("seq", F.lit(1), (F.col("q") + 1) * ID)).alias("head"), F.col("head").alias("up"), (F.col("q") + 1).alias("p"), *columns[3:])
        open_rows = stored(fallen, "trie-open")
        opened.append(open_rows)
    small = settled[0]
    for s in settled[1:]:
        small = small.unionByName(s)
    small = small.select("head", "up", "p", "seq", "chars", "n", "first", "ends").repartition("head").sortWithinPartitions("head", "seq")
    nodes = stored(small.mapInArrow(_sweep, NODE), "trie-nodes")
    opened.append(nodes)

    if not heads:  # no conversations
        return nodes.drop("head", "up", "top")

    total = lambda tops: tops.groupBy(F.col("up").alias("head")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below = stored(total(nodes.where("top")), "trie-sums")
    opened.append(below)
    parts, deeper = [nodes], None
    for own in reversed(heads):
        sums = below if deeper is None else below.unionByName(deeper).groupBy("head").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))
        filled = own.join(sums, "head", "left").select("head", "up", "p", "chars", "n", "first", "ends", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("kids", "leaves", "saved")))
        chain = stored(filled.mapInArrow(_head_nodes, NODE), "trie-nodes")
        parts.append(chain)
        opened.append(chain)
        deeper = total(chain.where("top"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    firsts = None
    for own in heads:
        own = own.select(F.col("head").alias("up"), F.col("first").alias("up_first"))
        firsts = own if firsts is None else firsts.unionByName(own)
    inner = out.where("not top").drop("head", "up", "top")
    tops = out.where("top").join(firsts, "up", "left").withColumn("parent_conv_id", F.col("up_first")).drop("head", "up", "top", "up_first")
    result = inner.unionByName(tops).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    result = stored(result, "trie")
    for done in opened:
        discard(done)
    return result
