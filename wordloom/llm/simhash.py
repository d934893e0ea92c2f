"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has 64 bits, bit ``i`` set if more than half of its shingle hashes have
it set. Two fingerprints link if at most ``distance`` bits differ. The 64 bits are cut into
``blocks`` blocks; a linked pair leaves at least ``blocks - distance`` blocks untouched, so every
linked pair agrees on all blocks of at least one combination of that many blocks. Each distinct
fingerprint is dealt out once per combination, sorted inside its partition, and compared with the
fingerprints that share the key.

Large buckets. A bucket yields a spanning forest of its links, never all pairs. A bucket above
``bucket_limit`` distinct fingerprints isn't held by any task: its members are dealt out again by
*midpoints*, the values within ``distance // 2`` bits of a member on the bits outside the key.
Two members link exactly if they share a midpoint (for even distances), a midpoint has a bounded
number of members, and the work is linear in the bucket.

Defined cases: a null or empty text, or one without words, has fingerprint zero, which links like
any other; repeated rows share their component; of equal doc_ids and ties all rows stay, the
smallest doc_id names the component; null doc_ids get a component but never name one (a component
of null ids only has component_id null); a very long text is hashed in pieces; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import keyed
from wordloom.llm.components import connected_components
from wordloom.session import ship_package, stored

SHINGLE_WORDS = 4
HASH_SEED = 42
DISTANCE = 4
#: Members that a bucket of evenly spread fingerprints may have; decides the number of blocks.
MEAN_BUCKET = 512
BUCKET_LIMIT = 8192
HASH_CHUNK = 1 << 15


def fingerprint(data: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text; A-Z is folded, words are split at ASCII white space."""
    import re

    from xxhash import xxh64_intdigest

    if not data:
        return 0
    line = re.sub(rb"[\x20\x09-\x0D]+", b" ", data.lower()).strip(b" ")
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    if len(starts) > shingle_words:
        starts, ends = starts[: len(starts) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASH_CHUNK):
        pairs = zip(starts[at : at + HASH_CHUNK].tolist(), ends[at : at + HASH_CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "print"])


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, print) of each row, and ``carried`` columns of it between them; print holds the 64
    bits as a signed long."""
    ship_package(docs.sparkSession)
    kept = ("doc_id", *carried)
    rows = docs.select(*kept, F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(_fingerprint_batches, f"{schema}, print bigint")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks for n fingerprints: the least whose keys are long enough that a bucket
    has about MEAN_BUCKET members. More documents get longer keys, and more combinations of blocks."""
    blocks = distance + 2
    while blocks < 32 and n > MEAN_BUCKET << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The unsigned bit mask of each combination of blocks that a linked pair may leave untouched."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("0 <= distance < blocks <= 64 is needed")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members exactly as all links of at most ``distance`` bits would."""
    left, right, rest = [], [], members
    front: list[np.uint64] = []
    while len(rest):
        if front:
            seed = front.pop()
        else:
            seed, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ seed) <= distance
        if near.any():
            got = rest[near]
            left.append(np.full(len(got), seed))
            right.append(got)
            front.extend(got)
            rest = rest[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(batches: Iterator[pa.RecordBatch], distance: int, limit: int) -> Iterator[pa.RecordBatch]:
    """From rows (combo, key, print) sorted by combo and key: links (-1, a, b), and members of
    buckets above the limit as (combo, key, print)."""

    def emit(kind: int, key: np.ndarray | int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["combo", "a", "b"])

    held: list[np.ndarray] = []
    at: tuple[int, int] | None = None
    over = False

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held, over
        if not over and held:
            members = np.concatenate(held)
            if len(members) > 1:
                a, b = _forest(members, distance)
                if len(a):
                    yield emit(-1, 0, a, b)
        held, over = [], False

    for batch in batches:
        if not batch.num_rows:
            continue
        combo = batch.column(0).to_numpy(zero_copy_only=False)
        key = batch.column(1).to_numpy(zero_copy_only=False)
        prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        new = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(key)]))
        first = (int(combo[0]), int(key[0]))
        if at is not None and first != at:
            yield from close()
        # groups of two or three inside the batch, all at once; the first and last may go on elsewhere
        inner = np.arange(1, len(starts) - 1)
        size = ends[inner] - starts[inner]
        left, right = [], []
        for n in (2, 3):
            s = starts[inner[size == n]]
            for i, j in combinations(range(n), 2):
                near = np.bitwise_count(prints[s + i] ^ prints[s + j]) <= distance
                left.append(prints[s + i][near])
                right.append(prints[s + j][near])
        for g in inner[(size > 3) & (size <= limit)]:
            a, b = _forest(prints[starts[g] : ends[g]], distance)
            left.append(a)
            right.append(b)
        if sum(map(len, left)):
            yield emit(-1, 0, np.concatenate(left), np.concatenate(right))
        for g in inner[size > limit]:
            own = prints[starts[g] : ends[g]]
            yield emit(int(combo[starts[g]]), 0, np.full(len(own), key[starts[g]]), own)
        for g in dict.fromkeys((0, len(starts) - 1)):
            if g:
                yield from close()
            at = (int(combo[starts[g]]), int(key[starts[g]]))
            own = prints[starts[g] : ends[g]]
            if not over and sum(map(len, held)) + len(own) > limit:
                for x in held:
                    yield emit(at[0], 0, np.full(len(x), at[1]), x)
                held, over = [], True
            if over:
                yield emit(at[0], 0, np.full(len(own), at[1]), own)
            else:
                held.append(own)
    yield from close()


def _midpoints(batches: Iterator[pa.RecordBatch], masks: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (combo, key, print) to (print, mid): the points within half the distance of a print, on
    the bits outside the key's blocks."""
    balls = {}
    for batch in batches:
        for combo, key, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if combo not in balls:
                free = [1 << i for i in range(64) if not masks[combo] >> i & 1]
                balls[combo] = np.array([sum(x) for r in range(distance // 2 + 1) for x in combinations(free, r)], dtype=np.uint64)
            mids = balls[combo] ^ np.uint64(own % (1 << 64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mids), own, np.int64)), pa.array(mids.view(np.int64))], ["print", "mid"])


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct values of ``print``: enough of them that their connected
    components are those of all pairs that differ in at most ``distance`` bits."""
    if distance % 2:
        raise ValueError("the midpoints of large buckets need an even distance")
    spark = prints.sparkSession
    ship_package(spark)
    masks = block_masks(blocks or blocks_for(prints.count(), distance), distance)
    keys = F.array(*(F.col("print").bitwiseAND(F.lit(_signed(m))) for m in masks))
    dealt = prints.select("print", F.posexplode(keys).alias("combo", "key")).select("combo", "key", "print")
    # one hash of both columns: a key of the zero block of one combination isn't that of another
    grouped = dealt.repartition("combo", "key").sortWithinPartitions("combo", "key")
    found = stored(grouped.mapInArrow(lambda it: _bucket_links(it, distance, bucket_limit), "combo int, a bigint, b bigint"), "simhash-links")
    near = found.where("combo < 0").select("a", "b")
    large = found.where("combo >= 0").select("combo", F.col("a").alias("key"), F.col("b").alias("print"))
    if large.isEmpty():
        return near
    mids = large.mapInArrow(lambda it: _midpoints(it, masks, distance), "print bigint, mid bigint")
    # a midpoint has at most as many members as there are values within distance/2 of it
    stars = mids.groupBy("mid").agg(F.collect_set("print").alias("own")).where(F.size("own") > 1)
    far = stars.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    return near.unionByName(far.distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None, bucket_limit: int = BUCKET_LIMIT, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links, itself included), and its ``carried`` columns."""
    prints = stored(fingerprints(docs, carried), "simhash-prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    blocks = blocks or blocks_for(prints.count(), distance)  # rows, of which the distinct ones are no more
    roots = connected_components(links(classes.select("print"), distance, blocks, bucket_limit))
    classes = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    classes = stored(classes, "simhash-classes")
    heads = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(heads, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", *carried)


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows whose doc_id is their component's, one row for each such doc_id (of repeated rows
    the one with the smallest text). Of rows that repeat a doc_id each is judged by its own text.
    Rows with a null doc_id can't be told apart and stay."""
    key = ("doc_id", "text_hash")
    found = near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), carried=("text_hash",), **options)
    found = stored(found.select(*key, "component_id"), "simhash-found")
    gone = stored(found.where("doc_id <> component_id").select(*key), "simhash-gone")
    kept = keyed.without(docs, gone)
    firsts = found.where("doc_id = component_id")
    repeated = stored(firsts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-repeated")
    if repeated.isEmpty():  # no doc_id repeats
        return kept
    twice = stored(firsts.join(repeated, "doc_id").select(*key).distinct().withColumn("_simhash_twice", F.lit(True)), "simhash-twice")
    maybe, single = keyed.with_values(kept, twice, "_simhash_twice")
    single = single.union(maybe.where(F.col("_simhash_twice").isNull()).select(*docs.columns))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = maybe.where(F.col("_simhash_twice")).groupBy("doc_id").agg(F.min_by(F.struct("text", *others), F.coalesce("text", F.lit(""))).alias("_row"))
    return single.union(least.select("doc_id", "_row.*").select(*docs.columns))
