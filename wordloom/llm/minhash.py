"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

A document is the set of its distinct shingles of ``shingle_words`` lower-cased words. One hash of a
shingle gives a bin and a value; a bin keeps its least value, and a bin left empty borrows from the
first full one along a probe sequence of its own (optimal densification). ``ROWS`` bins make a band.
Documents with equal sets are one class from the start, so copies cost nothing further on.

Candidates come as stars, never as all pairs of a bucket:

1. each bucket has a class as its centre; a class is compared (by signature) with the centres
   of its buckets, and the likeliest one becomes its edge: one edge a class. Edges are confirmed on
   full sets, and confirmed edges make components. Buckets that still hold several components go
   through ``STAR_ROUNDS`` such rounds, each with other centres;
2. of what is still mixed, members of different components are compared by 32 bits of each shingle (of
   very long texts a sample by hash); what that shows to be a link, one for each member and other
   component, is confirmed as well. Such a bucket is cut into chunks of ``CHUNK`` members, and pairs of
   chunks meet in tasks of their own, so no task holds a bucket, and no member is left out.

A link at 0.8 shares no band with a probability below one in two millions.

Defined cases: a null text, an empty one or one without words has an empty set, links with nothing and
names itself; a text of fewer words than a shingle has its whole sequence as only shingle; repeated rows
are equal sets and share a component; of ties the smallest doc_id names it; a null doc_id gets its
component's name and never gives one (kept is false then); very long texts are taken whole; an empty
table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.components import connected_components
from wordloom.session import discard, ship_package, stored

SHINGLE_WORDS = 5
#: Percent of the union that two sets must share.
SIMILARITY = 80
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
MIN_AGREEMENT = 0.7
#: Rounds of stars; centres that one round may give to a group of copies.
STAR_ROUNDS, LANES = 2, 4
#: Shingles of a set up to which all of them go along to its buckets.
MEMBERS = 4096
#: Members of a bucket that a task compares with as many others.
CHUNK = 1024
#: Words whose hashes a task remembers.
REMEMBERED = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.Generator(np.random.PCG64(11))
#: By bin, the bins that it asks in turn when it is empty; odd multipliers by bin for keys of bands.
PROBES = _RNG.integers(0, BINS, (BINS, 2048), dtype=np.int16)
FACTORS = _RNG.integers(0, 1 << 63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_NUMBERS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxh64_intdigest(word, 11)
        return got


def shingle_set(data: bytes | None, hashes: WordHashes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    words = data.lower().split() if data else []  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle_words, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - width + 1 + k])
    return np.unique(out)


def densified(values: np.ndarray) -> np.ndarray:
    """The least value of each bin over a set of hashes, empty bins filled by their probes."""
    bins = (((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    least = np.full(BINS, 1 << 32, np.uint64)
    np.minimum.at(least, bins, values & np.uint64(0xFFFFFFFF))
    full = least < (1 << 32)
    empty = np.flatnonzero(~full)
    for a, b in ((0, 16), (16, 256), (256, PROBES.shape[1])):
        if not len(empty):
            break
        hits = full[PROBES[empty, a:b]]
        found = hits.any(axis=1)
        least[empty[found]] = least[PROBES[empty[found], a + hits[found].argmax(axis=1)]]
        empty = empty[~found]
    if len(empty):  # next full bin from the last one asked
        at = np.flatnonzero(full)
        least[empty] = least[at[np.searchsorted(at, PROBES[empty, -1]) % len(at)]]
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return mixed((least * FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + BAND_NUMBERS).view(np.int64)


def sketches(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, keys) of each row: 128 bits of the set, a byte a bin
    and a key a band; the last three are null for an empty set."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for batch in batches:
            sizes, digests, signatures, keys = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), hashes, shingle_words)
                sizes.append(len(own))
                if not len(own):
                    for x in (digests, signatures, keys):
                        x.append(None)
                    continue
                least = densified(own)
                digests.append(xxh3_128_digest(own.tobytes()))
                signatures.append(least.astype(np.uint8).tobytes())
                keys.append(band_keys(least))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature", "keys"])

    return rows.mapInArrow(work, f"doc_id {kind}, n_shingles bigint, digest binary, signature binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(digest, members array<bigint>) of each row with a word."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for batch in batches:
            own = [s for s in (shingle_set(t.as_py(), hashes, shingle_words) for t in batch.column(0)) if len(s)]
            columns = [pa.array([xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "members"])

    return rows.mapInArrow(work, "digest binary, members array<bigint>")


def agreements(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with agreement, the share of bins in which their signatures agree."""
    side = lambda own: classes.select(F.col("node").alias(own), F.col("signature").alias(f"{own}_signature"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            share = (left == right).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "agreement"])

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_signature", "b_signature")
    return rows.mapInArrow(work, "a bigint, b bigint, agreement double")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, members) of some classes, from the texts of their first documents."""
    wanted = stored(nodes.join(classes, "node").select("node", "digest", "first_id"), "minhash-wanted")
    texts = docs.select("doc_id", "text")
    own = texts.join(wanted.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if not wanted.where("first_id is null").isEmpty():
        own = own.unionByName(texts.where("doc_id is null"))
    # rows that repeat a doc_id may have other sets, and equal sets come once
    sets = stored(shingle_sets(own, shingle_words).join(wanted, "digest").groupBy("node").agg(F.first("members").alias("members")), "minhash-sets")
    discard(wanted)
    return sets


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle_words: int, similarity: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets share ``similarity`` percent of their union."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(ends, classes, docs, shingle_words)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"{name}_members"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_members", "b_members"))
    union = F.size("a_members") + F.size("b_members") - common
    out = stored(both.where(common * 100 >= union * similarity).select("a", "b"), "minhash-links")
    discard(sets)
    return out


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(node, key, lane): the members of all buckets of two classes or more."""
    dealt = classes.select("node", F.posexplode("keys").alias("band", "key")).select("node", "key", (F.col("band") % LANES).alias("lane"))
    several = dealt.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    return dealt.join(several, "key")


def mixed_buckets(buckets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and (key, n) of the buckets that hold several components."""
    named = buckets.join(labels, "node") if labels is not None else buckets.withColumn("label", F.col("node"))
    several = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    return named, several.select("key", "n")


def star_edges(buckets: DataFrame, classes: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(a, b), a < b: each class with the likeliest of the centres of its buckets, if they are of
    different components. Centres change with the turn, and there are several to a group of copies."""
    named, several = mixed_buckets(buckets, labels)
    order = F.xxhash64("node", "lane", F.lit(turn))
    centres = named.join(several.select("key"), "key").groupBy("key").agg(F.min_by("node", order).alias("a"), F.min_by("label", order).alias("a_label"))
    spokes = named.join(centres, "key").where("label <> a_label").select("a", F.col("node").alias("b")).distinct()
    likely = agreements(spokes, classes).where(F.col("agreement") >= MIN_AGREEMENT)
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("agreement", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def small_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, rate, few): 32 bits of each shingle of a class; of a set of more than MEMBERS only those whose
    hash is divisible by 2 ** rate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, few = [], []
            for own in batch.column(1):
                h = own.values.to_numpy().view(np.uint64)
                rate = max(0, (len(h) - 1).bit_length() - (MEMBERS - 1).bit_length())
                h = mixed(h)
                rates.append(rate)
                few.append(np.unique((h[h & np.uint64((1 << rate) - 1) == 0] & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.int32()), pa.array(few, pa.binary())], ["node", "rate", "few"])

    return full_sets(nodes, classes, docs, shingle_words).mapInArrow(work, "node bigint, rate int, few binary")


def crossing_pairs(buckets: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, shingle_words: int, similarity: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b: members of one bucket but of different components that their small sets show to
    be linked: the likeliest partner of a member in each other component, and all partners where
    the sets are samples and leave it open."""
    named, several = mixed_buckets(buckets, labels)
    rows = stored(named.join(several.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "key"), "minhash-mixed")
    small = stored(small_sets(rows.select("node").distinct(), classes, docs, shingle_words), "minhash-small")
    rows = rows.join(small, "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    # chunk i meets chunk j >= i in cell (i, j)
    cells = rows.withColumn("part", part).select("key", "node", "label", "rate", "few", "part", other)
    cells = cells.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label", "rate", "few")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for k, a, b, p, n, l, r, f in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, a, b) != cell:
                    if len(held) > 1:
                        yield from linked(held, cell[1] != cell[2], similarity)
                    cell, held = (k, a, b), []
                held.append((p, n, l, r, f))
        if len(held) > 1:
            yield from linked(held, cell[1] != cell[2], similarity)

    grouped = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(work, "a bigint, b bigint").distinct()


def linked(held: list[tuple], across: bool, similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's members (part, node, label, rate, small set); ``across``: of different parts only."""
    part, node, label, rate = (np.array([x[i] for x in held], np.int64) for i in range(4))
    sets = [np.frombuffer(x[4], "<u4") for x in held]
    sizes = np.array([len(x) for x in sets], np.int64)
    common = np.bincount(np.unique(label, return_inverse=True)[1]).argmax()
    rare = np.flatnonzero(label != np.unique(label)[common])  # every crossing pair has one of them
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    by_value, ends = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(values)))))
    first = np.cumsum(sizes) - sizes
    left, right = [], []
    for i in rare.tolist():
        may = label != label[i]
        if across:
            may &= part != part[i]
        if not may.any():
            continue
        best: dict[int, tuple[float, int]] = {}
        for r in np.unique(rate[may]).tolist():
            most = max(r, int(rate[i]))
            own = at[first[i] : first[i] + sizes[i]]
            mask = np.uint32((1 << most) - 1)
            own = own[values[own] & mask == 0]
            spans = [by_value[ends[v] : ends[v + 1]] for v in own.tolist()]
            shared = np.bincount(np.concatenate(spans), minlength=len(sets)) if spans else np.zeros(len(sets), np.int64)
            there = np.flatnonzero(may & (rate == r))
            theirs = sizes[there] if most == r else np.array([(sets[k] & mask == 0).sum() for k in there])
            share = shared[there] / np.maximum(theirs + len(own) - shared[there], 1)
            if most:  # a sample: six standard deviations below
                n = np.maximum(theirs + len(own) - shared[there], 1)
                open_ = there[share >= similarity / 100 - 6 * np.sqrt(0.16 / n)]
                left += [node[i]] * len(open_)
                right += node[open_].tolist()
                continue
            sure = share >= similarity / 100 - 1e-9
            for k, x in zip(there[sure].tolist(), share[sure].tolist()):
                if (x, -k) > best.get(int(label[k]), (0.0, 0)):
                    best[int(label[k])] = (x, -k)
        left += [node[i]] * len(best)
        right += [node[-k] for _, k in best.values()]
    if left:
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _labelled(classes: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(node, label) of all classes."""
    if not links:
        return classes.select("node", F.col("node").alias("label"))
    together = links[0]
    for more in links[1:]:
        together = together.unionByName(more)
    return classes.select("node").join(connected_components(together), "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def kept_first(doc_id: Column, component_id: Column) -> Column:
    return F.coalesce(doc_id == component_id, F.lit(False))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: int = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable over links,
    itself included), kept (whether it is that one)."""
    if not SIMILARITY <= similarity <= 100:
        raise ValueError("bands and agreements are made for similarities of 80 percent or more")
    rows = stored(sketches(docs, shingle_words), "minhash-sketches")
    sketch = F.first(F.struct("signature", "keys")).alias("sketch")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), sketch)
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "sketch.*"), "minhash-classes")
    buckets = stored(shared_buckets(classes), "minhash-buckets")
    labels, links, edges = None, [], []
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            pairs = star_edges(buckets, classes, labels, turn)
        else:
            pairs = crossing_pairs(buckets, classes, labels, docs, shingle_words, similarity, chunk)
        for tested in edges:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        edges.append(stored(pairs, "minhash-edges"))
        if not edges[-1].isEmpty():
            links.append(confirmed(edges[-1], classes, docs, shingle_words, similarity))
        elif labels is not None:
            continue
        before, labels = labels, stored(_labelled(classes, links), "minhash-labels")
        if before is not None:
            discard(before)
    for done in (buckets, *edges, *links):
        discard(done)
    named = classes.select("node", "digest", "first_id").join(labels, "node")
    heads = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(heads, "label").select("digest", "component_id")
    with_words = rows.where("digest is not null").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    without = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(with_words.unionByName(without).withColumn("kept", kept_first(F.col("doc_id"), F.col("component_id"))), "minhash")
    for done in (rows, classes, labels):
        discard(done)
    return out
