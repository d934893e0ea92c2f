"""Weighted lattices as tables of arcs (utt, src, dst, label, weight).

Weights are negative log probabilities. State 0 is the start, states without outgoing arcs are
final; ``with_final_arcs`` brings final weights of other formats to this form. What looks at arcs
one by one is DataFrame work. What walks a graph runs on partitions that hold whole utterances,
sorted, many utterances to an Arrow batch (a graph is one utterance's, so it fits a task). Extra arc
columns pass through where rows are only filtered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.align import DELETE, INSERT, SUBSTITUTE, unpack
from wordloom.session import ship_package

EPS = "<eps>"
KEYS = ["utt", "src", "dst", "label"]


def merge_parallel(arcs: DataFrame, order: str | None = None) -> DataFrame:
    """One arc per (utt, src, dst, label), weights added in the log semiring. Window and grouping
    share one shuffle; the minimum keeps the exponentials in range. With ``order``, a column that
    orders arcs, other columns are those of the first arc."""
    others = [c for c in arcs.columns if c not in (*KEYS, "weight")] if order else []
    least = F.min("weight").over(Window.partitionBy(*KEYS))
    rows = arcs.select(*KEYS, "weight", least.alias("least"), *others)
    first = [F.min_by(c, order).alias(c) for c in others]
    merged = rows.groupBy(*KEYS, "least").agg(F.sum(F.exp(F.col("least") - F.col("weight"))).alias("s"), *first)
    return merged.select(*KEYS, (F.col("least") - F.log("s")).alias("weight"), *others)


def with_final_arcs(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """Arcs with final states (utt, state, weight) as <eps> arcs to a state of their own, one past
    the highest, where they have a weight or arcs go on from them."""
    goes_on = arcs.select("utt", F.col("src").alias("state")).distinct().withColumn("goes_on", F.lit(True))
    needed = finals.join(goes_on, ["utt", "state"], "left").where((F.col("weight") != 0) | F.col("goes_on"))
    last = arcs.groupBy("utt").agg((F.max(F.greatest("src", "dst")) + 1).alias("dst"))
    # states that end without being final would count as final ones: then all finals move, as when one must
    dead = final_states(arcs).join(finals.select("utt", "state"), ["utt", "state"], "left_anti")
    moved = finals.join(needed.select("utt").unionByName(dead.select("utt")).distinct(), "utt", "left_semi").join(last, "utt")
    return arcs.unionByName(moved.select("utt", F.col("state").alias("src"), "dst", F.lit(EPS).alias("label"), "weight"), allowMissingColumns=True)


def final_states(arcs: DataFrame) -> DataFrame:
    """(utt, state) without an outgoing arc."""
    return arcs.select("utt", F.col("dst").alias("state")).distinct().join(arcs.select("utt", F.col("src").alias("state")).distinct(), ["utt", "state"], "left_anti")


def sizes(arcs: DataFrame) -> DataFrame:
    """(utt, n_states, n_arcs)."""
    return arcs.groupBy("utt").agg((F.size(F.array_union(F.collect_set("src"), F.collect_set("dst")))).cast("bigint").alias("n_states"), F.count(F.lit(1)).alias("n_arcs"))


def sausage(rows: DataFrame, utt: Column, symbols: Column, alternative_weight: float = 2.0) -> DataFrame:
    """A chain lattice from symbols a to z: each letter at weight 0 and the next letter of the
    alphabet at ``alternative_weight``."""
    spelled = rows.select(utt.alias("utt"), F.posexplode(symbols).alias("src", "label")).withColumn("src", F.col("src").cast("bigint")).withColumn("dst", F.col("src") + 1)
    other = F.when(F.col("label") == "z", F.lit("a")).otherwise(F.chr(F.ascii("label") + 1))
    choice = F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(0.0).alias("w")), F.struct(other.alias("l"), F.lit(float(alternative_weight)).alias("w")))).alias("c")
    return spelled.select("utt", "src", "dst", choice).select("utt", "src", "dst", F.col("c.l").alias("label"), F.col("c.w").alias("weight"))


def sausage_arcs(symbols: Column, alternative_weight: float = 2.0) -> Column:
    """The arcs of a sausage as one array of (src, dst, label, weight), where an utterance needn't be put together again."""

    def both(c: Column, i: Column) -> Column:
        src = i.cast("bigint")
        other = F.when(c == "z", F.lit("a")).otherwise(F.chr(F.ascii(c) + 1))
        arc = lambda label, weight: F.struct(src.alias("src"), (src + 1).alias("dst"), label.alias("label"), F.lit(float(weight)).alias("weight"))
        return F.array(arc(c, 0.0), arc(other, alternative_weight))

    return F.flatten(F.transform(symbols, both))


class Graph:
    """One utterance's arcs and its states in topological order."""

    def __init__(self, src: list[int], dst: list[int], label: list[str], weight: list[float]):
        self.src, self.dst, self.label, self.weight = src, dst, label, weight
        self.out: dict[int, list[int]] = {}
        waits: dict[int, int] = {}
        for i, (a, b) in enumerate(zip(src, dst)):
            self.out.setdefault(a, []).append(i)
            waits[b] = waits.get(b, 0) + 1
        ready = sorted(s for s in {*src, *dst} if s not in waits)
        self.states: list[int] = []
        for s in ready:
            self.states.append(s)
            for i in self.out.get(s, ()):
                t = dst[i]
                waits[t] -= 1
                if not waits[t]:
                    ready.append(t)
        if any(waits.values()):
            raise ValueError("a lattice has a circle")
        self.order = [i for s in self.states for i in self.out.get(s, ())]
        self.ends = [s for s in self.states if s not in self.out]

    def forward(self) -> dict[int, float]:
        """Least weight from the start."""
        alpha = dict.fromkeys(self.states, math.inf)
        alpha[0] = 0.0
        src, dst, weight = self.src, self.dst, self.weight
        for i in self.order:
            if (w := alpha[src[i]] + weight[i]) < alpha[dst[i]]:
                alpha[dst[i]] = w
        return alpha

    def backward(self) -> dict[int, float]:
        """Least weight to a final state."""
        beta = dict.fromkeys(self.states, math.inf)
        beta.update(dict.fromkeys(self.ends, 0.0))
        src, dst, weight = self.src, self.dst, self.weight
        for i in reversed(self.order):
            if (w := beta[dst[i]] + weight[i]) < beta[src[i]]:
                beta[src[i]] = w
        return beta

    def through(self) -> tuple[list[float], float]:
        """Per arc the least weight of a path through it, and of any path."""
        alpha, beta = self.forward(), self.backward()
        return [alpha[a] + w + beta[b] for a, w, b in zip(self.src, self.weight, self.dst)], beta.get(0, math.inf)

    def levels(self) -> dict[int, int]:
        """Longest distance from the start in arcs."""
        out = {0: 0}
        for i in self.order:
            a, b = self.src[i], self.dst[i]
            if a in out:
                out[b] = max(out.get(b, 0), out[a] + 1)
        return out

    def lattice(self) -> tuple[list[list[tuple[str, float, int]]], dict[int, float]]:
        """The form that ``segment.Walk`` reads: states that the start reaches, numbered in order."""
        reached = self.levels()
        number = {s: n for n, s in enumerate([0, *(s for s in self.states if s in reached and s != 0)])}
        arcs = [[(self.label[i], self.weight[i], number[self.dst[i]]) for i in self.out.get(s, ())] for s in number]
        return arcs, {number[s]: 0.0 for s in self.ends if s in number}


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "utt") -> Iterator[tuple[pa.Table, list[int]]]:
    """From batches sorted by a key: tables that hold whole groups, and where each group starts."""
    held: list[pa.RecordBatch] = []

    def bounds(keys: pa.Array | pa.ChunkedArray) -> list[int]:
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        changed = pc.not_equal(keys[1:], keys[:-1]).fill_null(True)
        if keys.null_count:  # nulls are one group
            changed = pc.and_(changed, pc.invert(pc.and_(keys[1:].is_null(), keys[:-1].is_null())))
        return [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = bounds(batch.column(key))[-1]
        if last == 0 and held and held[-1].column(key)[held[-1].num_rows - 1].as_py() == batch.column(key)[0].as_py():
            held.append(batch)  # one long group goes on
            continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            table = pa.Table.from_batches(held)
            yield table, bounds(table.column(key))
        held = [batch.slice(last)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table.column(key))


def _together(arcs: DataFrame) -> DataFrame:
    return arcs.repartition("utt").sortWithinPartitions("utt", "src", "weight", "label", "dst")


def _graphs(table: pa.Table, starts: list[int]) -> Iterator[tuple[int, int, Graph]]:
    src, dst, label, weight = (table.column(c).to_pylist() for c in ("src", "dst", "label", "weight"))
    for a, b in zip(starts, [*starts[1:], table.num_rows]):
        yield a, b, Graph(src[a:b], dst[a:b], label[a:b], weight[a:b])


def grouped_graphs(arcs: DataFrame, work: Callable[[Graph], list[tuple]], schema: str) -> DataFrame:
    """utt and the columns of ``schema``: the rows that ``work`` makes of each utterance's graph.
    Arcs of a state come by (weight, label, target)."""
    ship_package(arcs.sparkSession)
    kind = arcs.schema["utt"].dataType.simpleString()
    full = f"utt {kind}, {schema}"
    out_schema = arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            owner, rows = [], []
            for a, _, graph in _graphs(table, starts):
                made = work(graph)
                owner += [a] * len(made)
                rows += made
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(out_schema)[1:])]
                utts = table.column("utt").take(pa.array(owner, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([utts, *columns], schema=out_schema)

    return _together(arcs.select(*KEYS, "weight")).mapInArrow(run, full)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def prune(arcs: DataFrame, threshold: float) -> DataFrame:
    """Arcs on a path within ``threshold`` of the best; infinity keeps every arc on some path."""
    ship_package(arcs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            kept: list[int] = []
            for a, _, graph in _graphs(table, starts):
                through, best = graph.through()
                kept += [a + i for i, w in enumerate(through) if w < math.inf and w <= best + threshold + 1e-9]
            yield from table.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    return _together(arcs).mapInArrow(run, arcs.schema.simpleString()[7:-1])


def connect(arcs: DataFrame) -> DataFrame:
    """Arcs that lie on a path from the start to a final state."""
    return prune(arcs, math.inf)


def topological_levels(arcs: DataFrame) -> DataFrame:
    """(utt, state, level)."""
    return grouped_graphs(arcs, lambda g: list(g.levels().items()), "state bigint, level bigint")


def best_path(arcs: DataFrame) -> DataFrame:
    """(utt, pos, src, dst, label, weight) of the best path; of equal ones (to nine decimals) the
    path whose arcs come first by (weight, label, target)."""

    def work(g: Graph) -> list[tuple]:
        beta = g.backward()
        at, out = 0, []
        while g.out.get(at) and beta[at] < math.inf:
            i = min(g.out[at], key=lambda i: (round(g.weight[i] + beta[g.dst[i]], 9), i))
            out.append((len(out), at, g.dst[i], g.label[i], g.weight[i]))
            at = g.dst[i]
        return out

    return grouped_graphs(arcs, work, "pos bigint, src bigint, dst bigint, label string, weight double")


def remove_epsilon(arcs: DataFrame) -> DataFrame:
    """The same label sequences and weights without <eps> arcs; a state that reaches a final state
    by <eps> alone gets its arcs from what follows, and finals keep their number. Other columns are
    those of the labelled arc that a new arc comes from."""
    others = [c for c in arcs.columns if c not in (*KEYS, "weight")]
    schema = ", ".join(f"{c} {arcs.schema[c].dataType.simpleString()}" for c in (*KEYS, "weight", *others))
    ship_package(arcs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            rows, owner = [], []
            for a, _, graph in _graphs(table, starts):
                for src, dst, weight, arc in _without_epsilon(graph):
                    rows.append((src, dst, weight))
                    owner.append(a + arc)
            if rows:
                taken = table.take(pa.array(owner, pa.int64()))
                for c, values in zip(("src", "dst", "weight"), zip(*rows)):
                    taken = taken.set_column(taken.column_names.index(c), c, pa.array(values, table.schema.field(c).type))
                yield from taken.combine_chunks().to_batches()

    return _together(arcs.select(*KEYS, "weight", *others)).mapInArrow(run, schema)


def _without_epsilon(g: Graph) -> list[tuple[int, int, float, int]]:
    """(src, dst, weight, arc that it comes from)."""
    reach: dict[int, dict[int, float]] = {}
    for s in reversed(g.states):
        own = {s: 0.0}
        for i in g.out.get(s, ()):
            if g.label[i] == EPS:
                for t, w in reach[g.dst[i]].items():
                    own[t] = min(own.get(t, math.inf), g.weight[i] + w)
        reach[s] = own
    best: dict[tuple[int, int, str], tuple[float, int]] = {}
    ends = set(g.ends)
    targets: dict[int, set[int]] = {}
    for s in g.states:
        for t, w in reach[s].items():
            for i in g.out.get(t, ()):
                if g.label[i] == EPS:
                    continue
                d = g.dst[i]
                # a target that only reaches the end by <eps> is an end itself, as well as what it was
                for to, more in {d: 0.0, **{e: v for e, v in reach[d].items() if e in ends}}.items():
                    key = (s, to, g.label[i])
                    best[key] = min(best.get(key, (math.inf, i)), (w + g.weight[i] + more, i))
                    targets.setdefault(s, set()).add(to)
    live = {0}
    for s in g.states:
        if s in live:
            live |= targets.get(s, set())
    return [(a, d, w, i) for (a, d, _), (w, i) in sorted(best.items()) if a in live and (d in targets or d in ends)]


def least_edits(g: Graph, ref: np.ndarray, kept: list[bool] | None = None) -> tuple[int, int] | None:
    """(edits, substitutions) of the best alignment of a reference with any path over the kept arcs;
    fewest edits first, then fewest substitutions. None if no path is left."""
    n = len(ref)
    steps = np.arange(n + 1, dtype=np.int64) * DELETE
    cost: dict[int, np.ndarray] = {0: steps.copy()}
    for s in g.states:
        if s not in cost:
            continue
        row = cost[s] = np.minimum.accumulate(cost[s] - steps) + steps  # reference symbols without a partner
        for i in g.out.get(s, ()):
            if kept is not None and not kept[i]:
                continue
            if g.label[i] == EPS:
                new = row
            else:
                new = row + INSERT
                np.minimum(new[1:], row[:-1] + np.where(ref == g.label[i], 0, SUBSTITUTE), out=new[1:])
            t = g.dst[i]
            cost[t] = np.minimum(cost[t], new) if t in cost else new.copy()
    found = [int(cost[s][n]) for s in g.ends if s in cost]
    return unpack(min(found)) if found else None


#: Longest chain together with its reference that goes by 32-bit costs; their digits for substitutions; letters
#: that are aligned together, and held for that.
CHAIN, LOW_BITS, TOGETHER, HELD = 16_000, 16, 65_536, 200_000


def _chain_labels(src: np.ndarray, dst: np.ndarray, label: np.ndarray, weight: np.ndarray, factors: list[float], eps: int) -> list[np.ndarray | None] | None:
    """For each factor the labels of each step, (arcs, steps) with -1 where there is no arc, None if no path
    is left. None if the arcs, sorted by source, aren't a chain from state 0 on without <eps>."""
    step = np.diff(src)
    if src[0] or (dst != src + 1).any() or ((step != 0) & (step != 1)).any() or (label == eps).any() or (label < 0).any():
        return None
    starts = np.flatnonzero(np.concatenate(([True], step != 0)))
    rank = np.arange(len(src)) - starts[src]
    least = np.minimum.reduceat(weight, starts)
    alpha = np.concatenate(([0.0], np.cumsum(least)))
    beta = np.concatenate((np.cumsum(least[::-1])[::-1], [0.0]))
    through = alpha[src] + weight + beta[dst]
    out: list[np.ndarray | None] = []
    for f in factors:
        kept = np.ones(len(src), bool) if math.isinf(f) else through <= beta[0] + f + 1e-9
        labels = np.full((int(rank.max()) + 1, len(starts)), -1, np.int32)
        labels[rank[kept], src[kept]] = label[kept]
        out.append(labels if (labels >= 0).any(axis=0).all() else None)
    return out


def chain_edits(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(edits, substitutions) of references (codes) with chains (labels by arc and step, see above), as
    ``least_edits`` has them: diagonal by diagonal, pairs of similar size together."""
    out: list = [None] * len(pairs)
    size = [(len(labels), len(ref) + labels.shape[1]) for ref, labels in pairs]
    order, at = sorted(range(len(pairs)), key=lambda i: size[i], reverse=True), 0
    while at < len(order):
        longest = size[order[at]]
        group = order[at : at + max(1, TOGETHER // (longest[1] + 1))]
        group = [i for i in group if size[i][0] == longest[0] and size[i][1] * 4 >= longest[1] * 3]
        at += len(group)
        for i, cost in zip(group, _diagonals([pairs[i] for i in group])):
            out[i] = cost >> LOW_BITS, cost & ((1 << LOW_BITS) - 1)
    return out


def _diagonals(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    edit, sub, far = np.int32(1 << LOW_BITS), np.int32((1 << LOW_BITS) + 1), np.int32(1 << 30)
    n, m, count = max(len(r) for r, _ in pairs), max(x.shape[1] for _, x in pairs), len(pairs)
    refs = np.full((n, count), -2, np.int32)
    chains = np.full((len(pairs[0][1]), m + 1, count), -1, np.int32)  # the last step first; one that isn't there
    for t, (ref, labels) in enumerate(pairs):
        refs[: len(ref), t] = ref
        chains[:, m - labels.shape[1] : m, t] = labels[:, ::-1]
    ends = np.array([len(r) + x.shape[1] for r, x in pairs])
    places = np.array([len(r) for r, _ in pairs])
    out = np.zeros(count, np.int64)
    before, last = np.full((n + 2, count), far), np.full((n + 2, count), far)
    last[0] = 0
    out[ends == 0] = 0
    for d in range(1, n + m + 1):  # cells of i reference symbols and d - i steps
        low, high = max(0, d - m), min(n, d)
        a, new = max(low, 1), np.empty((n + 2, count), np.int32)
        if low == 0:
            new[0] = edit * np.int32(d)
        if high >= a:
            there = slice(m - d + a, m - d + high + 1)
            other = refs[a - 1 : high] != chains[0, there]
            for labels in chains[1:]:
                other &= refs[a - 1 : high] != labels[there]
            pair = other * sub
            pair += before[a - 1 : high]
            alone = np.minimum(last[a - 1 : high], last[a : high + 1])
            alone += edit
            np.minimum(pair, alone, out=new[a : high + 1])
        new[high + 1] = far
        before, last = last, new
        for t in np.flatnonzero(ends == d):
            out[t] = new[places[t], t]
    return out.tolist()


def _edits(arcs: DataFrame, references: DataFrame, factors: list[float]) -> DataFrame:
    """(utt, factor, edits, substitutions, n_ref) of utterances with arcs and a reference (utt,
    symbols): one pass; the weights of paths through arcs serve every factor. Chains are aligned together."""
    ship_package(arcs.sparkSession)
    kind = arcs.schema["utt"].dataType.simpleString()
    schema = f"utt {kind}, factor double, edits bigint, substitutions bigint, n_ref bigint"
    # an utterance's reference is a row in front of its arcs
    front = references.select("utt", F.lit(-1).cast("bigint").alias("src"), F.lit(-1).cast("bigint").alias("dst"), F.lit("").alias("label"), F.lit(0.0).alias("weight"), "symbols")
    rows = arcs.select("utt", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "label", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("array<string>").alias("symbols"))

    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []  # (utt, factor, reference, chain)

        def done() -> Iterator[pa.RecordBatch]:
            found = chain_edits([x[2:] for x in held])
            rows = out + [(utt, f, *got, len(ref)) for (utt, f, ref, _), got in zip(held, found)]
            out.clear()
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

        size = 0
        for table, starts in whole_groups(batches):
            src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
            coded = table.column("label").combine_chunks().dictionary_encode()
            names = coded.dictionary
            label = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            eps = names.to_pylist().index(EPS) if EPS in names.to_pylist() else -1
            lists = table.column("symbols").combine_chunks()
            codes = pc.index_in(lists.values, value_set=names).fill_null(-2).to_numpy(zero_copy_only=False)
            cuts = lists.offsets.to_numpy()
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                if src[a] != -1 or b == a + 1:
                    continue
                first = a + 1
                while first < b and src[first] == -1:  # of repeated references the first
                    first += 1
                if first == b:
                    continue
                utt = table.column("utt")[a].as_py()
                ref = codes[cuts[a] : cuts[a + 1]]
                own = slice(first, b)
                chains = _chain_labels(src[own], dst[own], label[own], weight[own], factors, eps) if b - first + len(ref) <= CHAIN else None
                if chains is not None:
                    held += [(utt, f, ref, x) for f, x in zip(factors, chains) if x is not None]
                    size += (len(ref) + b - first) * len(factors)
                    continue
                symbols = np.array(table.column("symbols")[a].as_py() or [], dtype=object)
                g = Graph(src[own].tolist(), dst[own].tolist(), table.column("label").slice(first, b - first).to_pylist(), weight[own].tolist())
                through, best = g.through()
                for f in factors:
                    kept = None if math.isinf(f) else [w <= best + f + 1e-9 for w in through]
                    if got := least_edits(g, symbols, kept):
                        out.append((utt, f, *got, len(symbols)))
            if size >= HELD:
                yield from done()
                size = 0
        yield from done()

    return _together(rows.unionByName(front)).mapInArrow(run, schema)


def error_rates(arcs: DataFrame, references: DataFrame) -> DataFrame:
    """Per utterance the best alignment of its reference (utt, symbols) with any lattice path:
    (utt, edits, substitutions, n_ref), fewest edits first, then fewest substitutions."""
    return _edits(arcs, references, [math.inf]).drop("factor")


def error_sweep(arcs: DataFrame, references: DataFrame, factors: list[float]) -> DataFrame:
    """Lattice error rate by pruning factor: (factor, edits, n_ref, rate). The lattices stay as they are."""
    sums = _edits(arcs, references, factors).groupBy("factor").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"))
    return sums.select("factor", "edits", "n_ref", (F.col("edits") / F.nullif("n_ref", F.lit(0))).alias("rate"))


def rescore(arcs: DataFrame, bigrams: DataFrame, floor: float = 1e-6, start: str = "^") -> DataFrame:
    """Lattices composed with a bigram model (ctx, w, p): a state is a state and the label that led
    to it, given as src_label and dst_label. Unseen bigrams have probability ``floor``. Two
    equi-joins: each arc with those that follow it, and with its probability."""
    before = arcs.select("utt", F.col("dst").alias("src"), F.col("label").alias("src_label")).distinct()
    before = before.unionByName(arcs.where("src = 0").select("utt", "src").distinct().withColumn("src_label", F.lit(start)))
    wide = arcs.join(before, ["utt", "src"])
    probs = bigrams.select(F.col("ctx").alias("src_label"), F.col("w").alias("label"), "p")
    rows = wide.join(probs, ["src_label", "label"], "left")
    weight = F.col("weight") - F.log(F.coalesce("p", F.lit(floor)))
    return rows.select("utt", "src", "src_label", "dst", F.col("label").alias("dst_label"), "label", weight.alias("weight"))


def rescored(arcs: DataFrame, letters) -> DataFrame:
    """(utt, src, src_ctx, dst, dst_ctx, label, weight): lattices composed with a character model of
    any order (``letter`` and ``first_tail`` as in segment.Scores). A state is a state and the symbols
    that led to it, blank-separated."""
    shared = arcs.sparkSession.sparkContext.broadcast(letters)

    def work(g: Graph) -> list[tuple]:
        model = shared.value
        tails: dict[int, set[tuple]] = {0: {model.first_tail()}}
        out = []
        for s in g.states:
            for tail in sorted(tails.get(s, ())):
                for i in g.out.get(s, ()):
                    cost, after = (0.0, tail) if g.label[i] == EPS else model.letter(g.label[i], tail)
                    tails.setdefault(g.dst[i], set()).add(after)
                    out.append((s, " ".join(tail), g.dst[i], " ".join(after), g.label[i], g.weight[i] + cost))
        return out

    return grouped_graphs(arcs, work, "src bigint, src_ctx string, dst bigint, dst_ctx string, label string, weight double")


def timed_path(arcs: DataFrame, words: DataFrame) -> DataFrame:
    """(utt, pos, label, start_t, end_t, word_no): for each segmented utterance (utt, words, arrays of
    symbols) the arcs of its best path with just those symbols. ``arcs`` have start_t and end_t."""
    ship_package(arcs.sparkSession)
    kind = arcs.schema["utt"].dataType.simpleString()
    schema = f"utt {kind}, pos bigint, label string, start_t double, end_t double, word_no bigint"
    blank = F.lit(None).cast("array<array<string>>")
    rows = arcs.select("utt", "src", "dst", "label", "weight", F.col("start_t").cast("double").alias("start_t"), F.col("end_t").cast("double").alias("end_t"), blank.alias("words"))
    minus_one = F.lit(-1).cast("bigint")
    front = words.select("utt", minus_one.alias("src"), minus_one.alias("dst"), F.lit("").alias("label"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("start_t"), F.lit(None).cast("double").alias("end_t"), F.col("words").cast("array<array<string>>").alias("words"))

    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            src, dst, label, weight, begin, end = (table.column(c).to_pylist() for c in ("src", "dst", "label", "weight", "start_t", "end_t"))
            out, owner = [], []
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                if src[a] != -1 or b == a + 1:
                    continue
                marks = [(c, n) for n, w in enumerate(table.column("words")[a].as_py() or []) for c in w]
                g = Graph(src[a + 1 : b], dst[a + 1 : b], label[a + 1 : b], weight[a + 1 : b])
                for pos, i in enumerate(_path_of(g, [c for c, _ in marks])):
                    owner.append(a)
                    out.append((pos, g.label[i], begin[a + 1 + i], end[a + 1 + i], marks[pos][1]))
            if out:
                utts = table.column("utt").take(pa.array(owner, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([utts, *(pa.array(c, f.type) for c, f in zip(zip(*out), list(out_schema)[1:]))], schema=out_schema)

    return _together(rows.unionByName(front)).mapInArrow(run, schema)


def _path_of(g: Graph, symbols: list[str]) -> list[int]:
    """Arcs of the best path that spells the symbols; empty if there is none. <eps> arcs are not followed."""
    cells: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, -1)}
    for s in g.states:
        for i in g.out.get(s, ()):
            for n in [n for n in range(len(symbols)) if (s, n) in cells and symbols[n] == g.label[i]]:
                key, cost = (g.dst[i], n + 1), cells[s, n][0] + g.weight[i]
                if key not in cells or cost < cells[key][0]:
                    cells[key] = (cost, i)
    ends = [(cells[s, len(symbols)][0], s) for s in g.ends if (s, len(symbols)) in cells]
    out: list[int] = []
    if ends:
        at = (min(ends)[1], len(symbols))
        while at[1]:
            i = cells[at][1]
            out.append(i)
            at = (g.src[i], at[1] - 1)
    return out[::-1]


def draw(arcs: DataFrame) -> DataFrame:
    """(utt, dot): each lattice as Graphviz text."""
    line = F.format_string('  %d -> %d [label="%s/%.4f"];', "src", "dst", F.replace(F.col("label"), F.lit('"'), F.lit('\\"')), "weight")
    lines = arcs.select("utt", F.struct("src", "dst", "label", line.alias("line")).alias("x")).groupBy("utt").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("utt", F.concat(F.lit("digraph lattice {\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n}\n")).alias("dot"))


def word_times(arcs: DataFrame) -> DataFrame:
    """(utt, word_no, word, start_t, end_t) from path arcs (utt, pos, label, start_t, end_t,
    word_no): the first start and last end of each word's timed arcs."""
    rows = arcs.groupBy("utt", "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "").alias("word"),
        F.min_by("start_t", F.when(F.col("start_t") >= 0, F.col("pos"))).alias("start_t"),
        F.max_by("end_t", F.when(F.col("end_t") >= 0, F.col("pos"))).alias("end_t"),
    )
    checked = F.when(F.col("start_t") > F.col("end_t"), F.raise_error(F.lit("a word ends before it starts"))).otherwise(F.col("end_t"))
    return rows.withColumn("end_t", checked)
