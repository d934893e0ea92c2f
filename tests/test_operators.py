"""Operators against brute force on small tables."""

import itertools
import math
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from wordloom.config import Options, PruningSweep
from wordloom.functions import symbols as S
from wordloom.operators import align, lattice, lexicon, sampler, segment
from wordloom.operators.model import Nested
from wordloom.sources import lattices, text


def distance(ref, hyp):
    """(edits, substitutions), the plain way."""
    table = {}
    for i, j in itertools.product(range(len(ref) + 1), range(len(hyp) + 1)):
        options = [(0, 0)] if i == j == 0 else []
        if i:
            options.append((table[i - 1, j][0] + 1, table[i - 1, j][1]))
        if j:
            options.append((table[i, j - 1][0] + 1, table[i, j - 1][1]))
        if i and j:
            wrong = ref[i - 1] != hyp[j - 1]
            options.append((table[i - 1, j - 1][0] + wrong, table[i - 1, j - 1][1] + wrong))
        table[i, j] = min(options)
    return table[len(ref), len(hyp)]


def test_alignment_matches_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abc", k=rng.randint(0, 7)) for _ in range(2))
        ins, gone, subs, right = align.counts(a, b)
        assert (ins + gone + subs, subs) == distance(a, b)
        assert ins - gone == len(b) - len(a) and gone + subs + right == len(a)
        ops = align.operations(a, b)
        assert [r for _, r, _ in ops if r is not None] == a and [h for *_, h in ops if h is not None] == b
        assert sum(o == "s" for o, *_ in ops) == subs and sum(o != "c" for o, *_ in ops) == ins + gone + subs


def traced(ref, hyp):
    """Operations from a whole table of costs."""
    whole = [align._first_row(len(hyp))]
    a, b = align._coded(ref, hyp)
    for x in a:
        whole.append(align._next_row(whole[-1], x, b))
    i, j, out = len(ref), len(hyp), []
    while i or j:
        same = i and j and ref[i - 1] == hyp[j - 1]
        if i and j and whole[i][j] == whole[i - 1][j - 1] + (0 if same else align.SUBSTITUTE):
            out.append(("c" if same else "s", ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
        elif i and whole[i][j] == whole[i - 1][j] + align.DELETE:
            out.append(("d", ref[i - 1], None))
            i -= 1
        else:
            out.append(("i", None, hyp[j - 1]))
            j -= 1
    return out[::-1]


@pytest.mark.parametrize("cells", [1, 7, 40, 1 << 20])
def test_operations_in_ranges_are_those_of_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(150):
        a, b = (rng.choices("abc", k=rng.choice([0, 1, 2, 9, 30])) for _ in range(2))
        assert align.operations(a, b) == traced(a, b)


def test_long_pairs_align_in_little_memory():
    rng = random.Random(8)
    a = rng.choices("abcdefgh", k=6000)
    b = [rng.choice("abcdefgh") if rng.random() < 0.2 else c for c in a if rng.random() > 0.1]
    tracemalloc.start()
    ops = align.operations(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # the whole table has 260 million bytes
    ins, gone, subs, right = align.counts(a, b)
    assert [sum(o == k for o, *_ in ops) for k in "idsc"] == [ins, gone, subs, right]


def test_rates_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "utt long, ref array<string>, hyp array<string>")
    row = align.rates(align.align(empty)).first()
    assert row.n_ref == 0 and row.error_rate is None and row.f_score is None


GRAPH = [(1, 0, 1, "a", 0.5), (1, 0, 1, "b", 1.0), (1, 1, 2, "<eps>", 0.0), (1, 1, 3, "c", 2.0), (1, 2, 3, "d", 0.1), (1, 0, 4, "x", 0.2)]
ARCS = "utt long, src long, dst long, label string, weight double"


def paths(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)

    def walk(state):
        if state not in out:
            yield (), 0.0
            return
        for _, _, d, label, w in out[state]:
            for rest, more in walk(d):
                yield ((label,) if label != "<eps>" else ()) + rest, w + more

    best = {}
    for labels, w in walk(0):
        best[labels] = min(best.get(labels, math.inf), w)
    return {k: round(v, 9) for k, v in best.items()}


def test_epsilon_removal_keeps_paths(spark):
    tail = [(1, 3, 5, "<eps>", 0.3)]
    for rows in (GRAPH, GRAPH + tail):
        got = [tuple(r) for r in lattice.remove_epsilon(spark.createDataFrame(rows, ARCS)).collect()]
        assert all(r[3] != "<eps>" for r in got)
        assert paths(got) == paths(rows)


def test_pruning_and_best_path(spark):
    df = spark.createDataFrame(GRAPH, ARCS)
    best = min(paths(GRAPH).values())
    kept = [tuple(r) for r in lattice.prune(df, 0.5).collect()]
    assert all(w <= best + 0.5 + 1e-9 for w in paths(kept).values())
    assert {k for k, w in paths(GRAPH).items() if w <= best + 0.5} <= set(paths(kept))
    assert sum(r.weight for r in lattice.best_path(df).collect()) == pytest.approx(best)
    assert {(r.state) for r in lattice.final_states(df).collect()} == {3, 4}


def test_lattice_error_is_the_best_path(spark):
    refs = spark.createDataFrame([(1, ["a", "c", "c"])], "utt long, symbols array<string>")
    row = lattice.error_rates(spark.createDataFrame(GRAPH, ARCS), refs).first()
    assert (row.edits, row.substitutions) == min(distance(["a", "c", "c"], list(p)) for p in paths(GRAPH))


def test_error_sweep_prunes_a_copy_for_each_factor(spark):
    """Each factor as pruning and aligning with every path of what is left."""
    rng, rows, refs = random.Random(6), [], []
    for utt in range(12):
        n = rng.randint(1, 5)
        for s in range(n):
            rows += [(utt, s, t, rng.choice(["a", "b", "<eps>"]), round(rng.random() * 2, 3)) for t in {s + 1, min(n, s + 2)} for _ in range(rng.randint(1, 2))]
        refs.append((utt, rng.choices("abc", k=rng.randint(0, 5))))
    arcs = spark.createDataFrame(rows, ARCS)
    factors = [float("inf"), 1.0, 0.3]
    got = {r.factor: (r.edits, r.n_ref) for r in lattice.error_sweep(arcs, spark.createDataFrame(refs, "utt long, symbols array<string>"), factors).collect()}
    for f in factors:
        kept = [tuple(r) for r in lattice.prune(arcs, f).collect()]
        edits = sum(min(distance(ref, list(p)) for p in paths([r for r in kept if r[0] == utt]))[0] for utt, ref in refs)
        assert got[f] == (edits, sum(len(r) for _, r in refs))


def test_parallel_arcs_add_up(spark):
    rows = [(1, 0, 1, "a", 1.0), (1, 0, 1, "a", 1.5), (1, 0, 1, "b", 800.0), (1, 0, 1, "b", 801.0)]
    got = {r.label: r.weight for r in lattice.merge_parallel(spark.createDataFrame(rows, ARCS)).collect()}
    assert got["a"] == pytest.approx(-math.log(math.exp(-1) + math.exp(-1.5)))
    assert got["b"] == pytest.approx(800 - math.log(1 + math.exp(-1)))


def test_formats_round_trip(spark):
    df = spark.createDataFrame(GRAPH, ARCS)
    names = S.symbol_table(df.select(F.col("label").alias("sym"), F.col("label").alias("at")))
    expected = sorted((r[1], r[2], r[3], round(r[4], 5)) for r in GRAPH)
    for back in (lattices.att(lattices.to_att(df))[0], lattices.named(lattices.openfst(lattices.to_openfst(df, names))[0], names), lattices.slf(lattices.to_slf(df))):
        assert sorted((r.src, r.dst, r.label, round(r.weight, 5)) for r in back.collect()) == expected


SLF = 'VERSION=1.0\nUTTERANCE=u1\nN=3 L=3\nI=0 t=0.00\nI=1 t=0.10\nI=2 t=0.30\nJ=0 S=0 E=1 W=aa a=-2.0 l=-1.0\nJ=1 S=0 E=1 W="aa" v=1 a=-2.5 l=0\nJ=2 S=1 E=2 W=!NULL a=0 l=0\n'


def test_slf_fields(spark):
    files = spark.createDataFrame([(1, SLF)], "utt long, content string")
    assert lattices.slf_name(files).first().name == "u1"
    got = {(r.src, r.dst, r.label): r.weight for r in lattices.slf(files, 0.0, 1.0).collect()}
    a, b = 2 / math.log(10) + 1 / math.log(10), 2.5 / math.log(10)
    assert got[0, 1, "aa"] == pytest.approx(-math.log(math.exp(-a) + math.exp(-b)))
    assert (1, 2, "<eps>") in got
    timed = {(r.src, r.label): (r.start_t, r.end_t) for r in lattices.slf(files, node_times=True).collect()}
    assert timed == {(0, "aa"): (0.0, 0.1), (1, "<eps>"): (0.1, 0.3)}


def test_final_weights_become_arcs(spark):
    text_ = "0 1 a a 0.5\n1 2 b b 0.5\n1 0.25\n2 0.75\n"
    arcs, finals = lattices.att(spark.createDataFrame([(1, text_), (2, "0 1 c c\n1\n")], "utt long, content string"))
    whole = lattice.with_final_arcs(arcs, finals)
    got = [tuple(r) for r in whole.where("utt = 1").collect()]
    assert paths(got) == {("a",): 0.75, ("a", "b"): 1.75}
    assert [tuple(r) for r in whole.where("utt = 2").collect()] == [(2, 0, 1, "c", 0.0)]
    data = lattices.encode_fst(1, {0: 0.5, 2: 1.0}, {1: [(7, 6, 0.25, 0)], 0: [(8, 7, 0.5, 2)]}, 3)
    arcs, finals = lattices.openfst(spark.createDataFrame([(1, data)], "utt long, content binary"))
    names = spark.createDataFrame([("x", 6), ("y", 7)], "sym string, id int")
    fst = [tuple(r)[:5] for r in lattice.with_final_arcs(lattices.named(arcs, names).drop("ilabel"), finals).collect()]
    assert paths(fst) == {("x",): 0.75, ("x", "y"): 1.75}


def test_times_along_a_path(spark):
    rows = [(1, 0, 1, "a", 0.1, 0.0, 0.1), (1, 0, 1, "b", 0.0, 0.0, 0.1), (1, 1, 2, "a", 0.0, 0.1, 0.3), (1, 1, 2, "<eps>", 0.0, 0.1, 0.3), (1, 2, 3, "c", 0.0, 0.3, 0.4)]
    arcs = spark.createDataFrame(rows, f"{ARCS}, start_t double, end_t double")
    free = lattice.remove_epsilon(arcs)
    assert {(r.src, r.dst, r.label, r.start_t) for r in free.collect()} == {(0, 1, "a", 0.0), (0, 1, "b", 0.0), (1, 2, "a", 0.1), (1, 3, "c", 0.3), (2, 3, "c", 0.3)}
    words = spark.createDataFrame([(1, [["a", "a"], ["c"]])], "utt long, words array<array<string>>")
    got = lattice.word_times(lattice.timed_path(free, words)).orderBy("word_no").collect()
    assert [(r.word, r.start_t, r.end_t) for r in got] == [("aa", 0.0, 0.3), ("c", 0.3, 0.4)]


def test_rescored_paths_carry_the_model(spark):

    model = Nested(1, 2, 3, seed=1)
    model.add(["ab", "c"])
    letters = model.freeze().chars
    got = lattice.rescored(spark.createDataFrame(GRAPH, ARCS), letters).collect()
    steps = [((r.src, r.src_ctx), (r.dst, r.dst_ctx), r.label, r.weight) for r in got]
    for labels, w in paths(GRAPH).items():
        tail, cost = letters.first_tail(), w
        for c in labels:
            own, tail = letters.letter(c, tail)
            cost += own
        at = {(0, "</unk>"): 0.0}
        found = []

        def walk(state, rest, total):
            own = [x for x in steps if x[0] == state]
            if not own and not rest:
                found.append(total)
            for _, to, label, more in own:
                if label == "<eps>":
                    walk(to, rest, total + more)
                elif rest and label == rest[0]:
                    walk(to, rest[1:], total + more)

        walk(next(iter(at)), labels, 0.0)
        assert min(found) == pytest.approx(cost)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a b c \nb a\n")
    rows = {r.name.rpartition("/")[2]: r.symbols for r in text.sentences(text.lines(spark, [str(tmp_path / "a.txt")])).collect()}
    assert rows == {"a.txt_Line_1": ["a", "b", "c"], "a.txt_Line_2": ["b", "a"]}
    long = [f"s{i} t" for i in range(3000)]
    (tmp_path / "long.txt").write_text("\n".join(long) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        split = text.lines(spark, [str(tmp_path / "long.txt"), str(tmp_path / "a.txt")])
        placed = text.numbered(split, spark, [str(tmp_path / "a.txt"), str(tmp_path / "long.txt")]).collect()
        assert sorted((r.place, r.value) for r in placed) == [(1, "a b c "), (2, "b a"), *((i + 3, v) for i, v in enumerate(long))]
        assert len({r.file for r in placed}) == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.txt").write_text("a\n\nb\n")
    with pytest.raises(Exception, match="empty line"):
        text.sentences(text.lines(spark, [str(tmp_path / "bad.txt")])).collect()
    (tmp_path / "ref.txt").write_text("a b </unk> c </unk> </s> </unk>\n")
    ref = text.transcription(text.sentences(text.lines(spark, [str(tmp_path / "ref.txt")]))).first()
    assert ref.words == [["a", "b"], ["c"]]
    (tmp_path / "sym").write_text("".join(f"{s}\t{i}\n" for i, s in enumerate([*S.RESERVED, "x"])))
    assert text.symbol_file(spark, str(tmp_path / "sym")).where("sym = 'x'").first().id == 6
    (tmp_path / "sym2").write_text("x\t0\n")
    with pytest.raises(ValueError):
        text.symbol_file(spark, str(tmp_path / "sym2"))


def test_pronunciations(spark):
    lines = spark.createDataFrame([(1, "to t uw"), (2, "two t uw"), (3, "to t ow"), (4, "a ah")], "line int, value string")
    got = {r.word: r.phones for r in lexicon.disambiguated(text.pronunciations(lines)).collect()}
    assert got == {"to": ["t", "uw"], "two": ["t", "uw", "#1"], "a": ["ah"]}
    rows = spark.createDataFrame([(1, ["a", "to"])], "utt long, words array<string>")
    assert text.spoken(rows, lexicon.disambiguated(text.pronunciations(lines))).first().symbols == ["ah", "</unk>", "t", "uw", "</unk>"]
    with pytest.raises(Exception, match="no pronunciation"):
        text.spoken(spark.createDataFrame([(1, ["zz"])], "utt long, words array<string>"), text.pronunciations(lines)).collect()


def test_unigram_viterbi_broadcast_and_join_agree(spark):
    rng = random.Random(4)
    words = spark.createDataFrame([(w, rng.randint(1, 9)) for w in {"".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(9)}], "word string, n long")
    costs = segment.unigram_costs(words)
    known = {r.word: r.cost for r in costs.collect()}
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "utt long, text string")

    def cost(s):
        return sum(known.get(w, 3.0 * (len(w) + 1)) for w in s)

    def every(t):
        if not t:
            yield []
        for k in range(1, len(t) + 1):
            for rest in every(t[k:]):
                yield [t[:k], *rest]

    expected = {i: round(min(map(cost, every(t))), 9) for i, t in enumerate(texts)}
    for limit in (1000, 0):
        found = segment.viterbi_unigram(df, costs, 3.0, limit).collect()
        assert {r.utt: round(r.cost, 9) for r in found} == expected
        assert {r.utt: "".join(r.words) for r in found} == dict(enumerate(texts))


def test_sampled_words_dont_depend_on_partitions_or_the_way_of_the_model(spark):
    given = [("abab", ["ab", "ab"]), ("ababc", ["ab", "ab", "c"]), ("cab", ["c", "ab"]), ("abcd", ["abc", "d"])]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(given)], "utt long, text string, words array<string>")
    out = []
    for parts, limit in ((1, 10**6), (3, 0)):  # broadcast, and joined to chunks of sentences
        settings = sampler.Settings(alphabet=4, seed=7, batches=2, limit=limit)
        state = sampler.iterate(sampler.start(rows.repartition(parts), 2, 2), settings)
        out.append({r.utt: r.words for r in state.segmentation.collect()})
    assert out[0] == out[1]
    assert {k: "".join(v) for k, v in out[0].items()} == {i: t for i, (t, _) in enumerate(given)}


def test_planted_words_are_learnt(spark):
    """Unsegmented sentences of a known lexicon, default options: most words are found in the first sweep,
    and no fewer than by the exact process from the same start."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 5))) for _ in range(8)]
    sentences = [rng.choices(words, k=rng.randint(4, 8)) for _ in range(120)]
    rows = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(sentences)], "utt long, text string")
    settings = sampler.Settings(alphabet=8)
    state, f, perplexity = sampler.start(rows, 1, 2), [], []

    def spans(ws):
        ends = list(itertools.accumulate(map(len, ws)))
        return set(zip([0, *ends], ends))

    for _ in range(2):
        state = sampler.iterate(state, settings)
        found = {r.utt: r.words for r in state.segmentation.collect()}
        right = sum(len(spans(s) & spans(found[i])) for i, s in enumerate(sentences))
        f.append(2 * right / sum(len(s) + len(found[i]) for i, s in enumerate(sentences)))
        stats, loglik = sampler.model_statistics(state, settings)
        perplexity.append(loglik.first()["perplexity"])
    exact, own = Nested(1, 2, 8, seed=5), [None] * len(sentences)
    for _ in range(2):
        exact.sweep(["".join(s) for s in sentences], own)
    right = sum(len(spans(s) & spans(own[i])) for i, s in enumerate(sentences))
    assert f[0] > 0.5 and f[1] > 2 * right / sum(len(s) + len(own[i]) for i, s in enumerate(sentences)) - 0.1
    assert perplexity[1] < perplexity[0] * 1.1
    level = {(r.model, r.level): r for r in stats.collect()}
    assert level["word", 0].n_words == sum(len(w) + 1 for w in found.values())
    assert level["character", 1].n_tables == level["character", 0].n_words
    before = state.word_hyper
    after = sampler.retrain(sampler.switch_orders(state, 2, 3), settings, 1)
    assert len(after.word_hyper.discount) == 2 and after.word_hyper.discount != [0.5, 0.5] and before is not after.word_hyper


def test_poisson(spark):
    got = [r.p for r in spark.range(1, 8).select(S.poisson_pmf(F.col("id").cast("int"), F.lit(5.0)).alias("p")).collect()]
    for k, p in zip(range(1, 8), got):
        assert p == pytest.approx(math.exp(-3) * 3 ** (k - 2) / math.factorial(k - 2) if k >= 2 else 0)


@pytest.mark.parametrize("bad", [{"known_n": 0}, {"wer": True}, {"rescored_folder": "x"}, {"lattice_type": "cmu"}, {"batches": -1}, {"init_sweeps": 2}, {"node_times": True}, {"sweep": PruningSweep(16, 0, 0)}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Options(**bad)


def test_options_schedule():
    o = Options(viterbi_from=3, deactivate_characters_from=2, eval_interval=2)
    assert [o.uses_viterbi(i) for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert [o.evaluates(i) for i in (1, 2, 3)] == [True, False, True]
    assert PruningSweep(16, 8, 0).factors() == [16, 8, 0]


def test_command_line():
    from wordloom.cli import options

    o = options(["-KnownN", "2", "-NumIter", "3", "-PruneFactor", "inf", "-SwitchIter", "2", "2", "6", "0", "1", "a.txt", "b.txt"])
    assert (o.known_n, o.iterations, o.prune_factor, o.switch.unknown_n, o.input_files) == (2, 3, math.inf, 6, ("a.txt", "b.txt"))


def random_lattices(rng, n):
    """(utt, src, dst, label, weight) of branching lattices with <eps> arcs."""
    rows = []
    for u in range(n):
        states = rng.randint(4, 7)
        for s in range(states - 1):
            for _ in range(rng.randint(1, 2)):
                rows.append((u, s, rng.randint(s + 1, min(states - 1, s + 2)), rng.choice(["a", "b", "c", "<eps>"]), round(rng.random(), 3)))
            rows.append((u, s, s + 1, rng.choice("abc"), round(rng.random() + 1, 3)))
    return rows


def test_lattices_with_a_joined_lexicon(spark):
    """A lexicon above the limit, joined by its prefixes, gives the words and costs of the broadcast one."""
    arcs = spark.createDataFrame(random_lattices(random.Random(5), 12), "utt long, src long, dst long, label string, weight double")
    costs = spark.createDataFrame([("ab", 1.0), ("abc", 1.2), ("c", 0.7), ("ba", 1.1), ("zz", 0.1), ("aa", 0.9)], "word string, cost double")
    one, two = ({r.utt: (round(r.cost, 9), r.words) for r in segment.lattice_words(arcs, costs, 2.0, limit).collect()} for limit in (1000, 0))
    assert {u: c for u, (c, _) in one.items()} == {u: c for u, (c, _) in two.items()} and len(one) == 12


def test_lattices_with_a_joined_model(spark):
    """Drawn words of lattices don't depend on whether the model is broadcast or joined by where its words stand."""
    from wordloom.plans.train import with_states_in_order

    arcs = spark.createDataFrame(random_lattices(random.Random(7), 8), "utt long, src long, dst long, label string, weight double")
    one = F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "label", "weight")
    rows = with_states_in_order(arcs).groupBy("utt").agg(F.array_sort(F.collect_list(one)).alias("arcs"))
    fixed = spark.createDataFrame([(["ab", "c"],), (["ab", "ab", "c"],), (["ba", "c"],), (["ca"],)], "words array<string>")
    out = []
    for limit in (10**6, 0):
        settings = sampler.Settings(alphabet=3, seed=7, batches=2, limit=limit)
        state = sampler.iterate(sampler.start(rows, 2, 2), settings, fixed=fixed)
        out.append({r.utt: r.words for r in state.segmentation.collect()})
    assert out[0] == out[1] and any(out[0].values())


def test_a_resumed_run_is_the_whole_run(spark, tmp_path):
    """Three iterations are two and a resumed third, row by row."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["abab", "ababc", "cab", "abcab"])], "utt long, text string")
    settings, folder = sampler.Settings(alphabet=3, seed=4, batches=1, modulation=0.0), f"file://{tmp_path}/state"
    assert sampler.load(spark, folder) is None
    state = sampler.start(rows, 1, 2)
    for _ in range(2):
        state = sampler.iterate(state, settings)
        sampler.save(state, folder)
    again = sampler.iterate(sampler.load(spark, folder), settings)
    state = sampler.iterate(state, settings)
    both = [sorted((r.utt, r.words) for r in s.segmentation.collect()) for s in (state, again)]
    assert both[0] == both[1] and again.iteration == 3 and again.word_hyper == state.word_hyper
