"""What showed on odd values and larger tables: the same results by ways that hold there."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from wordloom.functions import symbols as S


def test_rounding_is_that_of_sql(spark):
    rng = random.Random(5)
    values = [-0.0, 0.0, math.nan, math.inf, -math.inf, 1e300, -4.9e-10, 5e-10, 1.5e-9, None]
    values += [rng.expovariate(1 / scale) * rng.choice((1, -1)) for scale in (50, 5e4, 1e7) for _ in range(2000)]
    own = {r.i: r.r for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", S.rounded(F.col("v"), 9).alias("r")).collect()}
    sql = duckdb.connect().execute("SELECT generate_subscripts($1::DOUBLE[], 1) - 1, round(unnest($1::DOUBLE[]), 9)", [values]).fetchall()
    assert [(i, repr(own[i])) for i, _ in sql] == [(i, repr(x)) for i, x in sql]


def test_small_frames_of_arcs_are_not_broadcast(spark):
    """Spark takes arcs that it explodes for as small as the texts they come from."""
    from wordloom.operators import lattice
    from wordloom.sources import lattices

    rows = spark.createDataFrame([(1, "abca"), (2, "b"), (7, "zya")], "utt long, text string")
    arcs = lattice.sausage(rows, F.col("utt"), F.split("text", ""))
    names = S.symbol_table(arcs.select(F.col("label").alias("sym"), F.col("label").alias("at")))
    coded = lattices.to_openfst(arcs, names)
    back = lattices.named(lattices.openfst(coded)[0], names)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == plan.count("Join ") >= 2
    key = lambda r: (r.utt, r.src, r.dst, r.label, r.weight)
    assert sorted(map(key, back.collect())) == sorted(map(key, arcs.collect()))
    ids = {r.sym: r.id for r in names.collect()}
    for r in coded.collect():
        own = sorted((x.src, ids[x.label], x.dst, x.weight) for x in arcs.where(F.col("utt") == r.utt).collect())
        by_state: dict = {}
        for s, i, t, w in own:
            by_state.setdefault(s, []).append((i, i, w, t))
        n = max(t for _, _, t, _ in own) + 1
        assert bytes(r.content) == lattices.encode_fst(0, {n - 1: 0.0}, by_state, n)
        assert lattices.decode_fst(bytes(r.content))[:2] == (0, {n - 1: 0.0})


def test_texts_segmented_together_are_those_segmented_alone(monkeypatch):
    """Ties, long words and texts, letters beyond ASCII, groups of any size."""
    import pyarrow as pa

    from wordloom.operators import words
    from wordloom.operators.segment import best_unigrams, suffixes_of

    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "aé\U0001f600"])
        known = {"".join(rng.choices(letters, k=rng.randint(1, rng.choice((3, 8, 60))))): rng.choice([1.0, 2.5, rng.uniform(0.1, 30)]) for _ in range(rng.randint(0, 30))}
        texts = ["".join(rng.choices(letters, k=rng.randint(0, rng.choice((5, 40, 200))))) for _ in range(20)] + ["".join(rng.choices(list(known) or ["a"], k=4)) for _ in range(5)]
        monkeypatch.setattr(words, "CELLS", rng.choice((50, 150_000)))
        monkeypatch.setattr(words, "LONG_TEXT", rng.choice((30, 8_000)))
        index = words.WordIndex(pa.table({"word": pa.array(list(known), pa.string()), "cost": pa.array(list(known.values()), pa.float64())}))
        for text, (cost, found) in zip(texts, index.segment(texts, 1.5)):
            expected = best_unigrams(text, known, suffixes_of(known), 1.5)
            assert abs(cost - expected[0]) < 1e-9 and found == expected[1]


def test_sentences_of_a_joined_model_are_those_of_a_broadcast_one(spark, monkeypatch):
    """Contexts of many words in several ranges; a word that nothing follows."""
    from wordloom.operators import generate

    monkeypatch.setattr(generate, "RANGE_WORDS", 3)
    rng = random.Random(2)
    names = [f"w{k}" for k in range(12)]
    rows = [(c, w, rng.random() * (0.01 if rng.random() < 0.5 else 1)) for c in ["</s>", *names[:-1]] for w in [*names, "</s>"] if w != "</s>" or c != "</s>"]
    probs = spark.createDataFrame(rows, "ctx string, w string, p double")
    whole = {r.no: r.words for r in generate.sentences(probs, 200, seed=3, longest=6).collect()}
    joined = [(r.no, r.words) for r in generate.sentences(probs, 200, seed=3, longest=6, model_rows=10).collect()]
    assert len(joined) == 200 and dict(joined) == whole
    assert {len(w) for w in whole.values()} >= {1, 2, 6}
    empty = generate.sentences(probs.where("ctx <> '</s>'"), 3, seed=3, model_rows=1).collect()
    assert sorted((r.no, r.words) for r in empty) == [(0, []), (1, []), (2, [])]


def test_chains_aligned_together_are_those_aligned_alone(spark, monkeypatch):
    """Also beside lattices that are none: arcs that skip, <eps>, pruned arcs, empty references."""
    import numpy as np

    from wordloom.operators import lattice

    rng, arcs, refs = random.Random(8), [], []
    for utt in range(80):
        n = rng.randint(1, rng.choice((3, 30)))
        for s in range(n):
            arcs += [(utt, s, s + 1, rng.choice("abcd"), round(rng.random() * 2, 3)) for _ in range(rng.randint(1, 3))]
        if utt % 5 == 0:
            arcs.append((utt, 0, n, rng.choice(["a", "<eps>"]), 0.7))
        refs.append((utt, rng.choices("abcde", k=rng.randint(0, 30))))
    factors = [math.inf, 0.9, 0.2]
    expected = set()
    for utt, ref in refs:
        own = sorted(x[1:] for x in arcs if x[0] == utt)
        g = lattice.Graph(*(list(c) for c in zip(*own)))
        through, best = g.through()
        for f in factors:
            got = lattice.least_edits(g, np.array(ref, dtype=object), [w <= best + f + 1e-9 for w in through])
            expected.add((utt, f, *got, len(ref)))
    together, chain_edits = [], lattice.chain_edits
    df, rs = spark.createDataFrame(arcs, "utt long, src long, dst long, label string, weight double"), spark.createDataFrame(refs, "utt long, symbols array<string>")
    assert {tuple(r) for r in lattice._edits(df, rs, factors).collect()} == expected
    pairs = [(np.array(rng.choices(range(4), k=rng.randint(0, 20))), np.array([rng.choices(range(-1, 4), k=w), rng.choices(range(4), k=w)])) for w in [rng.randint(1, 20) for _ in range(50)]]
    alone = [chain_edits([p])[0] for p in pairs]
    for most in (30, 400, 65_536):
        monkeypatch.setattr(lattice, "TOGETHER", most)
        together.append(chain_edits(pairs))
    assert together == [alone] * 3


def test_att_texts_need_arcs_once_or_where_they_are(spark):
    """One exchange for arcs of anywhere, none for those of one row; the same texts."""
    from wordloom.operators import lattice
    from wordloom.sources import lattices

    rows = spark.createDataFrame([(1, "abz"), (2, "q")], "utt long, text string")
    arcs = lattice.sausage(rows, F.col("utt"), F.split("text", ""))
    grouped = lattices.to_att(arcs)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    alone = rows.select("utt", lattices.att_text(lattice.sausage_arcs(F.split("text", ""))).alias("content"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, alone.collect()))
    skips = spark.createDataFrame([(1, 0, 1, "b", 0.5), (1, 0, 1, "a", 1.0), (1, 0, 10, "c", 2.0), (1, 1, 9, "d", 0.0)], "utt long, src long, dst long, label string, weight double")
    assert lattices.to_att(skips).first().content == "0 1 a a 1.0\n0 1 b b 0.5\n0 10 c c 2.0\n1 9 d d 0.0\n9\n10\n"


def test_many_customers_at_few_tables_take_no_integral(monkeypatch):
    import numpy as np

    from wordloom.operators import stirling

    n, base, a, u = np.array([300, 900, 4000, 257]), np.array([1e-6, 1e-3, 1e-4, 1e-2]), np.array([3.1, 40.1, 700.0, 2.0]), np.array([0.5, 0.99, 0.2, 0.7])
    with monkeypatch.context() as m:
        m.setattr(stirling, "FEW_N", 0)
        expected = stirling.draw_counts(n, base, a, 0.5, u).tolist()
    monkeypatch.setattr(stirling, "_on_hairpin", None)
    assert stirling.draw_counts(n, base, a, 0.5, u).tolist() == expected
