"""MinHash near-duplicates, the conversation trie and whitening against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from wordloom.llm import minhash, prefix_trie, whitening

DOCS = "doc_id long, text string, digest string, node string, keys string, label string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width, similarity):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    named = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(sets[i]), named[i], d is not None and d == named[i]) for i, (d, _) in enumerate(rows)), key=repr)


def found_components(spark, rows, width, **options):
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in rows], DOCS)
    return sorted((tuple(r) for r in minhash.near_duplicates(df, width, **options).collect()), key=repr)


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width,chunk", [(2, 1024), (5, 1024), (2, 3)])
def test_minhash_components_are_those_of_all_pairs(spark, width, chunk):
    rng = random.Random(width)
    rows = []
    for g in range(6):  # chains of edits: neighbours link, far ones don't
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(7):
            words = changed(rng, words, rng.choice([0, 1, 2])).split(" ")
            rows.append((len(rows) * 3 % 41 + 41 * (len(rows) // 41), " ".join(words)))
    rows += [(900, "one"), (901, "ONE"), (902, "one two"), (903, "İ É"), (904, "İ é"), (905, " \t "), (906, ""), (907, None), (None, "one two"), (None, None), (902, "one two"), (902, "other words"), (908, "long " * 30_000), (909, "long long")]
    assert found_components(spark, rows, width, chunk=chunk) == brute_components(rows, width, 80)


def test_minhash_of_a_large_group_of_relatives(spark):
    """Hundreds of variants of one text, of which many pairs are just below the bound and many above."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, changed(rng, words, rng.choice([2, 3, 5, 8]))) for i in range(300)]
    assert found_components(spark, rows, 2) == brute_components(rows, 2, 80)
    with pytest.raises(ValueError):
        found_components(spark, rows[:1], 2, similarity=50)


def test_minhash_of_an_empty_table(spark):
    assert found_components(spark, [], 2) == []


def test_signatures_estimate_similarity():
    """Optimal densification: agreement follows the similarity for few and for many shingles."""
    rng = np.random.default_rng(4)
    for size in (5, 40, 3000):
        got = []
        for _ in range(60):
            values = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2)
            got.append((minhash.densified(values) == minhash.densified(values[:size])).mean())
        assert abs(np.mean(got) - size / (size + size // 4)) < 0.04
    one = minhash.densified(np.array([12345678901234567], np.uint64))
    assert (one == one[0]).all()


# --- conversations ------------------------------------------------------------------------------


def rebuilt(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    return out


def brute_trie(convs):
    nodes = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            node = nodes.setdefault(s[:d], {"members": [], "ends": [], "kids": 0, "leaves": 0, "saved": 0})
            node["members"].append(c)
            if d == len(s):
                node["ends"].append(c)
    for k in nodes:
        if k:
            nodes[k[:-1]]["kids"] += 1
    for k, node in nodes.items():
        own = (len(node["members"]) - 1) * (len(k[-1][1]) if k else 0)
        for d in range(len(k) + 1):
            nodes[k[:d]]["saved"] += own
            nodes[k[:d]]["leaves"] += node["kids"] == 0
    row = lambda k, n: (min(n["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]), n["kids"], n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
    return sorted((row(k, n) for k, n in nodes.items()), key=repr)


def found_trie(spark, rows, *limits):
    df = spark.createDataFrame([(c, t, r, x, "a", "b") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, head string, seq string")
    lists = prefix_trie.with_shared_openings(prefix_trie.turn_lists(df))
    got = prefix_trie.prefix_trie(lists, *limits)
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("limits", [(), (4,), (1,), (1000, 3)])
def test_trie_nodes_are_those_of_all_prefixes(spark, limits):
    rng = random.Random(6)
    rows = []
    for c in [*rng.sample(range(1000), 60), 100, 200]:
        same = rng.random() < 0.4  # copies under other ids
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "tool"]) if not same else "user", f"t{t} \U0001f600" if same else rng.choice(["a", "bb", "ccc"])))
    rows += [(7, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, None, "y"), (None, 1, "user", "lost"), (300, 0, "user", "long " * 20_000), (399, 0, "user", "b")]
    convs = rebuilt(rows)
    assert any(not s for s in convs.values())
    assert found_trie(spark, rows, *limits) == brute_trie(convs)


def test_trie_of_an_empty_table(spark):
    assert found_trie(spark, []) == []


def test_many_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(1000, 1400)]
    assert found_trie(spark, rows) == brute_trie(rebuilt(rows))


# --- embeddings ---------------------------------------------------------------------------------


def found_white(spark, rows, **options):
    df = spark.createDataFrame([(v, e, 1, "a") for v, e in rows], "vec_id long, embedding array<float>, label int, x string")
    return whitening.whiten(df, **options).collect()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(70, 40)) @ rng.normal(size=(40, 40)) * 0.1).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(90)] + [(None, base[1]), (3, base[2])]
    odd = [(500, None), (501, [None, *base[0][1:]]), (502, [math.inf, *base[0][1:]]), (503, [math.nan, *base[0][1:]]), (504, [])]
    got = found_white(spark, rows + odd)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:32]
    white = np.abs(centred @ vectors[:, order] / np.sqrt(values[order]))
    expected = sorted((repr(v), k + 1, n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)), round(white[i, k], 6), round(values[order[k]] / values.sum(), 9)) for i, (v, _) in enumerate(rows) for k in range(32))
    assert sorted((repr(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 6), round(r.explained, 9)) for r in got) == expected
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all(first[r.component] == r.whitened for r in got if r.vec_id == 100)  # one sign for all


def test_whitening_of_odd_tables(spark):
    assert found_white(spark, [(1, None), (2, [])]) == []
    flat = found_white(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 2.0])])
    assert [(r.component, r.whitened is None) for r in flat] == [(1, False), (2, True)] * 3
    assert flat[0].explained == 1.0 and flat[0].identity_error < 1e-9
    alone = found_white(spark, [(1, [1.0, 2.0])])
    assert [(r.whitened, r.deviation, r.explained) for r in alone] == [(None, 0, 0.0)] * 2
    once = found_white(spark, [(1, [0.0, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 2.0])], weights="one", components=1)
    assert len(once) == 3 and {r.n for r in once} == {2}
    with pytest.raises(ValueError):
        found_white(spark, [(1, [1.0]), (2, [1.0, 2.0])])
