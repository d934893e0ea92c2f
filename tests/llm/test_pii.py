"""Bootstrapped contexts of op7 against a plain Python version of the method."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from wordloom.llm import pii
from tests.llm.test_documents import docs, plain_spans

CUES = (r"(?<![A-Za-z0-9_])[A-Za-z_]{2,}+\x20?[=:]\x20?[\"']?", r"(?<![A-Za-z0-9_])[A-Za-z]{2,}+\x20[A-Za-z]{2,}+\x20")
TOKEN = r"(?=[A-Za-z@._%+/-]*[0-9])[A-Za-z0-9+][A-Za-z0-9@._%+/-]*+"
BARE = r"(?<![A-Za-z0-9_])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+)|AKIA[0-9A-Z]{12,20}+)(?![A-Za-z0-9_])"
WHOLE = r"(?:[0-9a-f]{16,}|[0-9A-F]{16,}|AKIA[0-9A-Z]{12,20})"


def brute_spans(texts: list[str], min_evidence: int) -> list[str]:
    base = [[(int(a), int(b), k) for k, a, b in (x.split(":") for x in plain_spans(t).split(",") if x)] for t in texts]
    rows: list[dict[tuple[int, int], list]] = []  # per text: span -> [cue, token, plain]
    for t, own in zip(texts, base):
        at: dict[tuple[int, int], list] = {}

        def add(a: int, b: int, cue: str | None, plain: bool) -> None:
            old = at.get((a, b), [None, t[a:b], False])
            at[a, b] = [max(old[0] or "", cue) if cue is not None else old[0], t[a:b], old[2] or plain]

        for cue in CUES:
            for m in re.finditer(f"({cue})({TOKEN})", t):
                add(m.start(2), m.end(), re.sub(" +", " ", m[1]).lower(), re.fullmatch(WHOLE, m[2]) is not None)
        for a, b, plain in [(a, b, False) for a, b, _ in own] + [(*m.span(), True) for m in re.finditer(BARE, t)]:
            before = re.search(f"(?:{'|'.join(CUES)})\\Z", t[:a])
            if before or plain:
                add(a, b, before and re.sub(" +", " ", before[0]).lower(), plain)
        rows.append(at)
    known = lambda n, a, b: any(x < b and a < y for x, y, _ in base[n])
    edges: dict[tuple[str, str], bool] = {}
    for n, at in enumerate(rows):
        best: dict[int, tuple] = {}
        for (a, b), (cue, token, plain) in at.items():
            if cue is not None and (len(token) >= min_evidence or plain or any((a, b) == x[:2] for x in base[n])):
                best[a] = max(best.get(a, (False, -1, "", "")), (known(n, a, b) or plain, b, cue, token))
        for seed, _, cue, token in best.values():
            edges[cue, token] = edges.get((cue, token), False) or seed
    score = {e: float(seed) for e, seed in edges.items()}
    cues, tokens = {c for c, _ in edges}, {t for _, t in edges}
    for n in range(pii.ROUNDS):
        of = {c: [s for (d, _), s in score.items() if d == c] for c in cues}
        patterns = {c: sum(x) / (len(x) + pii.SHRINK) for c, x in of.items()}
        instances = {t: 1 - math.prod(1 - patterns[c] for c, u in edges if u == t) for t in tokens}
        score = {e: 1.0 if seed else instances[e[1]] for e, seed in edges.items()}
    trusted = {c for c in cues if patterns[c] >= pii.MIN_SCORE and sum(s for (d, _), s in edges.items() if d == c) >= pii.MIN_SEEDS}
    kinds = (*pii.KINDS, pii.FOUND)
    out = []
    for n, at in enumerate(rows):
        more = [(a, b, pii.FOUND) for (a, b), (cue, _, plain) in at.items() if (plain or cue in trusted) and not known(n, a, b)]
        out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for a, b, k in base[n] + more)))
    return out


def found(spark, texts: list[str], min_evidence: int = pii.MIN_EVIDENCE) -> list[str]:
    rows = pii.spans(docs(spark, texts), min_evidence).select("doc_id", pii.rendered(F.col("spans")).alias("s")).collect()
    return [r.s for r in sorted(rows, key=lambda r: r.doc_id)]


def test_spans_match_the_plain_method(spark):
    rng = random.Random(5)
    cues = ["login: ", "the key is ", "pin=", 'token = "', "note here ", "x", "\nref:", "so then "]
    tokens = [lambda: "%032x" % (rng.getrandbits(128) | 10 << 124), lambda: f"{rng.choice('abcd')}x@mail.org", lambda: "+1 (269) 555-3296", lambda: str(rng.randrange(30)), lambda: f"zq-{rng.randrange(9)}-plumb", lambda: "word", lambda: "1.2.3.4", lambda: "1-key=77123456"]
    texts = []
    for n in range(300):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            cue = rng.choice(cues)
            # two cues stand before secrets nearly always, the others before anything
            token = rng.choice(tokens[:3] if cue in ("login: ", "the key is ") and rng.random() < 0.93 else tokens)()
            parts.append(f"{cue}{token}{rng.choice([' ', ', ', chr(10), ' 😀 '])}")
        texts.append("".join(parts))
    for least in (pii.MIN_EVIDENCE, 1):
        got, expected = found(spark, texts, least), brute_spans(texts, least)
        assert got == expected
        assert any("secret" in x for x in expected)


def test_tokens_and_cue_words_of_any_length_are_found(spark):
    word = "identification" * 4
    for cue in ("note here pin:", f"{word}: ", f"{word} {word} "):
        seeds = [f"{cue}{n:032x}f and" for n in range(10, 22)]
        texts = [*seeds, f"{cue}4821937 and", f"{cue}482193 and", f"{cue}7 and", f"other: 7 and {cue}", f"{cue}{'q7' * 20_000}"]
        got = found(spark, texts)[12:]
        at = len(cue)
        assert got == [f"secret:{at}:{at + 7}", f"secret:{at}:{at + 6}", f"secret:{at}:{at + 1}", "", f"secret:{at}:{at + 40_000}"]


def test_a_text_with_very_many_candidates(spark):
    seeds = [f"login: {n:032x}f and" for n in range(10, 22)]
    many = "".join(f"login: z{n}, see page {n}\n" for n in range(20_000))
    got = found(spark, [*seeds, many])[12].split(",")
    assert len(got) == 20_000 and got[0] == "secret:7:9"
