"""What decontamination does without looking twice: plain texts, shared q-grams, alignments."""

import random
import re

import numpy as np
import pytest

from wordloom.llm import decontaminate

ODD = ["", " ", "_", "...", "a", " a", "a ", "A--b", "İstanbul İİ x İ", "x İ", "ΑΣ ΣΑΣ ς.Σ", "日本の 首都、", "ß ﬁ ǅ Å", "1½ ²x", "é ̇i", "�\x00 a\x00b", "𝔘x 😀 y", "a_b__c _"]


def slow_source(text):
    out, blank = [], False
    for at, c in enumerate(text):
        for x in c.replace("Σ", "σ").lower():
            if re.match(r"[\W_]", x):
                blank = True
                continue
            out += [at] * (2 if blank and out else 1)
            blank = False
    return out


def test_plain_texts_and_their_places():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("".join(ODD), k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["".join(f"{chr(c)}." if c % 3 else chr(c) for c in range(low, low + 0x1000)) for low in range(0, 0x20000, 0x1000)]
    for text in texts:
        plain = decontaminate.Plain(text)
        assert np.array_equal(plain.chars, decontaminate.codes(decontaminate.normalise(text)))
        assert plain.source().tolist() == slow_source(text)


def passages(rng, n, size=260):
    return [decontaminate.normalise("".join(rng.choices("abcdefghijklm ", k=size))) for _ in range(n)]


def test_scattered_qgrams_are_neither_sorted_nor_aligned(monkeypatch):
    """A clean text that shares short phrases with many items: no band holds what a window needs."""
    rng = random.Random(2)
    items = passages(rng, 60)
    index = decontaminate.Index(list(enumerate(items)))
    pieces = [item[at : at + 12] for item in items for at in rng.sample(range(240), 3)]
    rng.shuffle(pieces)
    text = " zzz ".join(pieces)
    assert len(index.found(decontaminate.Plain(text).chars)[0]) > 500

    def never(*args, **kwargs):
        raise AssertionError("nothing here is worth it")

    monkeypatch.setattr(np, "lexsort", never)
    monkeypatch.setattr(decontaminate, "aligned", never)
    assert decontaminate.regions(index, text) == []


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklm "])
def test_windows_are_those_that_share_enough(alphabet):
    """Every first window of its wording with enough q-grams in a band, once each, and no other."""
    rng = random.Random(alphabet)
    items = [decontaminate.normalise("".join(rng.choices(alphabet, k=n))) for n in (35, 45, 79, 130, 200)]
    index = decontaminate.Index(list(enumerate(items)))
    for _ in range(12):
        text = []
        for item in rng.sample(items, 3):
            text += list(item)
        for _ in range(rng.randint(0, 60)):
            text[rng.randrange(len(text))] = rng.choice(alphabet)
        chars = decontaminate.codes("".join(text))
        grams, expected = decontaminate.qgram_hashes(chars), []
        for i in range(len(items)):
            own = decontaminate.qgram_hashes(index.chars[i])
            used = decontaminate.first_windows(index.chars[i], int(index.width[i]))[1]
            pairs = [(int(p), int(d)) for p, d in np.argwhere((own[:, None] == grams) & used[:, None])]
            step = max(int(index.edits[i]), 1)
            for band in {(d - p) // step - k for p, d in pairs for k in (0, 1)}:
                places = [p for p, d in pairs if (d - p) // step - band in (0, 1)]
                for s in np.flatnonzero(index.first[i]).tolist():
                    if sum(s <= p <= s + index.width[i] - decontaminate.Q for p in places) >= index.need[i]:
                        expected.append((i, s, band * step))
        got = index.windows(*index.shared(*index.found(chars)))
        assert sorted(map(tuple, got.tolist())) == sorted(expected)


def test_alignments_over_the_budget_end_early(monkeypatch):
    """Those within it are the same beside hopeless ones, and whether or not these are dropped."""
    rng = random.Random(4)
    e, w = 6, 80
    patterns, texts = [], []
    for k in range(200):
        pattern = rng.choices(range(20), k=w)
        text = rng.choices(range(20), k=2 * e) + pattern + rng.choices(range(20), k=2 * e)
        changes = rng.choice([0, 3, 6, 7, 9, 80])
        for _ in range(changes):
            text[2 * e + rng.randrange(w)] = rng.randrange(20)
        if k % 2:
            del text[50]
            text.append(0)
        patterns.append(pattern)
        texts.append(text)
    patterns, texts = np.array(patterns), np.array(texts)
    cost, first, end = decontaminate.aligned(patterns, texts, e)
    monkeypatch.setattr(decontaminate, "LOOK", w)
    plain = decontaminate.aligned(patterns, texts, e)
    good = plain[0] <= e
    assert 20 < good.sum() < 180 and (cost[~good] > e).all()
    assert all(np.array_equal(x[good], y[good]) for x, y in zip((cost, first, end), plain))
    assert (cost[~good] == w).any()
    alone = [decontaminate.aligned(p[None], t[None], e) for p, t in zip(patterns, texts)]
    assert all([int(x[0]) for x in one] == [int(x[k]) for x in plain] for k, one in enumerate(alone) if good[k])


def test_no_window_needs_more_than_an_excerpt_has():
    for width in range(decontaminate.MIN_ITEM, decontaminate.WINDOW + 1):
        need = width - decontaminate.Q + 1 - decontaminate.Q * decontaminate.budget(width)
        assert 1 <= need <= decontaminate.EXCERPT - decontaminate.Q + 1
