"""A lexicon as arrays, and the best segmentation of many texts at once.

Words of a length are a matrix of code points with their costs; a table of slots by a polynomial hash of
the window finds them at all places of a group of texts, letter by letter compared, so a hash decides
nothing. Texts of similar length then advance together, a step being one more letter of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
#: A code point that no text has; cells of a group of texts; longest word and text that go by arrays.
NO_LETTER, CELLS, LONG_WORD, LONG_TEXT = 0x110000, 150_000, 48, 8_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordIndex:
    """Words by length: (matrix of code points, costs). What finds them is made where it is used."""

    def __init__(self, table: pa.Table):
        """From a table (word, cost), no word being empty; of a repeated word the last cost holds."""
        self.words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table = table.append_column("n", pc.utf8_length(table.column("word")))
        for k in sorted(pc.unique(table.column("n")).to_pylist()):
            own = table.filter(pc.equal(table.column("n"), k))
            costs = dict(zip(own.column("word").to_pylist(), own.column("cost").to_pylist()))
            codes = np.frombuffer("".join(costs).encode("utf-32-le"), np.uint32).reshape(-1, k)
            self.words[k] = codes.astype(np.uint8 if codes.max() < 256 else np.uint32), np.fromiter(costs.values(), np.float64, len(costs))
        self.slots: dict[int, tuple] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": None}

    def _ready(self) -> None:
        self.base, again = BASE, True
        while again:  # until all words of a length have hashes of their own
            self.slots, again = {}, False
            for k, (codes, _) in self.words.items():
                h = np.zeros(len(codes), np.uint64)
                for c in range(k):
                    h = h * np.uint64(self.base) + codes[:, c].astype(np.uint64)
                if len(np.unique(h)) < len(h):
                    self.base, again = self.base * MIX % 2**64 | 1, True
                    break
                bits = max(4, (4 * len(h)).bit_length())
                slot = (h * np.uint64(MIX) >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                same = slot[order][1:] == slot[order][:-1]
                following = np.full(len(h), -1, np.int32)
                following[order[:-1][same]] = order[1:][same]
                head = np.full(1 << bits, -1, np.int32)
                head[slot[order][::-1]] = order[::-1]
                self.slots[k] = h, head, following, np.uint64(64 - bits)
        self.inverse = pow(self.base, -1, 2**64)

    def places(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By length (length, places, costs) of the words that stand in an array of code points."""
        if self.slots is None:
            self._ready()
        n = len(codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * _powers(self.inverse, n), out=sums[1:])
        powers, out = _powers(self.base, n), []
        for k, (h, head, following, shift) in self.slots.items():
            if k > n:
                break
            found = (sums[k:] - sums[: n - k + 1]) * powers[k - 1 :]
            word = head[found * np.uint64(MIX) >> shift]
            at = np.flatnonzero(word >= 0)
            word, own = word[at], found[at]
            places, numbers = [], []
            while len(at):
                same = h[word] == own
                places.append(at[same])
                numbers.append(word[same])
                word = following[word]
                on = ~same & (word >= 0)
                at, word, own = at[on], word[on], own[on]
            if not places:
                continue
            at, word = np.concatenate(places), np.concatenate(numbers)
            whole = np.ones(len(at), bool)
            for c in range(k):
                whole &= codes[at + c] == self.words[k][0][word, c]
            if whole.any():
                out.append((k, at[whole], self.words[k][1][word[whole]]))
        return out

    def segment(self, texts: list[str], letter_cost: float) -> list[tuple[float, list[str]]]:
        """(cost, words) of each text, as ``segment.best_unigrams`` has them."""
        out: list = [(0.0, [])] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            width = len(texts[order[at]]) + 1
            group = order[at : at + max(1, CELLS // width)]
            at += len(group)
            for i, got in zip(group, self._group([texts[i] for i in group], width, letter_cost)):
                out[i] = got
        return out

    def _group(self, texts: list[str], width: int, letter_cost: float) -> list[tuple[float, list[str]]]:
        """Texts of falling lengths below ``width``."""
        lengths = np.array([len(t) for t in texts])
        codes = np.full((len(texts), width), NO_LETTER, np.uint32)
        codes[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        found = self.places(codes.ravel())
        most = max((k for k, *_ in found), default=1)
        if most > LONG_WORD or width > LONG_TEXT:
            return [self._plain(t, i * width, found, letter_cost) for i, t in enumerate(texts)]
        # by step, text and length of the last word its cost
        costs = np.empty((width, len(texts), most))
        costs[:] = letter_cost * np.arange(2, most + 2)
        for k, places, own in found:
            costs[places % width + k, places // width, k - 1] = own
        # costs by place from the first place on; before it nothing begins
        best = np.full((len(texts), width + most), math.inf)
        best[:, most] = 0.0
        size = np.zeros((width, len(texts)), np.int32)
        # the place from which an unknown word longer than those costs least, and the cost up to it
        spot, far = np.zeros(len(texts), np.int64), np.full(len(texts), math.inf)
        live = len(texts)
        for j in range(1, width):
            while lengths[live - 1] < j:
                live -= 1
            options = best[:live, j : j + most][:, ::-1] + costs[j, :live]
            rounded = np.round(options, 9)
            last = rounded.argmin(axis=1)
            rows = np.arange(live)
            least, chosen = rounded[rows, last], options[rows, last]
            last += 1
            if j > most:
                start = j - most - 1
                own = best[:live, start + most]
                nearer = own - letter_cost * start <= far[:live] - letter_cost * spot[:live] + 1e-9
                spot[:live][nearer], far[:live][nearer] = start, own[nearer]
                beyond = far[:live] + letter_cost * (j - spot[:live] + 1)
                longer = np.round(beyond, 9) < least
                last, chosen = np.where(longer, j - spot[:live], last), np.where(longer, beyond, chosen)
            best[:live, j + most], size[j, :live] = chosen, last
        out = []
        for i, t in enumerate(texts):
            back, end, words = size[:, i].tolist(), len(t), []
            while end:
                words.append(t[end - back[end] : end])
                end -= back[end]
            out.append((float(best[i, len(t) + most]), words[::-1]))
        return out

    def _plain(self, text: str, begin: int, found: list, letter_cost: float) -> tuple[float, list[str]]:
        """One by one, where words or texts are long."""
        from wordloom.operators.segment import best_unigrams, suffixes_of

        known = {}
        for k, places, costs in found:
            own = (places >= begin) & (places < begin + len(text))
            known.update((text[a : a + k], c) for a, c in zip((places[own] - begin).tolist(), costs[own].tolist()))
        return best_unigrams(text, known, suffixes_of(known), letter_cost)
