"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Of an item's windows with one wording the first counts, so a repetitive item (a table of numbers, a
refrain) has few, and a repetitive text is cut until its shared q-grams fit: memory doesn't grow with
the product of item and text.

Texts are lower-cased and every run of characters other than letters and digits becomes a blank. A
benchmark item is covered by windows of ``WINDOW`` characters at every place (a shorter item is one
window). A window of w characters is found in a document if some region of it lies within
``e = rate * w`` edits. By the q-gram lemma such a region shares at least ``w + 1 - q - q * e``
q-grams with the window, all within a diagonal band of ``2 * e``; bands of that width, half
overlapping, are counted, and only windows that reach the bound are aligned, in a band. Verbatim
excerpts of ``EXCERPT`` characters or more are found at every place too, whatever stands around them.

The index of the benchmark is broadcast in groups of bounded size, whatever the benchmark's size;
each group is one pass over the documents. Documents are scanned in chunks that overlap by more
than a window, so memory doesn't grow with a text.

Defined cases: null and empty texts hold nothing; items of fewer than ``MIN_ITEM`` normalised
characters are searched verbatim, as whole words; those of fewer than ``min_item`` (a parameter) are
not searched, since they'd be found in clean texts; repeated items are searched once; an empty
benchmark finds nothing; very long texts are scanned in chunks; an empty table gives an empty table; each row is judged by its own text, rows with repeated or null doc_ids too; extra columns
are ignored by ``find`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import keyed
from wordloom.session import ship_package, stored

Q = 10
WINDOW = 80
EXCERPT = 50
RATE = 0.075
MIN_ITEM = 30
#: Default of the parameter: shorter items aren't searched at all.
SHORTEST = 8
#: Groups of items that one pass over the documents searches.
GROUPS_A_SCAN = 4
CHUNK = 1 << 20
GROUP_CHARS = 2 << 20
MAX_ITEM = 1 << 20
#: Shared q-grams held at once, as long as pieces of a text can still be cut.
SHARED = 1 << 20
#: Windows aligned at once, and runs looked at to save alignments.
ALIGNED = 1024
SKIPPED = 64
#: Rows of an alignment between looks at what is over the budget.
LOOK = 8
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.replace("Σ", "σ").lower()).strip(" ")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@functools.cache
def letters_and_digits() -> np.ndarray:
    """By code point, whether ``normalise`` keeps the character."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.ones(len(every), bool)
    for m in _OTHER.finditer(every):
        out[m.start() : m.end()] = False
    return out


class Plain:
    """``codes(normalise(text))`` as ``chars``; for each of them, on demand, the place in the text that it comes from."""

    def __init__(self, text: str):
        self.text = text
        lowered = codes(text.replace("Σ", "σ").lower())
        self.word = letters_and_digits().take(lowered)
        # of a run of others the last character, right before a word, becomes the blank
        self.kept = self.word.copy()
        self.kept[:-1] |= self.word[1:]
        self.kept[: int(self.word.argmax()) if len(self.word) else 0] = False
        self.chars = np.where(self.word, lowered, np.uint32(32))[self.kept]

    def source(self) -> np.ndarray:
        """A blank comes from the character after it."""
        places = np.flatnonzero(self.kept)
        places += ~self.word[places]
        if "İ" in self.text:  # the one character whose lower case is two
            return np.repeat(np.arange(len(self.text)), np.where(codes(self.text) == ord("İ"), 2, 1))[places]
        return places


def qgram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A polynomial hash of every q characters, built by doubling: 1, 2, 4, ... characters."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, size, power = chars.astype(np.uint64), 1, np.uint64(0x100000001B3)
        out, done = None, 0
        rest = q
        while rest:
            if rest & 1:
                out = part if out is None else out[: len(part) - done] * power + part[done:]
                done += size
            rest >>= 1
            if rest:
                part = part[:-size] * power + part[size:]
                size, power = 2 * size, power * power
        out = out[:n]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def budget(width: int) -> int:
    """Edits allowed in a window, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(RATE * width), (width - Q) // Q))


def first_windows(chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an item: by start, whether its window is the first of its wording, and by place, whether the
    q-gram there lies in such a window. A repetitive item has few, and others would find nothing more."""
    first = np.zeros(len(chars) - width + 1, bool)
    first[np.unique(qgram_hashes(chars, width), return_index=True)[1]] = True
    before = np.concatenate(([0], np.cumsum(first)))
    place = np.arange(len(chars) - Q + 1)
    return first, before[np.minimum(place, len(first) - 1) + 1] > before[np.maximum(place - (width - Q), 0)]


def crowd(item: np.ndarray, band: np.ndarray) -> np.ndarray:
    """For each shared q-gram, how many lie in its band of the item and the fuller of the two beside it.
    They are counted by slots of a table: slots that collide give more, never fewer."""
    size = 1 << min(18, (4 * len(item)).bit_length())
    slot = (item * 0x9E3779B1 + band) & (size - 1)
    n = np.bincount(slot, minlength=size)
    return n[slot] + np.maximum(n[(slot + 1) & (size - 1)], n[(slot - 1) & (size - 1)])


class Index:
    """q-grams of items: (item, place) by hash."""

    def __init__(self, items: list[tuple[int, str]], min_item: int = SHORTEST):
        self.ids: list[int] = []
        self.chars: list[np.ndarray] = []
        self.short: list[tuple[int, str]] = []
        for item_id, text in items:
            plain = normalise(text)
            whole = codes(plain)
            if len(whole) < MIN_ITEM:
                if len(whole) >= max(min_item, 1):
                    self.short.append((item_id, plain))
                continue
            for at in range(0, max(1, len(whole) - WINDOW), MAX_ITEM - WINDOW):
                self.ids.append(item_id)
                self.chars.append(whole[at : at + MAX_ITEM])
        self.width = np.array([min(WINDOW, len(c)) for c in self.chars], np.int64)
        self.edits = np.array([budget(w) for w in self.width], np.int64)
        self.need = self.width - Q + 1 - Q * self.edits
        self.first, places, grams = [], [], []
        for c, w in zip(self.chars, self.width.tolist()):
            first, used = first_windows(c, w)
            self.first.append(first)
            places.append(np.flatnonzero(used))
            grams.append(qgram_hashes(c)[used])
        self.sizes = np.array([len(c) for c in self.chars], np.int64)
        # how many first windows come before each start, all items in a row
        self.n_first = np.concatenate([np.concatenate(([0], np.cumsum(f))) for f in self.first] or [np.zeros(1, np.int64)])
        # the starts of first windows, and how many lie in the items before
        self.firsts = np.concatenate([np.flatnonzero(f) for f in self.first] or [np.empty(0, np.int64)])
        self.firsts_before = np.cumsum([0, *(int(f.sum()) for f in self.first)])[:-1]
        self.first_before = np.cumsum([0, *(len(f) + 1 for f in self.first)])[:-1]
        hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        # each hash once, its first entry and how many there are
        self.hashes, self.low, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        # the hashes' upper 20 bits, and the 20 below
        self.upper, self.lower = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.upper[hashes >> np.uint64(44)] = True
        self.lower[hashes >> np.uint64(24) & np.uint64(0xFFFFF)] = True

    def verbatim(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, 0) of the short items in a normalised text, as whole words."""
        if not self.short:
            return []
        if not hasattr(self, "automaton"):
            import ahocorasick

            by_text: dict[str, list[int]] = {}
            for item_id, plain in self.short:
                by_text.setdefault(f" {plain} ", []).append(item_id)
            self.automaton = ahocorasick.Automaton()
            for plain, ids in by_text.items():
                self.automaton.add_word(plain, (len(plain), ids))
            self.automaton.make_automaton()
        # places in the padded text are one more than in the text, and a match has a blank on either side
        return [(i, end - size + 1, end - 1, 0) for end, (size, ids) in self.automaton.iter(f" {text} ") for i in ids]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def found(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the text of the known q-grams, the first entry of each and how many there are."""
        if not len(self.hashes):
            return (np.empty(0, np.int64),) * 3
        grams = qgram_hashes(chars)
        at = np.flatnonzero(self.upper.take((grams >> np.uint64(44)).view(np.int64)))
        at = at[self.lower[grams[at] >> np.uint64(24) & np.uint64(0xFFFFF)]]
        grams = grams[at]
        own = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        same = self.hashes[own] == grams
        own = own[same]
        return at[same], self.low[own], self.count[own]

    def shared(self, at: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in it and place in the text of each shared q-gram, but for those in bands with fewer
        than a window needs. An excerpt, on one diagonal, has more than any window needs."""
        total = int(count.sum())
        doc_at = np.repeat(at, count)
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
        item, place = self.item[entry], self.place[entry]
        some = crowd(item, (doc_at - place) // np.maximum(self.edits, 1)[item]) >= self.need[item]
        return item[some], place[some], doc_at[some]

    def excerpts(self, chars: np.ndarray, item: np.ndarray, place: np.ndarray, doc_at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first place in it, first place in the text, length) of the verbatim excerpts."""
        if len(item) <= EXCERPT - Q:
            return []
        order = np.lexsort((place, doc_at - place, item))
        item, place, doc_at = item[order], place[order], doc_at[order]
        joined = (np.diff(item) == 0) & (np.diff(place) == 1) & (np.diff(doc_at) == 1)
        first = np.flatnonzero(np.append(True, ~joined))
        size = np.diff(np.append(first, len(item))) + Q - 1
        out = []
        for k, n in zip(first[size >= EXCERPT].tolist(), size[size >= EXCERPT].tolist()):
            i, p, d = int(item[k]), int(place[k]), int(doc_at[k])
            if np.array_equal(self.chars[i][p : p + n], chars[d : d + n]):
                out.append((i, p, d, n))
        return out

    def windows(self, item: np.ndarray, place: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Candidate rows (item, first place of the window, diagonal of the band's start)."""
        none = np.empty((0, 3), np.int64)
        if not len(item):
            return none
        step = np.maximum(self.edits[item], 1)
        band = (doc_at - place) // step
        item, place = np.concatenate((item, item)), np.concatenate((place, place))
        band = np.concatenate((band, band - 1))
        order = np.lexsort((place, band, item))
        item, place, band = item[order], place[order], band[order]
        need = self.need[item]
        last = np.arange(len(item)) + need - 1
        fits = last < len(item)
        here, last = np.flatnonzero(fits), last[fits]
        same = (item[here] == item[last]) & (band[here] == band[last]) & (place[last] - place[here] <= self.width[item[here]] - Q)
        here, last = here[same], last[same]
        # of the windows that hold such a run only the first of their wording count: those from low to high
        start, end = place[here], place[last] + Q
        width, size = self.width[item[here]], self.sizes[item[here]]
        low, high = np.maximum(end - width, 0), np.minimum(start, size - width)
        at = self.first_before[item[here]]
        some = (low <= high) & (self.n_first[at + high + 1] > self.n_first[at + low])
        here, low, high, at = here[some], low[some], high[some], at[some]
        if not len(here):
            return none
        # neighbours that ask for the same windows ask once
        kept = np.append(True, (np.diff(item[here]) != 0) | (np.diff(band[here]) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))
        here, low, high, at = here[kept], low[kept], high[kept], at[kept]
        item, band = item[here], band[here]
        # runs of a band go on where the one before ended
        again = (np.diff(item) == 0) & (np.diff(band) == 0)
        low[1:] = np.where(again, np.maximum(low[1:], high[:-1] + 1), low[1:])
        begin = self.n_first[at + low]
        count = self.n_first[at + high + 1] - begin
        rank = np.repeat(self.firsts_before[item] + begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.column_stack((np.repeat(item, count), self.firsts[rank], np.repeat(band * np.maximum(self.edits[item], 1), count)))


def starts(size: int, width: int) -> list[int]:
    """First places of the windows over an item."""
    return list(range(size - width + 1))


def aligned(pattern: np.ndarray, text: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``pattern`` (n, w) against rows of ``text`` (n, w + 4 * edits): the least edits of an
    alignment in the band, and its first and last column (the end exclusive); w edits and no columns
    where the least are known to be more than ``edits``."""
    n, w = pattern.shape
    width = text.shape[1] - w + 1
    # edits in the high bits, the first column in the low ones: of equal edits the longest match;
    # a column of all windows is contiguous
    one = np.int32(1 << 16)
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    steps = (np.arange(width, dtype=np.int32) * one)[:, None]
    row = np.repeat(np.arange(width, dtype=np.int32)[:, None], n, axis=1)
    best, first, last = np.full(n, w, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(w):
        if i and i % LOOK == 0:  # costs never fall: those over the budget go
            near = np.flatnonzero(row.min(axis=0) >> 16 <= edits)
            if 4 * len(near) <= 3 * len(rows):
                rows, row, pattern, text = rows[near], row[:, near], pattern[:, near], text[:, near]
            if not len(rows):
                return best, first, last
        new = row + (text[i : i + width] != pattern[i]) * one
        np.minimum(new[:-1], row[1:] + one, out=new[:-1])  # the text lacks a character
        new -= steps  # the pattern lacks some: prefix minima by doubling
        size = 1
        while size < width:
            np.minimum(new[size:], new[:-size], out=new[size:])
            size *= 2
        row = new + steps
    end = (row >> 16).argmin(axis=0)
    cost = row[end, np.arange(len(rows))]
    best[rows], first[rows], last[rows] = cost >> 16, cost & (one - 1), end + w
    return best, first, last


def regions(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) in the text's own characters, end exclusive: unions of verified
    windows, with the least edits of one window."""
    plain = Plain(text)
    whole = plain.chars
    hits: list[tuple[int, int, int, int]] = index.verbatim(normalise(text)) if index.short else []
    overlap = 2 * WINDOW
    pieces = [(base, min(CHUNK + overlap, len(whole) - base)) for base in range(0, max(1, len(whole) - overlap), CHUNK)]
    while pieces:
        base, n = pieces.pop()
        chars = whole[base : base + n]
        known = index.found(chars)
        if n > 4 * overlap and int(known[2].sum()) > SHARED:  # a repetitive text is cut into smaller pieces
            half = n // 2
            pieces += [(base, half + overlap), (base + half, n - half)]
            continue
        shared = index.shared(*known)
        exact = index.excerpts(chars, *shared)
        hits += [(index.ids[i], base + d, base + d + n, 0) for i, _, d, n in exact]
        found = index.windows(*shared)
        for i, p, d, n in sorted(exact, key=lambda x: -x[3])[:SKIPPED]:  # windows within an excerpt say no more
            inside = (found[:, 0] == i) & (found[:, 1] >= p) & (found[:, 1] + index.width[i] <= p + n)
            lag = d - p - found[:, 2]
            found = found[~(inside & (lag >= 0) & (lag < 2 * max(int(index.edits[i]), 1)))]
        sizes = ((w, found[index.width[found[:, 0]] == w]) for w in (np.unique(index.width[found[:, 0]]) if len(found) else ()))
        for w, own in ((w, rows[k : k + ALIGNED]) for w, rows in sizes for k in range(0, len(rows), ALIGNED)):
            e = budget(int(w))
            left = own[:, 1] + own[:, 2] - e
            columns = left[:, None] + np.arange(w + 4 * e)
            inside = (columns >= 0) & (columns < len(chars))
            text_rows = np.where(inside, chars[np.clip(columns, 0, max(0, len(chars) - 1))], 0)
            pattern = np.array([index.chars[i][s : s + w] for i, s, _ in own.tolist()])
            if len(own) < ALIGNED:
                cost, first, end = aligned(pattern, text_rows, e)
            else:  # a repetitive text: equal pairs of wordings are aligned once
                keys = qgram_hashes(np.hstack((pattern, text_rows)).ravel(), int(2 * w + 4 * e))[:: int(2 * w + 4 * e)]
                _, once, back = np.unique(keys, return_index=True, return_inverse=True)
                cost, first, end = (x[back] for x in aligned(pattern[once], text_rows[once], e))
            for k in np.flatnonzero(cost <= e).tolist():
                a, b = max(0, int(left[k] + first[k])), min(len(chars), int(left[k] + end[k]))
                hits.append((index.ids[int(own[k, 0])], base + a, base + b, int(cost[k])))
    if not hits:
        return []
    merged: list[list[int]] = []
    for item_id, a, b, cost in sorted(hits):
        if merged and merged[-1][0] == item_id and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
            merged[-1][3] = min(merged[-1][3], cost)
        else:
            merged.append([item_id, a, b, cost])
    at = plain.source()
    return [(i, int(at[a]), int(at[b - 1]) + 1, cost) for i, a, b, cost in merged]


def find(docs: DataFrame, benchmark: DataFrame, group_chars: int = GROUP_CHARS, min_item: int = SHORTEST) -> DataFrame:
    """doc_id, text_hash, item_id, start, end, edits: a row per region of a document."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_chars))
    rows = docs.where(F.length("text") >= min(Q, max(min_item, 1))).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind.simpleString()}, text_hash bigint, item_id bigint, start bigint, end bigint, edits bigint"

    def scan(indexes: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, found = [], []
                for n, data in enumerate(batch.column(2)):
                    text = data.as_py().decode("utf-8", "replace")
                    for index in indexes:
                        got = regions(index.value, text)
                        owner += [n] * len(got)
                        found += got
                if found:
                    keys = batch.select([0, 1]).take(pa.array(owner, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, pa.int64()) for c in zip(*found))], [c.split()[0] for c in schema.split(", ")])

        return rows.mapInArrow(run, schema)

    def shared(g: int):  # a group's texts have a bounded size together
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        return spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own], min_item))

    out = None
    for first in range(0, groups, GROUPS_A_SCAN):
        part = scan([shared(g) for g in range(first, min(first + GROUPS_A_SCAN, groups))])
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no region of a benchmark item."""
    bad = stored(find(docs, benchmark).select("doc_id", "text_hash").distinct(), "contaminated")
    return keyed.without(docs, bad)
