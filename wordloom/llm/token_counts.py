"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest vocabulary piece that begins it, then again on what is left
(pieces for the rest of a word may be another set, as with a continuation mark). The automaton is a
trie of the initial pieces with a second root for continuation pieces. Each node has a failure link,
the node reached after popping the pieces that the greedy cut would take from the node's string
once no longer match is possible, and the *number* of those pieces, both computed ahead. Running a
word through it visits each letter once and adds the counts; pieces are never built.

Words are runs of bytes other than the space and U+0009 to U+000D, a leading space counting as part
of the word where the vocabulary marks word starts by one. Defined cases: a null or empty text has
no tokens; a word that can't be cut counts as one unknown token; null doc_ids pass through;
repeated rows are counted alike; long words cost time in proportion to their length; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bpe import byte_letters
from wordloom.session import ship_package

CACHE_WORDS = 500_000
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
FAIL = -1


class LongestMatch:
    """Greedy piece counts for a vocabulary of byte strings."""

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]  # nodes 0 and 1: roots of initial and continuation pieces
        ends: set[int] = set()
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                node = root
                for b in piece:
                    nxt = self.step[node].get(b)
                    if nxt is None:
                        nxt = len(self.step)
                        self.step.append({})
                        self.step[node][b] = nxt
                    node = nxt
                if node > 1:
                    ends.add(node)
        n = len(self.step)
        #: where a node's string leads once its longest pieces are popped, and how many those are
        self.link, self.popped = [FAIL] * n, [0] * n
        queue = deque([(0, c, v) for c, v in self.step[0].items()] + [(1, c, v) for c, v in self.step[1].items()])
        while queue:
            parent, byte, node = queue.popleft()
            if node in ends:
                self.link[node], self.popped[node] = 1, 1
            else:
                # pop what the parent's string would pop, then read the byte from there
                at, count = self.link[parent], self.popped[parent]
                while at != FAIL and byte not in self.step[at]:
                    at, count = self.link[at], count + self.popped[at]
                if at != FAIL:
                    self.link[node], self.popped[node] = self.step[at][byte], count
            queue.extend((node, c, v) for c, v in self.step[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of the greedy cut, or -1 if there is none. An empty word has none to cut: 0."""
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for b in word:
            nxt = step[node].get(b)
            while nxt is None:
                total += popped[node]
                node = link[node]
                if node == FAIL:
                    return -1
                nxt = step[node].get(b)
            node = nxt
        while node > 1:
            total += popped[node]
            node = link[node]
            if node == FAIL:
                return -1
        return total


def byte_pieces(spec: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and continuation pieces of a byte-level vocabulary: initial ones begin with a space."""
    j = json.loads(spec)
    back = {c: b for b, c in byte_letters().items()}
    special = {a["content"] for a in j["added_tokens"]}
    pieces = [bytes(back[c] for c in t) for t in j["model"]["vocab"] if t not in special and all(c in back for c in t)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def count_text(automaton: LongestMatch, text: bytes, cache: dict[bytes, int], lead: bytes = b" ") -> int:
    total = 0
    for word in SPACE.split(text):
        if not word:
            continue
        n = cache.get(word)
        if n is None:
            n = automaton.count(lead + word)
            cache[word] = n = 1 if n < 0 else n
        total += n
    return total


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and n_tokens of each row, with the pieces of the byte-level tokenizer file
    ``vocabulary`` (read on the driver; the automaton's size is fixed by it)."""
    spark = docs.sparkSession
    ship_package(spark)
    pieces = byte_pieces(open(vocabulary, encoding="utf-8").read())
    shared = spark.sparkContext.broadcast((digest(pieces), pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = _automaton(*shared.value)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for n, text in enumerate(batch.column(1)):
                if (data := text.as_py()) is not None:
                    counts[n] = count_text(automaton, data, cache)
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def digest(pieces: tuple[list[bytes], list[bytes]]) -> bytes:
    """Tells vocabularies apart: the lengths and all bytes of all pieces."""
    out = hashlib.sha256()
    for own in pieces:
        out.update(len(own).to_bytes(8, "little"))
        for p in own:
            out.update(len(p).to_bytes(4, "little") + p)
    return out.digest()


_made: dict[bytes, tuple[LongestMatch, dict[bytes, int]]] = {}


def _automaton(key: bytes, pieces: tuple[list[bytes], list[bytes]]) -> tuple[LongestMatch, dict[bytes, int]]:
    """One automaton for each worker process and vocabulary."""
    if key not in _made:
        _made[key] = (LongestMatch(*pieces), {})
    return _made[key]
