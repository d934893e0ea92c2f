"""Byte-pair encoding by speculation and verification, and decoding.

For each distinct word: a greedy longest match proposes tokens; every adjacent pair of proposed
tokens is checked for compatibility, for all words of a batch at once; only words with a failing
pair are merged exactly. Merging a sequence token by token is right if and only if each adjacent
pair is: in the merge order of the two tokens' own letters no merge may cross their border before
the tokens at the border have been swallowed. The check compares the right edge of the first
token's merge tree with the left edge of the second's.

Handles tokenizer files of the form: NFC, white space to a blank, lower case; a split pattern of
contractions, letters, single digits and other characters; bytes; BPE with an end-of-word suffix;
special tokens matched in the raw text. Other forms raise ValueError.

Defined cases: a null or empty text has no ids and decodes to the empty text; null doc_ids pass
through; repeated rows are encoded alike; very long texts are handled in pieces cut at blanks, very
long words by a heap; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import ship_package

#: The split pattern and normalizer that the vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WHITE = r"[\t-\r \x85\xa0  -     　]+"

CACHE_WORDS = 200_000
PIECE_CHARS = 1 << 20
BATCH_BYTES = 4 << 20
GROUP_ROWS = 256
NEVER = np.int32(2**31 - 1)
SHORT = 64  # letters that are merged without a heap


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """An encoder and decoder made from the content of a tokenizer file."""

    def __init__(self, spec: str):
        self.spec = spec
        j = json.loads(spec)
        model = j["model"]
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in (j["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if model["type"] != "BPE" or kinds != NORMALIZERS or not splits or splits[0]["pattern"].get("Regex") != SPLIT or not model["end_of_word_suffix"] or j["decoder"]:
            raise ValueError("this kind of tokenizer file isn't supported")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        letter = {c: b for b, c in byte_letters().items()}
        n = max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]) + 1
        if n > 1 << 16:
            raise ValueError("more than 65536 ids")
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.texts = [b""] * n
        for token, i in [*vocab.items(), *self.special.items()]:
            self.texts[i] = token.encode()
        self.first = [vocab[c] for _, c in sorted((b, c) for c, b in letter.items())]
        self.last = [vocab[c + suffix] for _, c in sorted((b, c) for c, b in letter.items())]
        self.merges: dict[int, int] = {}  # by pair, its rank
        self.results: list[int] = []  # by rank, the token made
        right = np.full(n, -1, np.int32)
        left = np.full(n, -1, np.int32)
        made = np.full(n, -1, np.int32)
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, z = vocab[a], vocab[b], vocab[a + b]
            if made[z] >= 0 or max(made[a], made[b]) >= rank:
                raise ValueError("merges must make each token once, after its parts")
            self.merges[a << 16 | b] = rank
            self.results.append(z)
            left[z], right[z], made[z] = a, b, rank
        self.keys = np.array(sorted(self.merges), np.uint32)
        self.key_ranks = np.array([self.merges[int(k)] for k in self.keys], np.int32)
        self.right_edge = self._edge(right, made)
        self.left_edge = self._edge(left, made)
        self.inner: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            if not body or any(c not in letter for c in body):
                continue
            data = bytes(letter[c] for c in body)
            if self.merge(data, ends) == [i]:  # a token that its own letters don't merge to can't be right
                (self.ending if ends else self.inner)[data] = i
        self.longest = max(map(len, [*self.inner, *self.ending]))
        self.reach: dict[bytes, int] = {}  # by the next two bytes, the longest inner token
        for data in self.inner:
            self.reach[data[:2]] = max(self.reach.get(data[:2], 1), len(data))
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, bytes] = {w: self.packed[i] for w, i in self.special.items()}
        self.verdicts: dict[int, bool] = {}
        self.assigned: set[str] = set()  # characters known to Python's Unicode version, as met
        self._patterns = self._library = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {w: self.packed[i] for w, i in self.special.items()}, "verdicts": {}, "_patterns": None, "_library": None}

    @staticmethod
    def _edge(child: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token: itself and its chain of edge children, and the rank of the merge that swallows each."""
        at, swallowed = np.arange(len(child), dtype=np.int32), np.full(len(child), NEVER)
        chain, ranks = [], []
        while (at >= 0).any():
            chain.append(at)
            ranks.append(swallowed)
            safe = np.maximum(at, 0)
            swallowed = np.where(at >= 0, made[safe], -1).astype(np.int32)
            at = np.where(at >= 0, child[safe], -1).astype(np.int32)
        return np.array(chain), np.array(ranks)

    def merge(self, data: bytes, ends: bool = True) -> list[int]:
        """Exact merging of a word: always the lowest rank, leftmost first."""
        ids = [self.first[b] for b in data]
        if ends:
            ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n <= SHORT:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            k = after[i]
            if k < n and (rank := self.merges.get(ids[i] << 16 | ids[k])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[k]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], ids[k] = self.results[rank], -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for few letters, without a heap."""
        rank_of, results, none = self.merges.get, self.results, int(NEVER)
        ranks = [rank_of(a << 16 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            ids[i : i + 2] = [results[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 16 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 16 | ids[i + 1], none)
        return ids

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(data)
        inner, ending, longest, reach = self.inner, self.ending, self.longest, self.reach
        while at < n:
            if n - at <= longest and (i := ending.get(data[at:])) is not None:
                out.append(i)
                break
            for stop in range(min(n - 1, at + reach.get(data[at : at + 2], 1)), at, -1):
                if (i := inner.get(data[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
            else:  # one byte is left and no token ends with it
                out.append(self.last[data[at]])
                break
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Per pair (first token << 16 | second): whether merging keeps the two apart."""
        good = np.ones(len(pairs), bool)
        a, b = pairs >> 16, pairs & 0xFFFF
        for x, x_gone in zip(*self.right_edge):
            here = np.flatnonzero(good & (x[a] >= 0))
            if not len(here):
                break
            for y, y_gone in zip(*self.left_edge):
                own = here[(y[b[here]] >= 0) & good[here]]
                if not len(own):
                    break
                key = (x[a[own]].astype(np.uint32) << 16) | y[b[own]].astype(np.uint32)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.key_ranks[at], NEVER)
                good[own[(rank < x_gone[a[own]]) & (rank <= y_gone[b[own]]) & (rank < NEVER)]] = False
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words into the cache."""
        datas = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self.propose(d) for d in datas]
        sizes = np.array([len(t) for t in tokens])
        flat = np.array([i for t in tokens for i in t], np.int64)
        joints = np.ones(max(len(flat) - 1, 0), bool)
        joints[np.cumsum(sizes)[:-1] - 1] = False
        places = np.flatnonzero(joints)
        pairs = flat[places] << 16 | flat[places + 1]
        distinct, back = np.unique(pairs, return_inverse=True)
        known = self.verdicts
        new = np.array([p for p in distinct.tolist() if p not in known], np.int64)
        known.update(zip(new.tolist(), self.compatible(new).tolist()))
        bad = ~np.array([known[p] for p in distinct.tolist()], bool)[back] if len(distinct) else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(words)), sizes)[places]
        for i in set(owner[bad].tolist()):
            tokens[i] = self.merge(datas[i])
        packed = self.packed
        for w, t in zip(words, tokens):
            self.cache[w] = b"".join([packed[i] for i in t])

    def patterns(self) -> tuple:
        """Split, white space, special tokens."""
        if self._patterns is None:
            import re

            import regex

            special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
            split = SPLIT.replace(r"\s", " ")
            self._patterns = regex.compile(split), re.compile(WHITE), special
        return self._patterns

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token stands for itself."""
        split, white, special = self.patterns()
        if not text.isascii() and not self.assigned.issuperset(text):
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                return self._library_words(text)
            self.assigned |= new
        out: list[str] = []
        at = 0
        for m in special.finditer(text) if special else ():
            out += self._plain(text[at : m.start()], split, white)
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:] if at else text, split, white)

    def _library_words(self, text: str) -> list[str]:
        """Words by the tokenizers library, whose Unicode version may know more characters."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_str(self.spec)
        library = self._library
        back = {c: b for b, c in byte_letters().items()}
        out: list[str] = []
        special, at = self.patterns()[2], 0

        def plain(part: str) -> None:
            for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                out.append(bytes(back[c] for c in word).decode("utf-8"))

        for m in special.finditer(text) if special else ():
            plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        plain(text[at:])
        return out

    @staticmethod
    def _plain(text: str, split, white) -> list[str]:
        # Lower case goes letter by letter: a final sigma gets no special form.
        text = white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return split.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            if len(self.cache) > CACHE_WORDS:
                self.cache = {w: self.packed[i] for w, i in self.special.items()}
            if len(self.verdicts) > 4 * CACHE_WORDS:
                self.verdicts = {}
            cache = self.cache
            new = {w for _, words in held for w in words if w not in cache}
            if new:
                self.learn(list(new))
            for i, words in held:
                out[i].append(b"".join([cache[w] for w in words]))
            held.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text):
                held.append((i, self.words(piece)))
                size += len(piece)
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: tokens joined by blanks, in UTF-8."""
        return decoded(ids, self.texts)


def decoded(ids: bytes, texts: list[bytes]) -> bytes:
    return b" ".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()])


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut at blanks (a longer word stays whole)."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size_of: int) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded bytes; ``size_of`` is the place of the column that is measured."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[size_of] or b"") + 64
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of each row.

    ``vocabulary``: path of the tokenizer file, read on the driver; the encoder made from it has a
    fixed size and is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(WordBpe(open(vocabulary, encoding="utf-8").read()))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP_ROWS):
                    part = batch.slice(at, GROUP_ROWS)
                    texts = [(x or b"").decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                    for key, ids in zip(part.column(0).to_pylist(), model.encode_all(texts)):
                        yield key, len(ids) // 4, ids

        from pyspark.sql.pandas.types import to_arrow_type

        yield from batched(rows(), [to_arrow_type(kind), pa.int64(), pa.binary()], ["doc_id", "n_tokens", "ids"], 2)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds the column decoded (text) to doc_id, n_tokens and ids."""
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(WordBpe(open(vocabulary, encoding="utf-8").read()).texts)
    kind = encoded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, n, ids in zip(*(batch.column(i) for i in range(3))):
                    data = ids.as_py()
                    yield key.as_py(), n.as_py(), data, decoded(data or b"", texts)

        from pyspark.sql.pandas.types import to_arrow_type

        yield from batched(rows(), [to_arrow_type(kind), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "n_tokens", "ids", "decoded"], 2)

    out = encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumn("decoded", F.col("decoded").cast("string"))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``decode(encode(docs))``, in one pass: a task takes one Python worker, not two."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(WordBpe(open(vocabulary, encoding="utf-8").read()))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP_ROWS):
                    part = batch.slice(at, GROUP_ROWS)
                    texts = [(x or b"").decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                    for key, ids in zip(part.column(0).to_pylist(), model.encode_all(texts)):
                        yield key, len(ids) // 4, ids, model.decode(ids)

        from pyspark.sql.pandas.types import to_arrow_type

        yield from batched(rows(), [to_arrow_type(kind), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "n_tokens", "ids", "decoded"], 2)

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumn("decoded", F.col("decoded").cast("string"))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)
