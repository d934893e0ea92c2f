"""Token ids in binary shards, with a minimal perfect hash per shard for keyed access.

Documents are range-partitioned by doc_id and written in ascending order. A shard is a pair of
files: ``.ids``, the raw ids back to back (unsigned 16 bits if the vocabulary allows, else 32,
little-endian), and ``.idx``: the number of documents, doc_ids and id counts in order, then a
perfect hash of the distinct doc_ids with, per slot, a 32-bit fingerprint, the offset of the
document's first id, its count and the number of documents under that id. ``Store.get`` finds the
shard by range, the slot by the hash, rejects strangers by the fingerprint, and reads the ids.

Defined cases: a null or empty text is the end id alone; repeated doc_ids are kept next to each
other, ordered by the hash of their text, and keyed access gives all of them; null doc_ids come
first and have no key; an empty table gives a manifest without shards; a long document makes a
long shard, since documents aren't cut; extra columns are ignored. Invalid UTF-8 counts as the
replacement character.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import files
from wordloom.llm.bpe import NORMALIZERS, SPLIT
from wordloom.llm.perfect_hash import PerfectHash
from wordloom.session import new_folder, ship_package

SHARD_BYTES = 64 << 20
SHARD_DOCS = 1 << 20
CACHE_WORDS = 500_000  # in each of two generations
JOINED_PIECES = 2000
GROUP_BYTES = 8 << 20
GROUP_ROWS = 4096
NO_KEY = -(1 << 63)
SLOT = np.dtype([("mark", "<u4"), ("offset", "<u8"), ("count", "<u4"), ("copies", "<u4")])

#: The split pattern on ASCII bytes in lower case.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: ASCII signs but the apostrophe, which begins contractions.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class LibraryEncoder:
    """Ids by the tokenizers library.

    A file of the form that ``bpe`` describes (NFC, white space, lower case; pieces by a split
    pattern; each piece merged on its own, with a mark at its end) lets texts be cut at ASCII white
    space: each distinct word is cut into pieces by the file's own pattern, and each distinct piece
    is encoded once, many of them in one call, told apart by the end marks. Words whose pieces
    depend on Unicode's tables (combining marks, special tokens, letters that change when
    normalised) are encoded whole. Texts for files of any other form are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.kind = "<u4" if self.library.get_vocab_size() > 1 << 16 else "<u2"
        self.cache: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}
        self.cuts = self._cuts_at_white_space(json.loads(spec))
        if self.cuts:
            from tokenizers import pre_tokenizers

            model = json.loads(spec)["model"]
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
            # pieces are normalised and split already
            bare = json.loads(spec) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
            self.pieces = Tokenizer.from_str(json.dumps(bare))
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @staticmethod
    def _cuts_at_white_space(j: dict) -> bool:
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        steps = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = [p["pattern"].get("Regex") for p in steps if p["type"] == "Split"]
        stripped = any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in j["added_tokens"])
        return j["model"]["type"] == "BPE" and bool(j["model"].get("end_of_word_suffix")) and kinds == NORMALIZERS and split == [SPLIT] and len(steps) == 2 and not stripped

    @staticmethod
    def pieces_of(word: bytes) -> list[bytes] | None:
        """The pieces of a word, normalised; None for words that only the library can cut."""
        if word.isascii():
            return None if b"<|" in word else ASCII_PIECES.findall(word.lower())
        body = word.strip(SIGNS)
        at = word.find(body)
        try:
            letters = body.decode()
        except UnicodeDecodeError:
            return None
        if not letters.isalpha():
            return None
        letters = unicodedata.normalize("NFC", letters).replace("Σ", "σ").lower()
        if not letters.isalpha() or unicodedata.normalize("NFC", letters) != letters:
            return None
        before, after = word[:at], word[at + len(body) :]
        return None if b"<|" in word else [x for x in (before, letters.encode(), after) if x]

    def learn(self, words: list[bytes]) -> None:
        """Encode words into the cache."""
        cache, aged = self.cache, self.aged
        cut = {w: self.pieces_of(w) for w in words}
        whole = [w for w, p in cut.items() if p is None]
        new = []
        for x in {x for p in cut.values() if p for x in p}:
            if x not in cache:
                if x in aged:
                    cache[x] = aged[x]
                else:
                    new.append(x)
        groups = [new[a : a + JOINED_PIECES] for a in range(0, len(new), JOINED_PIECES)]
        for g, e in zip(groups, self.pieces.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(stops) != len(g):
                raise ValueError("a piece isn't one word of the tokenizer")
            data = ids.tobytes()
            cache.update(zip(g, [data[a:b] for a, b in zip([0, *stops], stops)]))
        for w, e in zip(whole, self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)):
            cache[w] = np.array(e.ids, self.kind).tobytes()
        for w, p in cut.items():
            if p is not None and (len(p) != 1 or p[0] != w):
                cache[w] = b"".join([cache[x] for x in p])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as bytes of the store's width."""
        if not self.cuts:
            found = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() for e in found]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size < GROUP_BYTES or stop == at):
                size += len(texts[stop])
                stop += 1
            out += self._encode_group(texts[at:stop])
            at = stop
        return out

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        # ASCII letters may be lowered first, but for special tokens and combining marks (their
        # lead bytes in UTF-8), which compose with some lower-case letters only
        texts = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_pylist()
        if len(self.cache) > CACHE_WORDS:  # words met since the last time come back from the aged ones
            self.aged, self.cache = self.cache, {}
        cache, aged = self.cache, self.aged
        if new := [w for w in words if w and w not in cache]:
            cache.update((w, aged[w]) for w in new if w in aged)
            if new := [w for w in new if w not in cache]:
                self.learn(new)
        known = [cache[w] if w else b"" for w in words]
        width = np.dtype(self.kind).itemsize
        # the ids of word after word: from the place of each word's ids among those of the distinct words
        size = np.fromiter(map(len, known), np.int64, len(known)) // width
        first = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        ends = np.cumsum(n)
        place = np.repeat(first[index] - (ends - n), n)
        place += np.arange(len(place))
        data = np.frombuffer(b"".join(known), self.kind)[place].tobytes()
        bounds = (np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * width).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


_encoders: dict[bytes, LibraryEncoder] = {}


def _encoder(spec: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _encoders:
        _encoders[key] = LibraryEncoder(spec)
    return _encoders[key]


class _Shard:
    def __init__(self, folder: str, stem: str, width: int):
        self.ids = files.Pending(folder, stem, ".ids")
        self.folder, self.stem, self.width = folder, stem, width
        self.keys: list[int] = []
        self.counts: list[int] = []
        self.first: int | None = None

    def add(self, key: int | None, data: bytes) -> None:
        self.ids.write(data)
        self.keys.append(NO_KEY if key is None else key)
        self.counts.append(len(data) // self.width)

    def commit(self) -> dict:
        name = self.ids.commit()
        index = files.Pending(self.folder, self.stem, ".idx")
        index.write(index_bytes(np.array(self.keys, np.int64), np.array(self.counts, np.int64)))
        real = [k for k in self.keys if k != NO_KEY]
        return {
            "names": [name, index.commit()],
            "n_docs": len(self.keys),
            "n_ids": int(sum(self.counts)),
            "first": real[0] if real else None,
            "last": real[-1] if real else None,
        }


def index_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    offsets = np.cumsum(counts) - counts
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    real = distinct != NO_KEY
    distinct, first, copies = distinct[real], first[real], copies[real]
    table = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    at = table.index(distinct)
    slots["mark"][at] = PerfectHash.fingerprint(distinct)
    slots["offset"][at] = offsets[first]
    slots["count"][at] = counts[first]
    slots["copies"][at] = copies
    return struct.pack("<Q", len(keys)) + keys.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + table.dump() + slots.tobytes()


class ShardIndex:
    def __init__(self, data: bytes):
        (n,) = struct.unpack_from("<Q", data)
        self.keys = np.frombuffer(data, "<i8", n, 8)
        self.counts = np.frombuffer(data, "<u4", n, 8 + 8 * n).astype(np.int64)
        at = 8 + 12 * n
        self.hash, used = PerfectHash.load(data[at:])
        self.slots = np.frombuffer(data[at + used :], SLOT)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for strangers (but for one in four billion of them)."""
        at = self.hash.index(keys)
        known = at >= 0
        known[known] = self.slots["mark"][at[known]] == PerfectHash.fingerprint(keys[known])
        return np.where(known, at, -1)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode and write all documents; returns the manifest (one small entry per shard)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    width = np.dtype(_encoder(shared.value).kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(shared.value)
        end = int(end_id).to_bytes(width, "little")
        part, seq, done, shard = None, 0, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                some = batch.slice(at, GROUP_ROWS)
                for key, own, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), model.encode_all([x or b"" for x in some.column(1).to_pylist()])):
                    if own != part:
                        if shard is not None:
                            done.append((part, seq, shard.commit()))
                        part, seq, shard = own, 0, None
                    if shard is None:
                        shard = _Shard(folder, f"shard-{part:06d}-{seq:05d}", width)
                    shard.add(key, ids + end)
                    if shard.ids.size >= shard_bytes or len(shard.keys) >= SHARD_DOCS:
                        done.append((part, seq, shard.commit()))
                        seq, shard = seq + 1, None
        if shard is not None:
            done.append((part, seq, shard.commit()))
        rows = [[d[0] for d in done], [d[1] for d in done], *([d[2][k] for d in done] for k in ("names", "n_docs", "n_ids", "first", "last"))]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["part", "seq", "names", "n_docs", "n_ids", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # The text's hash orders repeated ids, and lets a much repeated id be dealt to several shards.
    ordered = files.dealt(rows, F.col("doc_id"), F.xxhash64("text"), F.octet_length("text"))
    shards = ordered.mapInArrow(run, "part int, seq int, names array<string>, n_docs bigint, n_ids bigint, first bigint, last bigint").collect()
    start, entries = 0, []
    for s in sorted(shards, key=lambda s: (s.part, s.seq)):
        entries.append({"names": list(s.names), "n_docs": s.n_docs, "n_ids": s.n_ids, "first": s.first, "last": s.last, "start": start})
        start += s.n_ids
    manifest = {"width": width, "end_id": end_id, "files": entries}
    files.write_manifest(folder, manifest)
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32-bit little-endian) of every document, a
    task per shard. Every document is looked up by its key; repeated and null ids follow the order."""
    ship_package(spark)
    manifest = files.read_manifest(folder)
    kind = f"<u{manifest['width']}"
    entries = [(*e["names"], e["start"]) for e in manifest["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_name, index_name, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                index = ShardIndex(files.read_bytes(folder, index_name))
                offsets = np.cumsum(index.counts) - index.counts
                keyed = index.keys != NO_KEY
                slot = index.find(index.keys[keyed])
                if (slot < 0).any():
                    raise ValueError(f"{index_name}: a document isn't found under its key")
                single = index.slots["copies"][slot] == 1
                at = np.flatnonzero(keyed)[single]
                offsets[at] = index.slots["offset"][slot[single]]
                counts = index.counts.copy()
                counts[at] = index.slots["count"][slot[single]]
                data = np.frombuffer(files.read_bytes(folder, ids_name), kind)
                for a in range(0, len(counts), 256):
                    some = slice(a, a + 256)
                    ids = [data[o : o + n].astype("<u4").tobytes() for o, n in zip(offsets[some].tolist(), counts[some].tolist())]
                    keys = [None if k == NO_KEY else k for k in index.keys[some].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + offsets[some]), pa.array(counts[some]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    shards = spark.createDataFrame(entries, "ids_name string, index_name string, start bigint").repartition(max(1, len(entries)))
    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


class Store:
    """Keyed access from one process."""

    def __init__(self, folder: str):
        self.folder, self.manifest = folder, files.read_manifest(folder)
        self.shards = [e for e in self.manifest["files"] if e["first"] is not None]
        self.lasts = [e["last"] for e in self.shards]
        self.indexes: dict[str, ShardIndex] = {}

    def get(self, doc_id: int) -> list[list[int]]:
        """The ids of every document stored under doc_id. The shards with the id are found by
        bisection, since they are in ascending order."""
        out = []
        width = self.manifest["width"]
        for at in range(bisect.bisect_left(self.lasts, doc_id), len(self.shards)):
            e = self.shards[at]
            if e["first"] > doc_id:
                break
            ids_name, index_name = e["names"]
            if index_name not in self.indexes:
                self.indexes[index_name] = ShardIndex(files.read_bytes(self.folder, index_name))
            index = self.indexes[index_name]
            (slot,) = index.find(np.array([doc_id]))
            if slot < 0:
                continue
            s = index.slots[slot]
            counts = [int(s["count"])]
            if s["copies"] > 1:
                counts = index.counts[index.keys == doc_id].tolist()
            system, path = files.resolve(self.folder)
            with system.open_input_file(f"{path}/{ids_name}") as source:
                source.seek(int(s["offset"]) * width)
                for n in counts:
                    out.append(np.frombuffer(source.read(n * width), f"<u{width}").tolist())
        return out


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write to a new folder in the shared one and read back."""
    folder = new_folder(docs.sparkSession, "token-store")
    write(docs, vocabulary, folder, end_id)
    return read(docs.sparkSession, folder)
