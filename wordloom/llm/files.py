"""Files that tasks write and read beside Spark's own formats, by URI (local, object store, HDFS).

A task writes under a temporary name of its own attempt and renames the file to its final name,
which depends on its place alone, when it is whole. A repeated task writes the same content under
the same name; only names that came back to the driver enter the manifest, which is written last,
to a temporary name, and renamed. What lost attempts leave stays in the temporary folder, which is
removed with the commit.
"""

from __future__ import annotations

import json
import math
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Pending:
    """A file being written under a temporary name."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.system, path = resolve(folder)
        self.name = f"{stem}{suffix}"
        self.final = f"{path}/{self.name}"
        self.system.create_dir(f"{path}/_temporary", recursive=True)
        self.path = f"{path}/_temporary/{stem}-{uuid.uuid4().hex}{suffix}"
        self.out = self.system.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.system.move(self.path, self.final)
        return self.name

    def abandon(self) -> None:
        self.out.close()
        self.system.delete_file(self.path)


#: Bytes of a range in small and in large tables, and the ranges up to which a table is small.
SMALL_RANGE, LARGE_RANGE, MANY_RANGES = 4 << 20, 2 << 30, 200
#: Rows that place the bounds of a range.
SAMPLED = 64


def parts_for(n_bytes: int) -> int:
    """Ranges that so many bytes are dealt to, by their number alone, so that the same table gives the
    same files: 4 MB each up to 200 ranges, in large tables 2 GB each, which the writers' own bound cuts into files."""
    return max(1, min(-(-n_bytes // SMALL_RANGE), max(MANY_RANGES, -(-n_bytes // LARGE_RANGE))))


def dealt(rows: DataFrame, key: Column, tie: Column, size: Column, source: DataFrame | None = None) -> DataFrame:
    """``rows`` with part, the number of a range of (key, tie), both longs, null first: ranges of about
    equal bytes, sorted by part, key and tie within partitions. Bounds come from the rows whose hash says
    so, about SAMPLED a range, whatever the session ran before: the same table gives the same ranges.
    A partition may hold several ranges, but no range lies in two. ``source``: the same keys and sizes from
    a plan that costs less."""
    mark = lambda df: df.withColumn("_key", F.coalesce(key, F.lit(-(1 << 63)))).withColumn("_tie", tie)
    marked = mark(rows)
    sizes = mark(source if source is not None else rows).select("_key", "_tie", F.coalesce(size, F.lit(0)).cast("bigint").alias("n"))
    count, total = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    parts = parts_for(total or 0)
    bounds: list[tuple[int, int]] = []
    if parts > 1:
        every = max(1, count // (parts * SAMPLED))
        found = sizes.where(F.pmod(F.xxhash64("_key", "_tie"), F.lit(every)) == 0).collect()  # some SAMPLED rows a range
        sample = sorted((r._key, r._tie, r.n) for r in found)
        whole, n = sum(x[2] for x in sample), 0
        for k, t, own in sample:
            if n >= whole * (len(bounds) + 1) / parts and (not bounds or (k, t) > bounds[-1]):
                bounds.append((k, t))
            n += own
    # the bounds as one constant of two levels, so that a row looks at few of them
    step = max(1, math.isqrt(len(bounds)))
    chunks = [[{"k": k, "t": t} for k, t in bounds[a : a + step]] for a in range(0, len(bounds), step)]
    kind = "array<array<struct<k:bigint,t:bigint>>>"
    table = F.from_json(F.lit(json.dumps(chunks)), kind)
    reached = lambda b: (b["k"] < F.col("_key")) | ((b["k"] == F.col("_key")) & (b["t"] <= F.col("_tie")))
    chunk = F.size(F.filter(table, lambda c: reached(c[0])))
    inside = F.when(chunk == 0, 0).otherwise((chunk - 1) * step + F.size(F.filter(F.element_at(table, F.greatest(chunk, F.lit(1))), reached)))
    numbered = marked.withColumn("part", inside.cast("int") if bounds else F.lit(0))
    order = ["part", "_key", "_tie"]
    return numbered.repartitionByRange(parts, "part").sortWithinPartitions(*order).drop("_key", "_tie")


def write_bytes(folder: str, name: str, data: bytes) -> None:
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}.tmp", compression=None) as out:
        out.write(data)
    system.move(f"{path}/{name}.tmp", f"{path}/{name}")


def read_bytes(folder: str, name: str) -> bytes:
    system, path = resolve(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        return source.readall()


def write_manifest(folder: str, content: dict) -> None:
    """Commits: from here on the files named are the result; what lost attempts left goes."""
    write_bytes(folder, "manifest.json", json.dumps(content, sort_keys=True).encode())
    system, path = resolve(folder)
    if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{path}/_temporary")


def read_manifest(folder: str) -> dict:
    return json.loads(read_bytes(folder, "manifest.json"))
