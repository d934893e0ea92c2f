"""Decontamination of repetitive items and texts; files that depend on the table alone."""

import hashlib
import os
import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from wordloom.llm import decontaminate, files, warc

SF = "/root/testdata/sf0.1"


def every_window(index_text, text):
    """Places of the text that lie in a part within the budget of some window, by a plain alignment
    of every window with the whole text; and those in verbatim excerpts."""
    item, plain = decontaminate.codes(decontaminate.normalise(index_text)), decontaminate.codes(decontaminate.normalise(text))
    width = min(decontaminate.WINDOW, len(item))
    edits = decontaminate.budget(width)
    for s in range(len(item) - width + 1):
        pattern = item[s : s + width]
        row = np.zeros(len(plain) + 1, np.int64)  # a match may start anywhere
        for i, c in enumerate(pattern):
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (plain != c))
            steps = np.arange(len(new))
            row = np.minimum.accumulate(new - steps) + steps
        if (row <= edits).any():
            return True
    return any(index_text[a : a + decontaminate.EXCERPT] in text for a in range(len(index_text) - decontaminate.EXCERPT + 1))


@pytest.mark.parametrize("period", ["0 1 ", "ab", "na na hey ", "12 13 14 15 16 17 18 19 20 21 22 "])
def test_repetitive_items_are_found_as_by_brute_force(period):
    rng = random.Random(period)
    item = decontaminate.normalise(period * 40)[:170]
    index = decontaminate.Index([(1, item)])
    for damage in (0, 3, 9, 30):
        core = list(decontaminate.normalise(period * 30)[:130])
        for _ in range(damage):
            core[rng.randrange(len(core))] = rng.choice("xyz")
        text = "some words before " + "".join(core) + " and after"
        assert bool(decontaminate.regions(index, text)) == every_window(item, text)


def test_repetitive_texts_take_bounded_time_and_memory():
    index = decontaminate.Index([(1, ("0 1 " * 200)[:600]), (2, "a" * 500)])
    began = time.process_time()
    assert decontaminate.regions(index, "0 1 " * 10_000) == [(1, 0, 39_999, 0)]
    assert decontaminate.regions(index, "a" * 30_000) == [(2, 0, 30_000, 0)]
    assert time.process_time() - began < 60
    tracemalloc.start()  # slows everything down, so a shorter text
    assert decontaminate.regions(index, "0 1 " * 2_000) == [(1, 0, 7_999, 0)]
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
def test_files_depend_on_the_table_alone(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = []
    for n, rows in enumerate((pages, pages.repartition(3))):
        folder = tmp_path / str(n)
        warc.write(rows, f"file://{folder}")
        seen.append({f: hashlib.md5((folder / f).read_bytes()).hexdigest() for f in sorted(os.listdir(folder))})
        rows.groupBy("url").count().collect()
    assert seen[0] == seen[1] and len(seen[0]) >= 3


def test_ranges_are_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(files, "SMALL_RANGE", 300)
    from pyspark.sql import functions as F

    ids = [None] * 20 + [7] * 60 + list(range(-30, 30)) * 2
    rows = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string")
    out = files.dealt(rows, F.col("doc_id"), F.xxhash64("text"), F.lit(10))
    got = [(r.part, r.doc_id, r.text) for r in out.collect()]
    assert sorted(t for _, _, t in got) == sorted(f"t{i}" for i in range(len(ids)))
    by_part = {}
    for part, d, _ in got:
        by_part.setdefault(part, []).append(-(10**9) if d is None else d)
    assert len(by_part) > 3 and sum(7 in v for v in by_part.values()) > 1  # a much repeated id in several ranges
    parts = sorted(by_part)
    assert all(v == sorted(v) for v in by_part.values())
    assert all(by_part[a][-1] <= by_part[b][0] for a, b in zip(parts, parts[1:]))
