"""Whole runs from input files to result files."""

import random

from wordloom.cli import options
from wordloom.plans.train import segment

WORDS = ["abc", "de", "fgh", "cab"]


def sentences(n, seed=1):
    rng = random.Random(seed)
    return [rng.choices(WORDS, k=rng.randint(2, 4)) for _ in range(n)]


def reference(rows):
    return "".join(" </unk> ".join(" ".join(w) for w in s) + " </unk> </s>\n" for s in rows)


def lines_of(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_text_run_with_order_switch(spark, tmp_path):
    rows = sentences(16)
    (tmp_path / "in.txt").write_text("".join(" ".join("".join(s)) + "\n" for s in rows))
    (tmp_path / "ref.txt").write_text(reference(rows))
    (tmp_path / "init.txt").write_text(reference(sentences(12, 2)))
    args = f"-KnownN 1 -UnkN 2 -NumIter 2 -Batches 2 -SwitchIter 1 2 2 0 1 -UseViterby 2 -DeactivateCharacterModel 2 -InitLM {tmp_path}/init.txt -InitLmNumIterations 1 -ReferenceTranscription {tmp_path}/ref.txt -CalculateWER -CalculatePER -OutputEditOperations -OutputDirectoryBasename {tmp_path}/out -OutputFilesBasename r_ {tmp_path}/in.txt"
    run = segment(spark, options(args.split()))
    found = {(i, name): v for i, name, v in run.metrics}
    assert found[2, "wer_error_rate"] < 0.2 and found[2, "lexicon_recall"] == 1.0 and found[2, "per_error_rate"] == 0.0
    assert found[2, "perplexity"] > 1 and found[0, "perplexity"] > 1
    assert found[2, "word_1_n_contexts"] > 1  # a bigram model after the switch
    folder = tmp_path / "out" / "KnownN_1_UnkN_2"
    written = lines_of(folder / "r_Sentences_Iter_2")
    assert len(written) == 16 and all(x.startswith("</s> ") and x.endswith(" </s>") for x in written)
    assert len(lines_of(folder / "r_EditOperations_Iter_2")) == 16


def slf(utt, words, rng):
    """Each symbol has a rival that is a little likelier than it, wrong symbols that words correct."""
    letters = "".join(words)
    lines = ["VERSION=1.0", f"UTTERANCE={utt}", f"N={len(letters) + 1} L={2 * len(letters)}"] + [f"I={i} t={i / 10:.2f}" for i in range(len(letters) + 1)]
    for i, c in enumerate(letters):
        other = rng.choice([x for x in "abcdefgh" if x != c])
        better = rng.random() < 0.15
        lines += [f"J={2 * i} S={i} E={i + 1} W={c} a={-2.0 if better else -1.0} l=0", f"J={2 * i + 1} S={i} E={i + 1} W={other} a={-1.8 if better else -6.0} l=0"]
    return "\n".join(lines) + "\n"


def test_lattice_run_corrects_symbols(spark, tmp_path):
    """The words learnt from a transcription choose other paths than the acoustic scores alone."""
    rng, rows = random.Random(4), sentences(8, 3)
    names = []
    for i, s in enumerate(rows):
        (tmp_path / f"u{i}.lat").write_text(slf(f"u{i}", s, rng))
        names.append(str(tmp_path / f"u{i}.lat"))
    (tmp_path / "list").write_text("\n".join(names) + "\n")
    (tmp_path / "ref.txt").write_text(reference(rows))
    (tmp_path / "init.txt").write_text(reference(sentences(40, 5)))
    base = f"-KnownN 1 -UnkN 2 -NumIter 1 -Batches 2 -UseViterby 1 -LatticeFileType htk -ReadNodeTimes -InitLM {tmp_path}/init.txt -ReferenceTranscription {tmp_path}/ref.txt -CalculateWER -CalculatePER -InputFilesList {tmp_path}/list"
    run = segment(spark, options(f"{base} -CalculateLPER -PruningStep 8 4 4 -ExportLattices {tmp_path}/export -OutputDirectoryBasename {tmp_path}/out -OutputFilesBasename r_".split()))
    found = {(i, name): v for i, name, v in run.metrics}
    assert found[0, "lattice_per_8.0"] == 0.0
    assert found[1, "per_error_rate"] < 0.05 and found[1, "wer_error_rate"] < 0.15
    timed = lines_of(tmp_path / "out" / "KnownN_1_UnkN_2" / "r_TimedSentences_Iter_1")
    assert len(timed) >= sum(map(len, rows)) * 0.9 and all(len(x.split(" ")) == 4 for x in timed)
    exported = tmp_path / "export" / "lattices_inf"
    assert {p.name for p in exported.iterdir()} >= {"arcs", "fst", "symbols", "input_arcs"}
    assert lines_of(exported / "symbols")[0] == "<eps>\t0"
    # with an additional character model: the best path first, then its words; rescored lattices
    args = base.replace("-ReadNodeTimes ", "") + f" -AddCharN 2 -WriteRescoredLattices {tmp_path}/rescored"
    again = {(i, name): v for i, name, v in segment(spark, options(args.split())).metrics}
    assert again[1, "wer_error_rate"] < 1.0
    assert spark.read.parquet(f"file://{tmp_path}/rescored/rescored").where("src_ctx <> '</unk>'").count() > 0
