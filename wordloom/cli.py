"""Command line: options by name, input files last."""

from __future__ import annotations

import argparse
import sys

from wordloom.config import Options, PruningSweep, SwitchOrders
from wordloom.sources.text import parse_prune


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom", description="Unsupervised word segmentation of text or lattices", allow_abbrev=False)
    add = p.add_argument
    add("-KnownN", dest="known_n", type=int, default=1, help="word order")
    add("-UnkN", dest="unknown_n", type=int, default=1, help="character order")
    add("-AddCharN", dest="add_char_n", type=int, default=0, help="order of the additional character model")
    add("-NoThreads", dest="threads", type=int, default=1, help="kept for its users; partitions decide")
    add("-PruneFactor", dest="prune_factor", type=parse_prune, default=float("inf"))
    add("-InputFilesList", dest="input_list")
    add("-InputType", dest="input_type", choices=("text", "fst"), default="text", help="accepted; the lattice type decides")
    add("-SymbolFile", dest="symbol_file")
    add("-InputArcInfosFile", dest="arc_info_file")
    add("-AmScale", dest="am_scale", type=float, default=1.0)
    add("-Debug", dest="debug", type=int, default=0, help="above 0: model statistics every evaluated iteration, else after the last")
    add("-WordLengthModulation", dest="word_length_modulation", type=float, default=-1.0, help="-1 off, 0 by the observed mean, above 0 a fixed mean")
    add("-LatticeFileType", dest="lattice_type", choices=("text", "htk", "openfst", "att"), default="text")
    add("-EvalInterval", dest="eval_interval", type=int, default=1)
    add("-UseViterby", dest="viterbi_from", type=int, default=0, help="first iteration (from 1) that decodes instead of sampling")
    add("-ExportLattices", dest="export_folder")
    add("-WriteRescoredLattices", dest="rescored_folder")
    add("-SwitchIter", dest="switch", nargs=5, type=int, metavar=("I", "K", "U", "A", "N"), help="after iteration I use orders K, U, A and retrain N sweeps")
    add("-DeactivateCharacterModel", dest="deactivate_characters_from", type=int, default=0)
    add("-InitLM", dest="init_transcription")
    add("-InitLmNumIterations", dest="init_sweeps", type=int, default=0)
    add("-WordData", dest="word_data", nargs=2, metavar=("SENTENCES", "DICTIONARY"))
    add("-OutputEditOperations", dest="output_edit_operations", action="store_true")
    add("-NumIter", dest="iterations", type=int, default=0)
    add("-BeamWidth", dest="beam_width", type=int, default=-1)
    add("-OutputDirectoryBasename", dest="output_folder", default="results")
    add("-OutputFilesBasename", dest="output_base", default="")
    add("-ReferenceTranscription", dest="reference")
    add("-CalculateLPER", dest="lattice_per", action="store_true")
    add("-CalculatePER", dest="per", action="store_true")
    add("-CalculateWER", dest="wer", action="store_true")
    add("-HTKLMScale", dest="lm_scale", type=float, default=0.0)
    add("-PruningStep", dest="sweep", nargs=3, type=parse_prune, metavar=("START", "STEP", "END"))
    add("-AMScoreShift", dest="am_shift", type=float, default=0.0)
    add("-ReadNodeTimes", dest="node_times", action="store_true")
    add("-Seed", dest="seed", type=int, default=1)
    add("-Batches", dest="batches", type=int, default=0, help="groups of sentences that are drawn side by side; 0: by the letters of the input")
    add("-StateFolder", dest="state_folder", help="keeps the state of each iteration; a run that finds one resumes from it")
    add("input_files", nargs="*")
    return p


def options(argv: list[str]) -> Options:
    given = vars(parser().parse_args(argv))
    switch, sweep, words = given.pop("switch"), given.pop("sweep"), given.pop("word_data")
    given["input_files"] = tuple(given["input_files"])
    if switch:
        given["switch"] = SwitchOrders(*switch)
    if sweep:
        given["sweep"] = PruningSweep(*sweep)
    if words:
        given["word_sentences"], given["pronunciations"] = words
    return Options(**given)


def main(argv: list[str] | None = None) -> int:
    from wordloom.plans.train import segment
    from wordloom.session import local_session

    run = segment(local_session(), options(sys.argv[1:] if argv is None else argv))
    for iteration, name, value in run.metrics:
        print(f"{iteration}\t{name}\t{value}")
    for phase, seconds in run.seconds.items():
        print(f"seconds\t{phase}\t{seconds:.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
