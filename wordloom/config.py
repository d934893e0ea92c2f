"""Run options of the segmenter, with the checks that relate them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SwitchOrders:
    """Change the model orders after an iteration, then retrain for some sweeps."""

    iteration: int = 0
    known_n: int = 0
    unknown_n: int = 0
    add_char_n: int = 0
    retrain_sweeps: int = 0


@dataclass(frozen=True)
class PruningSweep:
    """Lattice error rates for a falling pruning factor."""

    start: float = math.inf
    step: float = 0.0
    end: float = math.inf

    def factors(self) -> list[float]:
        if math.isinf(self.start):
            return [self.start]
        n = math.floor((self.start - self.end) / self.step + 1e-9)
        return [self.start - i * self.step for i in range(n + 1)]


@dataclass(frozen=True)
class Options:
    known_n: int = 1
    unknown_n: int = 1
    add_char_n: int = 0
    threads: int = 1
    prune_factor: float = math.inf
    input_files: tuple[str, ...] = ()
    input_list: str | None = None
    input_type: str = "text"
    symbol_file: str | None = None
    arc_info_file: str | None = None
    am_scale: float = 1.0
    debug: int = 0
    word_length_modulation: float = -1.0
    lattice_type: str = "text"
    eval_interval: int = 1
    viterbi_from: int = 0
    export_folder: str | None = None
    rescored_folder: str | None = None
    switch: SwitchOrders = field(default_factory=SwitchOrders)
    deactivate_characters_from: int = 0
    init_transcription: str | None = None
    init_sweeps: int = 0
    word_sentences: str | None = None
    pronunciations: str | None = None
    output_edit_operations: bool = False
    iterations: int = 0
    beam_width: int = -1
    output_folder: str = "results"
    output_base: str = ""
    reference: str | None = None
    lattice_per: bool = False
    per: bool = False
    wer: bool = False
    lm_scale: float = 0.0
    sweep: PruningSweep = field(default_factory=PruningSweep)
    am_shift: float = 0.0
    node_times: bool = False
    seed: int = 1
    batches: int = 0
    state_folder: str | None = None

    def __post_init__(self):
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise ValueError(why)

        need(self.known_n >= 1 and self.unknown_n >= 1, "model orders are 1 or more")
        need(self.add_char_n >= 0, "the additional character order is 0 or more")
        need(self.lattice_type in ("text", "htk", "openfst", "att"), f"lattice type {self.lattice_type!r} isn't supported")
        need(not (self.wer or self.per or self.lattice_per) or bool(self.reference), "error rates need a reference transcription")
        need(not self.rescored_folder or self.add_char_n >= 1, "rescored lattices need an additional character model")
        need(not self.rescored_folder or not self.switch.iteration or self.switch.add_char_n >= 1, "rescored lattices need an additional character model after the switch too")
        need((self.word_sentences is None) == (self.pronunciations is None), "word sentences and pronunciations come together")
        need(math.isinf(self.sweep.start) or self.sweep.step > 0, "a finite pruning sweep needs a positive step")
        need(self.eval_interval >= 1, "the evaluation interval is 1 or more")
        need(self.batches >= 0, "batches are 1 or more, or 0 for a default by the letters of the input")
        need(not self.init_sweeps or bool(self.init_transcription or self.word_sentences), "sweeps over initial sentences need such sentences")
        need(not self.arc_info_file or self.lattice_type == "openfst", "arc times from a file belong to OpenFST lattices")
        need(not self.node_times or self.lattice_type == "htk", "node times are those of HTK lattices")

    def uses_viterbi(self, iteration: int) -> bool:
        """``iteration`` counts from 1."""
        return 0 < self.viterbi_from <= iteration

    def characters_off(self, iteration: int) -> bool:
        return 0 < self.deactivate_characters_from <= iteration

    def evaluates(self, iteration: int) -> bool:
        return (iteration - 1) % self.eval_interval == 0

    def result_folder(self) -> str:
        return f"{self.output_folder}/KnownN_{self.known_n}_UnkN_{self.unknown_n}/{self.output_base}"
