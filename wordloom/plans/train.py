"""A run from inputs to results: read, initialise, iterate, evaluate, write."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import Options
from wordloom.functions import symbols as S
from wordloom.operators import align, lattice, lexicon, sampler
from wordloom.session import stored
from wordloom.sources import sinks, text

#: Symbols are coded as single characters from here on, so that words are plain strings.
PRIVATE, PRIVATE_SIZE = 0xE000, 6400


def coded(symbols: DataFrame) -> DataFrame:
    """Adds code, one character per symbol."""
    fits = F.when(F.col("id") >= PRIVATE_SIZE, F.raise_error(F.lit(f"more than {PRIVATE_SIZE} symbols")).cast("string"))
    return symbols.withColumn("code", F.coalesce(fits, F.expr(f"decode(unhex(lpad(hex({PRIVATE} + id), 4, '0')), 'UTF-16BE')")))


class Codes:
    """A symbol table (small by its bound) as columns: symbols to codes and back."""

    def __init__(self, table: DataFrame):
        rows = table.select("sym", "code").collect()  # at most PRIVATE_SIZE
        names, codes = F.array(*(F.lit(r.sym) for r in rows)), F.array(*(F.lit(r.code) for r in rows))
        self.by_name, self.by_code = F.map_from_arrays(names, codes), F.map_from_arrays(codes, names)

    def text(self, symbols: Column) -> Column:
        """Symbols as one string; those that aren't in the table stay as they are."""
        return F.array_join(F.transform(symbols, self.symbol), "")

    def symbol(self, s: Column) -> Column:
        return F.coalesce(F.try_element_at(self.by_name, s), s)

    def symbols(self, word: Column) -> Column:
        return F.transform(S.symbol_array(word), lambda c: F.coalesce(F.try_element_at(self.by_code, c), c))


@dataclass
class Run:
    options: Options
    metrics: list[tuple[int, str, float | None]] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    state: sampler.State | None = None

    def timed(self, phase: str, began: float) -> None:
        self.seconds[phase] = self.seconds.get(phase, 0.0) + time.time() - began


def evaluate(run: Run, found: DataFrame, reference: DataFrame | None, iteration: int) -> DataFrame | None:
    """Word and symbol error rates and lexicon scores of (utt, words, symbols) against (utt, words,
    symbols); words are strings."""
    if reference is None:
        return None
    pairs = reference.select("utt", F.col("words").alias("ref"), F.col("symbols").alias("ref_symbols")).join(found.select("utt", F.col("words").alias("hyp"), F.col("symbols").alias("hyp_symbols")), "utt")
    words = pairs.select("utt", "ref", "hyp")
    if run.options.wer:
        row = align.rates(align.align(words)).first()
        run.metrics += [(iteration, f"wer_{k}", row[k]) for k in ("error_rate", "precision", "recall", "f_score")]
        lex = lexicon.scores(found.select(F.explode("words").alias("word")), reference.select(F.explode("words").alias("word"))).first()
        run.metrics += [(iteration, f"lexicon_{k}", lex[k]) for k in ("precision", "recall", "f_score")]
    if run.options.per:
        row = align.rates(align.align(pairs.select("utt", F.col("ref_symbols").alias("ref"), F.col("hyp_symbols").alias("hyp")))).first()
        run.metrics.append((iteration, "per_error_rate", row["error_rate"]))
    return words


def measure_model(run: Run, state: sampler.State, settings: sampler.Settings, fixed: DataFrame | None, iteration: int) -> None:
    """Perplexity, and customers, tables, contexts and parameters by level."""
    stats, loglik = sampler.model_statistics(state, settings, fixed)
    run.metrics.append((iteration, "perplexity", loglik.first()["perplexity"]))
    for r in stats.orderBy("model", "level").collect():
        run.metrics += [(iteration, f"{r.model}_{r.level}_{name}", float(r[name])) for name in ("n_words", "n_tables", "n_contexts", "discount", "strength")]


def read_sentences(spark: SparkSession, options: Options, paths: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(utt, place, symbols) of text, or arcs of lattices with (utt, place)."""
    if options.lattice_type == "text":
        rows = text.numbered(text.lines(spark, paths), spark, paths)
        named = text.sentences(rows).select("file", "line", F.col("name").alias("utt"), "symbols")
        return named.join(rows.select("file", "line", "place"), ["file", "line"]).select("utt", "place", "symbols"), None
    extra = {}
    if options.lattice_type == "htk":
        extra = {"am_shift": options.am_shift, "lm_scale": options.lm_scale, "node_times": options.node_times}
    if options.lattice_type == "openfst":
        extra = {"symbols": text.symbol_file(spark, options.symbol_file)}
        if options.arc_info_file:
            extra["times"] = text.arc_infos(spark, options.arc_info_file)
    arcs = text.read_input(spark, options.lattice_type, paths, **extra)
    arcs = stored(lattice.prune(lattice.remove_epsilon(arcs), options.prune_factor), "lattices")
    places = spark.createDataFrame([(text.qualified(spark, p), n + 1) for n, p in enumerate(paths)], "utt string, place int")
    return places.join(arcs.select("utt").distinct(), "utt", "left_semi"), arcs


def with_states_in_order(arcs: DataFrame) -> DataFrame:
    """Arcs whose states are numbered from the start in topological order, as ``Walk`` needs them."""

    def work(g: lattice.Graph) -> list[tuple]:
        steps, _ = g.lattice()
        return [(s, t, label, w) for s, own in enumerate(steps) for label, w, t in own]

    return lattice.grouped_graphs(arcs, work, "src bigint, dst bigint, label string, weight double")


def read_reference(spark: SparkSession, options: Options, places: DataFrame) -> DataFrame | None:
    """(utt, words, symbols): references belong to inputs by their place."""
    if not options.reference:
        return None
    lines = text.numbered(text.lines(spark, [options.reference]), spark, [options.reference])
    ref = text.transcription(text.sentences(lines)).join(lines.select("file", "line", "place"), ["file", "line"])
    ref = ref.select("place", F.transform("words", lambda w: F.array_join(w, "")).alias("words"), F.filter("symbols", lambda s: ~s.isin(*S.RESERVED)).alias("symbols"))
    return stored(ref.join(places.select("place", "utt"), "place").select("utt", "words", "symbols"), "reference")


def initial_sentences(spark: SparkSession, options: Options) -> DataFrame | None:
    """(words), arrays of arrays of symbols: sentences that belong to the model for good."""
    if options.init_transcription:
        return text.transcription(text.sentences(text.lines(spark, [options.init_transcription]))).select("words")
    if options.word_sentences:
        spoken = text.sentences(text.lines(spark, [options.word_sentences])).select(F.col("name").alias("utt"), F.col("symbols").alias("words"))
        known = lexicon.disambiguated(text.pronunciations(text.lines(spark, [options.pronunciations])))
        return text.transcription(text.spoken(spoken, known).drop("words")).select("words")
    return None


def segment(spark: SparkSession, options: Options) -> Run:
    """The whole run; results go to the output folder if one is named."""
    run = Run(options)
    began = time.time()
    paths = list(options.input_files) + (text.file_list(spark, options.input_list) if options.input_list else [])
    if not paths:
        raise ValueError("no input files")
    places, arcs = read_sentences(spark, options, paths)
    places = stored(places, "places")
    occurrences = places.join(arcs.select("utt", "src", "label"), "utt").select(F.col("label").alias("sym"), "place", F.col("src").alias("pos")) if arcs is not None else places.select("place", F.posexplode("symbols").alias("pos", "sym")).select("sym", "place", "pos")
    initial = initial_sentences(spark, options)
    if initial is not None:  # their symbols come after those of the input
        initial = stored(initial, "initial")
        more = initial.select(F.explode(F.flatten("words")).alias("sym")).distinct().select("sym", F.lit(2**31 - 1).alias("place"), F.lit(0).cast("bigint").alias("pos"))
        occurrences = occurrences.withColumn("pos", F.col("pos").cast("bigint")).unionByName(more)
    table = stored(coded(S.symbol_table(occurrences)), "symbols")
    codes = Codes(table)
    reference = read_reference(spark, options, places)
    if arcs is not None:
        if options.export_folder:
            sinks.write_lattices(arcs, table.select("sym", "id"), f"{options.export_folder}/lattices_{options.prune_factor}")
        if options.lattice_per and reference is not None:
            for r in lattice.error_sweep(arcs, reference.select("utt", "symbols"), options.sweep.factors()).collect():
                run.metrics.append((0, f"lattice_per_{r.factor}", r.rate))
        scaled = arcs.select("utt", "src", "dst", codes.symbol(F.col("label")).alias("label"), S.scaled(F.col("weight"), options.am_scale).alias("weight"))
        plain = with_states_in_order(scaled)
        one = F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "label", "weight")
        sentences = plain.groupBy("utt").agg(F.array_sort(F.collect_list(one)).alias("arcs"))
    else:
        sentences = places.select("utt", codes.text(F.col("symbols")).alias("text"))
    run.timed("read", began)

    fixed = stored(initial.select(F.transform("words", codes.text).alias("words")), "initial") if initial is not None else None
    settings = sampler.Settings(alphabet=table.where("not reserved").count(), seed=options.seed, batches=options.batches, beam=options.beam_width, modulation=options.word_length_modulation)
    resumed = sampler.load(spark, options.state_folder) if options.state_folder else None
    state = resumed or sampler.start(sentences, options.known_n, options.unknown_n, options.add_char_n)
    if resumed is None and fixed is not None and options.init_sweeps:
        began = time.time()
        state = sampler.retrain(state, settings, options.init_sweeps, fixed)
        measure_model(run, state, settings, fixed, 0)
        run.timed("training", began)
    for n in range(state.iteration + 1, options.iterations + 1):
        began = time.time()
        state = sampler.iterate(state, settings, options.uses_viterbi(n), options.characters_off(n), fixed)
        run.timed("sampling", began)
        began = time.time()
        if options.evaluates(n):
            spelled = F.transform("words", codes.symbols)
            found = state.segmentation.select("utt", F.transform(spelled, lambda w: F.array_join(w, "")).alias("words"), F.flatten(spelled).alias("symbols"), spelled.alias("spelled"))
            pairs = evaluate(run, found, reference, n)
            if options.debug > 0 or n == options.iterations:
                measure_model(run, state, settings, fixed, n)
            if options.output_base:
                write_results(run, state, found, pairs, arcs, n)
        run.timed("evaluation", began)
        if options.switch.iteration == n:
            began = time.time()
            state = sampler.switch_orders(state, options.switch.known_n, options.switch.unknown_n, options.switch.add_char_n)
            state = sampler.retrain(state, settings, options.switch.retrain_sweeps, fixed)
            run.timed("training", began)
        if options.state_folder:
            sampler.save(state, options.state_folder)
    if options.rescored_folder and arcs is not None:
        counts = sampler.summed(sampler.counted(state.segmentation, state.known_n), *sampler.fixed_counts(fixed, state.known_n))
        letters = sampler.added_letters(state, stored(counts, "running"), settings, state.iteration + 1)
        out = lattice.rescored(arcs.select("utt", "src", "dst", codes.symbol(F.col("label")).alias("label"), "weight"), letters)
        named = lambda c: F.array_join(F.transform(F.split(F.col(c), " "), lambda x: F.coalesce(F.try_element_at(codes.by_code, x), x)), " ")
        out.select("utt", "src", named("src_ctx").alias("src_ctx"), "dst", named("dst_ctx").alias("dst_ctx"), named("label").alias("label"), "weight").write.parquet(f"{options.rescored_folder}/rescored")
    run.state = state
    return run


def write_results(run: Run, state: sampler.State, found: DataFrame, pairs: DataFrame | None, arcs: DataFrame | None, n: int) -> None:
    """The files of an iteration: sentences, timed sentences if the arcs have times, and edits after the last."""
    options, where = run.options, run.options.result_folder()
    sinks.write_sentences(found, sinks.iteration_path(where, "Sentences", n), state.known_n)
    if arcs is not None and "start_t" in arcs.columns:
        path = lattice.timed_path(arcs, found.select("utt", F.col("spelled").alias("words")))
        sinks.write_timed(lattice.word_times(path), sinks.iteration_path(where, "TimedSentences", n))
    if options.output_edit_operations and pairs is not None and n == options.iterations:
        names = S.symbol_table(pairs.select(F.explode(F.concat("ref", "hyp")).alias("sym")).select("sym", F.col("sym").alias("at")))
        sinks.operation_lines(align.edit_operations(pairs), names).select("value").write.text(sinks.iteration_path(where, "EditOperations", n))
