"""Queries over the driver's tables. Each runs over whole tables and whole texts.

Letters and words are ASCII only, cut out before lower-casing, so that any engine agrees on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import symbols as S
from wordloom.operators import align, beam, generate, lattice, lexicon, ngrams, sampler, segment
from wordloom.plans.registry import register
from wordloom.session import new_folder, stored, table
from wordloom.sources import lattices, sinks, text
from wordloom.streaming import segmenting

D, THETA = ngrams.DISCOUNT, ngrams.STRENGTH
BEAM = 3
LETTER_COST = 3.5

# Pieces of SQL that several queries share.
LETTERS = "lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
WORDS = "list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' '), lambda w: w <> '')"


def letter_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", S.letters(F.col("text")).alias("s"))


def word_rows(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return table(spark, folder, name).select(F.explode(S.words(F.col("text"))).alias("word"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(utt, text): the letters of each turn; a turn's number within all conversations."""
    rows = table(spark, folder, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), S.letters(F.col("text")).alias("text"))


UTT = "conv_id * 1000 + turn"

# --- symbols and text -------------------------------------------------------------------------


@register(
    "symbol_table",
    f"""
WITH c AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS p, s FROM (SELECT doc_id, string_split({LETTERS}, '') AS s FROM documents WHERE {LETTERS} <> '')),
f AS (SELECT s[p] AS sym, min(doc_id * 10000000 + p) AS first_at FROM c GROUP BY 1)
SELECT sym, CAST(5 + row_number() OVER (ORDER BY first_at) AS INTEGER) AS id, false AS reserved FROM f
UNION ALL SELECT * FROM (VALUES ('<eps>', 0, true), ('<phi>', 1, true), ('<unk>', 2, true), ('</unk>', 3, true), ('<s>', 4, true), ('</s>', 5, true))
""",
)
def symbol_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = letter_rows(spark, folder).where("s <> ''").select("doc_id", F.posexplode(F.split("s", "")).alias("pos", "sym"))
    return S.symbol_table(rows.select("sym", "doc_id", "pos"))


@register("symbol_freq", f"SELECT sym, count(*) AS n FROM (SELECT unnest(string_split({LETTERS}, '')) AS sym FROM documents) WHERE sym <> '' GROUP BY 1")
def symbol_freq(spark: SparkSession, folder: str) -> DataFrame:
    return letter_rows(spark, folder).select(F.explode(F.split("s", "")).alias("sym")).where("sym <> ''").groupBy("sym").agg(F.count(F.lit(1)).alias("n"))


@register(
    "text_lines",
    r"""
SELECT doc_id, CAST(line AS INTEGER) AS line, doc_id || '_Line_' || line AS name, CAST(len(list_filter(string_split_regex(l, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS INTEGER) AS n_symbols
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
WHERE len(list_filter(string_split_regex(l, '[ \t\n\r\f\v]+'), lambda x: x <> '')) > 0
""",
)
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    rows = rows.select(F.col("doc_id").cast("string").alias("file"), (F.col("line") + 1).alias("line"), "value")
    return text.sentences(rows, strict=False).select(F.col("file").cast("bigint").alias("doc_id"), "line", "name", F.size("symbols").alias("n_symbols"))


@register("sentence_chars", f"SELECT {UTT} AS utt, length({LETTERS}) AS n_arcs, '</s></s>' || {LETTERS} AS padded FROM conversations")
def sentence_chars(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder).select("utt", S.symbol_array(F.col("text")).alias("a"))
    return rows.select("utt", F.size("a").cast("bigint").alias("n_arcs"), F.array_join(S.padded(F.col("a"), 3), "").alias("padded"))


@register(
    "symbol_lookup",
    """WITH s AS (SELECT event_type AS sym, 5 + row_number() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT event_id, CAST(coalesce(s.id, -1) AS INTEGER) AS id, s.sym AS back FROM events LEFT JOIN s ON s.sym = event_type""",
)
def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Event types to ids and back; one of them isn't in the symbol table."""
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("sym"))
    symbols = stored(S.symbol_table(events.where("sym <> 'error'").select("sym", F.col("sym").alias("at"))), "symbols")
    return S.reverse_lookup(S.lookup(events, symbols).select("event_id", "id"), symbols, out="back").select("event_id", "id", "back")


@register("stripped_sentences", f"SELECT {UTT} AS utt, array_to_string({WORDS}, ' ') AS value FROM conversations")
def stripped_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as trigram sentences, and without their padding again."""
    whole = F.concat(S.padded(S.words(F.col("text")), 3), F.array(F.lit("</s>")))
    return table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), F.array_join(S.stripped(whole, 3), " ").alias("value"))


@register("silence_map", "SELECT event_id, CASE WHEN l IN ('!SENT_START', '!NULL', 'sil', 'NSN') THEN '<eps>' ELSE l END AS label FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'sil' WHEN 'error' THEN 'NSN' ELSE event_type END AS l FROM events)")
def silence_map(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "sil").when(F.col("event_type") == "error", "NSN").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select("event_id", S.silence_to_eps(label).alias("label"))


@register("am_transform", "SELECT event_id, round(-(value + 1.5) / ln(10) + 0.8 * (-(user_id % 7)) / ln(10), 9) AS weight FROM events")
def am_transform(spark: SparkSession, folder: str) -> DataFrame:
    weight = S.acoustic_weight(F.col("value"), (F.col("user_id") % 7).cast("double"), 1.5, 0.8)
    return table(spark, folder, "events").select("event_id", S.rounded(weight, 9).alias("weight"))


@register("am_scale", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'Infinity'::DOUBLE ELSE round(value * 0.3, 9) END AS weight FROM events")
def am_scale(spark: SparkSession, folder: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value"))
    out = S.scaled(weight, 0.3)
    return table(spark, folder, "events").select("event_id", S.rounded(out, 9).alias("weight"))


@register("separator_fields", "SELECT event_id, split_part('id=' || event_type || '=x', '=', 2) || '=x' AS field FROM events")
def separator_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", S.after_separator(F.concat(F.lit("id="), "event_type", F.lit("=x"))).alias("field"))


# --- counts and probabilities -----------------------------------------------------------------


def _grams(order: int) -> str:
    pad = "^" * (order - 1)
    ctx = " || ".join(f"t[i + {k}]" for k in range(order - 1))
    return f"g AS (SELECT {ctx} AS ctx, t[i + {order - 1}] AS w, count(*) AS n FROM (SELECT t, unnest(range(1, len(t) - {order - 2})) AS i FROM (SELECT string_split('{pad}' || {LETTERS}, '') AS t FROM documents WHERE {LETTERS} <> '')) GROUP BY 1, 2)"


GRAMS2 = "g2" + _grams(2)[1:]
GRAMS3 = "g3" + _grams(3)[1:]
KN2 = f"""{GRAMS2},
g1 AS (SELECT w, count(*) AS n FROM g2 GROUP BY 1),
s1 AS (SELECT sum(n) AS c_u, count(*) AS t_u FROM g1),
p1 AS (SELECT w, (n - {D} + ({THETA} + {D} * t_u) / (t_u + 1)) / ({THETA} + c_u) AS p FROM g1, s1),
s2 AS (SELECT ctx, sum(n) AS c_u, count(*) AS t_u FROM g2 GROUP BY 1),
p2 AS (SELECT g2.ctx, g2.w, g2.n, (g2.n - {D} + ({THETA} + {D} * t_u) * p1.p) / ({THETA} + c_u) AS p FROM g2 JOIN s2 USING (ctx) JOIN p1 USING (w))"""

def char_levels(spark: SparkSession, folder: str, order: int) -> list[DataFrame]:
    return ngrams.levels(ngrams.char_ngrams(letter_rows(spark, folder), F.col("s"), order), order)


@register("char_bigram_counts", f"WITH {GRAMS2} SELECT ctx, w, n FROM g2")
def char_bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.char_ngrams(letter_rows(spark, folder), F.col("s"), 2)


@register("char_trigram_counts", f"WITH {GRAMS3} SELECT ctx, w, n FROM g3")
def char_trigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.char_ngrams(letter_rows(spark, folder), F.col("s"), 3)


LEVELS3 = f"""{GRAMS3},
g2 AS (SELECT ctx[2:2] AS ctx, w, count(*) AS n FROM g3 GROUP BY 1, 2),
g1 AS (SELECT '' AS ctx, w, count(*) AS n FROM g2 GROUP BY 2)"""


@register(
    "level_totals",
    f"WITH {LEVELS3} "
    + " UNION ALL ".join(f"SELECT {k - 1} AS level, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_tables, count(DISTINCT ctx) AS n_contexts FROM g{k}" for k in (1, 2, 3)),
)
def level_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for k, level in enumerate(reversed(char_levels(spark, folder, 3))):
        own = ngrams.totals(level).agg(F.lit(k).alias("level"), F.sum("c_u").alias("n_words"), F.sum("t_u").alias("n_tables"), F.count(F.lit(1)).alias("n_contexts"))
        out = own if out is None else out.unionByName(own)
    return out


@register("kn_bigram_prob", f"WITH {KN2} SELECT ctx, w, n, round(p, 9) AS p FROM p2")
def kn_bigram_prob(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.predictive(char_levels(spark, folder, 2)).select("ctx", "w", "n", F.round("p", 9).alias("p"))


P123 = f"""{LEVELS3},
s1 AS (SELECT sum(n) AS c_u, count(*) AS t_u FROM g1),
p1 AS (SELECT w, (n - {D} + ({THETA} + {D} * t_u) / (t_u + 1)) / ({THETA} + c_u) AS p FROM g1, s1),
s2 AS (SELECT ctx, sum(n) AS c_u, count(*) AS t_u FROM g2 GROUP BY 1),
p2 AS (SELECT g2.ctx, g2.w, g2.n, (g2.n - {D} + ({THETA} + {D} * t_u) * p1.p) / ({THETA} + c_u) AS p FROM g2 JOIN s2 USING (ctx) JOIN p1 USING (w)),
s3 AS (SELECT ctx, sum(n) AS c_u, count(*) AS t_u FROM g3 GROUP BY 1),
p3 AS (SELECT g3.ctx, g3.w, g3.n, (g3.n - {D} + ({THETA} + {D} * t_u) * p2.p) / ({THETA} + c_u) AS p
       FROM g3 JOIN s3 USING (ctx) JOIN p2 ON p2.ctx = g3.ctx[2:2] AND p2.w = g3.w)"""


@register("kn_trigram_prob", f"WITH {P123} SELECT ctx, w, n, round(p, 9) AS p FROM p3")
def kn_trigram_prob(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.predictive(char_levels(spark, folder, 3)).select("ctx", "w", "n", F.round("p", 9).alias("p"))


@register("phi_mass", f"WITH {LEVELS3} SELECT ctx, CAST(sum(n) AS BIGINT) AS c_u, count(*) AS t_u, round(({THETA} + {D} * count(*)) / ({THETA} + sum(n)), 9) AS mass FROM g3 GROUP BY ctx")
def phi_mass(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.totals(char_levels(spark, folder, 3)[0]).select("ctx", "c_u", "t_u", F.round(ngrams.back_off(D, THETA), 9).alias("mass"))


@register(
    "lm_transitions",
    f"WITH {P123} SELECT ctx, w, ctx[2:2] || w AS next_ctx, round(p, 9) AS p FROM p3 UNION ALL SELECT ctx, '<phi>', ctx[2:2], round(({THETA} + {D} * t_u) / ({THETA} + c_u), 9) FROM s3",
)
def lm_transitions(spark: SparkSession, folder: str) -> DataFrame:
    levels = char_levels(spark, folder, 3)
    return ngrams.transitions(levels[0], ngrams.predictive(levels)).withColumn("p", F.round("p", 9))


@register("missing_symbols", f"SELECT DISTINCT sym FROM (SELECT unnest(string_split(lower(regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g')), '')) AS sym FROM documents) WHERE sym <> '' AND NOT regexp_matches(sym, '[a-z]')")
def missing_symbols(spark: SparkSession, folder: str) -> DataFrame:
    every = table(spark, folder, "documents").select(F.explode(F.split(F.lower(F.regexp_replace("text", "[^!-~]", "")), "")).alias("sym")).where("sym <> ''").distinct()
    return ngrams.missing_symbols(every, char_levels(spark, folder, 2)[-1])


@register(
    "longest_context",
    f"""WITH {GRAMS3}, known AS (SELECT DISTINCT ctx FROM g3 UNION SELECT DISTINCT ctx[2:2] FROM g3 UNION SELECT ''),
q AS (SELECT DISTINCT right({LETTERS}, 4) AS ctx FROM benchmark)
SELECT q.ctx, max_by(k.ctx, length(k.ctx)) AS found FROM q JOIN known k ON right(q.ctx, length(k.ctx)) = k.ctx GROUP BY 1""",
)
def longest_context(spark: SparkSession, folder: str) -> DataFrame:
    known = [x.select("ctx") for x in char_levels(spark, folder, 3)]
    queries = table(spark, folder, "benchmark").select(F.expr("right(lower(regexp_replace(text, '[^A-Za-z]', '')), 4)").alias("ctx")).distinct()
    return ngrams.longest_contexts(queries, known[0].union(known[1]).union(known[2]), 4)


LEXICON = f"lex AS (SELECT word, count(*) AS n, CAST(length(word) AS BIGINT) AS len FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY 1)"


def document_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.build(word_rows(spark, folder))


def spelled_bigrams(lex: DataFrame) -> DataFrame:
    """Letter bigrams of the distinct words with their ends, ^ at the start and $ at the end."""
    return ngrams.char_ngrams(lex.select(F.concat("word", F.lit("$")).alias("s")), F.col("s"), 2)


WORD_BASE = f"""{LEXICON},
g2 AS (SELECT t[i:i] AS ctx, t[i + 1] AS w, count(*) AS n FROM (SELECT t, unnest(range(1, length(t))) AS i FROM (SELECT '^' || word || '$' AS t FROM lex)) GROUP BY 1, 2),
{KN2[len(GRAMS2) + 2:]},
b AS (SELECT word, sum(ln(p2.p)) AS log_base FROM (SELECT word, t, unnest(range(1, length(t))) AS i FROM (SELECT word, '^' || word || '$' AS t FROM lex)) x JOIN p2 ON p2.ctx = x.t[x.i:x.i] AND p2.w = x.t[x.i + 1] GROUP BY 1)"""


def base_logs(lex: DataFrame) -> DataFrame:
    """(word, log_base): log probability of the spelling under the letter bigrams of the lexicon."""
    probs = ngrams.predictive(ngrams.levels(spelled_bigrams(lex), 2)).select(F.concat("ctx", "w").alias("g"), F.log("p").alias("log_p"))
    marked = lex.select("word", F.split(F.concat(F.lit("^"), "word", F.lit("$")), "").alias("c"))
    grams = marked.select("word", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("g"))
    return grams.join(probs, "g").groupBy("word").agg(F.sum("log_p").alias("log_base"))


@register("word_base_prob", f"WITH {WORD_BASE} SELECT word, round(log_base, 6) AS log_base FROM b")
def word_base_prob(spark: SparkSession, folder: str) -> DataFrame:
    return base_logs(stored(document_lexicon(spark, folder), "lexicon")).select("word", F.round("log_base", 6).alias("log_base"))


NESTED = f"""{WORD_BASE}, su AS (SELECT sum(n) AS c_u, count(*) AS t_u FROM lex),
nested AS (SELECT word, lex.n, (lex.n - {D} + ({THETA} + {D} * t_u) * exp(log_base)) / ({THETA} + c_u) AS p FROM lex JOIN b USING (word), su)"""


def nested_probs(lex: DataFrame) -> DataFrame:
    """(word, n, p): unigram word model over the letter model. The lexicon is used three times, so
    it is stored and the texts are read once."""
    lex = stored(lex, "lexicon")
    rows = lex.join(base_logs(lex), "word").select(F.lit("").alias("ctx"), F.col("word").alias("w"), "n", "log_base")
    return ngrams.predictive([rows], base=F.exp("log_base")).select(F.col("w").alias("word"), "n", "p")


@register("nested_word_prob", f"WITH {NESTED} SELECT word, n, round(p, 9) AS p FROM nested")
def nested_word_prob(spark: SparkSession, folder: str) -> DataFrame:
    return nested_probs(document_lexicon(spark, folder)).withColumn("p", F.round("p", 9))


SENTENCE_LL = f"""{NESTED}, k AS (SELECT word, ln(p) AS log_p FROM nested),
w AS (SELECT {UTT} AS utt, unnest({WORDS}) AS word FROM conversations),
ll AS (SELECT utt, count(*) AS n_words, count(log_p) AS n_known, sum(log_p) AS loglik FROM w LEFT JOIN k USING (word) GROUP BY 1)"""


def sentence_logs(spark: SparkSession, folder: str) -> DataFrame:
    known = nested_probs(document_lexicon(spark, folder)).select("word", F.log("p").alias("log_p"))
    rows = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), F.explode(S.words(F.col("text"))).alias("word"))
    return rows.join(known, "word", "left").groupBy("utt").agg(F.count(F.lit(1)).alias("n_words"), F.count("log_p").alias("n_known"), F.sum("log_p").alias("loglik"))


@register("sentence_loglik", f"WITH {SENTENCE_LL} SELECT utt, n_words, n_known, round(loglik, 6) AS loglik FROM ll")
def sentence_loglik(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_logs(spark, folder).withColumn("loglik", F.round("loglik", 6))


WORD_BIGRAMS = f"""g2 AS (SELECT t[i] AS ctx, t[i + 1] AS w, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT list_append(list_prepend('</s>', {WORDS}), '</s>') AS t FROM conversations)) GROUP BY 1, 2),
{KN2[len(GRAMS2) + 2:]}"""


# A word bigram model of the conversations themselves, sentence ends being words: as a run measures it.
@register("perplexity", f"WITH {WORD_BIGRAMS} SELECT CAST(sum(n) AS BIGINT) AS n_words, round(exp(-sum(n * ln(p)) / sum(n)), 6) AS perplexity FROM p2")
def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    probs = word_bigrams(spark, folder)
    return probs.agg(F.sum("n").alias("n_words"), F.round(F.exp(-F.sum(F.col("n") * F.log("p")) / F.sum("n")), 6).alias("perplexity"))


def word_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    top = ngrams.word_ngrams(table(spark, folder, "conversations"), S.words(F.col("text")), 2)
    return ngrams.predictive(ngrams.levels(top, 2, ngrams.WORD_PARENT), parent=ngrams.WORD_PARENT)


@register("word_bigram_prob", f"WITH {WORD_BIGRAMS} SELECT ctx, w, n, round(p, 9) AS p FROM p2")
def word_bigram_prob(spark: SparkSession, folder: str) -> DataFrame:
    return word_bigrams(spark, folder).withColumn("p", F.round("p", 9))


# --- lexicon ----------------------------------------------------------------------------------


@register("lexicon_build", f"WITH {LEXICON} SELECT word, n, len FROM lex")
def lexicon_build(spark: SparkSession, folder: str) -> DataFrame:
    return document_lexicon(spark, folder)


@register("lexicon_spelling", f"WITH {LEXICON} SELECT word, array_to_string(list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</unk>'), ' ') AS spelling FROM lex")
def lexicon_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return document_lexicon(spark, folder).select("word", F.array_join(S.separated(S.symbol_array(F.col("word"))), " ").alias("spelling"))


@register("word_lengths", f"WITH {LEXICON} SELECT len, CAST(count(*) AS BIGINT) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens FROM lex GROUP BY 1")
def word_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return document_lexicon(spark, folder).groupBy("len").agg(F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_tokens"))


@register(
    "lexicon_prf",
    f"""WITH {LEXICON}, r AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark),
c AS (SELECT (SELECT count(*) FROM lex) AS n_found, (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM lex JOIN r USING (word)) AS n_correct)
SELECT n_found, n_ref, n_correct, round(n_correct / n_found, 9) AS precision, round(n_correct / n_ref, 9) AS recall,
       round(2 * (n_correct / n_found) * (n_correct / n_ref) / (n_correct / n_found + n_correct / n_ref), 9) AS f_score FROM c""",
)
def lexicon_prf(spark: SparkSession, folder: str) -> DataFrame:
    out = lexicon.scores(document_lexicon(spark, folder), word_rows(spark, folder, "benchmark"))
    return out.select("n_found", "n_ref", "n_correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f_score")))


@register("length_hist", f"WITH {LEXICON}, h AS (SELECT len + 1 AS length, CAST(sum(n) AS BIGINT) AS n FROM lex GROUP BY 1) SELECT length, n, round(n / sum(n) OVER (), 9) AS share FROM h")
def length_hist(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.length_histogram(document_lexicon(spark, folder)).withColumn("share", F.round("share", 9))


@register(
    "poisson_scale",
    f"""WITH {LEXICON}, h AS (SELECT len + 1 AS length, sum(n) AS n FROM lex GROUP BY 1), m AS (SELECT sum(length * n) / sum(n) AS mean FROM h),
g AS (SELECT len + 1 AS length, count(*) / (SELECT count(*) FROM lex) AS share FROM lex GROUP BY 1)
SELECT length, round(exp(-(mean - 2) + (length - 2) * ln(mean - 2) - lgamma(length - 1)) / share, 6) AS scale FROM g, m""",
)
def poisson_scale(spark: SparkSession, folder: str) -> DataFrame:
    lex = document_lexicon(spark, folder)
    mean = lexicon.mean_length(lexicon.length_histogram(lex)).first()["mean"]
    shares = lexicon.length_histogram(lex.withColumn("n", F.lit(1)))
    rows = lexicon.length_scale(F.lit(mean), shares)
    return rows.select("length", F.round("scale", 6).alias("scale"))


@register(
    "pron_homophones",
    f"""WITH {LEXICON}, p AS (SELECT row_number() OVER (ORDER BY word) AS line, word, regexp_replace(word, '[aeiou]+', 'a', 'g') AS sound FROM lex),
k AS (SELECT word, sound, row_number() OVER (PARTITION BY sound ORDER BY word) - 1 AS k FROM p)
SELECT word, k AS rank, sound || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS phones FROM k""",
)
def pron_homophones(spark: SparkSession, folder: str) -> DataFrame:
    lex = document_lexicon(spark, folder).select(F.col("word").alias("line"), "word", F.split(F.regexp_replace("word", "[aeiou]+", "a"), "").alias("phones"))
    return lexicon.disambiguated(lex).select("word", F.col("k").cast("bigint").alias("rank"), F.array_join("phones", "").alias("phones"))


@register("oov_words", f"WITH {LEXICON}, r AS (SELECT DISTINCT unnest({WORDS}) AS word FROM conversations) SELECT word FROM r ANTI JOIN lex USING (word)")
def oov_words(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.unknown_words(word_rows(spark, folder, "conversations"), document_lexicon(spark, folder))


@register(
    "active_words",
    f"""WITH {LEXICON}, b AS (SELECT {LETTERS} AS t FROM benchmark), l AS (SELECT max(len) AS most FROM lex), s AS (SELECT DISTINCT t[i:i + k - 1] AS word FROM (SELECT t, i, unnest(range(1, least(most, length(t) - i + 1) + 1)) AS k FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM b), l))
SELECT word, n FROM lex SEMI JOIN s USING (word)""",
)
def active_words(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "benchmark").select(S.letters(F.col("text")).alias("text"))
    return lexicon.active(stored(document_lexicon(spark, folder), "lexicon"), texts).select("word", "n")


# --- alignment --------------------------------------------------------------------------------


def turn_pairs(spark: SparkSession, folder: str, symbols) -> DataFrame:
    """Each turn as reference, the next turn of the conversation as hypothesis."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", symbols.alias("x"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("hyp"))
    return rows.select("conv_id", "turn", F.col("x").alias("ref")).join(after, ["conv_id", "turn"])


# Alignment by anti-diagonals: cost 1,000,000 an edit and 1 more a substitution, so that of equally
# many edits those with fewer substitutions win. d1 and d2 are the last two diagonals, by reference place.
TURN_WORDS = f"w AS (SELECT conv_id, turn, {WORDS} AS x FROM conversations), p AS MATERIALIZED (SELECT a.conv_id * 1000 + a.turn AS id, a.x AS r, b.x AS h FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
LINES = "SELECT conv_id, turn, i, ls[i + 1] AS text FROM (SELECT conv_id, turn, ls, unnest(range(0, len(ls))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))"
LINE_LETTERS = f"w AS (SELECT conv_id, turn, i, list_filter(string_split({LETTERS}, ''), lambda c: c <> '') AS x FROM ({LINES})), p AS MATERIALIZED (SELECT ((a.conv_id * 1000 + a.turn) * 1000 + a.i) AS id, a.x AS r, b.x AS h FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.i = b.i)"


def _aligned(match: str = "x[4] = x[5]", key: str = "USING KEY (id)", other: str = "h") -> str:
    """d: the diagonals of the pairs p (id, r, h); with ``key`` only the last of each pair. A cell's
    three neighbours and its two symbols (and that of ``other``) are zipped; where there is no found
    symbol, only a deletion leads to the cell."""
    padded = lambda c: f"list_concat(list_resize(CAST([] AS VARCHAR[]), len(r) + 1), list_reverse({c}), list_resize(CAST([] AS VARCHAR[]), len(r) + 1))"
    here = lambda c: f"{c}[n + 1 + m - k:n + 1 + m - k + n]"
    return f"""pad AS MATERIALIZED (SELECT id, len(r) AS n, len(h) AS m, list_concat([CAST(NULL AS VARCHAR)], r) AS rr, {padded("h")} AS hh, {padded(other)} AS gg FROM p),
d(id, k, d1, d2) {key} AS (
  SELECT id, 0, list_concat([0], list_resize(CAST([] AS INTEGER[]), n)), list_resize(CAST([] AS INTEGER[]), n + 1) FROM pad
  UNION {'' if key else 'ALL'}
  SELECT d.id, k + 1, list_transform(list_zip(list_concat([CAST(NULL AS INTEGER)], d1[1:n]), d1, list_concat([CAST(NULL AS INTEGER)], d2[1:n]), rr, {here("hh")}, {here("gg")}),
    lambda x: CASE WHEN x[5] IS NULL THEN x[1] + 1000000 ELSE least(x[1] + 1000000, x[2] + 1000000, x[3] + CASE WHEN {match} THEN 0 ELSE 1000001 END) END), d1
  FROM d JOIN pad USING (id) WHERE k < n + m)"""


def _costs(match: str = "y[3] = x.x", other: str = "h") -> str:
    """c: edits and substitutions of the pairs p (id, r, h), row by row over the reference. A row holds
    a place's cost less 1,000,000 for each found symbol before it, so that insertions are the least
    value so far, taken by doubling steps."""
    least = "list_transform(list_zip(y, list_concat([CAST(NULL AS BIGINT)], y), list_concat([CAST(NULL AS VARCHAR)], h), list_concat([CAST(NULL AS VARCHAR)], g)), lambda y: least(y[1] + 1000000, y[2] + CASE WHEN {match} THEN -1000000 ELSE 1 END))[1:len(h) + 1]".replace("{match}", match).replace("list_zip(y, list_concat([CAST(NULL AS BIGINT)], y)", "list_zip(a.s, list_concat([CAST(NULL AS BIGINT)], a.s)")
    for step in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096):
        least = f"list_transform([{least}], lambda z: list_transform(list_zip(z, list_concat(list_resize(CAST([] AS BIGINT[]), {step}), z)[1:len(h) + 1]), lambda y: least(y[1], y[2])))[1]"
    return f"""c AS (SELECT id, len(r) AS n_ref, len(h) AS n_found, cost // 1000000 AS edits, cost % 1000000 AS n_sub
  FROM (SELECT id, r, h, list_reduce(list_transform(r, lambda v: {{'s': CAST([] AS BIGINT[]), 'x': v}}), lambda a, x: {{'s': {least}, 'x': x.x}}, {{'s': list_resize(CAST([] AS BIGINT[]), len(h) + 1, 0), 'x': ''}}).s[-1] + 1000000 * len(h) AS cost FROM (SELECT id, r, h, {other} AS g FROM p)))"""


OPS = """o AS (SELECT id, (edits - n_sub + n_found - n_ref) // 2 AS n_ins, (edits - n_sub - n_found + n_ref) // 2 AS n_del, n_sub, n_ref - (edits - n_sub - n_found + n_ref) // 2 - n_sub AS n_cor, n_found, n_ref FROM c)"""
RATES = """t AS (SELECT CAST(sum(n_ins) AS BIGINT) AS n_ins, CAST(sum(n_del) AS BIGINT) AS n_del, CAST(sum(n_sub) AS BIGINT) AS n_sub, CAST(sum(n_cor) AS BIGINT) AS n_cor, CAST(sum(n_found) AS BIGINT) AS n_found, CAST(sum(n_ref) AS BIGINT) AS n_ref FROM o),
q AS (SELECT *, n_cor / n_found AS p, n_cor / n_ref AS r FROM t)
SELECT n_ins, n_del, n_sub, n_cor, n_found, n_ref, round((n_ins + n_del + n_sub) / n_ref, 9) AS error_rate, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f_score FROM q"""


def rounded_rates(rows: DataFrame) -> DataFrame:
    return rows.select("n_ins", "n_del", "n_sub", "n_cor", "n_found", "n_ref", *(F.round(c, 9).alias(c) for c in ("error_rate", "precision", "recall", "f_score")))


@register("align_ops", f"WITH RECURSIVE {TURN_WORDS}, {_costs()}, {OPS} SELECT id // 1000 AS conv_id, id % 1000 AS turn, CAST(n_ins AS BIGINT) AS n_ins, CAST(n_del AS BIGINT) AS n_del, CAST(n_sub AS BIGINT) AS n_sub, CAST(n_cor AS BIGINT) AS n_cor, CAST(n_found AS BIGINT) AS n_found, CAST(n_ref AS BIGINT) AS n_ref FROM o")
def align_ops(spark: SparkSession, folder: str) -> DataFrame:
    return align.align(turn_pairs(spark, folder, S.words(F.col("text"))))


@register("wer", f"WITH RECURSIVE {TURN_WORDS}, {_costs()}, {OPS}, {RATES}")
def wer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_rates(align.rates(align_ops(spark, folder)))


@register("per", f"WITH RECURSIVE {LINE_LETTERS}, {_costs()}, {OPS}, {RATES}")
def per(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of each line of a turn as reference, those of the same line of the next turn as hypothesis."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    rows = rows.select("conv_id", "turn", "i", S.symbol_array(S.letters(F.col("l"))).alias("x"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), "i", F.col("x").alias("hyp"))
    pairs = rows.withColumnRenamed("x", "ref").join(after, ["conv_id", "turn", "i"])
    return rounded_rates(align.rates(align.align(pairs)))


def line_utterances(spark: SparkSession, folder: str) -> DataFrame:
    """(utt, text): the letters of each line of the turns."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return rows.select(((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("i")).alias("utt"), S.letters(F.col("l")).alias("text")).where("text <> ''")


# Back from the last cell: a diagonal step if it explains the cost, else a deletion, else an insertion.
@register(
    "edit_operation_lines",
    f"""WITH RECURSIVE {TURN_WORDS}, {_aligned(key="")},
b(id, i, j, pos, op, rs, hs) AS (
  SELECT id, len(r), len(h), 0, '', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM p
  UNION ALL
  SELECT id, CASE WHEN step = 'i' THEN i ELSE i - 1 END, CASE WHEN step = 'd' THEN j ELSE j - 1 END, pos - 1,
         CASE WHEN step = 'm' THEN CASE WHEN same THEN 'c' ELSE 's' END ELSE step END, CASE WHEN step <> 'i' THEN x END, CASE WHEN step <> 'd' THEN y END
  FROM (SELECT b.id, i, j, pos, p.r[i] AS x, p.h[j] AS y, p.r[i] = p.h[j] AS same,
               CASE WHEN i > 0 AND j > 0 AND here.d1[i + 1] = two.d1[i] + CASE WHEN p.r[i] = p.h[j] THEN 0 ELSE 1000001 END THEN 'm'
                    WHEN i > 0 AND here.d1[i + 1] = one.d1[i] + 1000000 THEN 'd' ELSE 'i' END AS step
        FROM b JOIN p ON p.id = b.id JOIN d here ON here.id = b.id AND here.k = i + j
             LEFT JOIN d one ON one.id = b.id AND one.k = i + j - 1 LEFT JOIN d two ON two.id = b.id AND two.k = i + j - 2
        WHERE i + j > 0)),
s AS (SELECT sym, 5 + row_number() OVER (ORDER BY sym) AS no FROM (SELECT DISTINCT unnest(list_concat(r, h)) AS sym FROM p))
SELECT b.id AS utt, string_agg(op || ':[' || coalesce(CAST(x.no AS VARCHAR), '0') || ',' || coalesce(rs, '<eps>') || ' --> ' || coalesce(CAST(y.no AS VARCHAR), '0') || ',' || coalesce(hs, '<eps>') || ']', ' ' ORDER BY pos) AS value
FROM b LEFT JOIN s x ON x.sym = rs LEFT JOIN s y ON y.sym = hs WHERE op <> '' GROUP BY 1""",
)
def edit_operation_lines(spark: SparkSession, folder: str) -> DataFrame:
    pairs = turn_pairs(spark, folder, S.words(F.col("text"))).select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), "ref", "hyp")
    words = pairs.select(F.explode(F.concat("ref", "hyp")).alias("sym"))
    return sinks.operation_lines(align.edit_operations(pairs), S.symbol_table(words.select("sym", F.col("sym").alias("at"))))


@register("sentence_lines", f"SELECT {UTT} AS utt, '</s> ' || array_to_string(list_append({WORDS}, '</s>'), ' ') AS value FROM conversations")
def sentence_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), sinks.sentence_lines(S.words(F.col("text")), 2).alias("value"))


# --- segmentation -----------------------------------------------------------------------------

# Per text the best costs and segmentations of the last places, as many as the longest word has
# letters, and the place before them from which an unknown word costs least. Costs are compared to
# nine decimals, then the shorter last word wins.
BEST_WORDS = f"""{LEXICON}, total AS (SELECT sum(n) AS n FROM lex), k AS MATERIALIZED (SELECT word, len, -ln(lex.n / total.n) AS cost FROM lex, total), most AS MATERIALIZED (SELECT max(len) AS m FROM lex),
t AS MATERIALIZED (SELECT {UTT} AS utt, {LETTERS} AS s FROM conversations),
e AS MATERIALIZED (SELECT utt, j, list(coalesce(cost, {LETTER_COST} * (q + 1)) ORDER BY q) AS cs
      FROM (SELECT utt, j, q, s[j - q + 1:j] AS word FROM (SELECT utt, s, j, unnest(range(1, least(j, m) + 1)) AS q FROM (SELECT utt, s, unnest(range(1, length(s) + 1)) AS j FROM t), most)) LEFT JOIN k USING (word) GROUP BY 1, 2),
b(utt, j, best, words, spot, far, begun) USING KEY (utt) AS (
  SELECT utt, 0, [CAST(0 AS DOUBLE)], [''], CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM t
  UNION
  SELECT utt, j, list_append(best, cost)[-(m + 1):], list_append(words, before || CASE WHEN before = '' THEN '' ELSE ' ' END || s[j - size + 1:j])[-(m + 1):], spot, far, begun
  FROM (SELECT *, CASE WHEN size <= m THEN best[-size] + cs[size] ELSE far + {LETTER_COST} * (size + 1) END AS cost, CASE WHEN size <= m THEN words[-size] ELSE begun END AS before
    FROM (SELECT *, least(list_min(list_transform(cs, lambda c, q: {{'c': round(best[-q] + c, 9), 'q': q}})), CASE WHEN spot IS NOT NULL THEN {{'c': round(far + {LETTER_COST} * (j - spot + 1), 9), 'q': j - spot}} END).q AS size
      FROM (SELECT utt, j, best, words, s, m, cs, CASE WHEN nearer THEN j - m - 1 ELSE spot END AS spot, CASE WHEN nearer THEN best[1] ELSE far END AS far, CASE WHEN nearer THEN words[1] ELSE begun END AS begun
        FROM (SELECT b.utt, b.j + 1 AS j, best, words, spot, far, begun, s, m, cs, b.j >= m AND coalesce(best[1] - {LETTER_COST} * (b.j - m) <= far - {LETTER_COST} * spot + 1e-9, true) AS nearer
              FROM b JOIN t USING (utt) JOIN e ON e.utt = b.utt AND e.j = b.j + 1, most)))))"""
BEST_COST = f"WITH RECURSIVE {BEST_WORDS} SELECT utt, round(best[-1], 6) AS cost FROM b"


def best_words(spark: SparkSession, folder: str) -> DataFrame:
    costs = stored(segment.unigram_costs(stored(document_lexicon(spark, folder), "lexicon")), "costs")
    return segment.viterbi_unigram(turns(spark, folder), costs, LETTER_COST)


@register("viterbi_unigram", BEST_COST)
def viterbi_unigram(spark: SparkSession, folder: str) -> DataFrame:
    return best_words(spark, folder).select("utt", F.round("cost", 6).alias("cost"))


@register("segmented_words", f"WITH RECURSIVE {BEST_WORDS} SELECT utt, words[-1] || CASE WHEN words[-1] = '' THEN '' ELSE ' ' END || '</s>' AS value FROM b")
def segmented_words(spark: SparkSession, folder: str) -> DataFrame:
    return best_words(spark, folder).select("utt", sinks.sentence_lines(F.col("words"), 1).alias("value"))


@register("lattice_segmentation")
def lattice_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Branching lattices over the items of the benchmark, each with its best path and words together."""
    rows = table(spark, folder, "benchmark").select(F.col("item_id").alias("utt"), S.letters(F.col("text")).alias("text")).where("text <> ''")
    costs = stored(segment.unigram_costs(stored(document_lexicon(spark, folder), "lexicon")), "costs")
    return segment.lattice_words(lattice.remove_epsilon(branching(rows)), costs, LETTER_COST).select("utt", F.round("cost", 6).alias("cost"), F.array_join("words", " ").alias("words"))


# --- lattices ---------------------------------------------------------------------------------


def sausages(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder).where("text <> ''")
    return lattice.sausage(rows, F.col("utt"), F.split("text", ""))


SAUSAGE = f"""t AS (SELECT {UTT} AS utt, {LETTERS} AS text FROM conversations),
c AS (SELECT utt, i - 1 AS src, i AS dst, text[i] AS l FROM (SELECT utt, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
arcs AS (SELECT utt, src, dst, l AS label, CAST(0 AS DOUBLE) AS weight FROM c
  UNION ALL SELECT utt, src, dst, CASE WHEN l = 'z' THEN 'a' ELSE chr(ascii(l) + 1) END, CAST(2 AS DOUBLE) FROM c)"""


def branching(rows: DataFrame) -> DataFrame:
    """Lattices of (utt, text) with two finals, arcs that skip a letter, and <eps> arcs: a sausage
    with other weights, from every sixth state an arc over two letters, after every ninth one that
    reads nothing, and from the last but one an arc to a final of its own."""
    plain = lattice.sausage(rows, F.col("utt"), F.split("text", ""))
    chosen = F.when(F.col("weight") == 0, F.col("src") % 7 * 0.01).otherwise(2.0 + F.col("src") * 3 % 5 * 0.1)
    spots = rows.select("utt", F.posexplode(F.split("text", "")).alias("src", "label"), F.length("text").alias("n")).withColumn("src", F.col("src").cast("bigint"))
    skips = spots.where("src % 6 = 1").select("utt", (F.col("src") - 1).alias("src"), (F.col("src") + 1).alias("dst"), "label", F.lit(1.25).alias("weight"))
    silent = spots.where("src % 9 = 4").select("utt", "src", (F.col("src") + 1).alias("dst"), F.lit("<eps>").alias("label"), F.lit(1.75).alias("weight"))
    other = spots.where("src = n - 1").select("utt", "src", (F.col("src") + 2).alias("dst"), F.lit("q").alias("label"), F.lit(0.5).alias("weight"))
    return plain.withColumn("weight", F.round(chosen, 6)).unionByName(skips).unionByName(silent).unionByName(other)


BRANCHING = f"""t AS (SELECT {UTT} AS utt, {LETTERS} AS text FROM conversations),
c AS (SELECT utt, i - 1 AS src, text[i] AS l, length(text) AS n FROM (SELECT utt, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
arcs AS (SELECT utt, src, src + 1 AS dst, l AS label, CAST(round(src % 7 * 0.01, 6) AS DOUBLE) AS weight FROM c
  UNION ALL SELECT utt, src, src + 1, CASE WHEN l = 'z' THEN 'a' ELSE chr(ascii(l) + 1) END, CAST(round(2.0 + src * 3 % 5 * 0.1, 6) AS DOUBLE) FROM c
  UNION ALL SELECT utt, src - 1, src + 1, l, CAST(1.25 AS DOUBLE) FROM c WHERE src % 6 = 1
  UNION ALL SELECT utt, src, src + 1, '<eps>', CAST(1.75 AS DOUBLE) FROM c WHERE src % 9 = 4
  UNION ALL SELECT utt, src, src + 2, 'q', CAST(0.5 AS DOUBLE) FROM c WHERE src = n - 1)"""
# Least weights to and from each state; arcs go one or two states on.
ALPHA = """steps AS MATERIALIZED (SELECT utt, dst AS state, min(weight) FILTER (dst - src = 1) AS w1, min(weight) FILTER (dst - src = 2) AS w2 FROM arcs GROUP BY 1, 2),
alpha(utt, state, a, a0) AS (SELECT utt, 0, CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM t WHERE text <> ''
  UNION ALL SELECT x.utt, s.state, least(x.a + w1, x.a0 + w2), x.a FROM alpha x JOIN steps s ON s.utt = x.utt AND s.state = x.state + 1)"""
BETA = """ways AS MATERIALIZED (SELECT utt, src AS state, min(weight) FILTER (dst - src = 1) AS w1, min(weight) FILTER (dst - src = 2) AS w2 FROM arcs GROUP BY 1, 2),
beta(utt, state, b, b1) AS (SELECT utt, length(text), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM t WHERE text <> ''
  UNION ALL SELECT x.utt, s.state, least(x.b + w1, x.b1 + w2), x.b FROM beta x JOIN ways s ON s.utt = x.utt AND s.state = x.state - 1),
backward AS (SELECT utt, state, b FROM beta UNION ALL SELECT utt, length(text) + 1, CAST(0 AS DOUBLE) FROM t WHERE text <> '')"""


def branching_turns(spark: SparkSession, folder: str) -> DataFrame:
    return branching(turns(spark, folder).where("text <> ''"))


def doubled(spark: SparkSession, folder: str) -> DataFrame:
    """Sausages whose vowels have a second, worse arc of the same label."""
    arcs = sausages(spark, folder)
    return arcs.unionByName(arcs.where(F.col("label").isin(*"aeiou")).withColumn("weight", F.col("weight") + 0.5))


@register(
    "merge_arcs",
    f"""WITH {SAUSAGE}, twice AS (SELECT * FROM arcs UNION ALL SELECT utt, src, dst, label, weight + 0.5 FROM arcs WHERE label IN ('a', 'e', 'i', 'o', 'u'))
SELECT utt, src, dst, label, round(-ln(sum(exp(-weight))), 9) AS weight FROM twice GROUP BY utt, src, dst, label""",
)
def merge_arcs(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.merge_parallel(doubled(spark, folder)).withColumn("weight", F.round("weight", 9))


@register("final_states", f"WITH {BRANCHING} SELECT DISTINCT utt, unnest([n, n + 1]) AS state FROM c")
def final_states(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.final_states(branching_turns(spark, folder))


@register("lattice_sizes", f"WITH {BRANCHING} SELECT utt, max(dst) + 1 AS n_states, count(*) AS n_arcs FROM arcs GROUP BY 1")
def lattice_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.sizes(branching_turns(spark, folder))


@register(
    "prune_arcs",
    f"""WITH RECURSIVE {BRANCHING}, {ALPHA}, {BETA}, best AS (SELECT utt, b FROM beta WHERE state = 0)
SELECT arcs.utt, arcs.src, arcs.dst, label, weight FROM arcs JOIN alpha ON alpha.utt = arcs.utt AND alpha.state = src JOIN backward y ON y.utt = arcs.utt AND y.state = dst JOIN best ON best.utt = arcs.utt
WHERE a + weight + y.b <= best.b + 2.2 + 1e-9""",
)
def prune_arcs(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.prune(branching_turns(spark, folder), 2.2)


@register("topological_levels", f"WITH {BRANCHING} SELECT DISTINCT utt, state, CASE WHEN state = n + 1 THEN n ELSE state END AS level FROM (SELECT utt, n, unnest(range(0, n + 2)) AS state FROM c)")
def topological_levels(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.topological_levels(branching_turns(spark, folder))


@register(
    "lattice_best",
    f"""WITH RECURSIVE {BRANCHING}, {BETA},
choice AS MATERIALIZED (SELECT arcs.utt, arcs.src, dst, label, weight FROM arcs JOIN backward y ON y.utt = arcs.utt AND y.state = dst
  QUALIFY row_number() OVER (PARTITION BY arcs.utt, arcs.src ORDER BY round(weight + b, 9), weight, label, dst) = 1),
path(utt, pos, src, dst, label, weight) AS (SELECT utt, CAST(0 AS BIGINT), src, dst, label, weight FROM choice WHERE src = 0
  UNION ALL SELECT c.utt, pos + 1, c.src, c.dst, c.label, c.weight FROM path JOIN choice c ON c.utt = path.utt AND c.src = path.dst)
SELECT * FROM path""",
)
def lattice_best(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.best_path(branching_turns(spark, folder))


# <eps> arcs stand far apart: the next state's arcs start here too, and an arc in front of an <eps> into a final ends there too.
@register(
    "epsilon_free",
    f"""WITH {BRANCHING}, own AS (SELECT * FROM arcs WHERE label <> '<eps>'), eps AS (SELECT * FROM arcs WHERE label = '<eps>'),
u AS (SELECT * FROM own UNION ALL SELECT e.utt, e.src, o.dst, o.label, e.weight + o.weight FROM eps e JOIN own o ON o.utt = e.utt AND o.src = e.dst),
v AS (SELECT * FROM u UNION ALL SELECT u.utt, u.src, e.dst, u.label, u.weight + e.weight FROM u JOIN eps e ON e.utt = u.utt AND e.src = u.dst JOIN t ON t.utt = e.utt WHERE e.dst = length(text))
SELECT utt, src, dst, label, round(min(weight), 9) AS weight FROM v GROUP BY 1, 2, 3, 4""",
)
def epsilon_free(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.remove_epsilon(branching_turns(spark, folder)).withColumn("weight", F.round("weight", 9))


def altered(letters) -> object:
    """Without every seventh letter, every fifth moved by two."""
    moved = F.transform(letters, lambda c, i: F.when(i % 5 == 0, F.chr((F.ascii(c) - 97 + 2) % 26 + 97)).otherwise(c))
    return F.filter(moved, lambda c, i: i % 7 != 6)


# A sausage has two letters at each place: a reference letter matches either.
SAUSAGE_PAIRS = f"""t AS (SELECT ({UTT}) * 1000 + i AS id, list_filter(string_split({LETTERS}, ''), lambda c: c <> '') AS x FROM ({LINES})),
p AS MATERIALIZED (SELECT id, list_transform(list_filter(range(1, len(x) + 1), lambda i: (i - 1) % 7 <> 6), lambda i: CASE WHEN (i - 1) % 5 = 0 THEN chr((ascii(x[i]) - 97 + 2) % 26 + 97) ELSE x[i] END) AS r,
             x AS h, list_transform(x, lambda c: CASE WHEN c = 'z' THEN 'a' ELSE chr(ascii(c) + 1) END) AS g FROM t WHERE len(x) > 0)"""
EITHER = "y[3] = x.x OR y[4] = x.x"


@register("lattice_per", f"WITH RECURSIVE {SAUSAGE_PAIRS}, {_costs(EITHER, "g")} SELECT id AS utt, CAST(edits AS BIGINT) AS edits, CAST(n_sub AS BIGINT) AS substitutions, CAST(n_ref AS BIGINT) AS n_ref FROM c")
def lattice_per(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of the turns, altered, against its own lattice."""
    rows = line_utterances(spark, folder)
    refs = rows.select("utt", altered(F.split("text", "")).alias("symbols"))
    return lattice.error_rates(lattice.sausage(rows, F.col("utt"), F.split("text", "")), refs)


@register("lattice_per_sweep")  # SQL takes minutes on the whole table; see the tests
def lattice_per_sweep(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.transform(F.split("text", ""), lambda c, i: F.when((i % 5 == 0) & (c != "z"), F.chr(F.ascii(c) + 1)).otherwise(c))
    rows = line_utterances(spark, folder)
    return lattice.error_sweep(lattice.sausage(rows, F.col("utt"), F.split("text", "")), rows.select("utt", shifted.alias("symbols")), [2.0, 1.0]).withColumn("rate", F.round("rate", 9))


@register(
    "beam_topk",
    f"WITH {SAUSAGE}, h AS (SELECT utt, src AS step, label, weight + (ascii(label) % 5) AS weight, ascii(label) AS seq FROM arcs), three AS (SELECT * FROM h UNION ALL SELECT utt, step, label, weight + 1, seq + 100 FROM h) SELECT utt, step, label, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY utt, step ORDER BY weight, seq) AS rank FROM three) WHERE rank <= {BEAM}",
)
def beam_topk(spark: SparkSession, folder: str) -> DataFrame:
    h = sausages(spark, folder).select("utt", F.col("src").cast("bigint").alias("step"), "label", (F.col("weight") + F.ascii("label") % 5).alias("weight"), F.ascii("label").alias("seq"))
    three = h.unionByName(h.select("utt", "step", "label", (F.col("weight") + 1).alias("weight"), (F.col("seq") + 100).alias("seq")))
    return segment.beam_topk(three, BEAM).select("utt", "step", "label", "weight", "rank")


# Hypotheses of a step, r by cost and creation; taken: each arc's first one and the <eps> arcs behind it, in the
# order of the search (no two <eps> arcs of these lattices meet). pop is the place of the one before.
TAKEN = """(WITH o AS (SELECT * FROM hyps QUALIFY row_number() OVER (PARTITION BY utt, step, src, dst, label ORDER BY r) = 1),
  e AS (SELECT o.utt, o.step, o.r, a.src, a.dst, a.label, a.weight, o.cost + a.weight AS cost FROM o JOIN arcs a ON a.utt = o.utt AND a.src = o.dst AND a.label = '<eps>'
    QUALIFY row_number() OVER (PARTITION BY o.utt, o.step, a.src ORDER BY o.cost + a.weight, o.r) = 1),
  u AS (SELECT utt, step, r, src, dst, label, weight, cost, 0 AS silent FROM o UNION ALL SELECT utt, step, r, src, dst, label, weight, cost, 1 FROM e)
  SELECT *, row_number() OVER (PARTITION BY utt, step ORDER BY cost, silent, r) AS place FROM u)"""


@register(
    "lattice_beam",
    f"""WITH RECURSIVE {BRANCHING.replace("arcs AS (", "arcs AS MATERIALIZED (")},
hyps(utt, step, pop, r, src, dst, label, weight, cost) AS (SELECT utt, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM t WHERE text <> ''
  UNION ALL SELECT utt, step + 1, place, r, src, dst, label, weight, cost FROM (SELECT p.utt, p.step, p.place, a.src, a.dst, a.label, a.weight, p.cost + a.weight AS cost,
    row_number() OVER (PARTITION BY p.utt ORDER BY p.cost + a.weight, p.place, a.weight, a.label, a.dst) AS r
    FROM {TAKEN} p JOIN arcs a ON a.utt = p.utt AND a.src = p.dst AND a.label <> '<eps>') WHERE r <= {BEAM}),
taken AS MATERIALIZED {TAKEN},
late AS (SELECT p.utt, p.step, p.place FROM taken p JOIN hyps n ON n.utt = p.utt AND n.step = p.step + 1 AND n.pop < p.place AND n.cost <= p.cost GROUP BY 1, 2, 3 HAVING count(*) = {BEAM})
SELECT DISTINCT utt, src, dst, label, weight FROM taken ANTI JOIN late USING (utt, step, place) WHERE step > 0 OR label <> ''""",
)
def lattice_beam(spark: SparkSession, folder: str) -> DataFrame:
    return beam.trim(branching_turns(spark, folder), BEAM)


@register(
    "timed_words",
    f"""WITH w AS (SELECT {UTT} AS utt, {WORDS} AS ws FROM conversations),
x AS (SELECT utt, i - 1 AS word_no, ws[i] AS word, list_sum(list_transform(ws[1:i - 1], lambda y: length(y))) AS before FROM (SELECT utt, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))
SELECT utt, CAST(word_no AS INTEGER) AS word_no, word, CAST(round(coalesce(before, 0) * 0.1, 6) AS DOUBLE) AS start_t, CAST(round((coalesce(before, 0) + length(word)) * 0.1, 6) AS DOUBLE) AS end_t FROM x""",
)
def timed_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of turns from their letters' arcs, each letter a tenth of a second."""
    ws = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), S.words(F.col("text")).alias("ws"))
    marks = F.flatten(F.transform("ws", lambda w, i: F.transform(F.split(w, ""), lambda c: F.struct(c.alias("label"), i.alias("word_no")))))
    arcs = ws.where(F.size("ws") > 0).select("utt", F.posexplode(marks).alias("pos", "m"))
    arcs = arcs.select("utt", "pos", F.col("m.label").alias("label"), F.col("m.word_no").alias("word_no"), (F.col("pos") * 0.1).alias("start_t"), ((F.col("pos") + 1) * 0.1).alias("end_t"))
    return lattice.word_times(arcs).select("utt", "word_no", "word", F.round("start_t", 6).alias("start_t"), F.round("end_t", 6).alias("end_t"))


@register("slf_lattices", f"WITH {SAUSAGE} SELECT utt, src, dst, label, weight FROM arcs")
def slf_lattices(spark: SparkSession, folder: str) -> DataFrame:
    """Sausages written as SLF text and read again."""
    arcs = lattices.slf(lattices.to_slf(sausages(spark, folder)))
    return arcs.withColumn("weight", F.round("weight", 9))


@register("att_lattices", f"WITH {SAUSAGE} SELECT utt, src, dst, label, weight FROM arcs")
def att_lattices(spark: SparkSession, folder: str) -> DataFrame:
    """Sausages written as AT&T text, each where its turn is, and read again."""
    rows = segment.spread(turns(spark, folder).where("text <> ''")).select("utt", lattice.sausage_arcs(F.split("text", "")).alias("x"))
    return lattices.att(rows.select("utt", lattices.att_text(F.col("x")).alias("content")))[0]


@register("openfst_lattices", f"WITH {SAUSAGE} SELECT utt, src, dst, label, weight FROM arcs")
def openfst_lattices(spark: SparkSession, folder: str) -> DataFrame:
    arcs = sausages(spark, folder)
    names = stored(S.symbol_table(arcs.select(F.col("label").alias("sym"), F.col("label").alias("at"))), "symbols")
    return lattices.named(lattices.openfst(lattices.to_openfst(arcs, names))[0], names).drop("ilabel")


@register(
    "lattice_drawing",
    f"""WITH {BRANCHING} SELECT utt, 'digraph lattice {{' || chr(10) || string_agg(printf('  %d -> %d [label="%s/%.4f"];', src, dst, label, weight), chr(10) ORDER BY src, dst, label) || chr(10) || '}}' || chr(10) AS dot FROM arcs GROUP BY 1""",
)
def lattice_drawing(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.draw(branching_turns(spark, folder))


# --- sampling ---------------------------------------------------------------------------------


@register("shuffle_order", f"SELECT {UTT} AS utt, md5(({UTT}) || '-1-1') AS place FROM conversations")
def shuffle_order(spark: SparkSession, folder: str) -> DataFrame:
    return sampler.shuffled(turns(spark, folder), 1, 1).select("utt", "place")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(utt, text): the letters of each line of the documents; a line's number within all documents."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return rows.select((F.col("doc_id") * 100_000 + F.col("line")).alias("utt"), S.letters(F.col("l")).alias("text")).where("text <> ''")


@register("gibbs_iteration")
def gibbs_iteration(spark: SparkSession, folder: str) -> DataFrame:
    """One sweep over all lines of the documents, from unsegmented letters."""
    state = sampler.iterate(sampler.start(document_lines(spark, folder), 1, 2), sampler.Settings(alphabet=26))
    return state.segmentation.select("utt", F.array_join("words", " ").alias("words"))


@register("seating_totals")
def seating_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, tables and contexts by level of a drawn word bigram seating of the documents."""
    rows = table(spark, folder, "documents").select(S.words(F.col("text")).alias("words"))
    counts = stored(sampler.counted(rows, 2), "counts")
    words, chars = sampler.model_rows(counts, 2, 2, sampler.Hyper.start(2), sampler.Hyper.start(2), 1, 1, 26)
    return sampler.level_totals(words).withColumn("model", F.lit("word")).unionByName(sampler.level_totals(chars).withColumn("model", F.lit("character")))


# --- streams ----------------------------------------------------------------------------------


@register("stream_lexicon", f"WITH {LEXICON} SELECT word, n FROM lex")
def stream_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts kept over a stream of documents."""
    source = table(spark, folder, "documents")
    rows = segmenting.table_stream(spark, folder, "documents", source.schema)
    where = new_folder(spark, "stream-lexicon")
    segmenting.count_stream(rows, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return segmenting.latest_counts(spark, f"{where}/out")


@register("stream_segmentation", BEST_COST)
def stream_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as a stream, segmented with the lexicon of the documents."""
    source = table(spark, folder, "conversations")
    rows = segmenting.table_stream(spark, folder, "conversations", source.schema)
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), S.letters(F.col("text")).alias("text"))
    where = new_folder(spark, "stream-segmentation")
    costs = stored(segment.unigram_costs(stored(document_lexicon(spark, folder), "lexicon")), "stream-costs")
    segmenting.segment_stream(rows, costs, LETTER_COST, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("utt", F.round("cost", 6).alias("cost"))


@register(
    "rescored_lattices",
    f"""WITH {KN2}, {SAUSAGE},
before AS (SELECT DISTINCT utt, dst AS state, label AS ctx FROM arcs UNION SELECT DISTINCT utt, 0, '^' FROM arcs)
SELECT arcs.utt, arcs.src, CASE before.ctx WHEN '^' THEN '</unk>' ELSE before.ctx END AS src_ctx, arcs.dst, arcs.label AS dst_ctx, arcs.label,
       round(arcs.weight - ln(coalesce(p2.p, CASE WHEN s2.c_u IS NULL THEN p1.p ELSE ({THETA} + {D} * s2.t_u) * p1.p / ({THETA} + s2.c_u) END)), 6) AS weight
FROM arcs JOIN before ON before.utt = arcs.utt AND before.state = arcs.src JOIN p1 ON p1.w = arcs.label
LEFT JOIN s2 ON s2.ctx = before.ctx LEFT JOIN p2 ON p2.ctx = before.ctx AND p2.w = arcs.label""",
)
def rescored_lattices(spark: SparkSession, folder: str) -> DataFrame:
    """Sausages with a letter bigram model of the documents on top, a table for each letter after a letter."""
    levels = char_levels(spark, folder, 2)
    rows = [((*("</unk>" if c == "^" else c for c in r.ctx),), r.w, r.n, 1) for level in levels for r in level.collect()]  # letter pairs
    letters = sampler.Letters(rows, None, sampler.Hyper([D, D], [THETA, THETA]), sum(1 for c, *_ in rows if not c) - 1)
    out = lattice.rescored(sausages(spark, folder), letters)
    return out.withColumn("weight", F.round("weight", 6))


# A letter is drawn by the number that 52 bits of a digest of (seed, row, place) give.
DRAWN = f"""{LEXICON},
g3 AS (SELECT t[i:i + 1] AS ctx, t[i + 2] AS w, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT '^^' || word || '$' AS t FROM lex)) GROUP BY 1, 2),
{P123[len(GRAMS3) + 2:]},
m AS (SELECT ctx, w, sum(p) OVER (PARTITION BY ctx ORDER BY w) AS mass, sum(p) OVER (PARTITION BY ctx) AS whole, row_number() OVER (PARTITION BY ctx ORDER BY w DESC) = 1 AS at_last FROM p3),
r(no, word, ctx, ended) AS (SELECT no, '', '^^', false FROM (SELECT unnest(range(0, 10000)) AS no)
  UNION ALL
  SELECT no, CASE WHEN w = '$' THEN word ELSE word || w END, CASE WHEN w = '$' THEN ctx ELSE (ctx || w)[2:] END, w = '$' OR length(word) >= 199
  FROM (SELECT r.no, r.word, r.ctx, m.w FROM r JOIN m USING (ctx) WHERE NOT ended AND (mass > ('0x' || substr(md5('1-' || no || '-' || length(word)), 1, 13))::BIGINT / 4503599627370496.0 * whole OR at_last)
        QUALIFY row_number() OVER (PARTITION BY r.no ORDER BY m.w) = 1)),
words AS (SELECT no, max_by(word, length(word)) AS word FROM r GROUP BY 1)"""


@register("generate_words", f"WITH RECURSIVE {DRAWN} SELECT no, word FROM words")
def generate_words(spark: SparkSession, folder: str) -> DataFrame:
    """10,000 words from the letter trigrams of the document lexicon's words."""
    lex = document_lexicon(spark, folder)
    levels = ngrams.levels(ngrams.char_ngrams(lex.select(F.concat("word", F.lit("$")).alias("s")), F.col("s"), 3), 3)
    return generate.words(ngrams.predictive(levels).select("ctx", "w", "p"), 3, 10_000, seed=1)


@register(
    "generate_sentences",
    f"""WITH RECURSIVE {WORD_BIGRAMS},
m AS MATERIALIZED (SELECT ctx, w, sum(p) OVER (PARTITION BY ctx ORDER BY w) AS mass, sum(p) OVER (PARTITION BY ctx) AS whole, row_number() OVER (PARTITION BY ctx ORDER BY w DESC) = 1 AS at_last FROM p2),
r(no, ctx, place, ended, words) AS (SELECT no, '</s>', 0, false, '' FROM (SELECT unnest(range(0, 1000)) AS no)
  UNION ALL
  SELECT no, w, place + 1, w = '</s>' OR place >= 99, CASE WHEN w = '</s>' THEN words ELSE words || ' ' || w END
  FROM (SELECT r.*, m.w FROM r JOIN m USING (ctx) WHERE NOT ended AND (mass > ('0x' || substr(md5('2-' || no || '-' || place), 1, 13))::BIGINT / 4503599627370496.0 * whole OR at_last)
        QUALIFY row_number() OVER (PARTITION BY r.no ORDER BY m.w) = 1))
SELECT no, trim(max_by(words, place)) AS value FROM r GROUP BY 1""",
)
def generate_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 sentences over the words of the conversations."""
    return generate.sentences(word_bigrams(spark, folder), 1000, seed=2).select("no", F.array_join("words", " ").alias("value"))


@register(
    "length_modulation",
    f"""WITH RECURSIVE {DRAWN}, h AS (SELECT len + 1 AS length, sum(n) AS n FROM lex GROUP BY 1), a AS (SELECT sum(length * n) / sum(n) AS mean FROM h),
g AS (SELECT length(word) + 1 AS length, count(*) / 10000 AS share FROM words GROUP BY 1)
SELECT length, round(CASE WHEN length < 2 THEN 0 ELSE exp(-(mean - 2) + (length - 2) * ln(mean - 2) - lgamma(greatest(length - 1, 1))) / share END, 6) AS scale FROM g, a""",
)
def length_modulation(spark: SparkSession, folder: str) -> DataFrame:
    """Share of lengths of 10,000 words drawn from letter trigrams, and the factor that brings them
    to the Poisson of the lexicon's mean."""
    mean = lexicon.mean_length(lexicon.length_histogram(document_lexicon(spark, folder))).first()["mean"]
    shares = generate.length_shares(stored(generate_words(spark, folder), "generated"))
    return lexicon.length_scale(F.lit(mean), shares).select("length", F.round("scale", 6).alias("scale"))
