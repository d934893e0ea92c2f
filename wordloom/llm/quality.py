"""Quality rules as a bit-mask ledger.

``ledger`` measures each text once and sets one failure bit per rule. ``apply_policy`` reads bits
only, so that a policy (a named, versioned set of rules) can be changed, compared and ablated
without touching texts again; ``ablation`` counts with bitwise aggregates. Everything is a row-wise
expression: no shuffle, no Python.

Words are runs of characters other than the space and U+0009 to U+000D; characters are code points.
Defined cases: a null or empty text has no words and fails ``few_words``; very long texts are
handled in place with memory in proportion to the text; repeated rows are judged alike; null doc_ids
pass through; a measure equal to a bound doesn't fail; an empty table gives an empty table; columns of
the input other than doc_id and text are ignored by ``ledger`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expr import let

WINDOW_WORDS = 8
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
NOT_UPPER = r"[^A-ZÀ-ÖØ-Þ]+"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # a SQL predicate over the measurements


#: The place of a rule is its bit; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("shouting", "100 * n_upper > 30 * word_chars"),
    Rule("stutter", "100 * n_stutter > 20 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
)

#: Policy versions: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "v1"


def policy_mask(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of eight that occur twice or more. A window's hash is built by
    doubling: pairs of words, pairs of pairs, pairs of those."""

    def paired(h: Column, step: int) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(1 + step), F.size(h) - step), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]) & F.get(p, k + 1).isNotNull()))
        starts = F.array_sort(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"]))
        first = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(starts, first, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW_WORDS), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered(windows))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: let(paired(h1, 1), lambda h2: let(paired(h2, 2), lambda h4: let(paired(h4, 4), counted))))
    return F.when(F.size(words) <= WINDOW_WORDS, F.lit(0).cast("bigint")).otherwise(hashed)


def measurements(text: Column) -> Column:
    """A struct of all measurements of a text."""

    def of_words(words: Column, whole: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(whole, NOT_SYMBOL, "")).cast("bigint").alias("n_symbols"),
            F.length(F.regexp_replace(whole, NOT_UPPER, "")).cast("bigint").alias("n_upper"),
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)).cast("bigint").alias("n_stutter"),
        )

    return let(
        F.coalesce(text, F.lit("")),
        lambda whole: let(
            F.array_remove(F.split(whole, SPACE, -1), ""),
            lambda words: let(F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0), lambda lines: of_words(words, whole, lines)),
        ),
    )


def failures(measured: str) -> Column:
    """The bit mask of failed rules over the struct column ``measured``."""
    bits = [F.when(F.expr(_within(r.fails, measured)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, r in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def _within(predicate: str, struct: str) -> str:
    import re

    return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{struct}.\1", predicate)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement, and ``failed``, the bit mask of failed rules, one row per row."""
    # The measured struct passes through an array, so that the optimizer can't copy its expression
    # into each of its readers.
    measured = docs.select("doc_id", measurements(F.col("text")).alias("m"))
    return measured.select("doc_id", "m", failures("m").alias("failed")).select("doc_id", "m.*", "failed")


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds base_failed and kept to a ledger."""
    failed = F.col("failed")
    return rows.select("*", (failed.bitwiseAND(F.lit(policy_mask("base"))) != 0).alias("base_failed"), (failed.bitwiseAND(F.lit(policy_mask("base") | policy_mask(policy))) == 0).alias("kept"))


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects (which would come
    back without it). One aggregation, by bits of the ledger."""
    mask = F.col("failed").bitwiseAND(F.lit(policy_mask(policy)))
    names = [r.name for r in RULES if r.name in POLICIES[policy]]
    bit = {r.name: 1 << i for i, r in enumerate(RULES)}
    sums = rows.select(mask.alias("f")).agg(
        *(F.count(F.when(F.col("f").bitwiseAND(F.lit(bit[n])) != 0, 1)).alias(f"failed_{n}") for n in names),
        *(F.count(F.when(F.col("f") == bit[n], 1)).alias(f"only_{n}") for n in names),
    )
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only")) for n in names))).alias("r")).select("r.*")


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all columns and no others."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    mask = F.lit(policy_mask("base") | policy_mask(policy))
    measured = docs.withColumn(name, measurements(F.col("text")))
    return measured.where(failures(name).bitwiseAND(mask) == 0).select(*docs.columns)
