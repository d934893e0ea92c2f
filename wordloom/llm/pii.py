"""Personal data by fixed patterns and bootstrapped contexts, in DataFrame functions only.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns and
checks. Bootstrapping: the base entities and self-evident secrets (long hexadecimal strings, key
ids) are seeds, wherever they stand. A *candidate* is a token with a digit, of any length, that
follows a cue, either ``name = "`` or ``name:`` or two plain words, of any length too; its cue is the
*pattern*, its text the *instance*. Tokens of fewer than ``min_evidence`` characters (a parameter) are
no instances, since a figure such as 7 stands behind countless cues and would tie them together; behind
a trusted cue they are found like any other. Seeds behind a cue are instances whatever their shape. Over
the bipartite graph of patterns and instances, seeds start with score 1; a pattern's score is the mean score of
its instances, shrunk for small support, an instance's score is one minus the product of (1 - score)
over its patterns, and a few rounds of both follow. Candidates of patterns that score at least
``MIN_SCORE`` and hold at least ``MIN_SEEDS`` distinct seeds become spans of kind ``secret``, as do
the secret seeds themselves, unless they overlap a base span. Patterns never cross lines and matching never looks back over a run, so
scanning is linear in the text.

Documents are keyed by (doc_id, hash of the text) in the graph, so repeated rows share their spans.
Defined cases: a null or empty text has no spans; null doc_ids pass through; adjacent and repeated
entities are each their own span; very long texts keep positions by prefix sums; extra columns are
ignored by ``spans`` and kept by ``redact``. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import keyed
from wordloom.llm.expr import found_spans, let
from wordloom.session import stored

KINDS = ("email", "ip", "card", "phone")
FOUND = "secret"

# Equal to the contract's patterns match for match. A possessive run doesn't give back what can't
# help; a match may only begin inside a run where the former match ended (\G), as elsewhere it
# would have begun with the run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
IP_PART = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

#: Forms of a cue. Each is searched by itself, so that a token behind one form never hides the other.
CUES = (r"(?<![A-Za-z0-9_])[A-Za-z_]{2,}+\x20?[=:]\x20?[\"']?", r"(?<![A-Za-z0-9_])[A-Za-z]{2,}+\x20[A-Za-z]{2,}+\x20")
CUE = "(?:" + "|".join(CUES) + ")"
TOKEN = r"(?=[A-Za-z@._%+/-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9@._%+/-]*+"
CANDIDATES = tuple(f"({c})({TOKEN})" for c in CUES)
SEED = r"^(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+|AKIA[0-9A-Z]{12,20})$"
#: A seed anywhere. Digits alone are no evident secret without a cue.
BARE_SEED = r"(?<![A-Za-z0-9_])(?:(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+)|AKIA[0-9A-Z]{12,20}+)(?![A-Za-z0-9_])"

ROUNDS = 3
MIN_SCORE = 0.7
MIN_SEEDS = 5
SHRINK = 1.0
#: Default of the parameter: shorter tokens are found, but say nothing about their cue.
MIN_EVIDENCE = 7
TAG = {k: f"[{k.upper()}]" for k in (*KINDS, FOUND)}

SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    marks = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(marks, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0))),
        F.lit(0),
        lambda acc, v: acc + v,
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(IP_PART))
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & luhn(F.when(F.length(d).between(14, 19), d).otherwise(F.lit("1"))))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


HITS = "array<struct<s:bigint,k:int,e:bigint,m:string,l:string>>"


def _hits(text: Column) -> Column:
    """Base spans and seeds of a text as structs (s, k, e, m, l), k being the place in KINDS (seeds:
    one more), with the matched text and the characters before it; sorted."""

    def of(k: int, kind: str) -> Column:
        pattern = PATTERNS.get(kind, BARE_SEED)
        hits = F.filter(found_spans(text, pattern, with_left=True), lambda x: _valid(kind, x["m"]))
        spans = F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l")))
        has = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]" if kind != FOUND else "[0-9A-Fa-f]{16}|AKIA")
        return F.when(has, spans).otherwise(F.array().cast(HITS))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate((*KINDS, FOUND)))))


def _base(hits: Column) -> Column:
    """The base spans among hits, as structs (s, k, e)."""
    return F.transform(F.filter(hits, lambda x: x["k"] < len(KINDS)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _cue(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\x20+", " "))


def _candidates(text: Column, hits: Column) -> Column:
    """Structs (s, e, cue, token, plain) of the candidates of a text, and of its base spans behind a
    cue and its seeds, whatever their shape (cue null: none). plain: a seed by its own form."""

    def splitter(pattern: str) -> Callable[[Column], Column]:
        return lambda hit: split(hit, F.regexp_extract(hit["m"], f"^{pattern}$", 1))

    def split(hit: Column, cue: Column) -> Column:
        token = lambda c: F.substring(hit["m"], F.length(c) + 1, F.length(hit["m"]))
        return let(cue, lambda c: F.struct((hit["s"] + F.length(c)).alias("s"), hit["e"].alias("e"), _cue(c).alias("cue"), token(c).alias("token"), token(c).rlike(SEED).alias("plain")))

    def own(x: Column) -> Column:
        cue = F.nullif(F.regexp_extract(x["l"], rf"{CUE}\z", 0), F.lit(""))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), _cue(cue).alias("cue"), x["m"].alias("token"), (x["k"] == len(KINDS)).alias("plain"))

    empty = F.array().cast("array<struct<s:bigint,e:bigint,cue:string,token:string,plain:boolean>>")
    behind = F.filter(F.transform(hits, own), lambda x: x["plain"] | x["cue"].isNotNull())
    after = [F.transform(found_spans(text, p), splitter(p)) for p in CANDIDATES]
    return F.concat(F.when(text.rlike("[0-9]"), F.concat(*after)).otherwise(empty), behind)


def _overlaps(spans: Column, s: Column, e: Column) -> Column:
    return F.exists(spans, lambda x: (x["s"] < e) & (s < x["e"]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans) and candidates of each row; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("body"))
    rows = rows.select("*", _hits(F.col("body")).alias("hits"))
    return rows.select("doc_id", "text_hash", _base(F.col("hits")).alias("base"), _candidates(F.col("body"), F.col("hits")).alias("candidates"))


def trusted_patterns(candidates: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(cue, score, seeds) of the patterns to trust. ``candidates``: cue, token, seed (boolean)."""
    edges = stored(candidates.groupBy("cue", "token").agg(F.max("seed").alias("seed")), "pii-edges")
    # a pattern without a seed's neighbourhood can only fall to zero; all stay in the graph
    scores = edges.select("cue", "token", F.col("seed").cast("double").alias("score"))
    for n in range(rounds):
        patterns = scores.groupBy("cue").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(SHRINK))).alias("pattern_score"))
        if n == rounds - 1:
            break
        joined = edges.join(patterns, "cue")
        tokens = joined.groupBy("token").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("pattern_score"), F.lit(1e-12)))))).alias("token_score"))
        scores = edges.join(tokens, "token").select("cue", "token", F.when(F.col("seed"), 1.0).otherwise(F.col("token_score")).alias("score"))
    seeds = edges.groupBy("cue").agg(F.count(F.when(F.col("seed"), 1)).alias("seeds"))
    return patterns.join(seeds, "cue").where((F.col("pattern_score") >= min_score) & (F.col("seeds") >= min_seeds)).select("cue", F.col("pattern_score").alias("score"), "seeds")


def with_spans(scanned: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """doc_id, text_hash, base and spans (all spans, sorted) of the rows of ``scan``, which must be
    stored: it is read twice."""
    found = scanned.where(F.size("candidates") > 0).select("doc_id", "text_hash", "base", F.explode("candidates").alias("c"))
    # a span found in two ways is one row
    found = found.groupBy("doc_id", "text_hash", "base", F.col("c.s").alias("s"), F.col("c.e").alias("e")).agg(F.max(F.struct("c.cue", "c.token")).alias("c"), F.max("c.plain").alias("plain"))
    found = found.select("doc_id", "text_hash", "s", "e", "c.*", "plain", _overlaps(F.col("base"), F.col("s"), F.col("e")).alias("known"), F.exists("base", lambda x: (x["s"] == F.col("s")) & (x["e"] == F.col("e"))).alias("own"))
    # of spans that start together, as a seed and the token it begins, one is an instance: the seed
    one = F.max(F.struct((F.col("known") | F.col("plain")).alias("seed"), "e", "cue", "token")).alias("i")
    evidence = (F.length("token") >= min_evidence) | F.col("plain") | F.col("own")
    seeds = found.where(F.col("cue").isNotNull() & evidence).groupBy("doc_id", "text_hash", "s").agg(one).select("i.cue", "i.token", "i.seed")
    trusted = stored(trusted_patterns(seeds), "pii-patterns")
    new = found.where(~F.col("known")).join(trusted.select("cue", F.lit(True).alias("trusted")), "cue", "left").where(F.col("plain") | F.col("trusted"))
    span = F.struct(F.col("s"), F.lit(len(KINDS)).alias("k"), F.col("e"))
    by_doc = new.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(span).alias("more"))
    joined = scanned.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    everything = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    return joined.select("doc_id", "text_hash", "base", everything.alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    return with_spans(stored(scan(docs), "pii-scan"), min_evidence)


def _redacted(text: Column, found: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by a tag."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(SPANS).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["end"]
        grown = F.concat(F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1), F.array(let(F.element_at(acc["kept"], -1), lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), F.greatest(y["e"], x["e"]).alias("e")))))
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), F.when(fresh, F.concat(acc["kept"], F.array(x))).otherwise(grown).alias("kept"))

    def joined(kept: Column) -> Column:
        tags = F.array(*(F.lit(TAG[k]) for k in (*KINDS, FOUND)))
        cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        parts = F.transform(kept, lambda x, i: F.concat(cut(F.coalesce(F.get(kept, i - 1)["e"], F.lit(0).cast("bigint")), x["s"]), F.get(tags, x["k"])))
        tail = cut(F.element_at(kept, -1)["e"], F.length(text).cast("bigint"))
        return F.concat(F.array_join(parts, ""), tail)

    return F.when(F.size(found) == 0, text).otherwise(let(F.aggregate(found, start, step, lambda acc: acc["kept"]), joined))


def redact(docs: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """All rows and columns of ``docs``, spans in text replaced by tags; n_chars, if there, follows
    the new text."""
    found = spans(docs, min_evidence).where(F.size("spans") > 0).select("doc_id", "text_hash", F.col("spans").alias("_pii_spans")).distinct()
    maybe, others = keyed.with_values(docs, stored(found, "pii-found"), "_pii_spans")
    text = F.when(F.col("_pii_spans").isNull(), maybe["text"]).otherwise(_redacted(maybe["text"], F.coalesce("_pii_spans", F.array().cast(SPANS))))
    out = others.union(maybe.select(*(text.alias(c) if c == "text" else maybe[c] for c in docs.columns)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
