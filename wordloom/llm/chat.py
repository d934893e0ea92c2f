"""Chat formatting: tool calls linked to their results, ordered, checked and serialised.

``calls_of``, ``results_of`` and ``others_of`` read calls, results and all other messages; ``link``
hash-joins calls and results by (conversation, call id); ``levels`` places each call after those
that it refers to (a call whose arguments mention ``{"$result": "<id>"}`` comes after that call);
``problems`` validates arguments, with their JSON types, against the tool's schema; ``canonical``
serialises a row as canonical JSON: keys sorted at every depth, no white space, numbers and
literals as such, strings escaped minimally. ``format_chats`` gives all of them in topological
order: by conversation, then ``place`` (a call's own turn or, if later, that of a call it refers
to), level and turn. Everything is DataFrame functions; a conversation's rows are never gathered.

In messages, a call is ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`` in an
assistant's text (arguments may also be a string that holds JSON), a result a message of role
``tool`` with ``{"id": ..., "content": ...}``. A plain turn of a user counts as a call of the tool
``reply`` with the argument ``text``, answered by the assistant's turn that follows directly; so
every table of turns has links. What is neither, as a system's turn, another role's or the text
around an assistant's calls, is a row of kind ``message``.

Kinds of rows: ``call``, ``orphan`` (a result without a call), ``repeated`` (calls or results
beyond the first, by turn and place in it, of their kind and id; of equal rows one is the first)
and ``message``. Each call, result and message gives one row, but for a call's first result, whose
content and turn are in the call's row.

Defined cases: a null text is the empty text, a null role is ``user``; a call without a result is
kept with linked false; references to unknown calls or in a circle have level null, place null and
are invalid, and come last; rows with null conv_id, turn or id are kept and never link; a call or
result whose body isn't JSON (or repeats a key) has no id, and a result then keeps its text as
content; very long texts are single values; an empty table gives an empty table; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expr import let
from wordloom.session import stored

#: Tools and their arguments: name to (type, required). Types: string, integer, number, boolean,
#: null, array, object, any.
SCHEMAS = {"reply": {"text": ("string", True)}}
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
REFERENCE = r'\{\s*"\$result"\s*:\s*"((?:[^"\\]|\\.)+)"\s*\}'
#: Parts that the rows of one repeated id are dealt to.
SALT = 16

EVENT = ["conv_id", "call_id", "turn", "seq", "is_call", "role", "name", "arguments", "content"]


def quoted(text: Column) -> Column:
    """A JSON string: backslash, quote and control characters escaped, all else as it is."""
    plain = F.regexp_replace(text, r'([\\"])', r"\\$1")
    for code, short in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"\\{short}"))
    rare = plain
    for code in (*range(8), 11, *range(14, 32)):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(plain)
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form (a variant holds its keys sorted); null if it isn't JSON."""

    def lower(out: Column) -> Column:
        for code in (11, 14, 15, *range(26, 32)):  # escapes with a letter are in lower case
            out = F.regexp_replace(out, rf"((?<!\\)(?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
        return out

    written = F.to_json(F.try_parse_json(text))
    return let(written, lambda w: F.when(w.contains("\\u00"), lower(w)).otherwise(w))


def _turns(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _field(body: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(body)), path, kind)


def _has_calls() -> Column:
    return (F.col("role") == "assistant") & F.col("text").contains("<tool_call>")


def _event(rows: DataFrame, is_call: bool, **columns: Column) -> DataFrame:
    kinds = {"call_id": "string", "seq": "int", "name": "string", "arguments": "string", "content": "string"}
    own = {"is_call": F.lit(is_call)} | {c: columns.get(c, F.lit(None)).cast(k) for c, k in kinds.items()}
    return rows.select(*(own[c].alias(c) if c in own else F.col(c) for c in EVENT))


def calls_of(messages: DataFrame) -> DataFrame:
    """EVENT columns of the calls; arguments is canonical JSON, null if there are none or they aren't JSON."""
    turns = _turns(messages)
    marked = turns.where(_has_calls()).select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("at", "body"))
    given = F.coalesce(F.to_json(_field("body", "$.arguments", "variant")), F.lit(None).cast("string"))
    unwrapped = F.when(given.startswith('"'), _field("body", "$.arguments")).otherwise(given)
    marked = _event(marked, True, call_id=_field("body", "$.id"), seq=F.col("at"), name=_field("body", "$.name"), arguments=canonical_json(unwrapped))
    plain = turns.where(F.col("role") == "user")
    asked = F.concat(F.lit('{"text":'), quoted(F.col("text")), F.lit("}"))
    return marked.unionByName(_event(plain, True, call_id=F.concat(F.lit("turn-"), F.col("turn").cast("string")), seq=F.lit(0), name=F.lit("reply"), arguments=asked))


def results_of(messages: DataFrame) -> DataFrame:
    """EVENT columns of the results; content is JSON."""
    turns = _turns(messages)
    marked = turns.where(F.col("role") == "tool")
    found = canonical_json(F.to_json(_field("text", "$.content", "variant")))
    content = F.when(_field("text", "$.id").isNull(), quoted(F.col("text"))).otherwise(F.coalesce(found, F.lit("null")))
    marked = _event(marked, False, call_id=_field("text", "$.id"), seq=F.lit(0), content=content)
    plain = turns.where((F.col("role") == "assistant") & ~F.col("text").contains("<tool_call>"))
    return marked.unionByName(_event(plain, False, call_id=F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")), seq=F.lit(0), content=quoted(F.col("text"))))


def others_of(messages: DataFrame) -> DataFrame:
    """EVENT columns of all other messages."""
    turns = _turns(messages)
    rest = F.when(_has_calls(), F.trim(F.regexp_replace("text", CALL, " "))).otherwise(F.col("text"))
    rows = turns.where(~F.col("role").isin("user", "assistant", "tool") | _has_calls()).select("conv_id", "turn", "role", rest.alias("rest"))
    return _event(rows.where((F.col("rest") != "") | (F.col("role") != "assistant")), False, seq=F.lit(-1), content=quoted(F.col("rest")))


def _typed(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON type. A reference counts as any, its value being another's result."""
    name = F.schema_of_variant(value)
    number = name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    checks = {
        "string": name == "STRING",
        "integer": number & let(F.try_variant_get(value, "$", "double"), lambda x: x == F.floor(x)),
        "number": number,
        "boolean": name == "BOOLEAN",
        "null": name == "VOID",
        "array": name.startswith("ARRAY"),
        "object": name.startswith("OBJECT"),
        "any": F.lit(True),
    }
    return checks[kind] | F.try_variant_get(value, "$['$result']", "string").isNotNull()


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Faults of a call's arguments (JSON) against its tool's schema, as an array of strings."""
    value = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    whole = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), none)
    found = none
    for tool, fields in sorted(schemas.items()):
        faults = []
        for f, (kind, required) in sorted(fields.items()):
            own = F.try_variant_get(value, f"$['{f}']", "variant")
            given = F.array_contains(keys, f)
            missing = F.when(~given, F.lit(f"missing {f}")) if required else F.lit(None).cast("string")
            faults.append(F.when(given & ~F.coalesce(_typed(own, kind), F.lit(False)), F.lit(f"{f} isn't {kind}")).otherwise(missing))
        extra = F.transform(F.array_except(F.array_sort(keys), F.array(*map(F.lit, sorted(fields))).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*faults).cast("array<string>")), extra)).otherwise(found)
    shape = F.when(~whole, F.array(F.lit("arguments aren't an object"))).otherwise(none)
    tools = F.array(*map(F.lit, sorted(schemas))).cast("array<string>")
    unknown = F.when(F.coalesce(F.array_contains(tools, name), F.lit(False)), none).otherwise(F.array(F.lit("unknown tool")))
    return F.concat(shape, F.when(whole, found).otherwise(none), unknown)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, place of the calls (conv_id, call_id, turn, arguments; one each) that
    refer to others: level is one more than the highest referred to (0 without references), place
    the highest turn among a call and those. Calls in circles, or that refer to calls that aren't
    there, are missing. A round per level, over what still waits; each round stores its own calls."""
    needs = F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))
    referring = calls.where(F.col("arguments").contains('"$result"')).select("conv_id", "call_id", "turn", needs.alias("needs")).where(F.size("needs") > 0)
    waiting = stored(referring.select("conv_id", "call_id", F.col("turn").alias("place"), "needs"), "chat-waiting")
    wanted = waiting.select("conv_id", F.explode("needs").alias("call_id")).distinct()
    free = calls.join(waiting.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(wanted, ["conv_id", "call_id"], "left_semi")
    newest = free.select("conv_id", "call_id", F.col("turn").alias("place"))
    out, level = None, 0
    while True:
        level += 1
        met = waiting.select("conv_id", "call_id", F.explode("needs").alias("need")).join(newest.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("need_place")), ["conv_id", "need"])
        met = met.groupBy("conv_id", "call_id").agg(F.collect_set("need").alias("met"), F.max("need_place").alias("need_place"))
        left = F.array_except("needs", F.coalesce("met", F.array().cast("array<string>")))
        state = stored(waiting.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("place", "need_place").alias("place"), left.alias("needs")), "chat-waiting")
        newest = state.where(F.size("needs") == 0).select("conv_id", "call_id", "place")
        if newest.isEmpty():
            return out if out is not None else newest.withColumn("level", F.lit(0))
        own = newest.withColumn("level", F.lit(level))
        out = own if out is None else out.unionByName(own)
        waiting = state.where(F.size("needs") > 0)


def link(events: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """Rows of kind call, repeated and orphan from calls and results (EVENT columns)."""
    schemas = schemas or SCHEMAS
    keys = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    body = [c for c in EVENT if c not in (*keys, "is_call")]
    first = lambda calls: F.min(F.when(F.col("is_call") == calls, F.struct("turn", "seq", *(c for c in body if c not in ("turn", "seq")))))
    linkable = stored(events.where(keyed), "chat-events")
    grouped = linkable.groupBy(*keys).agg(first(True).alias("c"), first(False).alias("r"), F.count(F.when(F.col("is_call"), 1)).alias("n_calls"), F.count(F.when(~F.col("is_call"), 1)).alias("n_results"))
    grouped = stored(grouped, "chat-linked")

    # calls, with the level of those that refer to others
    calls = grouped.where("c is not null").select(*keys, "c.*", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("answer")).withColumn("content", F.col("answer")).drop("answer")
    refers = F.coalesce(F.col("arguments").contains('"$result"'), F.lit(False)) & (F.size(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))) > 0)
    plain = calls.where(~refers).withColumn("level", F.lit(0)).withColumn("place", F.col("turn"))
    placed = calls.where(refers).join(levels(calls), keys, "left").select(*plain.columns)
    calls = plain.unionByName(placed).withColumn("kind", F.lit("call"))

    orphans = grouped.where("c is null").select(*keys, "r.*").withColumn("kind", F.lit("orphan")).withColumn("result_turn", F.col("turn"))
    loose = events.where(~keyed).withColumn("kind", F.when(F.col("is_call"), "call").otherwise("orphan"))
    loose = loose.withColumn("level", F.when(F.col("is_call"), 0)).withColumn("result_turn", F.when(~F.col("is_call"), F.col("turn"))).drop("is_call")

    # what repeats: the rows of such ids dealt to SALT parts, of equal rows one less if they are the first
    salt = F.pmod(F.xxhash64("turn", "seq", "arguments", "content"), F.lit(SALT))
    many = grouped.where("n_calls > 1 or n_results > 1").select(*keys, "c", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt"))
    again = linkable.withColumn("salt", salt).join(many, [*keys, "salt"])
    again = again.groupBy(*EVENT, "c", "r").agg(F.count(F.lit(1)).alias("n"))
    own = F.struct("turn", "seq", *(c for c in body if c not in ("turn", "seq")))
    left = F.col("n") - F.when(own.eqNullSafe(F.when(F.col("is_call"), F.col("c")).otherwise(F.col("r"))), 1).otherwise(0)
    repeated = again.select(*EVENT, F.explode(F.array_repeat(F.lit("repeated"), left.cast("int"))).alias("kind"))
    repeated = repeated.withColumn("result_turn", F.when(~F.col("is_call"), F.col("turn"))).drop("is_call")

    rows = calls.unionByName(orphans, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True).unionByName(repeated, allowMissingColumns=True)
    is_call = F.col("name").isNotNull() | F.col("arguments").isNotNull() | (F.col("kind") == "call")
    rows = rows.withColumn("place", F.when((F.col("kind") == "call") & F.col("level").isNull(), F.col("place")).otherwise(F.coalesce("place", "turn")))
    rows = rows.withColumn("linked", F.when(F.col("kind") == "call", F.col("result_turn").isNotNull())).withColumn("problems", F.when(is_call, problems(F.col("name"), F.col("arguments"), schemas)))
    return rows.withColumn("valid", F.when(F.col("kind") == "call", (F.size("problems") == 0) & F.col("level").isNotNull()))


def canonical(rows: DataFrame) -> DataFrame:
    """Adds message, the canonical JSON of a row."""
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    fields = [("arguments", plain("arguments")), ("call_id", text("call_id")), ("content", plain("content")), ("kind", text("kind")), ("level", plain("level")), ("name", text("name")), ("role", text("role")), ("turn", plain("turn"))]
    parts = [x for k, v in fields for x in (F.lit(f'{"," if k != "arguments" else "{"}{json.dumps(k)}:'), v)]
    return rows.withColumn("message", F.concat(*parts, F.lit("}")))


def format_chats(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, call_id, turn, kind, role, name, level, place, linked, result_turn, problems, valid,
    arguments, content and message of every row, in topological order."""
    linked = link(calls_of(messages).unionByName(results_of(messages)), schemas)
    others = others_of(messages).drop("is_call").withColumn("kind", F.lit("message")).withColumn("place", F.col("turn"))
    rows = canonical(linked.unionByName(others, allowMissingColumns=True))
    out = rows.select("conv_id", "call_id", "turn", "seq", "kind", "role", "name", "level", "place", "linked", "result_turn", "problems", "valid", "arguments", "content", "message")
    return out.orderBy("conv_id", F.col("place").asc_nulls_last(), F.coalesce("level", F.lit(0)), "turn", "seq", "call_id").drop("seq")
