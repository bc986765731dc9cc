"""Chat formatting: tool calls are linked with their results, ordered, validated and serialised, with DataFrame operations only.

Calls and results are hash-joined by conversation and call id. Calls name the calls that they depend on; the level of a
call is the length of the longest chain of dependencies before it, so levels are a topological order. Chains of calls
with one dependency each are followed by doubling, in as many rounds as the logarithm of their length; only calls with
several dependencies are peeled, a round for each that stands behind another. Both find cycles. Arguments are parsed as
variants and checked against a JSON schema; the canonical form has sorted keys, no white space and UTF-8.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import only, shared_folder

#: Variant types that a JSON schema's type allows.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*", "null": "^VOID$"}

#: Keywords that schema_errors() checks, and those that say nothing of validity.
_OF_OBJECT, _OF_KEY = {"type", "properties", "required", "additionalProperties"}, {"type", "enum", "minLength", "maxLength", "minimum", "maximum"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}

#: The tools of turns_as_calls().
TURN_TOOLS = {
    "ask": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False},
    "configure": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}, "required": ["text", "turn"], "additionalProperties": False},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from chat turns (conv_id, turn, role, text).

    A system turn calls `configure` and a user turn `ask`, with the text (left out if null) and the turn as arguments and
    the turn as id. An assistant turn is the result of the turn before it. A user turn depends on the call two turns
    before, or on turn 0 if it is turn 1. Turns of other roles or without a number are neither.
    """
    t = only(turns, conv_id="conv_id", turn="turn", role="role", text="text").where("turn is not null")
    name = F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "ask")
    needs = F.when((F.col("role") != "user") | (F.col("turn") < 1), F.array().cast("array<string>")).when(F.col("turn") == 1, F.array(F.lit("0"))).otherwise(F.array((F.col("turn") - 2).cast("string")))
    calls = t.where("role in ('system', 'user')").select("conv_id", F.col("turn").cast("string").alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), needs.alias("depends_on"))
    results = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def _typed(kind: Column, wanted: str | list[str]) -> Column:
    return kind.rlike("|".join(_TYPES[t] for t in ([wanted] if isinstance(wanted, str) else wanted)))


def _path(key: str) -> str:
    """The path of a key; raises ValueError if it has quotes of both kinds, which paths can't hold."""
    if "'" in key and '"' in key:
        raise ValueError(f"{key}: keys with quotes of both kinds aren't supported")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def schema_errors(arguments: Column, schema: dict) -> Column:
    """The violations of a schema (object with properties, required, additionalProperties; type, enum, lengths, bounds), sorted.

    A schema with other keywords raises ValueError, as they would go unchecked.
    """
    for place, rule, known in (("schema", schema, _OF_OBJECT), *((k, r, _OF_KEY) for k, r in schema.get("properties", {}).items())):
        if unknown := set(rule) - known - _NOTES:
            raise ValueError(f"{place}: unsupported keywords {sorted(unknown)}")
    if schema.get("type", "object") != "object" or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("schema: only type object, and additionalProperties true or false, are supported")
    v = F.try_parse_json(arguments)
    found: list[Column] = [F.when(v.isNull(), "not JSON"), F.when(v.isNotNull() & ~_typed(F.schema_of_variant(v), "object"), "not an object")]
    for key in schema.get("required", []):
        found.append(F.when(v.isNotNull() & F.try_variant_get(v, _path(key), "variant").isNull(), f"{key}: missing"))
    for key, rule in schema.get("properties", {}).items():
        path = _path(key)
        own = F.try_variant_get(v, path, "variant")
        kind, text, number = F.schema_of_variant(own), F.try_variant_get(v, path, "string"), F.try_variant_get(v, path, "double")
        if "type" in rule:
            found.append(F.when(own.isNotNull() & ~_typed(kind, rule["type"]), f"{key}: type"))
        if "enum" in rule:
            found.append(F.when(own.isNotNull() & ~F.to_json(own).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in rule["enum"]]), f"{key}: enum"))
        is_text, is_number = _typed(kind, "string"), _typed(kind, "number")
        for name, broken in (("minLength", is_text & (F.length(text) < rule.get("minLength", 0))), ("maxLength", is_text & (F.length(text) > rule.get("maxLength", 0))), ("minimum", is_number & (number < rule.get("minimum", 0))), ("maximum", is_number & (number > rule.get("maximum", 0)))):
            if name in rule:
                found.append(F.when(own.isNotNull() & broken, f"{key}: {name}"))
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {})) or [""]
        extra = F.filter(F.json_object_keys(arguments), lambda k: ~k.isin(known))
        unknown = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        return F.array_sort(F.concat(F.array_compact(F.array(*found)), unknown))
    return F.array_sort(F.array_compact(F.array(*found)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of each distinct call of (conv_id, call_id, seq, depends_on).

    The level is the length of the longest chain of dependencies before a call, and null for calls on a cycle or behind
    one. Dependencies on unknown calls are left out; those of a repeated call are taken together.
    """
    spark, key = calls.sparkSession, ["conv_id", "call_id"]
    folder = shared_folder(spark, "levels")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    ids = calls.select(*key).distinct()
    wanted = calls.select(*key, F.explode("depends_on").alias("parent")).distinct()
    edges = wanted.join(ids.withColumnRenamed("call_id", "parent").hint("shuffle_hash"), ["conv_id", "parent"])
    parents = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("parent").alias("to"))
    state = kept("state", ids.join(parents.hint("shuffle_hash"), key, "left").withColumn("n", F.coalesce("n", F.lit(0))))
    done = state.where("n = 0").select(*key, F.lit(0).cast("long").alias("level"))

    # Calls with one dependency: `to` is the call `dist` steps before; it goes on until that one has none or several.
    chain, k = kept("chain-0", state.where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("going"))), 0
    longest = state.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 0
    while 1 << k <= 2 * longest and not chain.where("going").isEmpty():
        ahead = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        met = chain.join(ahead.hint("shuffle_hash"), ["conv_id", "to"], "left")
        k += 1
        chain = kept(f"chain-{k}", met.select(*key, F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("going")))
    ended = chain.where("not going").select(*key, "to", "dist")  # those that still go are on a cycle or behind one

    # Calls with several: a round for those all of whose dependencies, or their chains' ends, are placed.
    knots = state.where("n > 1").select(*key)
    if not knots.isEmpty():
        own = edges.join(knots.hint("shuffle_hash"), key, "left_semi")
        through = own.join(chain.select("conv_id", F.col("call_id").alias("parent"), "to", "dist", "going").hint("shuffle_hash"), ["conv_id", "parent"], "left")
        weights = kept("knots-0", through.select(*key, F.coalesce("to", "parent").alias("to"), F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("going", F.lit(False)).alias("never")))
        placed, j = kept("placed-0", done), 0
        while True:
            seen = weights.join(placed.select("conv_id", F.col("call_id").alias("to"), "level").hint("shuffle_hash"), ["conv_id", "to"], "left")
            ready = seen.groupBy(*key).agg(F.max(F.col("dist") + 1 + F.col("level")).alias("level"), F.max(F.col("level").isNull() | F.col("never")).alias("waits")).where("not waits").select(*key, "level")
            ready = kept(f"ready-{j}", ready)
            if ready.isEmpty():
                break
            j += 1
            placed = kept(f"placed-{j}", placed.union(ready))
            weights = kept(f"knots-{j}", weights.join(ready.hint("shuffle_hash"), key, "left_anti"))
        done = placed
    behind = ended.join(done.select("conv_id", F.col("call_id").alias("to"), "level").hint("shuffle_hash"), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    return ids.join(done.union(behind).hint("shuffle_hash"), key, "left").select(*key, "level", F.col("level").isNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """A row for each call: conv_id, call_id, level, seq, name, valid, errors (joined by '; '), linked, record.

    `calls` has conv_id, call_id, seq, name, arguments (JSON), depends_on (ids); `results` has conv_id, call_id, seq and
    content. `level`, then `seq`, is a topological order of a conversation's calls. `record` is the canonical JSON of the
    call: arguments (null if they aren't JSON), id, name and result (null if there is none). Of several results of one call
    the first by seq counts. A call that is repeated keeps its rows, all with the same result. Null names and names
    without a tool are errors; calls with a null conversation or id are left out, as nothing can be linked with them, and so are
    results without a call. Other columns are left out.
    """
    calls = only(calls, conv_id="conv_id", call_id="call_id", seq="seq", name="name", arguments="arguments", depends_on="depends_on").where("conv_id is not null and call_id is not null")
    first = only(results, conv_id="conv_id", call_id="call_id", seq="seq", content="content").where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "content")).alias("result"))
    errors: Column = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(tools.items()):
        errors = F.when(F.col("name") == tool, schema_errors(F.col("arguments"), schema)).otherwise(errors)
    joined = calls.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    placed = joined.join(levels(calls).hint("shuffle_hash"), ["conv_id", "call_id"])
    errors = F.concat(errors, F.when(F.col("cyclic"), F.array(F.lit("cyclic"))).otherwise(F.array().cast("array<string>")))
    text = lambda c: F.when(F.col(c).isNull() if isinstance(c, str) else c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    record = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text(F.col("result.content")), F.lit("}"))
    return placed.withColumn("found", errors).select("conv_id", "call_id", "level", "seq", "name", (F.size("found") == 0).alias("valid"), F.array_join("found", "; ").alias("errors"), F.col("result").isNotNull().alias("linked"), record.alias("record"))
