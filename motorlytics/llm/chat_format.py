"""Chat formatting: tool calls linked with their results, ordered, checked, serialised.

* Linking: calls and results meet in a hash join on (conversation, identifier), both
  sides made unique first by pre-aggregated minima.
* Order: a call stands after the calls whose results it uses. Calls are peeled off in
  rounds of joins (as many as the longest chain of uses): level 0 uses nothing, level n
  something of level n - 1. Each round is written to the shared folder. Sorting a
  conversation by (level, turn, part) is a topological order; a conversation of any
  size stays spread over tasks, since no step needs it together.
* Arguments are parsed once into a variant and checked against their tool's parameters.
* Canonical JSON: keys sorted at every level, no white space, only what JSON requires
  escaped, one text for each number with all its digits: no leading or trailing zeros,
  no ``-0``, plain for a point up to 21 places right or 6 left of the first digit, else
  ``d.ddde+x``. (An exponent of over 15 digits stays as written.) A variant would round
  numbers, so they pass through it as marked strings.
* A number is an integer by its value: ``100``, ``100.0`` and ``1e2`` are the same.

Only built-in functions are used. Defined results: a null identifier links with
nothing (status ``no_id``); of calls, or results, that share an identifier the first by
turn, then by text counts and the others are ``duplicate``; whole rows repeated are
``duplicate`` too, reported once; a result without a call is ``orphan``, a call without
a result ``unanswered``; uses of unknown calls are reported and not waited for; calls
that use each other, or themselves, and what depends on them get a null level and the
error ``cycle``; turns of other roles, or none, are ``message`` rows of level 0, once for
each distinct turn, a null role left out of their JSON; null arguments are an empty
object, unreadable ones an error and null; an unknown or null tool is an error; null texts are empty; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlytics.llm.common import broadcast_if_small, stored

CALLS = ["conv_id", "turn", "call_id", "name", "arguments", "uses"]
RESULTS = ["conv_id", "turn", "call_id", "content"]
#: JSON type -> pattern of the kind of a value (Spark's name for a variant's type, or that of a marked number).
TYPES = {"string": "^STRING", "integer": "^INTEGER", "number": "^(INTEGER|NUMBER)", "boolean": "^BOOLEAN",
         "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}
MESSAGES = ["conv_id", "turn", "role", "content"]
#: A JSON text in pieces: strings, numbers, what lies between. Possessive, so that long strings need no stack.
PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
#: First characters of the strings that stand for numbers, and of strings that begin like one of them.
NUMBER, STRING = "\\u0001n", "\\u0001s"


def canonical_number(text: Column) -> Column:
    """One text for each number, from any JSON spelling of it."""
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)
    whole, fraction = part(r"^-?([0-9]+)", 1), part(r"\.([0-9]+)", 1)
    written = part(r"[eE]\+?(-?[0-9]+)$", 1)
    shift = F.when(written == "", F.lit(0).cast("long")).when(F.length(written) <= 15, written.cast("long"))
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    # places of the point right of the first digit
    point = F.length(digits) - F.length(fraction) + shift
    digits = F.regexp_replace(digits, "0+$", "")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    rest = lambda k: F.substr(digits, k.cast("int") + 1)
    power = point - 1
    scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), rest(F.lit(1)))).otherwise(""),
                          F.when(power < 0, "e").otherwise("e+"), power.cast("string"))
    size = (F.when(n == 0, "0").when((point >= n) & (point <= 21), F.concat(digits, zeros(point - n)))
            .when((point > 0) & (point <= 21), F.concat(F.left(digits, point.cast("int")), F.lit("."), rest(point)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits)).otherwise(scientific))
    return F.when(shift.isNull(), text).otherwise(F.concat(F.when(text.startswith("-") & (n > 0), "-").otherwise(""), size))


def marked(json: Column) -> Column:
    """JSON text with its numbers written as marked strings of their canonical text."""
    def piece(p: Column) -> Column:
        return (F.when(p.rlike("^-?[0-9]"), F.concat(F.lit(f'"{NUMBER}'), canonical_number(p), F.lit('"')))
                .when(p.startswith('"\\u0001'), F.concat(F.lit(f'"{STRING}'), F.substr(p, F.lit(8)))).otherwise(p))
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(PIECES), F.lit(0)), piece), "")


def unmarked(json: Column) -> Column:
    """The inverse of ``marked`` on canonical text."""
    def piece(p: Column) -> Column:
        return (F.when(p.startswith(f'"{NUMBER}'), F.regexp_replace(F.substr(p, F.lit(9)), '"$', ""))
                .when(p.startswith(f'"{STRING}'), F.concat(F.lit('"\\u0001'), F.substr(p, F.lit(9)))).otherwise(p))
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(PIECES), F.lit(0)), piece), "")


def first_of(rows: DataFrame, rest: list[str]) -> DataFrame:
    """Rows with ``status`` null for the first of its (conv_id, call_id), ``duplicate``
    for another and ``no_id`` without one. A repeated whole row is told by its number."""
    whole = rows.groupBy("conv_id", "call_id", "turn", *rest).agg(F.count("*").alias("copies"))
    rank = F.struct("turn", F.xxhash64(*rest).alias("h"), *rest)
    named = whole.where("call_id is not null")
    least = named.groupBy("conv_id", "call_id").agg(F.min(rank).alias("least")).select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "least")
    marked = named.join(least, F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi"))).withColumn(
        "status", F.when(~rank.eqNullSafe(F.col("least")), "duplicate")).drop("fc", "fi", "least")
    return marked.unionByName(whole.where("call_id is null").withColumn("status", F.lit("no_id")))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of ``calls(conv_id, call_id, uses)``, unique by the first two.
    Calls on a cycle, or behind one, are missing."""
    known = stored(calls.select("conv_id", "call_id"), "chat-known")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used")).where("used is not null")
    edges = stored(edges.join(known.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_semi"), "chat-uses")
    ready = known.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    ready = stored(ready, "chat-level")
    out, level = ready, 0
    while not edges.isEmpty() and not ready.isEmpty():
        level += 1
        done = ready.select("conv_id", F.col("call_id").alias("used"))
        freed = edges.join(done, ["conv_id", "used"], "left_semi").select("conv_id", "call_id").distinct()
        edges = stored(edges.join(done, ["conv_id", "used"], "left_anti"), "chat-uses")
        ready = freed.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        ready = stored(ready.withColumn("level", F.lit(level)), "chat-level")
        out = out.unionByName(ready)
    return out


def tool_table(schemas: DataFrame) -> DataFrame:
    """``schemas(name, param, type, required, min_size, max_size)`` -> one row per tool. A tool's
    parameters are few by nature; repeated rows count once."""
    one = schemas.where("name is not null and param is not null").select("name", F.struct("param", "type", "required", "min_size", "max_size").alias("p"))
    return one.groupBy("name").agg(F.sort_array(F.collect_set("p")).alias("params"))


def argument_errors(arguments: Column, params: Column) -> Column:
    """Errors of a map of variants, numbers marked, against a tool's parameters, in order of
    parameters, then unknown ones in order of name."""
    def check(p: Column) -> Column:
        value = F.element_at(arguments, p["param"])
        text = F.try_variant_get(value, "$", "string")
        number = F.when(text.startswith("\x01n"), F.substr(text, F.lit(3)))
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        power = F.regexp_extract(number, r"e\+([0-9]+)$", 1).try_cast("long")
        whole = number.rlike("^-?[0-9]+$") | (F.length(F.regexp_extract(number, r"\.([0-9]+)e", 1)) <= power)
        kind = F.when(whole, "INTEGER").when(number.isNotNull(), "NUMBER").otherwise(kind)
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((p["type"] == name) & kind.rlike(pattern))
        size = F.when(kind.rlike("^STRING"), F.length(text) - text.startswith("\x01s").cast("int")).when(number.isNotNull(), number.cast("double"))
        return (F.when(~F.map_contains_key(arguments, p["param"]), F.when(p["required"], F.concat(p["param"], F.lit(": missing"))))
                .when(~fits, F.concat(p["param"], F.lit(": not of type "), p["type"]))
                .when(size < p["min_size"], F.concat(p["param"], F.lit(": too small")))
                .when(size > p["max_size"], F.concat(p["param"], F.lit(": too large"))))

    wrong = F.filter(F.transform(params, check), lambda e: e.isNotNull())
    names = F.array_sort(F.array_except(F.map_keys(arguments), F.transform(params, lambda p: p["param"])))
    return F.concat(wrong, F.transform(names, lambda n: F.concat(n, F.lit(": unknown"))))


def quoted(text: Column) -> Column:
    """A string as JSON; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def canonical_object(fields: dict[str, Column]) -> Column:
    """JSON text of an object, given the JSON text of its values (null: left out)."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def message_rows(messages: DataFrame) -> DataFrame:
    """Turns that are neither call nor result, in the columns of ``format_chat``."""
    one = messages.select("conv_id", "turn", "role", F.coalesce("content", F.lit("")).alias("content")).groupBy(*MESSAGES).agg(F.count("*").alias("copies"))
    none = F.lit(None).cast("string")
    return one.select("conv_id", F.lit(0).alias("level"), "turn", F.lit(2).alias("part"), none.alias("call_id"), F.lit("message").alias("status"),
                      F.array().cast("array<string>").alias("errors"), "copies",
                      canonical_object({"content": quoted(F.col("content")), "role": quoted(F.col("role"))}).alias("json"))


def format_chat(calls: DataFrame, results: DataFrame, schemas: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """``calls(conv_id, turn, call_id, name, arguments, uses)``, ``results(conv_id, turn,
    call_id, content)`` and tool ``schemas`` -> one row per distinct call or result:
    ``conv_id, level, turn, part`` (0 call, 1 result, 2 a turn of ``messages(conv_id, turn,
    role, content)``; a linked result has its call's turn and level), ``call_id, status, errors`` (array) and ``json``."""
    calls = stored(first_of(calls.select(*CALLS), ["name", "arguments", "uses"]), "chat-calls")
    results = stored(first_of(results.select(*RESULTS), ["content"]), "chat-results")
    live = calls.where("status is null")
    level = levels(live)
    # a null conversation is a conversation of its own for identifiers, but orders nothing
    answered = results.where("status is null").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.lit(True).alias("answered"))
    live = live.join(answered, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left").drop("rc", "ri")
    live = live.join(level, ["conv_id", "call_id"], "left")
    rest = calls.where("status is not null").withColumns({"answered": F.lit(None).cast("boolean"), "level": F.lit(None).cast("int")})
    both = live.unionByName(rest.select(live.columns)).withColumn(
        "status", F.coalesce("status", F.when(F.col("answered"), "linked").otherwise("unanswered")))

    tools = stored(tool_table(schemas), "chat-tools")
    both = both.join(broadcast_if_small(tools, 4096), "name", "left")
    text = F.coalesce("arguments", F.lit("{}"))
    # the text itself must be JSON: marking could mend numbers that are not
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.try_parse_json(marked(text)))
    both = both.withColumn("parsed", parsed).withColumn("by_name", F.try_variant_get("parsed", "$", "map<string,variant>"))
    unknown = F.coalesce(F.size(F.array_except(F.array_distinct(F.coalesce("uses", F.array().cast("array<string>"))), F.coalesce("found_uses", F.array().cast("array<string>")))), F.lit(0))
    uses = calls.where("status is null").select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used")).where("used is not null")
    met = uses.join(calls.where("status is null").select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_semi")
    # bounded by the uses one call lists
    met = met.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("used")).alias("found_uses"))
    both = both.join(met, ["conv_id", "call_id"], "left")
    live_row = F.col("status").isin("linked", "unanswered")
    errors = F.concat(
        F.when(F.col("params").isNull(), F.array(F.lit("unknown tool"))).when(F.col("by_name").isNull(), F.array(F.lit("arguments: not an object")))
        .otherwise(argument_errors(F.col("by_name"), F.col("params"))),
        F.when(live_row & (unknown > 0), F.array(F.lit("uses: unknown call"))).otherwise(F.array().cast("array<string>")),
        F.when(live_row & F.col("level").isNull() & F.col("conv_id").isNotNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    both = both.withColumn("errors", errors)
    json = canonical_object({"arguments": unmarked(F.to_json("parsed")), "call_id": quoted(F.col("call_id")), "name": quoted(F.col("name")), "role": F.lit('"assistant"'),
                             "valid": F.when(F.size("errors") == 0, F.lit("true")).otherwise(F.lit("false"))})
    made = both.select("conv_id", "level", "turn", F.lit(0).alias("part"), "call_id", "status", "errors", "copies", json.alias("json"))

    place = made.where(live_row).select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.col("level").alias("call_level"), F.col("turn").alias("call_turn"))
    answers = results.join(place, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("call_id") == F.col("pi")) & F.col("status").isNull(), "left")
    status = F.coalesce("status", F.when(F.col("pi").isNotNull(), "linked").otherwise("orphan"))
    json = canonical_object({"call_id": quoted(F.col("call_id")), "content": quoted(F.coalesce("content", F.lit(""))), "role": F.lit('"tool"')})
    linked = F.col("pi").isNotNull()
    answers = answers.select("conv_id", F.col("call_level").alias("level"), F.when(linked, F.col("call_turn")).otherwise(F.col("turn")).alias("turn"), F.lit(1).alias("part"),
                             "call_id", status.alias("status"), F.array().cast("array<string>").alias("errors"), "copies", json.alias("json"))
    done = made.unionByName(answers)
    return done if messages is None else done.unionByName(message_rows(messages))
