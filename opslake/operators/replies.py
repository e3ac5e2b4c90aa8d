"""Quality jobs over a table of model replies (id, command, raw)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions import json_reply as jr
from opslake.functions.text import once
from opslake.plans.partitioning import spread_rows
from opslake.plans.session import scratch_path

# Repair attempts per reply.
MAX_ATTEMPTS = 3
#: Replies a task works on: each takes some tenths of a millisecond.
TASK_ROWS = 50_000

Responder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def checks(raw: str = "raw") -> tuple[Column, Column]:
    """The structural and the semantic error list of a reply; content is checked on sound ones only."""
    return jr.structural_errors(F.col("command"), F.col(raw)), F.when(
        F.size("structural") == 0, jr.semantic_errors(F.col("command"), F.col(raw)),
    ).otherwise(F.array().cast("array<string>"))


def validated(df: DataFrame, raw: str = "raw", given: tuple[Column, Column] | None = None) -> DataFrame:
    """Add the ``structural`` and ``semantic`` error lists (``given``: the columns, if built already)."""
    structural, semantic = given or checks(raw)
    return once(once(df, "structural", structural), "semantic", semantic)


def salvaged(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(…, reply, dropped) of the replies that hold a JSON object, be it noisy or cut off."""
    whole = once(df, "_whole", jr.recovered(F.col(raw)))
    return whole.select(*df.columns, F.inline(F.array_compact(F.array(jr.salvage(F.col("command"), F.col("_whole"))))))


def route(raw: str = "raw") -> Column:
    """What to do with a validated reply."""
    return (
        F.when((F.size("structural") == 0) & (F.size("semantic") == 0), "valid")
        .when(F.size("structural") == 0, "semantic")
        .when(jr.essentially_empty(F.col(raw)), "structural_with_context")
        .otherwise("structural"))


def _leaf_text(name: str) -> str:
    return f'"{name}":' + ("bool" if name in jr.BOOL_FIELDS else '"string"')


def schema_text(command: str) -> str:
    def one(name: str, shape) -> str:
        if shape == "strings":
            return f'"{name}":["string"]'
        if shape == "string":
            return _leaf_text(name)
        return f'"{name}":[{{' + ",".join(_leaf_text(f) for f in shape) + "}]"
    return "{" + ",".join(one(n, s) for n, s in jr.SCHEMAS[command].items()) + "}"


def repair_request(raw: str = "raw") -> Column:
    """Text asking for a corrected reply: the schema, the errors and, as needed, reply or task."""
    schemas = F.create_map(*[x for c in jr.SCHEMAS for x in (F.lit(c), F.lit(schema_text(c)))])
    schema = F.coalesce(schemas[F.col("command")], F.lit(""))
    errors = lambda col: F.array_join(F.transform(col, lambda e: F.concat(F.lit("- "), e)), "\n")
    block = lambda title, body: F.concat(F.lit(f"\n{title}:\n"), body)
    return (
        F.when(F.col("route") == "semantic", F.concat(
            F.lit("Answer the task again and meet every requirement."),
            block("REQUIREMENTS", errors("semantic")), block("SCHEMA", schema), block("TASK", F.col("command"))))
        .when(F.col("route") == "structural", F.concat(
            F.lit("Correct this JSON to match the schema; change only what the errors name."),
            block("SCHEMA", schema), block("JSON", F.col(raw)), block("ERRORS", errors("structural"))))
        .when(F.col("route") == "structural_with_context", F.concat(
            F.lit("The last answer had no usable content. Do the task and answer in the schema."),
            block("SCHEMA", schema), block("ANSWER", F.col(raw)), block("ERRORS", errors("structural")),
            block("TASK", F.col("command")))))


def repair_queue(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies that need repair, with their route and request text."""
    routed = validated(df, raw).withColumn("route", route(raw)).filter("route <> 'valid'")
    return routed.withColumn("request", repair_request(raw))


def element_request(element: str = "element") -> Column:
    """Text asking for one corrected list entry."""
    listed = [(f"{c}.{n}", "{" + ",".join(_leaf_text(f) for f in shape) + "}")
              for c, fields in jr.SCHEMAS.items() for n, shape in fields.items() if isinstance(shape, list)]
    schemas = F.create_map(*[F.lit(x) for pair in listed for x in pair])
    errors = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(
        F.lit("Correct this one list entry and answer with it alone; change only what the errors name."),
        F.lit("\nSCHEMA:\n"), F.coalesce(schemas[F.concat_ws(".", "command", "list")], F.lit("")),
        F.lit("\nENTRY:\n"), F.col(element), F.lit("\nERRORS:\n"), errors)


_KEY = ["row", "id", "command", "list", "position"]


class _Rounds:
    """Asks a responder and keeps every table in the shared folder, so that nothing is asked twice."""

    def __init__(self, spark, responder: Responder):
        self.path, self.spark, self.responder, self.n = scratch_path(spark, "repair"), spark, responder, 0
        # built once: every round applies the same columns
        command = F.col("command")
        self.checks, self.request, self.entry_request = checks("current"), repair_request("current"), element_request()
        self.parts, self.entry = jr.parts(command, F.col("_whole")), jr.answered_element(command, F.col("list"), F.col("_text"))
        self.document = jr.document(command, F.col("fields"), F.col("lists"))
        self.merged = jr.merged(command, F.col("fields"), F.col("lists"), F.col("a"))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/table{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/table{self.n}")

    def ask(self, rows: DataFrame, attempt: int) -> DataFrame:
        """(row, id, command, list, position, current) answered; ``rows`` has a request and a current text as well."""
        responder, names = self.responder, [*_KEY, "current"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in responder(frames):
                yield frame[names]

        asked = rows.select(*_KEY, F.lit(attempt).alias("attempt"), "request", "current")
        return self.keep(asked.mapInPandas(run, asked.select(*names).schema))


def _repaired_elements(rounds: _Rounds, elements: DataFrame, max_attempts: int) -> DataFrame:
    """One row per reply with elements: row, lists, lost (entries given up), asked (rounds)."""
    fit = elements.filter(F.size("errors") == 0).select(*_KEY, "element", "sound", F.lit(0).alias("attempt"))
    todo = elements.filter(F.size("errors") > 0)
    opened = todo.select(*_KEY, F.lit(None).cast("string").alias("element"), F.lit(None).cast("boolean").alias("sound"),
                         F.lit(0).alias("attempt"))
    for attempt in range(1, max_attempts + 1):
        if todo.isEmpty():
            break
        opened = opened.unionByName(todo.select(*_KEY, F.lit(None).cast("string").alias("element"),
                                                F.lit(None).cast("boolean").alias("sound"), F.lit(attempt).alias("attempt")))
        answers = rounds.ask(todo.withColumn("request", rounds.entry_request).withColumn("current", F.col("element")), attempt)
        found = once(answers, "_text", F.coalesce(jr.json_object(F.col("current")), F.col("current"), F.lit("")))
        checked = rounds.keep(once(found, "c", rounds.entry).select(*_KEY, "c.*"))
        fit = fit.unionByName(checked.filter(F.size("errors") == 0).select(*_KEY, "element", "sound", F.lit(attempt).alias("attempt")))
        todo = checked.filter(F.size("errors") > 0)
    # of an entry answered twice in a round the least counts
    each = fit.unionByName(opened).groupBy("row", "list", "position").agg(
        F.min(F.when(F.col("element").isNotNull(), F.struct("element", "sound"))).alias("e"), F.max("attempt").alias("attempt"))
    entry = F.when(F.col("e").isNotNull(), F.struct("list", "position", "e.element", "e.sound"))
    return each.groupBy("row").agg(
        jr.by_list(F.sort_array(F.collect_list(entry))).alias("lists"), F.count_if(F.col("e").isNull()).alias("lost"),
        F.max("attempt").alias("asked"))


def repair_outcomes(df: DataFrame, responder: Responder, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(id, command, attempts, status, reply) after element and document repair.

    A reply that is not sound as a whole is taken apart: its complete fields and sound list
    entries are set aside and stay, whatever is answered later. Every unsound entry is sent back
    alone, up to ``max_attempts`` times, and then put together again by position. Only a document
    that still lacks something is asked for as a whole, as often. ``responder`` is a mapInPandas
    function from (row, id, command, list, position, attempt, request, current) to the same rows
    with a new ``current``; whole documents come with list '' and position -1. Rows it leaves out
    count as not answered.

    Status: valid (sound as given), recovered (its complete parts are a sound reply), repaired,
    incomplete (an entry given up, or a document that stays unsound: what is sound of it is kept).
    Attempts counts rounds asked. Equal rows are repaired each for itself.
    """
    rounds = _Rounds(df.sparkSession, responder)
    # numbered in a kept table, as the numbers are a row's key from here on
    base = rounds.keep(df.select(F.monotonically_increasing_id().alias("row"), "id", "command", F.col("raw").alias("original")))
    # the kept files are small beside the work on them, so their splits would make few, long tasks
    found = once(spread_rows(base, TASK_ROWS), "_object", F.coalesce(jr.json_object(F.col("original")), F.col("original")))
    first = validated(found.withColumn("current", jr.normalise(F.col("command"), F.col("_object"))), "current", rounds.checks)
    start = rounds.keep(first.withColumn("route", route("current")).drop("_object"))
    out = start.filter("route = 'valid'").select(
        "id", "command", F.lit(0).alias("attempts"), F.lit("valid").alias("status"), F.col("current").alias("reply"))

    left = spread_rows(start.filter("route <> 'valid'").select("row", "id", "command", "original"), TASK_ROWS)
    whole = once(left, "_whole", jr.recovered(F.col("original")))
    apart = rounds.keep(once(whole, "p", rounds.parts).drop("_whole"))
    elements = apart.select("row", "id", "command", F.inline("p.elements"))
    lists = rounds.keep(_repaired_elements(rounds, elements, max_attempts))
    empty = lambda kind: F.map_from_entries(F.array().cast(f"array<struct<k:string,v:{kind}>>"))
    held = apart.join(lists, "row", "left").select(
        "row", "id", "command", "original", F.coalesce("p.fields", empty("string")).alias("fields"),
        F.coalesce("lists", empty(jr.ENTRIES)).alias("lists"),
        F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("asked", F.lit(0)).alias("asked"),
        ((F.size("p.fields") > 0) | (F.size("p.elements") > 0)).alias("seen"), F.lit(True).alias("clean"))
    for attempt in range(max_attempts + 1):
        text = F.when(F.col("seen"), rounds.document).otherwise(F.col("original"))
        judged = validated(once(held, "current", F.coalesce(text, F.lit(""))), "current", rounds.checks)
        judged = rounds.keep(judged.withColumn("route", F.when(~F.col("clean"), "structural").otherwise(route("current"))))
        status = F.when(F.col("lost") > 0, "incomplete").when(F.col("asked") + attempt > 0, "repaired").otherwise("recovered")
        attempts = (F.col("asked") + attempt).cast("int").alias("attempts")
        out = out.unionByName(judged.filter("route = 'valid'").select(
            "id", "command", attempts, status.alias("status"), F.col("current").alias("reply")))
        todo = judged.filter("route <> 'valid'")
        if attempt == max_attempts:
            # a field in place of a list is no part of what is kept
            kept = todo.withColumn("fields", F.map_filter("fields", lambda k, v: ~F.array_contains(
                _list_names(), F.concat_ws(".", "command", k))))
            out = out.unionByName(kept.select("id", "command", attempts, F.lit("incomplete").alias("status"),
                                              F.when(F.col("seen"), rounds.document).alias("reply")))
        elif todo.isEmpty():
            break
        else:
            asked = todo.withColumn("request", rounds.request).withColumn("list", F.lit("")).withColumn("position", F.lit(-1))
            answers = rounds.ask(asked, attempt + 1).groupBy("row").agg(F.min("current").alias("answer"))
            held = _with_answers(rounds, todo.drop("current", "structural", "semantic", "route"), answers)
    return out


def _list_names() -> Column:
    return F.array(*[F.lit(f"{c}.{n}") for c, fields in jr.SCHEMAS.items() for n, s in fields.items() if isinstance(s, list)])


def _with_answers(rounds: _Rounds, held: DataFrame, answers: DataFrame) -> DataFrame:
    """What is held of each reply, and what its whole-document answer adds to it."""
    both = once(held.join(answers, "row", "left"), "_object", jr.json_object(F.col("answer")))
    whole = once(both, "_whole", F.coalesce("_object", jr.recovered(F.col("answer"))))
    joined = once(once(whole, "a", rounds.parts), "m", F.when(F.col("a").isNotNull(), rounds.merged))
    return joined.select(
        "row", "id", "command", "original", F.coalesce("m.fields", "fields").alias("fields"),
        F.coalesce("m.lists", "lists").alias("lists"), "lost", "asked", (F.col("seen") | F.col("m").isNotNull()).alias("seen"),
        # an answer that is cut off adds its complete parts but settles nothing
        F.coalesce(F.col("m.clean") & F.col("_object").isNotNull(), F.lit(False)).alias("clean"))


def quality_cube(df: DataFrame) -> DataFrame:
    """Reply counts by command and outcome with all subtotals, and the share in 1/10,000."""
    counts = df.groupBy("command", "outcome").agg(F.count(F.lit(1)).alias("n"))
    cube = counts.cube("command", "outcome").agg(F.sum("n").alias("n")).select(
        *[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("command", "outcome")], "n")
    totals = cube.filter("outcome = '(all)'").select("command", F.col("n").alias("total"))
    return cube.join(totals, "command").select(
        "command", "outcome", "n", F.floor(F.col("n") * 10000 / F.col("total")).alias("per_10k"))


def observed_keys(df: DataFrame, command: str, text: str) -> DataFrame:
    """(command, key, n) of the top-level keys that occur."""
    whole = df.filter(jr.strict_json(F.col(text)).isNotNull())
    keys = whole.select(command, F.explode(F.json_object_keys(F.col(text))).alias("key"))
    return keys.groupBy(F.col(command).alias("command"), "key").agg(F.count(F.lit(1)).alias("n"))


def schema_drift(observed: DataFrame) -> DataFrame:
    """Observed keys the reply schemas do not declare; the registry is a fixed short list."""
    short = {"doctor_brief": "doctor", "status_brief": "status"}
    rows = sorted({(short.get(c, c), name) for c, fields in jr.SCHEMAS.items() for name in fields})
    declared = observed.sparkSession.createDataFrame(rows, "command string, key string")
    return observed.join(F.broadcast(declared), ["command", "key"], "left_anti")


def findings_tally(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings per command and severity; any other severity counts as info."""
    whole = F.when(jr.strict_json(F.col(raw)).isNotNull(), F.col(raw))
    found = F.coalesce(F.from_json(whole, "findings array<struct<severity string>>")["findings"],
                       F.array().cast("array<struct<severity string>>"))
    n = lambda word: F.size(F.filter("f", lambda x: x["severity"] == word))
    return df.withColumn("f", found).groupBy("command").agg(
        F.sum(F.size("f")).alias("findings"), F.sum(n("critical")).alias("critical"),
        F.sum(n("warning")).alias("warning"),
        F.sum(F.size("f") - n("critical") - n("warning")).alias("info"))
