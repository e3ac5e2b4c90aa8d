"""Model replies as JSON: find, normalise, validate, salvage. Column -> Column.

What each command's reply must look like is data (``SPEC``): a constant the expressions
look fields up in, so the plan has the same size however many commands there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake.functions.text import SPACE_CHARS, bind, trim

# Reply fields per command; a list names its element fields.
SCHEMAS: dict[str, dict[str, object]] = {
    "explain": {"issues": ["what", "why"]},
    "watch": {"issues": ["what", "why"]},
    "why": {"summary": "string", "chain": ["event", "detail"], "next_steps": "strings"},
    "doctor": {"issues": ["severity", "title", "detail"], "actions": ["description", "disruptive"]},
    "doctor_brief": {"summary": "string"},
    "status": {"overview": "string", "anomalies": ["severity", "title", "detail"]},
    "status_brief": {"summary": "string"},
    "audit": {"summary": "string", "findings": ["severity", "category", "title", "detail"]},
    "ports": {"summary": "string", "findings": ["severity", "port", "title", "detail"]},
    "timers": {"summary": "string",
               "timers": ["name", "schedule", "last_run", "next_run", "status", "detail"]},
    "crons": {"summary": "string",
              "jobs": ["source", "schedule", "command", "what_it_does", "last_run", "status", "detail"]},
    "mounts": {"summary": "string", "findings": ["severity", "mount_point", "title", "detail"]},
    "updates": {"summary": "string",
                "updates": ["package", "installed", "available", "category", "reboot_required", "detail"]},
    "history": {"summary": "string", "entries": ["timestamp", "command", "summary"]},
    "firewall": {"summary": "string", "findings": ["severity", "rule", "port", "title", "detail"]},
}
BOOL_FIELDS = {"disruptive", "reboot_required"}

# Fields whose near misses are mapped to an allowed word.
ENUMS: dict[str, dict[str, list[str]]] = {
    "audit": {"severity": ["critical", "warning", "info"],
              "category": ["service", "file", "permission", "package", "network", "user"]},
    "ports": {"severity": ["warning", "info"]},
    "crons": {"status": ["ok", "warning", "failed"]},
}

# Checks on list elements and their messages.
LEVELS = ["critical", "warning", "info"]
STATES = ["ok", "warning", "failed"]
ELEMENT_CHECKS: dict[str, list[tuple]] = {
    "ports": [("word", "severity", ["warning", "info"], "'warning' or 'info'"),
              ("filled", "port"), ("filled", "title"), ("filled", "detail")],
    "mounts": [("word", "severity", LEVELS, "'critical', 'warning', or 'info'"),
               ("filled", "mount_point"), ("filled", "title"), ("filled", "detail")],
    "firewall": [("bare_word", "severity", LEVELS, "critical, warning, or info"),
                 ("filled", "title"), ("filled", "detail")],
    "timers": [("filled", "name"), ("word", "status", STATES, "'ok', 'warning', or 'failed'"),
               ("filled", "last_run"), ("filled", "next_run")],
    "crons": [("filled", "source"), ("filled", "command"), ("filled", "what_it_does"),
              ("word", "status", STATES, "'ok', 'warning', or 'failed'"),
              ("filled", "last_run", [], " (use 'unknown' when unavailable)")],
    "updates": [("filled", "package"),
                ("exact_word", "category", ["security", "major", "minor", "unknown"],
                 "'security'/'major'/'minor'/'unknown'"),
                ("filled_if_category", "detail", ["security", "major"])],
    "history": [("filled", "timestamp"), ("filled", "command")],
    "why": [("filled", "event"), ("filled", "detail")],
}
# Lists that must not be empty, and commands whose elements are only checked as a whole.
REQUIRED_ITEMS = {"chain": "chain must contain at least one step",
                  "next_steps": "next_steps must contain at least one remediation step"}
WHOLE_ONLY = ["why"]

def _leaf(command: str, name: str) -> dict:
    return {"name": name, "kind": "bool" if name in BOOL_FIELDS else "string",
            "allowed": ENUMS.get(command, {}).get(name, [])}


def _check(c: tuple) -> dict:
    op, name, words, say = (*c, [], "")[:4] if len(c) < 4 else c
    return {"op": op, "name": name, "words": words, "say": say}


def _tidy(command: str, shape: list[str], checks: list[dict]) -> dict:
    """What an element that is sound and already normal looks like (``tidy``)."""
    leaves = [_leaf(command, f) for f in shape]
    said = {op: [{"name": c["name"], "words": c["words"]} for c in checks if c["op"] == op] for op in ("word", "bare_word", "exact_word", "filled_if_category")}
    return {"schema": "OBJECT<" + ", ".join(f"{x['name']}: {'BOOLEAN' if x['kind'] == 'bool' else 'STRING'}" for x in sorted(
                leaves, key=lambda x: x["name"])) + ">",
            "filled": [c["name"] for c in checks if c["op"] == "filled"],
            "words": [{"name": x["name"], "words": x["allowed"]} for x in leaves if x["allowed"]]
                     + said["word"] + said["bare_word"] + said["exact_word"],
            "by_category": said["filled_if_category"]}


def _spec() -> dict:
    out = {}
    for command, fields in SCHEMAS.items():
        rows = []
        for name, shape in fields.items():
            row = _leaf(command, name)
            row.update(fields=[], checks=[], required=REQUIRED_ITEMS.get(name, ""), tidy=None)
            if shape == "strings":
                row["kind"] = "strings"
            elif shape != "string":
                row.update(kind="objects", fields=[_leaf(command, f) for f in shape],
                           checks=[_check(c) for c in ELEMENT_CHECKS.get(command, [])])
                row["tidy"] = _tidy(command, shape, row["checks"])
            rows.append(row)
        out[command] = {"checked": command in ELEMENT_CHECKS, "elementwise": command not in WHOLE_ONLY,
                        "fields": rows}
    return out


SPEC_JSON = json.dumps(_spec())
SPEC_TYPE = """map<string, struct<checked: boolean, elementwise: boolean, fields: array<struct<
    name: string, kind: string, allowed: array<string>, required: string,
    fields: array<struct<name: string, kind: string, allowed: array<string>>>,
    checks: array<struct<op: string, name: string, words: array<string>, say: string>>,
    tidy: struct<schema: string, filled: array<string>, words: array<struct<name: string, words: array<string>>>,
        by_category: array<struct<name: string, words: array<string>>>>>>>>"""


def spec(command: Column) -> Column:
    return F.from_json(F.lit(SPEC_JSON), SPEC_TYPE)[command]


def kind(v: Column) -> Column:
    """string, bool, number, object, array or null of a variant."""
    return bind(F.schema_of_variant(v), lambda s: (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null")
        .otherwise("number")))


def members(v: Column) -> Column:
    """An object's fields; empty for null."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"),
                      F.from_json(F.lit("{}"), "map<string,variant>"))


def items(v: Column) -> Column:
    """A list's elements; empty for null or absent."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _no_messages() -> Column:
    return F.array().cast("array<string>")


# --- parsing ------------------------------------------------------------------------

_END = "\ue000 end of reply"  # a private character, so that no reply holds it by chance


def strict_json(c: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value, so the text is read as the first of two list
    elements: whatever follows the value moves or breaks the second one. Of repeated keys the
    last one counts where ``spark.sql.variant.allowDuplicateKeys`` is set, as the registered
    queries do; else such a text does not parse.
    """
    def of(pair: Column) -> Column:
        whole = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(pair, "$[2]", "variant").isNull()
        return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))
    # a text that holds the end mark itself is no reply
    text = F.when(~F.contains(c, F.lit(_END)), F.concat(F.lit("["), c, F.lit(f',"{_END}"]')))
    return bind(F.try_parse_json(text), of)


# --- finding the object in the text -------------------------------------------------

# What the scanner stops at: escape pairs, quotes, brackets and commas.
_SPLIT = r"(?s)\\.|[\"{}\[\],]"


def _tokens(t: Column) -> Column:
    """array(struct(c, gap)): the tokens of a text, and how many characters stand before each."""
    found = F.regexp_extract_all(t, F.lit(_SPLIT), F.lit(0))
    gaps = F.transform(F.split(t, _SPLIT, -1), F.length)
    return F.arrays_zip(found.alias("c"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))


def _scan(tokens: Column, opening: str, closing: str) -> Column:
    """State after the tokens of a text that starts with a brace.

    ``depth`` counts the given brackets, ``done`` is where it falls back to 0, ``quoted`` says
    whether a string is open. ``kept`` is the last place where all before is complete: a comma of
    the object, or a comma or the start of a list that is one of its fields (``listed``).
    """
    def step(s: Column, x: Column) -> Column:
        def of(c: Column, end: Column) -> Column:
            # an escaped quote ends no string, but outside strings it starts one
            quote = (c == '"') & ~(s["quoted"] & (F.length(x["c"]) > 1))
            plain = ~s["quoted"] & (c != '"')
            opens, closes = plain & c.isin(*opening), plain & c.isin(*closing)
            starts = opens & (s["depth"] == 1)
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            in_list = F.when(starts, c == "[").otherwise(s["in_list"])
            comma = plain & (c == ",") & ((s["depth"] == 1) | ((s["depth"] == 2) & s["in_list"]))
            begins = starts & (c == "[")
            return F.when(s["done"] > 0, s).otherwise(F.struct(
                end.alias("at"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), depth.alias("depth"),
                F.when(closes & (depth <= 0), end).otherwise(0).alias("done"), in_list.alias("in_list"),
                F.when(begins, end).when(comma, end - 1).otherwise(s["kept"]).alias("kept"),
                F.when(begins, True).when(comma, s["depth"] == 2).otherwise(s["listed"]).alias("listed")))
        size = F.length(x["c"])
        return bind(F.struct(F.right(x["c"], F.lit(1)).alias("c"), (s["at"] + x["gap"] + size).alias("end")),
                    lambda y: of(y["c"], y["end"]))
    zero, no = F.lit(0), F.lit(False)
    return F.aggregate(tokens, F.struct(
        zero.alias("at"), no.alias("quoted"), zero.alias("depth"), zero.alias("done"), no.alias("in_list"),
        zero.alias("kept"), no.alias("listed")), step)


def _from_brace(text: Column) -> Column:
    at = F.instr(text, "{")
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def _valid(text: Column) -> Column:
    return bind(text, lambda x: F.when(strict_json(x).isNotNull(), x))


def _to_last_brace(t: Column) -> Column:
    """A text that starts with a brace up to its last closing one, if that is JSON: then it is the first object, and needs no scan."""
    return _valid(F.substring(t, F.lit(1), F.length(t) - F.instr(F.reverse(t), "}") + 1))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, aware of strings and escapes; null when there is none."""
    def of(t: Column) -> Column:
        return F.coalesce(_to_last_brace(t), bind(
            _scan(_tokens(t), "{", "}")["done"], lambda end: F.when(end > 0, F.substring(t, F.lit(1), end))))
    return bind(_from_brace(text), of)


def json_object(raw: Column) -> Column:
    """First JSON object in noisy text, null when there is none.

    Texts that are one object already are taken as they are; only the rest is scanned.
    """
    def of(t: Column) -> Column:
        return F.when(t.startswith("{") & strict_json(t).isNotNull(), t).otherwise(first_object(raw))
    return bind(F.btrim(raw, F.lit(" \t\n\r")), of)


def complete_part(text: Column) -> Column:
    """The first object of a text as far as it is complete: whole fields, and whole elements of lists.

    What follows a cut or a mistake is left out. A text that is only cut off can be closed after its
    last complete place. Else, as one whose beginning up to some token can be closed to JSON can be
    closed at every earlier token, the last one is found by halving.
    """
    def of(t: Column, tokens: Column) -> Column:
        n = F.size(tokens)
        upto = lambda end, tail: F.concat(F.substring(t, F.lit(1), end), tail)
        closers = lambda listed: F.when(listed, "]}").otherwise("}")
        scanned = lambda k: _scan(F.slice(tokens, F.lit(1), k), "{[", "}]")

        closed = lambda s: F.when(s["kept"] > 0, upto(s["kept"], closers(s["listed"])))

        def kept(k: Column) -> Column:
            return bind(scanned(k), closed)

        def half(s: Column, _: Column) -> Column:
            def of_mid(mid: Column) -> Column:
                # no complete place so far is no mistake so far
                return bind(kept(mid), lambda c: bind(_valid(c), lambda v: F.when(
                    c.isNull() | v.isNotNull(), F.struct(mid.alias("lo"), s["hi"].alias("hi"), v.alias("best"))).otherwise(
                    F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi"), s["best"].alias("best")))))
            return F.when(s["lo"] >= s["hi"], s).otherwise(bind(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int"), of_mid))
        start = F.struct(F.lit(0).alias("lo"), n.alias("hi"), F.lit(None).cast("string").alias("best"))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        halved = F.aggregate(rounds, start, half)["best"]
        # a number at the very end may go on
        outer = lambda s: (s["depth"] == 1) | ((s["depth"] == 2) & s["in_list"])
        whole = lambda s: F.when(s["done"] > 0, upto(s["done"], F.lit(""))).when(
            ~s["quoted"] & outer(s) & ~t.rlike(r"[0-9.eE+-]\z"), F.concat(t, closers(s["depth"] == 2)))
        return bind(scanned(n), lambda s: F.coalesce(_valid(whole(s)), F.when(
            s["kept"] > 0, F.coalesce(_valid(closed(s)), halved))))
    found = bind(_from_brace(text), lambda t: F.coalesce(_to_last_brace(t), bind(_tokens(t), lambda tokens: of(t, tokens))))
    return bind(found, lambda f: F.when(F.size(F.json_object_keys(f)) > 0, f))


def recovered(raw: Column) -> Column:
    """The text where it is one JSON value, else the complete part of its first object, if any."""
    return F.when(strict_json(raw).isNotNull(), raw).otherwise(F.when(F.contains(raw, F.lit("{")), complete_part(raw)))


def essentially_empty(raw: Column) -> Column:
    return F.translate(raw, " \t\n\r", "").isin("", "{}", "null", "[]")


# --- normalising --------------------------------------------------------------------

def canonical(value: Column, allowed: list[str] | Column) -> Column:
    """Allowed word for a near miss (exact, case-insensitive, prefix either way), else the value."""
    words = allowed if isinstance(allowed, Column) else F.array(*[F.lit(a) for a in allowed])

    def pick(t: Column) -> Column:
        low = F.lower(t)
        first = lambda test: F.get(F.filter(words, test), F.lit(0))
        return F.when(t == "", value).otherwise(F.coalesce(
            first(lambda a: a == t),
            first(lambda a: F.lower(a) == low),
            first(lambda a: F.lower(a).startswith(low) | low.startswith(F.lower(a))),
            value))
    return bind(trim(value), pick)


def _plain_number(v: Column) -> Column:
    s = F.try_variant_get(v, "$", "decimal(38,9)").cast("string")
    short = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(short, F.try_variant_get(v, "$", "string"))


def _normal_leaf(x: Column, f: Column) -> Column:
    """A value brought to the field's type where its text allows it."""
    def of_kind(k: Column) -> Column:
        text = trim(F.try_variant_get(x, "$", "string"))
        word = (F.when(k == "string", text).when(k == "bool", F.try_variant_get(x, "$", "string"))
                .when(k == "number", _plain_number(x)))
        truth = F.when(k == "string", F.lower(text))
        number = F.when(k == "string", text.try_cast("double"))
        return (
            F.when((f["kind"] == "string") & k.isin("string", "bool", "number"),
                   canonical(word, f["allowed"]).cast("variant"))
            .when((f["kind"] == "bool") & truth.isin("true", "false"), (truth == "true").cast("variant"))
            .when((f["kind"] == "number") & number.isNotNull(), number.cast("variant"))
            .otherwise(x))
    return bind(kind(x), of_kind)


def normal_object(v: Column, fields: Column, change: Callable[[Column, Column], Column] = _normal_leaf) -> Column:
    """Known fields of an object variant normalised; unknown ones kept; keys sorted."""
    def value(name: Column, x: Column) -> Column:
        known = F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))
        return bind(known, lambda f: F.when(f.isNull(), x).otherwise(change(x, f)))
    return F.when(kind(v) == "object", F.to_variant_object(F.transform_values(members(v), value))).otherwise(v)


_EDGE = "".join(f"\\x{{{ord(c):x}}}" for c in SPACE_CHARS)
_GAP = "\x01"


def tidy(e: Column, f: Column) -> Column:
    """Whether an element of list ``f`` is sound and normal as it is: exactly the known fields, of their types, no space
    around a text, and no check to fail. Most are, and this looks at an element as a whole instead of field by field.
    """
    def of_texts(m: Column) -> Column:
        text = lambda name: F.try_element_at(m, name)
        is_word = lambda w, name: F.array_contains(w["words"], text(name))
        want = f["tidy"]
        return (
            F.forall(want["filled"], lambda n: text(n) != "") & F.forall(want["words"], lambda w: is_word(w, w["name"]))
            & F.forall(want["by_category"], lambda w: (text(w["name"]) != "") | ~is_word(w, F.lit("category")))
            & ~F.array_join(F.map_values(m), _GAP).rlike(f"(?:\\A|{_GAP})[{_EDGE}]|[{_EDGE}](?:{_GAP}|\\z)"))
    return F.coalesce(F.when(F.schema_of_variant(e) == f["tidy"]["schema"], bind(
        F.try_variant_get(e, "$", "map<string,string>"), of_texts)), F.lit(False))


def _normal_element(e: Column, f: Column) -> Column:
    return F.when(tidy(e, f), e).otherwise(normal_object(e, f["fields"]))


def _normal_field(x: Column, f: Column) -> Column:
    string = F.struct(F.lit("").alias("name"), F.lit("string").alias("kind"), f["allowed"].alias("allowed"))
    is_list = kind(x) == "array"
    return (
        F.when((f["kind"] == "objects") & is_list, F.to_variant_object(F.transform(
            items(x), lambda e: _normal_element(e, f))))
        .when((f["kind"] == "strings") & is_list, F.to_variant_object(F.transform(
            items(x), lambda e: _normal_leaf(e, string))))
        .otherwise(_normal_leaf(x, f)))


def normalise(command: Column, raw: Column) -> Column:
    """Reply text with trimmed strings, coerced types and canonical words; keys sorted.

    Text that does not parse is returned unchanged.
    """
    fields = F.coalesce(spec(command)["fields"], F.from_json(F.lit(SPEC_JSON), SPEC_TYPE)["watch"]["fields"])
    return bind(strict_json(raw), lambda v: F.when(v.isNull(), raw).otherwise(
        bind(fields, lambda fs: F.to_json(normal_object(v, fs, _normal_field)))))


# --- validating ---------------------------------------------------------------------

def object_errors(v: Column, fields: Column, prefix: Column,
                  listed: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """Messages for the fields of object ``v``, with full field paths."""
    def of_members(m: Column) -> Column:
        def check(f: Column) -> Column:
            path = F.concat(prefix, f["name"])
            quoted = F.concat(F.lit('field "'), path, F.lit('"'))
            a_list = f["kind"].isin("strings", "objects")

            def of_value(x: Column) -> Column:
                def of_kind(k: Column) -> Column:
                    want = F.when(a_list, "array").otherwise(f["kind"])
                    inner = listed(x, f, path) if listed else _no_messages()
                    return (
                        F.when((k == "null") & a_list, _no_messages())
                        .when(k == "null", F.array(F.concat(quoted, F.lit(" cannot be null"))))
                        .when(k != want, F.array(F.concat(quoted, F.lit(": expected "), want, F.lit(", got "), k)))
                        .when(a_list, inner).otherwise(_no_messages()))
                return F.when(x.isNull(), F.array(F.concat(quoted, F.lit(" is missing")))).otherwise(
                    bind(kind(x), of_kind))
            return bind(F.try_element_at(m, f["name"]), of_value)
        return F.flatten(F.transform(fields, check))
    return bind(members(v), of_members)


def _list_errors(x: Column, f: Column, path: Column) -> Column:
    def element(e: Column, i: Column) -> Column:
        at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        as_wanted = F.schema_of_variant(e) == f["tidy"]["schema"]
        return F.when(as_wanted, _no_messages()).otherwise(bind(kind(e), lambda k: (
            F.when((f["kind"] == "strings") & k.isin("string", "null"), _no_messages())
            .when(f["kind"] == "strings", F.array(F.concat(
                F.lit('field "'), at, F.lit('": expected string, got '), k)))
            .when(k.isin("object", "null"), object_errors(e, f["fields"], F.concat(at, F.lit("."))))
            .otherwise(F.array(F.concat(at, F.lit(": invalid object")))))))
    return F.flatten(F.transform(items(x), element))


def structural_errors(command: Column, raw: Column) -> Column:
    """Syntax, missing, null and type errors of a reply with their paths; empty when sound."""
    def of(v: Column) -> Column:
        return (
            F.when(v.isNull(), F.array(F.lit("JSON syntax error")))
            .when(~kind(v).isin("object", "null"), F.array(F.lit("top-level must be a JSON object")))
            .otherwise(bind(spec(command)["fields"], lambda fs: F.when(
                fs.isNull(), F.array(F.concat(F.lit("unknown command "), command)),
            ).otherwise(object_errors(v, fs, F.lit(""), _list_errors)))))
    return bind(strict_json(raw), of)


def _element_messages(e: Column, checks: Column) -> Column:
    """Messages of the content checks an element fails."""
    def of_members(m: Column) -> Column:
        text = lambda name: _text(F.try_element_at(m, name))

        def message(c: Column) -> Column:
            def of_text(s: Column) -> Column:
                empty = F.concat(c["name"], F.lit(" must not be empty"))
                wrong = lambda shown: F.concat(
                    c["name"], F.lit(" must be "), c["say"], F.lit(', got "'), shown, F.lit('"'))
                known = F.array_contains(c["words"], trim(s))
                category = text(F.lit("category"))
                return (
                    F.when((c["op"] == "filled") & (trim(s) == ""), F.concat(empty, c["say"]))
                    .when((c["op"] == "word") & (trim(s) == ""), empty)
                    .when((c["op"] == "word") & ~known, wrong(trim(s)))
                    .when((c["op"] == "bare_word") & ~known, wrong(s))
                    .when((c["op"] == "exact_word") & ~F.array_contains(c["words"], s), wrong(s))
                    .when((c["op"] == "filled_if_category") & F.array_contains(c["words"], category)
                          & (trim(s) == ""),
                          F.concat(empty, F.lit(' when category is "'), category, F.lit('"'))))
            return bind(text(c["name"]), of_text)
        return F.array_compact(F.transform(checks, message))
    return bind(members(e), of_members)


def semantic_errors(command: Column, raw: Column) -> Column:
    """Content rules of a structurally sound reply, with element paths."""
    def of(v: Column) -> Column:
        def whole(m: Column) -> Column:
            def field(f: Column) -> Column:
                def of_items(arr: Column) -> Column:
                    def element(e: Column, i: Column) -> Column:
                        at = F.concat(f["name"], F.lit("["), i.cast("string"), F.lit("]."))
                        return F.when(tidy(e, f), _no_messages()).otherwise(
                            F.transform(_element_messages(e, f["checks"]), lambda t: F.concat(at, t)))
                    needed = F.when((f["required"] != "") & (F.size(arr) == 0), F.array(f["required"]))
                    return F.concat(F.coalesce(needed, _no_messages()), F.flatten(F.transform(arr, element)))
                x = F.try_element_at(m, f["name"])
                return (
                    F.when(f["kind"].isin("objects", "strings"), bind(items(x), of_items))
                    .when((f["name"] == "summary") & (trim(_text(x)) == ""),
                          F.array(F.lit("summary must not be empty")))
                    .otherwise(_no_messages()))
            return bind(spec(command), lambda sp: F.when(
                sp["checked"], F.flatten(F.transform(sp["fields"], field))).otherwise(_no_messages()))
        return bind(members(v), whole)
    return bind(strict_json(raw), of)


# --- salvaging ----------------------------------------------------------------------

def salvage(command: Column, raw: Column) -> Column:
    """struct(reply, dropped): the reply with its valid list elements only.

    Elements are normalised and checked one by one, order kept; list entries that are no
    objects are left out without being counted. Missing lists become []. Null reply when
    the text is no JSON object; ``recovered`` makes one of a noisy or cut-off text.
    """
    def of(v: Column) -> Column:
        def rebuilt(sp: Column, m: Column) -> Column:
            def field(f: Column) -> Column:
                def sound(e: Column) -> Column:
                    content = F.when(sp["elementwise"], _element_messages(e, f["checks"])).otherwise(_no_messages())
                    return (F.size(object_errors(e, f["fields"], F.lit(""))) == 0) & (F.size(content) == 0)

                def of_value(x: Column) -> Column:
                    def entry(e: Column) -> Column:
                        other = F.when(kind(e) == "object", normal_object(e, f["fields"]))
                        return bind(tidy(e, f), lambda good: F.struct(good.alias("good"), F.when(good, e).otherwise(other).alias("e")))
                    objects = F.filter(F.transform(items(x), entry), lambda y: y["e"].isNotNull())

                    def keep(arr: Column) -> Column:
                        fit = F.filter(arr, lambda y: y["good"] | sound(y["e"]))
                        return bind(F.transform(fit, lambda y: y["e"]), lambda kept: F.struct(
                            f["name"].alias("name"), F.to_variant_object(kept).alias("value"),
                            (F.size(arr) - F.size(kept)).alias("lost")))
                    scalar = F.struct(f["name"].alias("name"), F.when(
                        x.isNotNull(), _normal_field(x, f)).alias("value"), F.lit(0).alias("lost"))
                    return F.when(f["kind"] == "objects", bind(objects, keep)).otherwise(scalar)
                return bind(F.try_element_at(m, f["name"]), of_value)

            def assemble(rows: Column) -> Column:
                present = F.array_sort(
                    F.transform(F.filter(rows, lambda r: r["value"].isNotNull()), lambda r: r["name"]))
                by_name = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["name"], r["value"])))
                doc = F.map_from_arrays(present, F.transform(present, lambda n: by_name[n]))
                return F.struct(F.to_json(doc).alias("reply"), F.aggregate(
                    rows, F.lit(0), lambda acc, r: acc + r["lost"]).alias("dropped"))
            return bind(F.transform(sp["fields"], field), assemble)
        return F.when(v.isNull() | (kind(v) != "object"), F.lit(None)).otherwise(
            bind(spec(command), lambda sp: bind(members(v), lambda m: rebuilt(sp, m))))
    return bind(strict_json(raw), of)


# --- repairing by parts -------------------------------------------------------------

def _checked_element(sp: Column, f: Column, e: Column) -> Column:
    """struct(element, errors, sound) of one list element, normalised.

    ``errors`` is what the element is sent back for; ``sound`` also minds content that is only
    checked as a whole.
    """
    def of(n: Column) -> Column:
        def found(bad: Column, content: Column) -> Column:
            asked = F.when((F.size(bad) > 0) | ~sp["elementwise"], bad).otherwise(content)
            return F.struct(F.to_json(n).alias("element"), asked.alias("errors"),
                            ((F.size(bad) == 0) & (F.size(content) == 0)).alias("sound"))
        return bind(object_errors(n, f["fields"], F.lit("")), lambda bad: bind(
            _element_messages(n, f["checks"]), lambda content: found(bad, content)))
    as_is = F.struct(F.to_json(e).alias("element"), _no_messages().alias("errors"), F.lit(True).alias("sound"))
    return F.when(tidy(e, f), as_is).otherwise(bind(normal_object(e, f["fields"]), of))


def parts(command: Column, text: Column) -> Column:
    """The known fields of a reply as JSON texts, and its list elements one by one; null for no object.

    A list field that holds no list is a field; list entries that are no objects are left out.
    """
    def of(v: Column) -> Column:
        def split(sp: Column, m: Column) -> Column:
            value = lambda f: F.try_element_at(m, f["name"])
            listed = lambda f: (f["kind"] == "objects") & kind(value(f)).isin("array", "null")
            present = F.filter(sp["fields"], lambda f: value(f).isNotNull())

            def elements(f: Column) -> Column:
                numbered = F.transform(items(value(f)), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
                objects = F.filter(numbered, lambda x: kind(x["e"]) == "object")
                return F.transform(objects, lambda x: bind(_checked_element(sp, f, x["e"]), lambda c: F.struct(
                    f["name"].alias("list"), x["i"].alias("position"), c["element"].alias("element"),
                    c["errors"].alias("errors"), c["sound"].alias("sound"))))
            return F.struct(
                F.map_from_entries(F.transform(F.filter(present, lambda f: ~listed(f)), lambda f: F.struct(
                    f["name"], F.to_json(_normal_field(value(f), f))))).alias("fields"),
                F.flatten(F.transform(F.filter(present, listed), elements)).alias("elements"))
        return F.when(kind(v) == "object", bind(spec(command), lambda sp: F.when(
            sp["fields"].isNotNull(), bind(members(v), lambda m: split(sp, m)))))
    return bind(strict_json(text), of)


def answered_element(command: Column, name: Column, answer: Column) -> Column:
    """struct(element, errors, sound) of an answer to the request for one element of list ``name``.

    An answer that wraps the element in its list is unwrapped.
    """
    def of(v: Column) -> Column:
        def unwrapped(m: Column) -> Column:
            inner = items(F.try_element_at(m, name))
            return F.when((F.size(m) == 1) & (F.size(inner) == 1), F.get(inner, F.lit(0))).otherwise(v)
        lost = F.struct(answer.alias("element"), F.array(F.lit("invalid object")).alias("errors"), F.lit(False).alias("sound"))
        return F.when(kind(v) == "object", bind(bind(members(v), unwrapped), lambda e: F.when(kind(e) == "object", bind(
            spec(command), lambda sp: bind(F.get(F.filter(sp["fields"], lambda f: f["name"] == name), F.lit(0)),
                                           lambda f: _checked_element(sp, f, e))))
            .otherwise(lost))).otherwise(lost)
    return bind(strict_json(answer), lambda v: F.coalesce(of(v), F.struct(
        answer.alias("element"), F.array(F.lit("invalid object")).alias("errors"), F.lit(False).alias("sound"))))


def document(command: Column, fields: Column, lists: Column) -> Column:
    """Reply text of known fields (JSON texts) and lists (arrays of structs with an ``element``); keys sorted."""
    def of(sp: Column) -> Column:
        def entry(f: Column) -> Column:
            of_list = F.transform(F.try_element_at(lists, f["name"]), lambda e: e["element"])
            listed = F.concat(F.lit("["), F.array_join(F.coalesce(of_list, _no_messages()), ","), F.lit("]"))
            value = F.coalesce(F.try_element_at(fields, f["name"]), F.when(f["kind"] == "objects", listed))
            return F.concat(F.lit('"'), f["name"], F.lit('":'), value)
        ordered = F.array_sort(F.transform(sp["fields"], lambda f: F.struct(f["name"].alias("name"), f["kind"].alias("kind"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(ordered, entry), ","), F.lit("}"))
    return bind(spec(command), of)


ENTRIES = "array<struct<element: string, sound: boolean>>"


def _sound(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda e: e["sound"]))


def by_list(elements: Column) -> Column:
    """map(list -> entries in order) of an ordered array of elements."""
    names = F.array_distinct(F.transform(elements, lambda e: e["list"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(
        F.filter(elements, lambda e: e["list"] == n),
        lambda e: F.struct(e["element"].alias("element"), e["sound"].alias("sound"))))))


def merged(command: Column, fields: Column, lists: Column, answer: Column) -> Column:
    """struct(fields, lists, clean) of what is held and a whole-document answer (``parts``) together.

    Held entries never leave a list: an answer's list counts where nothing is held, or, for
    content that is only checked as a whole, where it has as many sound entries. ``clean`` is
    false if an entry taken from the answer still has errors.
    """
    fit = F.filter(answer["elements"], lambda e: F.size(e["errors"]) == 0)

    def of(sp: Column, theirs: Column) -> Column:
        own = lambda n: F.coalesce(F.try_element_at(lists, n), F.array().cast(ENTRIES))
        new = lambda n: F.coalesce(F.try_element_at(theirs, n), F.array().cast(ENTRIES))
        stays = lambda n: (sp["elementwise"] & (F.size(own(n)) > 0)) | (_sound(own(n)) > _sound(new(n)))
        names = F.transform(F.filter(sp["fields"], lambda f: f["kind"] == "objects"), lambda f: f["name"])
        both = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.when(stays(n), own(n)).otherwise(new(n)))))
        given = F.map_filter(answer["fields"], lambda k, v: v != '""')
        # a list that was no list before is one once the answer has it
        left = F.map_filter(fields, lambda k, v: ~F.map_contains_key(given, k) & ~(
            F.array_contains(names, k) & F.map_contains_key(theirs, k)))
        clean = F.forall(answer["elements"], lambda e: (F.size(e["errors"]) == 0) | stays(e["list"]))
        return F.struct(F.map_concat(left, given).alias("fields"), both.alias("lists"), clean.alias("clean"))
    return bind(spec(command), lambda sp: bind(by_list(fit), lambda theirs: of(sp, theirs)))
