"""Reply normalising, validation, salvage and repair."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from opslake.functions import json_reply as jr
from opslake.operators import replies


def one(spark, fn, command, raw):
    df = spark.createDataFrame([(command, raw if isinstance(raw, str) else json.dumps(raw))], "c string, r string")
    return df.select(fn(F.col("c"), F.col("r")).alias("x")).head()[0]


@pytest.mark.parametrize(("text", "want"), [
    ('Sure: {"a":{"b":"}"}} done {"c":1}', '{"a":{"b":"}"}}'), ('```json\n{"a":"q\\"}"}\n```', '{"a":"q\\"}"}'),
    ("no braces", None), ('{"a": 1', None), ('{"open string', None), ("", None), ('  {"a":1}\n', '{"a":1}'), ("x } {}", "{}")])
def test_first_object(values, text, want):
    assert values(jr.json_object, [text]) == [want]
    assert values(jr.first_object, [text]) == [want]


def _first(text):
    """The first balanced object, character by character."""
    start, depth, quoted, i = text.find("{"), 0, False, 0
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if quoted:
            escapes = len(text[start:i]) - len(text[start:i].rstrip("\\"))
            quoted = not (c == '"' and escapes % 2 == 0)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start:i + 1]
    return None


def test_objects_in_random_text(values):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['{', '}', '"', '\\', 'a', ',', '[', ']', ':', 'é', ' ']) for _ in range(rng.randrange(14))) for _ in range(400)]
    # a backslash outside strings is plain text, but pairs with what follows; leave such texts out
    texts = [t for t in texts if not re.search(r'\\\\', re.sub(r'"(?:[^"\\]|\\.)*("|$)', "", t[t.find("{"):], flags=re.S))]
    texts += ["x" * 50_000 + '{"a":"' + '\\"' * 30_000 + '"} y', "{" * 20_000, '{"a":' + "[" * 3000 + "]" * 3000 + "}"]
    assert values(jr.first_object, texts) == [_first(t) for t in texts]


def test_essentially_empty(values):
    texts = ["", " \n", "{ }", "null", "[ ]", '{"a":1}', "nul l"]
    assert values(jr.essentially_empty, texts) == [True, True, True, True, True, False, True]


# Words and the allowed word they stand for.
@pytest.mark.parametrize(("value", "want"), [
    ("warning", "warning"), ("Warning", "warning"), ("WARNING", "warning"), ("  warning  ", "warning"), ("warn", "warning"),
    ("crit", "critical"), ("informational", "info"), ("error", "error"), ("", ""), ("  ", "  ")])
def test_canonical(values, value, want):
    assert values(lambda c: jr.canonical(c, ["critical", "warning", "info"]), [value]) == [want]


def test_normalise(spark):
    doc = {"summary": " ok ", "issues": 1, "findings": [
        {"severity": "Warning", "title": "  spaced  ", "port": 8080, "detail": True, "extra": [1]}, 5]}
    assert json.loads(one(spark, jr.normalise, "ports", doc)) == {
        "summary": "ok", "issues": 1, "findings": [
            {"severity": "warning", "title": "spaced", "port": "8080", "detail": "true", "extra": [1]}, 5]}
    acts = {"issues": [], "actions": [{"description": 1.5, "disruptive": " False "}, {"description": None, "disruptive": "maybe"}]}
    assert json.loads(one(spark, jr.normalise, "doctor", acts))["actions"] == [
        {"description": "1.5", "disruptive": False}, {"description": None, "disruptive": "maybe"}]
    assert one(spark, jr.normalise, "ports", "{broken") == "{broken"
    assert json.loads(one(spark, jr.normalise, "why", {"next_steps": [" a ", 2]}))["next_steps"] == ["a", "2"]


@pytest.mark.parametrize(("command", "raw", "want"), [
    ("audit", {"summary": "s", "findings": []}, []),
    ("audit", {"summary": "s", "findings": None}, []),
    ("audit", "{", ["JSON syntax error"]),
    ("audit", [1], ["top-level must be a JSON object"]),
    ("audit", "null", ['field "summary" is missing', 'field "findings" is missing']),
    ("audit", {"summary": None, "findings": "x"}, ['field "summary" cannot be null', 'field "findings": expected array, got string']),
    ("audit", {"summary": 3, "findings": [{"severity": "info", "category": "file", "title": [], "detail": "d"}]},
     ['field "summary": expected string, got number', 'field "findings[0].title": expected string, got array']),
    ("audit", {"summary": "s", "findings": [7]}, ["findings[0]: invalid object"]),
    ("doctor", {"issues": [], "actions": [{"description": "d", "disruptive": "yes"}]},
     ['field "actions[0].disruptive": expected bool, got string']),
    ("why", {"summary": "s", "chain": [], "next_steps": ["a", 1]}, ['field "next_steps[1]": expected string, got number']),
])
def test_structural(spark, command, raw, want):
    assert one(spark, jr.structural_errors, command, raw) == want


@pytest.mark.parametrize(("command", "raw", "want"), [
    ("why", {"summary": " ", "chain": [], "next_steps": []}, [
        "summary must not be empty", "chain must contain at least one step",
        "next_steps must contain at least one remediation step"]),
    ("why", {"summary": "s", "chain": [{"event": "", "detail": "d"}], "next_steps": ["x"]}, ["chain[0].event must not be empty"]),
    ("ports", {"summary": "s", "findings": [{"severity": "critical", "port": "1", "title": "t", "detail": ""}]}, [
        "findings[0].severity must be 'warning' or 'info', got \"critical\"", "findings[0].detail must not be empty"]),
    ("updates", {"summary": "s", "updates": [{"package": "p", "category": "security", "detail": " "}]}, [
        'updates[0].detail must not be empty when category is "security"']),
    ("updates", {"summary": "s", "updates": [{"package": "p", "category": "huge", "detail": " "}]}, [
        "updates[0].category must be 'security'/'major'/'minor'/'unknown', got \"huge\""]),
    ("crons", {"summary": "s", "jobs": [{"source": "a", "command": "b", "what_it_does": "c", "status": "ok", "last_run": ""}]}, [
        "jobs[0].last_run must not be empty (use 'unknown' when unavailable)"]),
    ("timers", {"summary": "s", "timers": [{"name": "n", "status": "", "last_run": "x", "next_run": "y"}]}, [
        "timers[0].status must not be empty"]),
    ("audit", {"summary": "", "findings": []}, []),
])
def test_semantic(spark, command, raw, want):
    assert one(spark, jr.semantic_errors, command, raw) == want


def test_salvage(spark):
    good = {"severity": "Warn", "port": 22, "title": "t", "detail": "d"}
    doc = {"summary": "s", "findings": [good, {"severity": "info"}, "text", good | {"severity": "critical"}, good | {"port": "9"}]}
    got = one(spark, jr.salvage, "ports", doc)
    kept = json.loads(got.reply)
    assert [f["port"] for f in kept["findings"]] == ["22", "9"] and kept["findings"][0]["severity"] == "warning"
    assert kept["summary"] == "s" and got.dropped == 2
    assert json.loads(one(spark, jr.salvage, "ports", {"summary": "s"}).reply) == {"findings": [], "summary": "s"}
    assert one(spark, jr.salvage, "ports", "nothing here") is None


@pytest.mark.parametrize("text", [
    '{"summary":"s","findings":[]} trailing', '{"summary":"s"}{"x":1}', '{"summary":"s"} ]', '{"summary":"s"}, {"x":1}', '{"summary":"s"}}',
    '{"summary":"s"', "", "not json", '1], [2'])
def test_only_one_whole_value_parses(spark, values, text):
    assert values(lambda c: F.to_json(jr.strict_json(c)), [text, ' {"a":1} ', "null", "[1,2]", None]) == [
        None, '{"a":1}', "null", "[1,2]", None]
    assert one(spark, jr.structural_errors, "audit", text) == ["JSON syntax error"]
    assert one(spark, jr.normalise, "audit", text) == text


def test_the_last_of_repeated_keys_counts(spark):
    raw = '{"summary":"a","summary":" b ","findings":[]}'
    assert one(spark, jr.structural_errors, "audit", raw) == []
    assert json.loads(one(spark, jr.normalise, "audit", raw)) == {"summary": "b", "findings": []}


@pytest.mark.parametrize(("text", "want"), [
    ('{"summary":"s","findings":[{"a":1},{"b":"}"},{"severity":"in', {"summary": "s", "findings": [{"a": 1}, {"b": "}"}]}),
    ('{"summary":"cut o', None), ('{"a":1,"b":2', {"a": 1}), ('{"a":[', {"a": []}), ('{"a":[1,2', {"a": [1]}), ('so {"a":true} and {"b":1}', {"a": True}),
    ('{"a":{"b":[1]},"c":nul', {"a": {"b": [1]}}), ('{"a":1,"a":2,', {"a": 2}), ("{", None), (None, None), ("{]", None), ('{"a" 1}', None)])
def test_complete_part(values, text, want):
    got = values(jr.complete_part, [text])[0]
    assert (json.loads(got) if got else None) == want


def test_every_cut_of_a_reply(values):
    items = [{"severity": "info", "title": f'q "{k}", {{[', "n": [k, {"x": None}]} for k in range(7)]
    doc = json.dumps({"summary": "a, {b}", "findings": items, "next": ["é", "y"], "n": 12.5, "ok": True})
    got = values(jr.complete_part, [f"so: {doc[:k]}" for k in range(len(doc) + 1)])
    for k, text in enumerate(got):
        part = json.loads(text) if text else {}
        whole = [i for i in items if doc.find(json.dumps(i)) + len(json.dumps(i)) <= k]
        assert part.get("findings", []) == whole or part["findings"] == whole[:-1] and doc[k - 1] != ",", (k, doc[:k])
        assert all(part[f] == json.loads(doc)[f] for f in part if f not in ("findings", "next"))
    assert json.loads(got[-1]) == json.loads(doc)
    wrong = doc.replace('"next"', '"next" oops', 1)
    assert json.loads(values(jr.complete_part, [wrong + " and more"])[0]) == {"summary": "a, {b}", "findings": items}


def _repair(spark, rows, answer, log=None):
    """Outcomes by id; ``answer`` gets (id, list, position, attempt, current)."""
    def responder(frames):
        for pdf in frames:
            if log:
                with open(log, "a") as f:
                    f.writelines(f"{r.id}{r.list and ':%s%d' % (r.list, r.position)}:{r.attempt}\n" for r in pdf.itertuples())
            yield pdf.assign(current=[answer(r.id, r.list, r.position, r.attempt, r.current) for r in pdf.itertuples()])
    df = spark.createDataFrame(rows, "id long, command string, raw string")
    out = replies.repair_outcomes(df, responder)
    assert out.columns == ["id", "command", "attempts", "status", "reply"]
    got = out.collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    return {r.id: (r.status, r.attempts, r.reply and json.loads(r.reply)) for r in got}


FINE = {"severity": "info", "category": "file", "title": "t", "detail": "d"}
ALSO = {"severity": "info", "category": "user", "title": "u", "detail": "e"}


def _doc(*findings, summary="s", **more):
    return json.dumps({"summary": summary, "findings": list(findings)} | more)


def test_only_what_is_unsound_is_asked_for(spark, tmp_path):
    log = str(tmp_path / "calls")
    whole = _doc(FINE)
    cut = '{"summary":"s","findings":[' + json.dumps(FINE) + ',{"severity":1}],"x":'
    rows = [(1, "audit", "text " + whole), (2, "audit", ""), (3, "audit", cut), (4, "audit", _doc(FINE, {"severity": 1}, ALSO)),
            (5, "audit", ""), (6, "audit", whole[:-9]), (7, "nothing", whole), (8, "audit", None)]

    def answer(i, name, position, attempt, current):
        if i == 4:
            return json.dumps(json.loads(current) | {"title": "new"} | ({"detail": "n", "category": "file"} if attempt > 1 else {}))
        return whole if (i, attempt) == (2, 2) else '{"summary":"late","findings":[{"sev' if i == 5 else "no"

    got = _repair(spark, rows, answer, log)
    assert got[1] == ("valid", 0, json.loads(whole)) and got[2] == ("repaired", 2, json.loads(whole))
    assert got[3] == ("incomplete", 3, json.loads(whole))
    assert got[4] == ("repaired", 2, json.loads(_doc(FINE, {"severity": "1", "title": "new", "detail": "n", "category": "file"}, ALSO)))
    assert got[5] == ("incomplete", 3, json.loads(_doc(summary="late")))
    assert got[6] == ("recovered", 0, json.loads(_doc()))
    assert got[7] == ("incomplete", 3, None) and got[8] == ("incomplete", 3, None)
    assert sorted(open(log).read().split()) == sorted(
        ["2:1", "2:2", *[f"3:findings1:{k}" for k in (1, 2, 3)], "4:findings1:1", "4:findings1:2",
         *[f"{i}:{k}" for i in (5, 7, 8) for k in (1, 2, 3)]])


def test_sound_entries_never_leave(spark):
    answers = ["{}", "", "null", "[]", "no", '{"findings":[]}', _doc(ALSO, summary=""), None, '{"summary":"","findings":[{"sev']
    port = lambda n, sev="info": {"severity": sev, "port": n, "title": "t", "detail": "d"}
    docs = [("ports", _doc(port("1"), port("2"), summary="")), ("audit", json.dumps({"findings": [FINE, 7, ALSO]})),
            ("ports", _doc(port("1"), port("2", "bad"), port("3")))]
    got = _repair(spark, [(10 * k + n, *d) for k in range(len(answers)) for n, d in enumerate(docs)], lambda i, *_: answers[i // 10])
    for k, answer in enumerate(answers):
        a, b, c = (got[10 * k + n] for n in range(3))
        assert (a[0], a[1]) == ("incomplete", 3) and a[2] == {"summary": "", "findings": [port("1"), port("2")]}, answer
        assert b[0] == "incomplete" and b[2]["findings"] == [FINE, ALSO], answer
        assert c == ("incomplete", 3, {"summary": "s", "findings": [port("1"), port("3")]}), answer


def test_document_answers_add_to_what_is_held(spark):
    port = lambda n: {"severity": "info", "port": n, "title": "t", "detail": "d"}
    step = lambda e: {"event": e, "detail": "d"}
    act = lambda d: {"description": d, "disruptive": True}
    issue = {"severity": "x", "title": "t", "detail": "d"}
    rows = [
        (1, "ports", _doc(port("1"), port("2"), summary=" ")),  # answered shorter and reordered
        (2, "ports", '{"findings":"none","summary":"s"}'),  # a list that is no list
        (3, "why", json.dumps({"summary": "s", "chain": [step("a"), step("")], "next_steps": ["n"]})),  # content checked as a whole
        (4, "doctor", json.dumps({"issues": [issue, {}], "actions": [act("a"), {"description": "b"}]})),  # two lists
        (5, "ports", "{}"), (6, "ports", _doc({"severity": "bad", "port": "1", "title": "t", "detail": "d"}))]

    first = {1: _doc(port("2"), summary="new"), 2: _doc(port("5"), summary=""), 3: "{}", 5: _doc(port("1"), {"port": 2}),
             6: json.dumps({"findings": [port("1") | {"severity": "Warn"}]})}
    later = {3: json.dumps({"chain": [step("a"), step("b")]}), 5: _doc(port("1"), port("2"))}
    entry = {"issues": json.dumps({"issues": [issue | {"title": "u"}]}), "actions": json.dumps(act("c"))}

    def answer(i, name, position, attempt, current):
        return entry[name] if i == 4 else later[i] if attempt > 1 else first[i]

    got = _repair(spark, rows, answer)
    assert got[1] == ("repaired", 1, json.loads(_doc(port("1"), port("2"), summary="new")))
    assert got[2] == ("repaired", 1, json.loads(_doc(port("5"))))
    assert got[3] == ("repaired", 2, {"summary": "s", "chain": [step("a"), step("b")], "next_steps": ["n"]})
    assert got[4] == ("repaired", 1, {"issues": [issue, issue | {"title": "u"}], "actions": [act("a"), act("c")]})
    assert got[5] == ("repaired", 2, json.loads(_doc(port("1"))))  # the first answer's sound entry is held
    assert got[6] == ("repaired", 1, json.loads(_doc(port("1") | {"severity": "warning"})))


def test_equal_rows_are_repaired_each_for_itself(spark):
    rows = [(1, "audit", _doc(FINE, {})), (1, "audit", _doc(FINE, {})), (1, "audit", _doc({}))]
    df = spark.createDataFrame(rows, "id long, command string, raw string")
    out = replies.repair_outcomes(df, lambda frames: (f.assign(current=json.dumps(ALSO)) for f in frames))
    assert sorted(len(json.loads(r.reply)["findings"]) for r in out.collect()) == [1, 2, 2]
    assert replies.repair_outcomes(df, lambda frames: (f.head(0) for f in frames)).filter("status = 'incomplete'").count() == 3
    assert replies.repair_outcomes(df.limit(0), lambda frames: frames).count() == 0


def test_schema_text_lists_every_field():
    assert replies.schema_text("audit") == (
        '{"summary":"string","findings":[{"severity":"string","category":"string","title":"string","detail":"string"}]}')
    assert replies.schema_text("doctor").endswith('"actions":[{"description":"string","disruptive":bool}]}')


def test_tidy_elements_are_those_left_as_they_are_and_sound(spark):
    fine = {"severity": "info", "port": "1", "title": "t", "detail": "d"}
    odd = [{}, {"title": " t"}, {"title": "t　"}, {"title": "t\n"}, {"title": ""}, {"title": 1}, {"title": None}, {"severity": "Info"},
           {"severity": "critical"}, {"severity": ""}, {"more": "x"}, {"detail": "a b"}, {"detail": "\x01 x"}, {"title": ["t"]}]
    near = [{"severity": "info", "port": "1", "detail": "d"}, {"severity": "info", "port": "1", "title: STRING, detail": "t", "title": "t"}]
    cases = [("ports", "findings", fine | o) for o in odd] + [("ports", "findings", n) for n in near] + [
        ("updates", "updates", {"package": "p", "installed": "1", "available": "2", "category": c, "reboot_required": True, "detail": d})
        for c in ("security", "minor", "huge", "") for d in ("", "d")] + [
        ("audit", "findings", FINE | {"category": c}) for c in ("file", "File", "none", "")] + [
        ("why", "chain", {"event": e, "detail": "d"}) for e in ("e", "")]
    df = spark.createDataFrame([(i, c, n, json.dumps(e)) for i, (c, n, e) in enumerate(cases)], "i int, c string, n string, e string")
    of = F.get(F.filter(jr.spec(F.col("c"))["fields"], lambda f: f["name"] == F.col("n")), F.lit(0))
    rows = df.select("*", jr.strict_json(F.col("e")).alias("v"), of.alias("f"))
    normal = jr.normal_object(F.col("v"), F.col("f")["fields"])
    plain = ((F.to_json(normal) == F.to_json("v")) & (F.size(jr.object_errors(normal, F.col("f")["fields"], F.lit(""))) == 0)
             & (F.size(jr._element_messages(normal, F.col("f")["checks"])) == 0))
    got = rows.select("i", jr.tidy(F.col("v"), F.col("f")).alias("tidy"), plain.alias("plain")).collect()
    known = {r.i for r in got if r.tidy}
    assert all(r.plain for r in got if r.tidy) and {0, 11} <= known and len(known) > 5
    # more fields than the known ones, a word audit does not check, or the mark between texts take the longer way
    assert {json.dumps(cases[r.i][2]) for r in got if r.plain and not r.tidy} <= {
        json.dumps(fine | {"more": "x"}), json.dumps(fine | {"detail": "\x01 x"}), json.dumps(near[1]),
        *[json.dumps(FINE | {"category": c}) for c in ("none", "")]}


def test_replies_are_dealt_by_rows(spark, tmp_path):
    from opslake.catalog import fixtures, replies as queries
    spark.range(1, 2_001).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = fixtures.spread_view(spark, str(tmp_path), "replies", "orders", ["o_orderkey"], 100)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 110
    assert sorted(got.collect()) == sorted(fixtures.view(spark, str(tmp_path), "replies").collect())
    assert queries.replies.TASK_ROWS <= 50_000


def test_kept_replies_are_dealt_by_rows_again(spark, monkeypatch):
    dealt = []
    spread = replies.spread_rows
    monkeypatch.setattr(replies, "TASK_ROWS", 10)
    monkeypatch.setattr(replies, "spread_rows", lambda df, n: dealt.append(spread(df, n)) or dealt[-1])
    df = spark.createDataFrame([(i, "audit", _doc(FINE, *[{}] * (i % 2))) for i in range(200)], "id long, command string, raw string")
    out = replies.repair_outcomes(df, lambda frames: (f.assign(current=json.dumps(ALSO)) for f in frames))
    assert out.groupBy("status").count().orderBy("status").collect() == [("repaired", 100), ("valid", 100)]
    assert [d.rdd.getNumPartitions() for d in dealt] == [20, 10]
