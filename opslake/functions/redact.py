"""Ordered redaction rules and line classification, all as Column -> Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake.functions.text import WB, WE, bind, lines, trim


@dataclass(frozen=True)
class Rule:
    name: str
    apply: Callable[[Column], Column]


# What each rule matches, in Java regex syntax with ASCII boundaries.
STOP = r"""\t\n\f\r ,;)\]>"'"""
PATTERNS = {
    "iso_time": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:[+-]\d{2}:?\d{2}|Z)?",
    "syslog_time": r"(?md)^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} ",
    "journal_mark": r"(?md)^-- (?:Boot|Logs begin|No entries|Reboot)[^\n]*",
    "pid_tag": r"\[\d{2,}\][\t\n\f\r ]*",
    "syslog_host": r"(?md)^([A-Za-z0-9_.-]+) ([A-Za-z0-9_./+-]+(?:\[\d+\])?:)",
    "url": rf"{WB}(?iu:https?|ftp|rsync|file)://[^{STOP}]+",
    # \G or a non-local-part character before: same matches, no restart inside a long token
    "email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "mac": rf"{WB}(?:[0-9a-fA-F]{{2}}:){{5}}[0-9a-fA-F]{{2}}{WE}",
    "ipv4": rf"{WB}(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?:/\d{{1,2}})?{WE}",
    "repo_cache": r"/var/cache/(?:libdnf5|dnf|yum)/[a-zA-Z0-9._-]+-[0-9a-fA-F]{6,}",
    "home_path": rf"(?:/home/[^/{STOP}]+|/root|/Users/[^/{STOP}]+)(?:/[^{STOP}]*)?",
    "config_path": rf"/etc(?:/[^{STOP}]*)?",
    "log_path": rf"/var/log(?:/[^{STOP}]*)?",
    "cache_path": rf"/var/cache(?:/[^{STOP}]*)?",
    "lib_path": rf"/usr/(?:lib|share|local)(?:/[^{STOP}]*)?",
    "any_path": rf"(^|[\t\n\f\r (])/[A-Za-z0-9_.][^{STOP}]*",
    "uuid": rf"{WB}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{WE}",
    "prefixed_hex": rf"{WB}0x[0-9a-fA-F]{{6,}}{WE}",
    "bare_hex": rf"{WB}[0-9a-fA-F]{{32,}}{WE}",
    "package_nvr": (
        rf"{WB}([a-zA-Z][a-zA-Z0-9_+.]*(?:-[a-zA-Z][a-zA-Z0-9_+.]*)*)-\d+(?:\.\d+){{0,3}}"
        r"(?:-[\w.]+)?(?:\.(?:fc|el|rhel|al|amzn|suse|deb|ubuntu)\d+)?"
        rf"(?:\.(?:x86_64|i[3-6]86|aarch64|armv\d\w*|noarch|src)){WE}"
    ),
    "already_tagged": r"^<[A-Z_]+>",
    "error_word": rf"(?i){WB}(?:error|fatal|fail(?:ed|ure)?|panic|critical|emerg){WE}",
    "warn_word": rf"(?i){WB}warn(?:ing)?{WE}",
    "scriptlet_word": r"(?iu)scriptlet|%(?:pre|post|preun|postun)|update-alternatives",
    "transaction_word": rf"{WB}(?iu:installed|upgraded|removed|reinstalled|obsoleted|downgraded){WE}",
    "debug_word": rf"(?i){WB}(?:debug|trace){WE}",
}

# Cheap necessary conditions: a text without them cannot match the rule.
MARKER_HINTS = [
    "error", "fatal", "fail", "panic", "critical", "emerg", "warn", "scriptlet",
    "%p", "update-alternatives", "install", "upgraded", "removed", "obsoleted",
    "downgraded", "debug", "trace", "\u017f",
]
NVR_HINT = r"\.(?:x86_64|i[3-6]86|aarch64|armv\d|noarch|src)"


def _sub(name: str, repl: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, F.lit(PATTERNS[name]), F.lit(repl))


def _gated(test: Callable[[Column], Column], change: Callable[[Column], Column]):
    """Run ``change`` only on texts that pass the cheap ``test``."""
    return lambda c: bind(c, lambda v: F.when(test(v), change(v)).otherwise(v))


def _chain(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        for step in steps:
            c = step(c)
        return c
    return run


def _has(text: str) -> Callable[[Column], Column]:
    return lambda v: F.contains(v, F.lit(text))


_H = "[0-9a-fA-F]{1,4}"
_MAPPED_FULL = rf"{WB}(?:0{{1,4}}:){{5}}[fF]{{4}}:{_H}:{_H}{WE}"
_FULL = rf"{WB}(?:{_H}:){{7}}{_H}{WE}"
_COLON_RUN = rf"{WB}(?:{_H}:){{2,7}}{_H}{WE}"
_MAPPED_LEAD = (
    rf"::(?:(?:0{{1,4}}:){{4}}[fF]{{4}}:{_H}:{_H}{WE}"
    rf"|(?:0{{1,4}}:){{0,3}}[fF]{{4}}:{_H}:{_H}{WE}(?!:{_H}{WE}))"
)
_LEAD = rf"::(?:{_H}:){{0,6}}{_H}{WE}"
_MAPPED_TRAIL = rf"{WB}(?:0{{1,4}}:){{5}}[fF]{{4}}:(?:{_H}:)?:"
_TRAIL = rf"{WB}(?:{_H}:){{1,7}}:"

# Candidates are consumed left to right whether or not they are addresses. Group 1
# captures the ones that are kept (not an address, or an IPv4-mapped one); the
# negative lookaheads leave the addresses to the last alternative.
IPV6_CANDIDATE = (
    rf"({_MAPPED_FULL}|(?!{_FULL}){_COLON_RUN}|{_MAPPED_LEAD}|(?!{_COLON_RUN}){_MAPPED_TRAIL})"
    rf"|{_FULL}|{_LEAD}|{_TRAIL}"
)


def _mask_ipv6(c: Column) -> Column:
    def put(piece: Column, kept: Column) -> Column:
        return F.concat(piece, F.when(kept.isNull(), "").when(kept == "", "<IPV6>").otherwise(kept))

    def masked(t: Column) -> Column:
        kept = F.regexp_extract_all(t, F.lit(IPV6_CANDIDATE), F.lit(1))
        return F.concat_ws("", F.zip_with(F.split(t, IPV6_CANDIDATE, -1), kept, put))
    return bind(c, lambda t: F.when(t.rlike(IPV6_CANDIDATE), masked(t)).otherwise(t))


def classify_line(line: Column) -> Column:
    """Tagged form of one line: blank stays blank, tagged stays as it is."""
    def tagged(t: Column) -> Column:
        tag = lambda name: F.concat(F.lit(f"<{name}> "), t)
        return (
            F.when(t == "", t)
            .when(t.rlike(PATTERNS["already_tagged"]), t)
            .when(t.rlike(PATTERNS["error_word"]), tag("ERROR"))
            .when(t.rlike(PATTERNS["warn_word"]), tag("WARN"))
            .when(t.rlike(PATTERNS["scriptlet_word"]), tag("SCRIPTLET"))
            .when(t.rlike(PATTERNS["transaction_word"]), tag("TRANSACTION"))
            .when(t.rlike(PATTERNS["debug_word"]), tag("DEBUG"))
            .otherwise(tag("INFO"))
        )
    return bind(trim(line), tagged)


def _plain_line(line: Column) -> Column:
    return bind(trim(line), lambda t: F.when(
        (t == "") | t.rlike(PATTERNS["already_tagged"]), t,
    ).otherwise(F.concat(F.lit("<INFO> "), t)))


def classify_lines(text: Column) -> Column:
    """Tag every line; texts without any marker word skip the per-line word tests."""
    def has_marker(low: Column) -> Column:
        hit = F.contains(low, F.lit(MARKER_HINTS[0]))
        for word in MARKER_HINTS[1:]:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    def tag_all(t: Column) -> Column:
        return F.when(bind(F.lower(t), has_marker), F.transform(lines(t), classify_line)).otherwise(
            F.transform(lines(t), _plain_line))
    return F.array_join(bind(text, tag_all), "\n")


def severity(tagged: Column) -> Column:
    """ERROR, WARN, ... of a classified line; '' when it carries another tag."""
    return F.regexp_extract(tagged, r"^<(ERROR|WARN|SCRIPTLET|TRANSACTION|DEBUG|INFO)>", 1)


def actionable(tagged: Column) -> Column:
    return tagged.startswith("<ERROR>") | tagged.startswith("<WARN>")


def collapse_repeats(text: Column) -> Column:
    """Run-length encode consecutive equal lines of one text: ``line [xN]``."""
    def from_lines(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ls, i) != F.get(ls, i - 1)))

        def from_starts(ss: Column) -> Column:
            def run(s: Column, k: Column) -> Column:
                return bind(
                    F.coalesce(F.get(ss, k + 1), n) - s,
                    lambda length: F.when(
                        length > 1,
                        F.concat(F.get(ls, s), F.lit(" [x"), length.cast("string"), F.lit("]")),
                    ).otherwise(F.get(ls, s)))
            return F.array_join(F.transform(ss, run), "\n")

        return bind(starts, from_starts)
    return bind(lines(text), from_lines)


RULES = [
    Rule("strip-timestamps", _chain(
        _sub("iso_time", ""), _sub("syslog_time", ""),
        _gated(_has("-- "), _sub("journal_mark", "")),
        _gated(_has("["), _sub("pid_tag", "")))),
    Rule("strip-hostnames", _gated(_has(":"), _sub("syslog_host", "$2"))),
    Rule("mask-urls", _gated(_has("://"), _sub("url", "<URL>"))),
    Rule("mask-emails", _gated(_has("@"), _sub("email", "<EMAIL>"))),
    Rule("mask-mac", _gated(_has(":"), _sub("mac", "<MAC>"))),
    Rule("mask-ipv4", _sub("ipv4", "<IPV4>")),
    Rule("mask-ipv6", _gated(lambda v: v.rlike("::|:[0-9a-fA-F]{1,4}:"), _mask_ipv6)),
    Rule("normalise-repo", _gated(_has("/var/cache/"), _sub("repo_cache", "<REPO_CACHE>"))),
    Rule("mask-home", _gated(_has("/"), _sub("home_path", "<HOME_PATH>"))),
    Rule("mask-paths", _gated(_has("/"), _chain(
        _sub("config_path", "<CONFIG_PATH>"), _sub("log_path", "<LOG_PATH>"),
        _sub("cache_path", "<CACHE_PATH>"), _sub("lib_path", "<LIB_PATH>"),
        _sub("any_path", "$1<PATH>")))),
    Rule("mask-uuid", _gated(_has("-"), _sub("uuid", "<UUID>"))),
    Rule("mask-hex", _chain(
        _gated(_has("0x"), _sub("prefixed_hex", "<HEX>")), _sub("bare_hex", "<HEX>"))),
    Rule("normalise-package-nvr", _gated(
        lambda v: v.rlike(NVR_HINT), _sub("package_nvr", "$1-<VERSION>"))),
    Rule("classify-lines", classify_lines),
    Rule("collapse-repeats", collapse_repeats),
]
BY_NAME = {r.name: r for r in RULES}


def default_rules() -> list[Rule]:
    """All rules, for whole texts."""
    return list(RULES)


def line_rules() -> list[Rule]:
    """Rules that are safe on one line at a time (no collapsing)."""
    return [r for r in RULES if r.name != "collapse-repeats"]


def sanitise(c: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Apply the rules in order and trim; empty in, empty out."""
    for rule in default_rules() if rules is None else rules:
        c = rule.apply(c)
    return trim(c)


def sanitise_line(c: Column) -> Column:
    return sanitise(c, line_rules())


# The masking rules step by step: rule, pattern, the group that is removed, what stands in its place.
_REMOVALS = [
    ("strip-timestamps", "iso_time", 0, ""), ("strip-timestamps", "syslog_time", 0, ""),
    ("strip-timestamps", "journal_mark", 0, ""), ("strip-timestamps", "pid_tag", 0, ""),
    ("strip-hostnames", "syslog_host", 1, "$2"), ("mask-urls", "url", 0, "<URL>"), ("mask-emails", "email", 0, "<EMAIL>"),
    ("mask-mac", "mac", 0, "<MAC>"), ("mask-ipv4", "ipv4", 0, "<IPV4>"), ("mask-ipv6", "ipv6", 0, "<IPV6>"),
    ("normalise-repo", "repo_cache", 0, "<REPO_CACHE>"), ("mask-home", "home_path", 0, "<HOME_PATH>"),
    ("mask-paths", "config_path", 0, "<CONFIG_PATH>"), ("mask-paths", "log_path", 0, "<LOG_PATH>"),
    ("mask-paths", "cache_path", 0, "<CACHE_PATH>"), ("mask-paths", "lib_path", 0, "<LIB_PATH>"),
    ("mask-paths", "any_path", 0, "$1<PATH>"), ("mask-uuid", "uuid", 0, "<UUID>"),
    ("mask-hex", "prefixed_hex", 0, "<HEX>"), ("mask-hex", "bare_hex", 0, "<HEX>"),
    ("normalise-package-nvr", "package_nvr", 0, "$1-<VERSION>"),
]
MASKING = list(dict.fromkeys(r[0] for r in _REMOVALS))
#: What a removed value does not begin or end with.
VALUE_EDGE = " \t\n\f\r"


def nothing_removed(text: Column) -> Column:
    """struct(values, text) before the first step."""
    return F.struct(F.array().cast("array<struct<rule:string,value:string>>").alias("values"), text.alias("text"))


def removal_steps() -> list[Callable[[Column], Column]]:
    """The masking rules' steps on struct(values, text): what a step takes out joins the (rule, value) pairs.

    A value is what the step's pattern matches in the text as it stands then, without white
    space around it.
    """
    def masked_ipv6(t: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(IPV6_CANDIDATE), F.lit(0)).alias("m"),
                             F.regexp_extract_all(t, F.lit(IPV6_CANDIDATE), F.lit(1)).alias("kept"))
        return F.transform(F.filter(pairs, lambda p: p["kept"] == ""), lambda p: p["m"])

    def step(rule: str, name: str, group: int, repl: str) -> Callable[[Column], Column]:
        change = _mask_ipv6 if name == "ipv6" else _sub(name, repl)
        found = masked_ipv6 if name == "ipv6" else lambda t: F.regexp_extract_all(t, F.lit(PATTERNS[name]), F.lit(group))
        opening = F.lit(VALUE_EDGE + "(" * (name == "any_path"))  # a path may stand in brackets

        def run(s: Column) -> Column:
            own = F.transform(found(s["text"]), lambda v: F.struct(F.lit(rule).alias("rule"), F.rtrim(
                F.ltrim(v, opening), F.lit(VALUE_EDGE)).alias("value")))
            return bind(change(s["text"]), lambda left: F.struct(
                F.when(left == s["text"], s["values"]).otherwise(F.concat(s["values"], own)).alias("values"), left.alias("text")))
        return run
    return [step(*r) for r in _REMOVALS]
