"""DuckDB spellings of the redaction rules, used only to check the Spark results."""

from __future__ import annotations

from opslake.functions.text import SPACE_CHARS

# The rules' patterns in RE2 syntax, in rule order.
_STOP = r"""\s,;)\]>"'"""
RULE_SQL: dict[str, list[tuple[str, str]]] = {
    "strip-timestamps": [
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:[+-]\d{2}:?\d{2}|Z)?", ""),
        (r"(?m)^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} ", ""),
        (r"(?m)^-- (?:Boot|Logs begin|No entries|Reboot)[^\n]*", ""),
        (r"\[\d{2,}]\s*", ""),
    ],
    "strip-hostnames": [(r"(?m)^([A-Za-z0-9_.-]+) ([A-Za-z0-9_./+-]+(?:\[\d+])?:)", r"\2")],
    "mask-urls": [(rf"(?i)\b(?:https?|ftp|rsync|file)://[^{_STOP}]+", "<URL>")],
    "mask-emails": [(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<EMAIL>")],
    "mask-mac": [(r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", "<MAC>")],
    "mask-ipv4": [(r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b", "<IPV4>")],
    "mask-ipv6": [],
    "normalise-repo": [
        (r"/var/cache/(?:libdnf5|dnf|yum)/[a-zA-Z0-9._-]+-[0-9a-fA-F]{6,}", "<REPO_CACHE>")],
    "mask-home": [
        (rf"(?:/home/[^/{_STOP}]+|/root|/Users/[^/{_STOP}]+)(?:/[^{_STOP}]*)*", "<HOME_PATH>")],
    "mask-paths": [
        (rf"/etc(?:/[^{_STOP}]*)*", "<CONFIG_PATH>"),
        (rf"/var/log(?:/[^{_STOP}]*)*", "<LOG_PATH>"),
        (rf"/var/cache(?:/[^{_STOP}]*)*", "<CACHE_PATH>"),
        (rf"/usr/(?:lib|share|local)(?:/[^{_STOP}]*)*", "<LIB_PATH>"),
        (rf"(^|[\s(])/[A-Za-z0-9_.][^{_STOP}]*", r"\1<PATH>"),
    ],
    "mask-uuid": [
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>")],
    "mask-hex": [(r"\b0x[0-9a-fA-F]{6,}\b", "<HEX>"), (r"\b[0-9a-fA-F]{32,}\b", "<HEX>")],
    "normalise-package-nvr": [(
        r"\b([a-zA-Z][a-zA-Z0-9_+.]*(?:-[a-zA-Z][a-zA-Z0-9_+.]*)*)-\d+(?:\.\d+){0,3}(?:-[\w.]+)?"
        r"(?:\.(?:fc|el|rhel|al|amzn|suse|deb|ubuntu)\d+)?"
        r"(?:\.(?:x86_64|i[3-6]86|aarch64|armv\d\w*|noarch|src))\b", r"\1-<VERSION>")],
}

# Kept candidates in group 1, masked ones outside it.
_H = "[0-9a-fA-F]{1,4}"
_FULL = rf"\b(?:{_H}:){{7}}{_H}\b"
_MAPPED = rf"\b(?:0{{1,4}}:){{5}}[fF]{{4}}:{_H}:{_H}\b"
_LONG_LEAD = rf"::(?:0{{1,4}}:){{0,3}}[fF]{{4}}:{_H}:{_H}(?::{_H})+\b"
_MAPPED_LEAD = rf"::(?:0{{1,4}}:){{0,4}}[fF]{{4}}:{_H}:{_H}\b"
_LEAD = rf"::(?:{_H}:){{0,6}}{_H}\b"
_TRAIL = rf"\b(?:{_H}:){{1,7}}:"
_SHORT = rf"\b(?:{_H}:){{2,6}}{_H}\b"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(repl)}, 'g')"


def mask_ipv6(expr: str) -> str:
    # addresses first, each pass on text the earlier passes cannot produce
    kept = (rf"({_MAPPED})|{_FULL}|({_SHORT})|{_LONG_LEAD}|({_MAPPED_LEAD})|{_LEAD}|{_TRAIL}")
    groups = " || ".join(f"coalesce(regexp_extract_all(t, {quote(kept)}, {g})[i], '')" for g in (1, 2, 3))
    pieces = f"string_split_regex(t, {quote(kept)})"
    return (f"list_transform([{expr}], lambda t: array_to_string(list_transform(range(1, len({pieces}) + 1), "
            f"lambda i: {pieces}[i] || case when i = len({pieces}) then '' when {groups} = '' then '<IPV6>' else {groups} end), ''))[1]")


def masked_ipv6(expr: str) -> str:
    """The addresses that ``mask_ipv6`` masks."""
    kept = (rf"({_MAPPED})|{_FULL}|({_SHORT})|{_LONG_LEAD}|({_MAPPED_LEAD})|{_LEAD}|{_TRAIL}")
    groups = " || ".join(f"coalesce(regexp_extract_all({expr}, {quote(kept)}, {g})[i], '')" for g in (1, 2, 3))
    every = f"regexp_extract_all({expr}, {quote(kept)})"
    return (f"list_transform(list_filter(range(1, len({every}) + 1), lambda i: {groups} = ''), lambda i: {every}[i])")


def rule(name: str, expr: str) -> str:
    if name == "mask-ipv6":
        return mask_ipv6(expr)
    for pattern, repl in RULE_SQL[name]:
        expr = sub(expr, pattern, repl)
    return expr


def masked(expr: str) -> str:
    """Every rule before line classification."""
    for name in RULE_SQL:
        expr = rule(name, expr)
    return expr


def trim(expr: str) -> str:
    codes = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    return f"trim({expr}, {codes})"


def classify(line: str) -> str:
    """Tagged form of one already trimmed line."""
    word = lambda words: rf"(?i)\b(?:{words})\b"
    # The words of each tag, in order.
    tests = [
        ("ERROR", word("error|fatal|fail(?:ed|ure)?|panic|critical|emerg")),
        ("WARN", word("warn(?:ing)?")),
        ("SCRIPTLET", r"(?i)scriptlet|%(?:pre|post|preun|postun)|update-alternatives"),
        ("TRANSACTION", word("installed|upgraded|removed|reinstalled|obsoleted|downgraded")),
        ("DEBUG", word("debug|trace")),
    ]
    whens = " ".join(
        f"when regexp_matches({line}, {quote(p)}) then '<{tag}> ' || {line}" for tag, p in tests)
    return (f"case when {line} = '' then {line} when regexp_matches({line}, '^<[A-Z_]+>') then {line} "
            f"{whens} else '<INFO> ' || {line} end")


def classify_text(expr: str) -> str:
    trimmed = f"list_transform(string_split({expr}, chr(10)), lambda l: {trim('l')})"
    return f"array_to_string(list_transform({trimmed}, lambda t: {classify('t')}), chr(10))"


def sanitise_line(expr: str) -> str:
    return trim(classify_text(masked(expr)))


def collapse(source: str, key: str, text: str, out: str) -> str:
    """Query that run-length encodes the lines of ``text`` per ``key`` of ``source``."""
    return f"""
select {key}, string_agg(line || case when n > 1 then ' [x' || n || ']' else '' end, chr(10) order by run) as {out}
from (select {key}, run, line, count(*) as n from (
    select {key}, line, pos, sum(fresh) over (partition by {key} order by pos) as run from (
      select *, case when lag(line) over (partition by {key} order by pos) = line then 0 else 1 end as fresh
      from (select {key}, unnest(string_split({text}, chr(10))) as line,
              unnest(range(len(string_split({text}, chr(10))))) as pos from {source}) a) b) c
  group by all) d
group by {key}"""
