"""Personal data by anchor expansion.

Method. One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier cues.
From each anchor a deterministic parser of its kind expands to the boundaries and validates:
addresses by their labels, IPv4 parts by range, cards by Luhn, phones by digit count, IBANs by
their check digits. Parsers look only at the run of characters around the anchor, and a run is
read once per kind, so a text takes time in proportion to its length.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base. The method adds ``account`` (an
IBAN, or 6 to 34 letters and digits with at least 6 digits after an account cue) and ``login``
(user and password in a URL).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from opslake.llm.common import arrow_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
#: In letters of either case.
CUES = ("iban", "account", "acct", "a/c")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_digits = re.compile(r"[0-9]+").match
_chain = re.compile(r"[0-9](?:[\x20-]?[0-9])*").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]*").match
_after_cue = re.compile(r"(?:[\x20\t]*+(?:[.:#]|(?i:numbers?|num|no|nr)(?![A-Za-z0-9])))*+[\x20\t]*+").match
_word = re.compile(r"[A-Za-z0-9]+").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}").match
_login = re.compile(r"([^\s/?#@:]+):([^\s/?#@]+)@").match
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        found.add_word(word, (word, len(word)))
    for cue in CUES:
        for letters in itertools.product(*({c, c.upper()} for c in cue)):
            found.add_word("".join(letters), (cue, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """ISO 7064 check of an IBAN of 15 to 34 characters."""
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    rest = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def iban_end(text: str, at: int) -> int:
    """Where the longest valid IBAN that starts at ``at`` ends, at a word's end; 0 if there is none."""
    m = _iban(text, at)
    for end in range(m.end(), at + 14, -1) if m else ():
        if text[end - 1] != " " and not text[end:end + 1].isalnum() and iban_valid(text[at:end]):
            return end
    return 0


def spans(text: str) -> list[Span]:
    """All spans of a text, by kind as listed, then start; ends are exclusive."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # what lies before is consumed
    runs = {"ip": 0, "card": 0, "word": 0}  # the run that begins before is read

    def add(kind: str, a: int, b: int) -> None:
        out[kind].append((kind, a, b))
        done[kind] = b

    def email(at: int) -> None:
        a, low = at, done["email"]
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        m = _domain(text, at + 1) if a < at else None
        if m:
            add("email", a, m.end())

    def digit(at: int) -> None:
        if at >= runs["card"]:
            m = _chain(text, at)
            runs["card"] = m.end()
            only = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(only) <= 19 and luhn(only):
                add("card", at, m.end())
        if at >= runs["ip"]:
            a, b, parts = at, _digits(text, at).end(), 1
            edges = [(a, b)]
            while parts < 4 and text[b:b + 1] == ".":
                m = _digits(text, b + 1)
                if not m:
                    break
                b, parts = m.end(), parts + 1
                edges.append(m.span())
            runs["ip"] = b if parts == 4 else edges[0][1]
            # a part of more than three digits that has zeros in front is still in range
            if parts == 4 and all(int(text[x:y].lstrip("0")[:4] or 0) <= 255 for x, y in edges):
                add("ip", a, b)

    def phone(at: int) -> None:
        m = _phone(text, at)
        end = m.end() if m else at
        while end > at + 3 and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end >= at + 4 and 8 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
            add("phone", at, end)

    def account(end: int) -> None:
        if end < done["account"] or text[end:end + 1] in _LETTERS:
            return
        a = _after_cue(text, end).end()
        b = iban_end(text, a)
        if b:
            add("account", a, b)
            return
        if a >= runs["word"]:
            m = _word(text, a)
            runs["word"] = m.end() if m else a
        b = runs["word"]
        if 6 <= b - a <= 34 and sum(c in "0123456789" for c in text[a:b]) >= 6:
            add("account", a, b)

    def login(at: int) -> None:
        # both runs stop at a slash, so that no character is read for two schemes
        a = at
        while a > done["login"] and text[a - 1] in _SCHEME:
            a -= 1
        m = _login(text, at + 3) if any(c in _LETTERS for c in text[a:at]) else None
        if m:
            add("login", m.start(1), m.end(2))

    # a plus sign, a cue or a scheme is rare; digits and at-signs are read where they stand
    for end, (word, size) in anchors().iter(text):
        at = end - size + 1
        if "0" <= word <= "9" and size == 1:
            digit(at)
        elif word == "@":
            email(at)
        elif word == "+":
            phone(at)
        elif word == "://":
            login(at)
        else:
            account(end + 1)
    return [s for k in KINDS for s in out[k]]


def joined(found: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in found])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are code points, ends exclusive. A null text is empty and has no spans; equal rows
    give equal rows; texts are read whole; an empty table gives no rows.
    """
    def fold(ids, texts):
        cols: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        for text in texts.to_pylist():
            found = spans(text) if text else []
            base = [s for s in found if s[0] in BASE]
            for k in BASE:
                cols[f"n_{k}"].append(sum([s[0] == k for s in base]))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(found))
        return pa.table({"_id": ids} | {c: pa.array(v, pa.int64() if c[:2] == "n_" else pa.string())
                                        for c, v in cols.items()})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(
        arrow_rows(fold, ["_id", "_text"]),
        f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    ).withColumnRenamed("_id", id_col)


def masked(text: str, tag: Callable[[str], str] = lambda kind: f"<{kind.upper()}>") -> str:
    """The text with its spans replaced by tags; overlapping spans share the first one's tag."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], tag(kind)]
        at = max(at, b)
    return "".join(out) + text[at:]
