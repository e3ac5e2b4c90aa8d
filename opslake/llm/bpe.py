"""Byte-level BPE encoding and decoding with a given public vocabulary.

Method. The symbols of a piece stand under a segment tree whose leaf i holds the rank of the
pair (i, next). Its root yields the leftmost pair of the lowest rank; a merge changes three
leaves, each in logarithmic time, until no pair can merge. So a piece of n symbols takes
O(n log n) whatever its length. Pieces recur, so a worker keeps a bounded number of results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opslake.llm.common import arrow_rows

#: Pieces kept by a worker (in two generations of so many), and how long a kept piece may be.
KEPT_PIECES = 300_000
KEPT_CHARS = 64
PLAIN_BELOW = 0x250

#: A leaf in one number, so that the least is the lowest rank, then the leftmost.
PLACE_BITS, SYMBOL_BITS = 40, 24
PLACE, SYMBOL, NONE = (1 << PLACE_BITS) - 1, (1 << SYMBOL_BITS) - 1, 1 << 96


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """Ids of pieces, joined by commas, of a bounded number of pieces; a missing one is encoded."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, str] = {}

    def __missing__(self, text: str) -> str:
        found = self.older.get(text)
        if found is None:
            byte_ids = self.bpe.byte_ids
            found = ",".join(map(str, self.bpe.merge([byte_ids[b] for b in text.encode("utf-8")])))
        if len(text) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""findall of a pattern whose classes are \p{L}, \p{N}, \s and \S.

    Texts of characters below U+0250 go to the standard matcher, with the classes written out.
    """
    whole = regex.compile(pattern).findall
    members = {name: "".join(re.escape(chr(i)) for i in range(PLAIN_BELOW) if regex.match(name, chr(i)))
               for name in (r"\p{L}", r"\p{N}", r"\s")}
    plain = regex.sub(
        r"(\[\^?)|(\])|(\\p\{L\}|\\p\{N\}|\\s)|(\\S)",
        _Rewrite(members), pattern)
    quick, odd = re.compile(plain).findall, re.compile(f"[^\0-{chr(PLAIN_BELOW - 1)}]").search
    return lambda text: whole(text) if odd(text) else quick(text)


class _Rewrite:
    """Writes out the classes of a pattern, with brackets where they stand outside of any."""

    def __init__(self, members: dict[str, str]):
        self.members = members
        self.inside = False

    def __call__(self, m) -> str:
        if m[1] or m[2]:
            self.inside = bool(m[1])
            return m[0]
        if m[4]:
            return "[^" + self.members[r"\s"] + "]"
        return self.members[m[3]] if self.inside else "[" + self.members[m[3]] + "]"


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.split = splitter(pattern)
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank << SYMBOL_BITS | vocab[a + b]) << PLACE_BITS
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {str(i): bytes(back[c] for c in token) for token, i in vocab.items()
                         if all(c in back for c in token)}
        self.bytes_of |= {str(i): token.encode() for token, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.kept = Kept(self)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        find = self.pairs.get
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            found = find(pair)
            if found:
                tree[size + i] = found | i  # a leaf holds rank, then merged symbol, then place
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        root = tree[1]
        while root != NONE:
            i = root & PLACE
            j = after[i]
            symbols[i] = root >> PLACE_BITS & SYMBOL
            symbols[j] = -1
            k = after[i] = after[j]
            leaves = [(i, NONE)]
            if k < n:
                before[k] = i
                found = find((symbols[i], symbols[k]))
                leaves[0] = (i, found | i if found else NONE)
                leaves.append((j, NONE))
            elif j < n - 1:
                leaves.append((j, NONE))
            h = before[i]
            if h >= 0:
                found = find((symbols[h], symbols[i]))
                leaves.append((h, found | h if found else NONE))
            for at, value in leaves:
                at += size
                tree[at] = value
                while at > 1:
                    b = tree[at ^ 1]
                    if b < value:
                        value = b
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
            root = tree[1]
        return [s for s in symbols if s >= 0]

    def encoded(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        known = self.kept.__getitem__
        if self.cut is None or not self.cut.search(text):
            return ",".join(map(known, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(known, self.split(text[at:m.start()]))
            out.append(str(self.special[m[0]]))
            at = m.end()
        return ",".join(out + list(map(known, self.split(text[at:]))))

    def encode(self, text: str) -> list[int]:
        joined = self.encoded(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: Iterable[str]) -> str:
        """The text of ids, each as a decimal; unknown ones are left out, broken UTF-8 gives U+FFFD."""
        known = self.bytes_of
        try:
            out = b"".join(map(known.__getitem__, ids))
        except KeyError:
            out = b"".join([known[i] for i in ids if i in known])
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; equal rows give equal rows; an empty table none.
    Texts are taken whole. The vocabulary file must be readable at ``path`` on every executor.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def fold(ids, texts):
        bpe = load(path, pattern)
        counts, sums, backs = [], [], []
        for text in texts.to_pylist():
            joined = bpe.encoded(text or "")
            ids_of = joined.split(",") if joined else []
            counts.append(len(ids_of))
            sums.append(hashlib.sha256(joined.encode()).hexdigest())
            backs.append(hashlib.sha256(bpe.decode(ids_of).encode()).hexdigest())
        return pa.table({"_id": ids, "n_tokens": pa.array(counts, pa.int64()),
                         "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(backs, pa.string())})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(
        arrow_rows(fold, ["_id", "_text"]),
        f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens and the token ids of every document, whole."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def fold(ids, texts):
        bpe = load(path, pattern)
        rows = [np.array(bpe.encode(t or ""), np.int32) for t in texts.to_pylist()]
        return pa.table({"_id": ids, "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
                         "token_ids": pa.array(rows, pa.list_(pa.int32()))})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(arrow_rows(fold, ["_id", "_text"]), f"_id {kind}, n_tokens long, token_ids array<int>"
                           ).withColumnRenamed("_id", id_col)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None,
                  pattern: str | None = None) -> DataFrame:
    """id and text of rows of token ids; null ids give an empty text."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def fold(ids, tokens):
        bpe = load(path, pattern)
        return pa.table({"_id": ids, "text": pa.array([bpe.decode(map(str, t or [])) for t in tokens.to_pylist()], pa.string())})

    rows = encoded.select(encoded[id_col].alias("_id"), encoded["token_ids"].alias("_ids"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(arrow_rows(fold, ["_id", "_ids"]), f"_id {kind}, text string").withColumnRenamed("_id", id_col)
