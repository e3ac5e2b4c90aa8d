"""Plain Python forms of the operators, for comparison."""

from __future__ import annotations

import re

import xxhash


def simhash(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def classes(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= radius:
                a, b = sorted((find(ids[x]), find(ids[y])))
                parent[b] = a
    return {i: find(i) for i in ids}


def pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        odd = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(odd)) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = {g: grams.count(g) for g in set(grams)} if len(grams) < 400 else __import__("collections").Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if times[g] > 1 for d in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def secrets(text):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, least) in enumerate(kinds)
             for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def repeats(texts, width=200):
    """(bytes, removed, spans, kept) of every text."""
    import collections
    data = [(t or "").encode() for t in texts]
    times = collections.Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if times[d[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def semiglobal(item, text):
    """Fewest edits of ``item`` anywhere in ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]
