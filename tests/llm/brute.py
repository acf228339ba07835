"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lower(text):
    return (text or "").translate(UP)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def groups(ids, links):
    """Least id reachable, by id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def near(docs, n, percent):
    """docs: [(id, text)] -> ({id: set size}, {id: least id})."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if a == b or (x and y and 100 * len(x & y) >= percent * len(x | y))]
    return sets, groups({i for i, _ in sets}, links)


def contaminated(text, items, span=10):
    w = words(text)
    hit, found = set(), set()
    for item, passage in items:
        p = words(passage)
        n = min(len(p), span)
        if not n:
            continue
        windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        hit |= {k for i in at for k in range(i, i + n)}
        if at:
            found.add(item)
    return len(w), len(hit), found, hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def canonical(text):
    n = unicodedata.normalize
    folded = n("NFKD", n("NFKD", n("NFD", text or "").casefold()).casefold())
    return re.sub(r"\s+", " ", re.sub(r"[\s\x1c-\x1f\x85]+", " ", folded)).strip(" ")


def line_norm(line):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")


def seeded(number, text):
    """Spark's xxhash64 of an int and a string."""
    return xxhash.xxh64(text.encode(), seed=xxhash.xxh64(number.to_bytes(4, "little"), seed=42).intdigest()).intdigest()


def simhash(norm, bits=63):
    hs = []
    for w in norm.split(" "):
        half = -(-len(w) // 2)
        hs += [seeded(1, w)] * 2 if len(w) < 5 else [seeded(1, w[:half]), seeded(2, w[half:])]
    counts = np.array([[h >> k & 1 for k in range(bits)] for h in hs]).sum(axis=0)
    return sum(1 << k for k in range(bits) if counts[k] > len(hs) // 2)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_dedup(docs, distance=3, percent=80):
    """docs: [(id, text)], ids distinct -> {id: text}."""
    places = defaultdict(list)
    for i, text in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate((text or "").split("\n")):
            if norm := line_norm(line):
                places[norm].append((i, k))
    norms = sorted(places)
    sims = [simhash(x) for x in norms]
    alike = lambda a, b: edits(a, b) <= max(len(a), len(b)) * (100 - percent) // 100
    links = [(a, b) for a, b in combinations(range(len(norms)), 2) if (sims[a] ^ sims[b]).bit_count() <= distance and alike(norms[a], norms[b])]
    gone = set()
    members = defaultdict(list)
    for k, g in groups(range(len(norms)), links).items():
        members[g] += places[norms[k]]
    for found in members.values():
        gone |= set(found) - {min(found)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the four kinds that hold."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out
