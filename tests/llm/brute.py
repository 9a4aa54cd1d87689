"""The operators by brute force, in plain Python and without their code."""

from __future__ import annotations

import json
import math
import struct
from collections import Counter, defaultdict
from hashlib import md5
from unicodedata import normalize

import xxhash

SPACE = " \t\n\r\f\x0b"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash64(*values) -> int:
    """Spark's xxhash64: each value hashed with the hash before it as seed, nulls left out."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def text_key(text: str | None) -> int:
    return hash64("\x00null" if text is None else text)


def words(text: str | None) -> list[str]:
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


# 1
def language(model, text: str | None) -> tuple[str | None, float, bool]:
    """Nearest centroid by cosine of plain TF-IDF vectors of byte 2- and 3-grams; model: languages, owner, centroids, idf, radius."""
    body = bytearray(b" ")
    for b in (text or "").lower().encode():
        letter = b if 97 <= b <= 122 or b >= 128 else 32
        if letter != 32 or body[-1] != 32:
            body.append(letter)
    if body[-1] != 32:
        body.append(32)
    grams: Counter = Counter()
    m = 0xFFFFFFFF
    if len(body) >= 3:
        for i in range(len(body) - 1):
            two = (body[i] * 0x9E3779B1 + body[i + 1] * 0x85EBCA77) & m
            grams[((two ^ two >> 15) * 0x27D4EB2F & m) >> 19] += 1
            if i + 2 < len(body):
                three = (two + body[i + 2] * 0xC2B2AE3D) & m
                grams[((three ^ three >> 13) * 0x165667B1 & m) >> 19] += 1
    n = sum(grams.values())
    if not n:
        return None, 1.0, False
    v = {g: (1 + math.log(c)) * float(model.idf[g]) for g, c in grams.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cosines = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    distance = 1 - cosines[best]
    return model.languages[model.owner[best]], distance, distance <= model.radius[min(23, int(math.log2(n)))]


# 2
def mix(items: list[tuple], quality: dict, budget: int | None = None, weights: dict | None = None, seed: int = 7, worth: dict | None = None) -> Counter:
    """items: (doc_id, text, source). Copies of each (doc_id, source, tokens)."""
    worth = worth or {1: 2.0, 0: 0.5}
    by = defaultdict(list)
    for i, text, source in items:
        u = (int(md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[source].append((-math.log(u) / worth.get(quality.get(i), 1.0), -1 if i is None else i, len(words(text)), i))
    total = {s: sum(x[2] for x in rows) for s, rows in by.items()}
    share = {s: weights.get(s, 0) if weights else math.sqrt(t) for s, t in total.items() if t}
    budget = sum(total.values()) if budget is None else budget
    out: Counter = Counter()
    for s, w in share.items():
        want = w / sum(share.values()) * budget
        epochs, rest = int(want // total[s]), want - want // total[s] * total[s]
        for key, order, n, i in by[s]:
            copies = epochs + (sum(x[2] for x in by[s] if (x[0], x[1]) <= (key, order)) <= rest)
            if copies:
                out[(i, s, n)] += copies
    return out


# 3
def removed_lines(rows: list[tuple], num: int = 4, den: int = 5) -> dict[tuple, set[int]]:
    """rows: (doc_id, text). Lines that go, by (doc_id, text)."""
    lines = []
    for i, text in dict.fromkeys(rows):
        for k, x in enumerate((text or "").split("\n")):
            if w := frozenset(words(x.lower())):
                lines.append((2**63 - 1 if i is None else i, text_key(text), k, (i, text), w))
    lines.sort(key=lambda x: x[:3])
    holds = defaultdict(list)
    out = defaultdict(set)
    for j, (*_, k, doc, w) in enumerate(lines):
        both: Counter = Counter(a for t in w for a in holds[t])
        if any(den * c >= num * (len(w) + len(lines[a][4]) - c) for a, c in both.items()):
            out[doc].add(k)
        for t in w:
            holds[t].append(j)
    return out


def without(text: str | None, gone: set[int]) -> str | None:
    return text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


# 4
def canonical(text: str) -> bytes:
    return " ".join(normalize("NFKC", normalize("NFKC", text).casefold()).split()).encode()


# 5
def groups(prints: list[tuple], blocks: tuple[int, ...], block_k: int, cover_k: int, confirm_k: int) -> list[int]:
    """Group of each fingerprint (four signed words): all pairs, then connected groups. One without words (None) is alone."""
    whole = [None if f[0] is None else sum((w & (2**64 - 1)) << 64 * k for k, w in enumerate(f)) for f in prints]
    known = sorted({x for x in whole if x is not None})
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(known):
        for y in known[:i]:
            d = x ^ y
            if (d & (2**120 - 1)).bit_count() <= cover_k and (d >> 128).bit_count() <= confirm_k and min((d >> b & (2**30 - 1)).bit_count() for b in blocks) <= block_k:
                root[find(x)] = find(y)
    return [-1 - i if x is None else known.index(find(x)) for i, x in enumerate(whole)]


# 7
def placed(pieces: list[tuple], patterns: list[tuple[tuple[int, ...], int]]) -> set[tuple]:
    """(seq_id, slot, piece) when each slot of a pattern takes its repeats' pieces off its class in order. pieces: (class, piece)
    in order of their rank."""
    queue = defaultdict(list)
    for c, x in pieces:
        queue[c].append(x)
    at: Counter = Counter()
    out, seq = set(), 0
    for pattern, repeats in patterns:
        for slot, c in enumerate(pattern):
            out |= {(seq + r, slot, queue[c][at[c] + r]) for r in range(repeats)}
            at[c] += repeats
        seq += repeats
    return out


# 10
def shards(rows: list[tuple], target: int, split: int = 8) -> Counter:
    """rows: (doc_id, text, source, lang). Count of each (doc_id, shard)."""
    need = lambda r: (len((r[1] or "").encode()), len(words(r[1])), 1)
    item = lambda r: hash64(json.dumps({k: v for k, v in (("g0", r[2]), ("g1", r[3])) if v is not None}, separators=(",", ":"), ensure_ascii=False))
    total = [max(1, sum(need(r)[d] for r in rows)) for d in range(3)]
    n = max(1, -(-sum(need(r)[0] for r in rows) // target))
    sums = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        sums[item(r)] = [a + b for a, b in zip(sums[item(r)], need(r), strict=True)]
    share = {k: max(x * n / t for x, t in zip(v, total, strict=True)) for k, v in sums.items()}
    parts = {k: math.ceil(s * split) if s > 1 + 1e-9 else 1 for k, s in share.items()}
    where = lambda r: (item(r), hash64(r[0], text_key(r[1])) % parts[item(r)])
    items = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        items[where(r)] = [a + b for a, b in zip(items[where(r)], need(r), strict=True)]
    order = sorted(items)
    needs = [[x * n / t for x, t in zip(items[k], total, strict=True)] for k in order]
    room = [[1.0] * 3 for _ in range(n)]
    at = {}
    for i in sorted(range(len(order)), key=lambda i: (-max(needs[i]), i)):
        left = [[a - b for a, b in zip(x, needs[i], strict=True)] for x in room]
        fits = [s for s in range(n) if min(left[s]) >= -1e-12]
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(room[s], needs[i], strict=True)), -s)) if fits else max(range(n), key=lambda s: (min(left[s]), -s))
        room[best] = left[best]
        at[order[i]] = best
    return Counter((r[0], at[where(r)]) for r in rows)
