"""Operator 8, language-model scoring by a hierarchical Pitman-Yor model of order 6 over characters.

Characters (lower case) are 64 symbols. Every context is a Chinese restaurant: of length 5, with the corpus's counts
as customers, down to the empty one over a uniform base. Each table of a restaurant is a customer of its parent, the
context without its oldest symbol. Counts come from all documents, whole.

Restaurants whose contexts end in the same three symbols share all their ancestors down to length 3, and lie in one
part. A round lets every part sample its seating by Gibbs (the tables of all customers of all dishes of a level
at once), levels 5 to 3, given the predictive probabilities of the levels above. Those (at most 64**2 + 64 + 1
restaurants) are sampled on the driver from the parts' table counts, between rounds. After the burn-in each round's
predictive probabilities are a sample; scores use their mean. A text's perplexity is per symbol.

Of a seating only the number of tables of each type (context, dish) is kept: predictions depend on no more. With c
customers, discount d and base probability p it has the weights S(c, t) (d x p)^t, where S are generalised Stirling
numbers and x ~ Gamma(strength / d + tables of the restaurant) makes the dishes independent. So a draw takes in every
customer whatever the count. S is exact up to EXACT customers; above, ratios S(c, t + 1) / S(c, t) are a saddle point's.

Texts are read once: in blocks of BLOCK bytes, as symbols, with the counts of the distinct 6-grams of each block. The
counts go to the parts, which learn from them; afterwards the same 6-grams ask the parts for their probabilities,
which come back to the block and are summed by text. The model is never in one place: a part's share of it is bounded
by the alphabet (three symbols of context have at most 64**3 types at the longest level), parts follow the bytes of
the corpus up to PARTS, and beyond that the blocks that ask a part are split by salts, to each of which it is sent.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import U64, chunks, expand, expand_rising, materialize, mix, partitions, release, squeeze, squeeze_rising

SYMBOLS, LEVELS = 64, 6
LENGTHS = (5, 4, 3)  # of the contexts that the parts hold
TOPS = (2, 1, 0)  # and of those on the driver
BURN_IN, SAMPLES, MOVES = 3, 4, 4
DISCOUNT = (0.3, 0.5, 0.6, 0.7, 0.75, 0.8)  # by length of the context
STRENGTH = (1.0,) * 6
_CHUNK = 1 << 19  # bytes of text handled at once: some eight words of 64 bits are held for each
BLOCK, PART_BYTES, PARTS, SALT_BYTES = 1 << 24, 1 << 24, 1 << 12, 1 << 28
_TOP = U64((1 << 18) - 1)

_SYMBOL = np.zeros(1 << 16, np.uint32)
_SYMBOL[:] = 60 + np.arange(1 << 16) % 4
_SYMBOL[:128] = 32 + np.arange(128) % 4
_SYMBOL[[9, 11, 12, 13, 32]] = 27
_SYMBOL[10], _SYMBOL[46], _SYMBOL[44] = 28, 30, 31
_SYMBOL[48:58] = 29
_SYMBOL[97:123] = np.arange(1, 27)
for _i, _c in enumerate("àáâãäåæçèéêëìíîïñòóôöùúû"):
    _SYMBOL[ord(_c)] = 36 + _i
for _c in "üß":
    _SYMBOL[ord(_c)] = 60 + ord(_c) % 4


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk's characters, and where each row's end (from 0)."""
    if not len(data) or int(data.max()) < 128:
        return _SYMBOL[data].astype(np.uint8), offs
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    return _SYMBOL[np.minimum(points, (1 << 16) - 1)].astype(np.uint8), ends


def ngrams(symbol: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """36-bit code of every symbol with the 5 before it (0 before a text's first), and the row that each is in."""
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    pad = LEVELS - 1
    padded = np.zeros(len(symbol) + pad * len(n), U64)
    at = np.arange(len(symbol)) + pad * row
    padded[at + pad] = symbol
    size = max(len(padded) - pad, 0)
    code = padded[pad:].copy()
    for k in range(1, LEVELS):
        code |= padded[pad - k : pad - k + size] << U64(6 * k)
    return code[at], row


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, where the run of each begins in the order of codes, and that order."""
    if len(code) < 1 << 28:  # code and place in one word, which sorts fastest
        both = np.sort(code << U64(28) | np.arange(len(code), dtype=U64))
        code, order = both >> U64(28), (both & U64((1 << 28) - 1)).astype(np.int64)
    else:
        order = np.argsort(code)
        code = code[order]
    at = np.flatnonzero(np.diff(code, prepend=code[:1] ^ U64(1)))
    return code[at], at, order


def _sum(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(codes, kind="stable")  # merges sorted stretches
    codes, counts = codes[o], counts[o]
    at = np.flatnonzero(np.diff(codes, prepend=codes[:1] ^ U64(1)))
    return codes[at], np.add.reduceat(counts, at)


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """By the context's last three symbols, so that whole subtrees stay together."""
    return mix(code >> U64(6) & _TOP) % U64(parts)


# blocks
_ROWS_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()), ("counts", pa.binary())])
_ROWS_SQL = "kind int, block long, part int, ids array<long>, ends array<long>, data binary, counts binary"


def _blocks(parts: int, block_bytes: int):
    """Texts as symbols (kind 0, a chunk a row), and of each block the distinct codes of each part with counts (kind 1)."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_ROWS_SCHEMA)

    def counted(block: int, held: list) -> pa.RecordBatch:
        code, n = _sum(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = part_of(code, parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        code, n, part = code[order], n[order], part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        return made([
            {"kind": 1, "block": block, "part": int(part[i]), "data": squeeze_rising(code[i:j]), "counts": squeeze(n[i:j])}
            for i, j in zip(first, [*first[1:], len(code)], strict=True)
        ])

    def run(batches):
        block, held, size, seen = uuid.uuid4().int >> 65, [], 0, 0
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for row, data, offs in chunks(text, limit=_CHUNK):
                symbol, ends = symbols(data, offs)
                yield made([{"kind": 0, "block": block, "ids": ids.slice(row, len(offs) - 1).to_pylist(), "ends": ends[1:].tolist(), "data": squeeze(symbol)}])
                if len(symbol):
                    code = np.sort(ngrams(symbol, ends)[0])
                    at = np.flatnonzero(np.diff(code, prepend=code[:1] ^ U64(1)))
                    held.append((code[at], np.diff(at, append=len(code)).astype(np.int64)))
                    seen += len(at)
                    if seen > 1 << 21:
                        held = [_sum(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                        seen = 0
                size += len(data)
                if size >= block_bytes:
                    if held:
                        yield counted(block, held)
                    block, held, size, seen = uuid.uuid4().int >> 65, [], 0, 0
        if held:
            yield counted(block, held)

    return run


@dataclass
class Blocks:
    """Documents as blocks of symbols with their 6-grams' counts by part."""

    texts: DataFrame
    codes: DataFrame
    parts: int
    salts: int


def blocked(docs: DataFrame, parts: int | None = None, block_bytes: int = BLOCK, part_bytes: int = PART_BYTES, salt_bytes: int = SALT_BYTES) -> Blocks:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if parts is None:
        parts = int(min(PARTS, max(partitions(docs.sparkSession), size // part_bytes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(rows.mapInArrow(_blocks(parts, block_bytes), _ROWS_SQL), "blocks", by="kind")
    return Blocks(table.where("kind = 0").select("block", "ids", "ends", "data"), table.where("kind = 1").select("block", "part", "data", "counts"), parts, int(1 + size // (parts * salt_bytes)))


def _counts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of a part's rows."""
    held, size = [], 0
    for data, counts in zip(table.column("data").to_pylist(), table.column("counts").to_pylist(), strict=True):
        held.append((expand_rising(data), expand(counts, np.int64)))
        size += len(held[-1][0])
        if size > 1 << 21 and len(held) > 8:
            held = [_sum(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0
    return _sum(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _merge(table: pa.Table) -> pa.Table:
    code, n = _counts_of(table)
    return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([squeeze_rising(code)], pa.binary()), "counts": pa.array([squeeze(n)], pa.binary())})


# seating
EXACT, _DIRECT, _GRID, _ROWS = 256, 32, 64, 1 << 14


@cache
def _stirling(d: float) -> np.ndarray:
    """log S(n, t) for n, t <= EXACT; a column more, and -inf where t is 0 or over n."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        out[n + 1, 1:-1] = np.logaddexp(out[n, :-2], out[n, 1:-1] + np.log(np.maximum(n - d * t, 1e-9)))
    return out


@cache
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(n / t), rising, and log(1 - u^d), where u solves the saddle point of t tables for n customers."""
    u = np.concatenate([1 - np.logspace(-6, -0.31, 400), np.logspace(-0.3, -60, 1600)])
    full = -np.expm1(d * np.log(u))
    return np.log(d * (1 - u) * u ** (d - 1) / full), np.log(full)


def _log_ratio(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(n, t + 1) / S(n, t) for 1 <= t; -inf from t = n on."""
    out = np.full(n.shape, -np.inf)
    ok = t < n
    low, high = ok & (n <= EXACT), ok & (n > EXACT)
    table = _stirling(d)
    out[low] = table[n[low], t[low] + 1] - table[n[low], t[low]]
    out[high] = np.interp(np.log(n[high] / t[high]), *_saddle(d)) - np.log(d * t[high])
    return out


def _choose(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, with chances exp(logs)."""
    cum = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
    return np.minimum((cum <= rng.random((len(cum), 1)) * cum[:, -1:]).sum(1), logs.shape[1] - 1)


def draw_tables(c: np.ndarray, q: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each type of c customers, with chances as S(c, t) q^t."""
    t = np.minimum(c, 1)
    lq = np.log(np.maximum(q, 1e-300))
    lo = 1
    for width in (2, 4, 8, 16, _DIRECT):
        at = np.flatnonzero((c > lo) & (c <= width))
        for a in range(0, len(at), _ROWS):
            i = at[a : a + _ROWS]
            t[i] = 1 + _choose(_stirling(d)[c[i], 1 : width + 1] + lq[i, None] * np.arange(width), rng)
        lo = width
    at = np.flatnonzero(c > _DIRECT)
    for a in range(0, len(at), _ROWS):
        i = at[a : a + _ROWS]
        t[i] = _draw_many(c[i], lq[i], d, rng)
    return t


def _draw_many(c: np.ndarray, lq: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """draw_tables on a grid of at least 8 standard deviations to both sides of the mode (chances are log-concave)."""
    mode, hi = np.ones_like(c), c.copy()
    while (mode < hi).any():
        mid = (mode + hi) // 2
        rises = (mid < hi) & (lq + _log_ratio(c, mid, d) > 0)
        mode, hi = np.where(rises, mid + 1, mode), np.where(rises, hi, mid)
    h = np.maximum(1, np.sqrt(mode).astype(np.int64) // 2)
    left, right = np.maximum(mode - h, 1), np.minimum(mode + h, c - 1)
    left = np.minimum(left, right - 1)
    bend = (_log_ratio(c, left, d) - _log_ratio(c, right, d)) / (right - left)
    step = np.maximum(1, np.ceil(1 / np.sqrt(np.maximum(bend, 1e-18)) / 4)).astype(np.int64)
    grid = mode[:, None] + (np.arange(_GRID) - _GRID // 2) * step[:, None]
    inside = (grid >= 1) & (grid <= c[:, None])
    rise = step[:, None] * (lq[:, None] + _log_ratio(np.broadcast_to(c[:, None], grid.shape), np.clip(grid + (step[:, None] - 1) // 2, 1, c[:, None] - 1), d))
    logs = np.cumsum(rise, axis=1) - rise
    got = grid[np.arange(len(c)), _choose(np.where(inside, logs, -np.inf), rng)]
    return np.clip(got - step // 2 + (rng.random(len(c)) * step).astype(np.int64), 1, c)


class Level:
    """Restaurants of one context length. Types are (context, dish), sorted by code; c customers sit at t tables."""

    def __init__(self, code: np.ndarray, discount: float, strength: float):
        self.code, self.d, self.theta = code, discount, strength
        context = code >> U64(6)
        new = np.diff(context, prepend=context[:1] ^ U64(1)) != 0
        self.context, self.rest = context[new], np.cumsum(new) - 1
        self.c = self.t = np.zeros(len(code), np.int64)
        self._count()

    def _count(self) -> None:
        self.tables = np.bincount(self.rest, self.t, minlength=len(self.context))

    @property
    def owner(self) -> np.ndarray:
        """Type of every table."""
        return np.repeat(np.arange(len(self.t)), self.t)

    @property
    def size(self) -> np.ndarray:
        """Customers of every table in one seating of c at t tables: a type's first table has all but one of each other's."""
        out = np.ones(int(self.t.sum()), np.int64)
        has = np.flatnonzero(self.t > 0)
        out[(np.cumsum(self.t) - self.t)[has]] += (self.c - self.t)[has]
        return out

    def _draw(self, base: np.ndarray, rng: np.random.Generator) -> None:
        """Draw the tables of all types; base: probability of each type's dish in the parent."""
        x = rng.gamma(self.theta / self.d + self.tables)
        self.t = draw_tables(self.c, self.d * x[self.rest] * base, self.d, rng)
        self._count()

    def fill(self, counts: np.ndarray, base: np.ndarray, rng: np.random.Generator, draws: int = 4) -> None:
        """Seat counts of each type: from about c^d tables each, `draws` times."""
        self.c = counts.astype(np.int64)
        self.t = np.ceil(self.c**self.d).astype(np.int64)
        self._count()
        for _ in range(draws):
            self._draw(base, rng)

    def follow(self, counts: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> None:
        """Make the customers counts, and seat them."""
        self.c = counts.astype(np.int64)
        self._draw(base, rng)

    def sweep(self, base: np.ndarray, moves: int, rng: np.random.Generator) -> None:
        for _ in range(moves):
            self._draw(base, rng)

    def backoff(self) -> np.ndarray:
        """What each restaurant leaves to its parent."""
        return (self.theta + self.d * self.tables) / (self.theta + np.bincount(self.rest, self.c, minlength=len(self.context)))

    def predict(self, base: np.ndarray) -> np.ndarray:
        total = self.theta + np.bincount(self.rest, self.c, minlength=len(self.context))
        return (self.c - self.d * self.t) / total[self.rest] + self.backoff()[self.rest] * base


class Tree:
    """The restaurants of contexts of the LENGTHS of one part."""

    def __init__(self, codes: list[np.ndarray]):
        self.levels, self.up = [], []
        for k, length in enumerate(LENGTHS):
            level = Level(codes[k], DISCOUNT[length], STRENGTH[length])
            self.levels.append(level)
            if k + 1 < len(LENGTHS):
                self.up.append(np.searchsorted(codes[k + 1], codes[k] & U64((1 << 6 * length) - 1)))
        self.up.append((codes[-1] & _TOP).astype(np.int64))  # type of the driver's longest level
        self.sums = None

    @classmethod
    def start(cls, code: np.ndarray, counts: np.ndarray, top: np.ndarray, rng: np.random.Generator) -> Tree:
        codes = [code]
        for length in LENGTHS[:-1]:
            codes.append(np.unique(codes[-1] & U64((1 << 6 * length) - 1)))
        tree = cls(codes)
        base = tree._bases(top, flat=True)
        for k, level in enumerate(tree.levels):
            level.fill(counts, base[k], rng)
            counts = tree._parents(k)
        return tree

    def _parents(self, k: int) -> np.ndarray | None:
        """Customers that level k sends to the next one."""
        return np.bincount(self.up[k], self.levels[k].t, minlength=len(self.levels[k + 1].code)).astype(np.int64) if k + 1 < len(LENGTHS) else None

    def _bases(self, top: np.ndarray, flat: bool = False) -> list[np.ndarray]:
        """For each level the parent's probability of each type."""
        base = top[self.up[-1]]
        out = [base]
        for k in range(len(LENGTHS) - 1, 0, -1):
            p = base if flat else self.levels[k].predict(base)
            base = p[self.up[k - 1]]
            out.append(base)
        return out[::-1]

    def round(self, top: np.ndarray, moves: int, rng: np.random.Generator, sample: bool) -> None:
        for k, level in enumerate(self.levels):
            level.sweep(self._bases(top)[k], moves, rng)
            if k + 1 < len(LENGTHS):
                self.levels[k + 1].follow(self._parents(k), self._bases(top)[k + 1], rng)
        if sample:
            base = self._bases(top)
            now = [x.astype(np.float32) for k, level in enumerate(self.levels) for x in (level.predict(base[k]), level.backoff())]
            self.sums = now if self.sums is None else [a + b for a, b in zip(self.sums, now, strict=True)]

    def top_customers(self) -> np.ndarray:
        return np.bincount(self.up[-1], self.levels[-1].t, minlength=SYMBOLS**3).astype(np.int64)

    def packed(self) -> bytes:
        """Codes, customers of the lowest level, tables and sums; all else follows from them."""
        sums = None if self.sums is None else [squeeze(x) for x in self.sums]
        return pickle.dumps(([squeeze_rising(x.code) for x in self.levels], squeeze(self.levels[0].c), [squeeze(x.t) for x in self.levels], sums), 5)

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        codes, c, t, sums = pickle.loads(blob)
        tree = cls([expand_rising(x) for x in codes])
        c = expand(c, np.int64)
        for k, level in enumerate(tree.levels):
            level.c, level.t = c, expand(t[k], np.int64)
            level._count()
            c = tree._parents(k)
        tree.sums = None if sums is None else [expand(x, np.float32) for x in sums]
        return tree


class Top:
    """The restaurants of two symbols of context, one and none, on the driver: at most 64**2 + 64 + 1."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.levels = [Level(np.arange(SYMBOLS ** (k + 1), dtype=U64), DISCOUNT[k], STRENGTH[k]) for k in TOPS]

    def _base(self, k: int) -> np.ndarray:
        """The parent's probability of every type of level k."""
        if k == len(TOPS) - 1:
            return np.full(SYMBOLS, 1 / SYMBOLS)
        return np.tile(self.levels[k + 1].predict(self._base(k + 1)), SYMBOLS)

    def round(self, customers: np.ndarray, moves: int) -> np.ndarray:
        """Follow the parts' tables, sweep, and return P(symbol | two symbols before)."""
        for k, level in enumerate(self.levels):
            seat = level.follow if level.c.any() else level.fill
            seat(customers, self._base(k), self.rng)
            level.sweep(self._base(k), moves, self.rng)
            customers = level.t.reshape(SYMBOLS, -1).sum(0)
        return self.levels[0].predict(self._base(0))


_STATE = pa.schema([("part", pa.int32()), ("state", pa.binary()), ("cells", pa.list_(pa.int32())), ("t", pa.list_(pa.int64()))])
_STATE_SQL = "part int, state binary, cells array<int>, t array<long>"


def _row(part: int, tree: Tree) -> pa.RecordBatch:
    top = tree.top_customers()
    cells = np.flatnonzero(top)
    ends = pa.array([0, len(cells)], pa.int32())
    lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cells.astype(np.int32), top[cells]))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree.packed()], pa.binary()), *lists], schema=_STATE)


def _start(top: np.ndarray, seed: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.Table.from_batches([_row(part, Tree.start(*_counts_of(table), top, np.random.default_rng([seed, part])))])

    return run


def _round(top: np.ndarray, seed: int, number: int, moves: int, sample: bool):
    def run(batches):
        for batch in batches:
            for part, state in zip(batch.column("part").to_pylist(), batch.column("state"), strict=True):
                tree = Tree.unpacked(state.as_py())
                tree.round(top, moves, np.random.default_rng([seed, part, number]), sample)
                yield _row(part, tree)

    return run


@dataclass
class Model:
    """The parts' states, whose sums are of `samples` rounds, and P(symbol | two symbols before)."""

    state: DataFrame
    top: np.ndarray
    samples: int
    parts: int


def fit(blocks: Blocks, burn_in: int = BURN_IN, samples: int = SAMPLES, moves: int = MOVES, seed: int = 11) -> Model:
    driver = Top(np.random.default_rng([seed, 999]))
    top = np.full(SYMBOLS**3, 1 / SYMBOLS)
    counts = blocks.codes
    if blocks.salts > 1:  # so that no task holds all of a part's counts before they are summed
        salted = counts.withColumn("salt", F.pmod("block", F.lit(blocks.salts)))
        counts = salted.groupBy("part", "salt").applyInArrow(_merge, "part int, data binary, counts binary")
    state = materialize(counts.groupBy("part").applyInArrow(_start(top, seed), _STATE_SQL), "seating")
    tops = []
    for number in range(burn_in + samples):
        customers = np.zeros(SYMBOLS**3, np.int64)
        cells = state.select(F.explode(F.arrays_zip("cells", "t")).alias("x")).groupBy("x.cells").agg(F.sum("x.t").alias("t")).toArrow()
        customers[cells.column("cells").to_numpy()] = cells.column("t").to_numpy()
        top = driver.round(customers, moves)
        if number >= burn_in:
            tops.append(top)
        old, state = state, materialize(state.mapInArrow(_round(top, seed, number, moves, number >= burn_in), _STATE_SQL), "seating")
        release(old)
    return Model(state, np.mean(tops, axis=0), samples, blocks.parts)


class Lookup:
    """A part's mean probabilities and back-off weights, by code."""

    def __init__(self, tree: Tree, samples: int, top: np.ndarray):
        self.top = top
        self.p = [(level.code, tree.sums[2 * k] / samples) for k, level in enumerate(tree.levels)]
        self.w = [(level.context, tree.sums[2 * k + 1] / samples) for k, level in enumerate(tree.levels)]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], code), len(table[0]) - 1)
        return table[0][at] == code, table[1][at].astype(np.float64)

    def probability(self, code: np.ndarray, k: int = 0) -> np.ndarray:
        """Of the codes' symbols after their contexts; what a level hasn't seen backs off to the next."""
        if k == len(LENGTHS):
            return self.top[(code & _TOP).astype(np.int64)]
        seen, p = self._find(self.p[k], code)
        rest = np.flatnonzero(~seen)
        if len(rest):
            known, w = self._find(self.w[k], code[rest] >> U64(6))
            p[rest] = np.where(known, w, 1.0) * self.probability(code[rest] & U64((1 << 6 * LENGTHS[k]) - 1), k + 1)
        return p


def _answer(samples: int, top: np.ndarray):
    """The logarithms of the probabilities of all codes that blocks ask a part for."""

    def run(states: pa.Table, asked: pa.Table) -> pa.Table:
        look = Lookup(Tree.unpacked(states.column("state")[0].as_py()), samples, top) if states.num_rows else None
        out = []
        for data in asked.column("data").to_pylist():
            code = expand_rising(data)
            p = look.probability(code) if look else top[(code & _TOP).astype(np.int64)]
            out.append(squeeze(np.log(p).astype(np.float32)))
        return pa.table({"block": asked.column("block"), "codes": asked.column("data"), "lp": pa.array(out, pa.binary())})

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("lp", pa.float64())])


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Symbols and log probability of each text of a block."""
    pairs = [(expand_rising(c), expand(x, np.float32)) for c, x in zip(answers.column("codes").to_pylist(), answers.column("lp").to_pylist(), strict=True)]
    known, value = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, U64), np.zeros(0, np.float32))
    o = np.argsort(known)
    known, value = known[o], value[o].astype(np.float64)
    out = []
    for ids, ends, data in zip(texts.column("ids"), texts.column("ends"), texts.column("data"), strict=True):
        ends = np.append(0, ends.values.to_numpy())
        code, row = ngrams(expand(data.as_py(), np.uint8), ends)
        lp = np.zeros(len(ends) - 1)
        if len(code):
            distinct, at, order = _distinct(code)
            each = np.repeat(value[np.searchsorted(known, distinct)], np.diff(at, append=len(code)))
            lp = np.bincount(row[order], each, minlength=len(ends) - 1)
        out.append(pa.Table.from_arrays([ids.values, pa.array(np.diff(ends)), pa.array(lp)], schema=_SCORES))
    return pa.concat_tables(out) if out else _SCORES.empty_table()


def score(blocks: Blocks, model: Model) -> DataFrame:
    """One row a document: doc_id, n_symbols, log_prob (natural, 3 digits) and perplexity (6 digits).

    A null or empty text has no symbols, log_prob 0 and a null perplexity. A null doc_id stays null. Rows that repeat
    are scored each; equal texts get equal scores. Texts are whole, however long: a very long one is a block of its own.
    Other columns are ignored. An empty table gives none. blocks must have as many parts as the model.
    """
    if blocks.parts != model.parts:
        raise ValueError("blocks and model differ in their number of parts")
    state = model.state.select("part", "state", F.explode(F.sequence(F.lit(0), F.lit(blocks.salts - 1))).alias("salt"))
    asked = blocks.codes.select("part", F.pmod("block", F.lit(blocks.salts)).cast("int").alias("salt"), "block", "data")
    answers = state.groupBy("part", "salt").cogroup(asked.groupBy("part", "salt")).applyInArrow(_answer(model.samples, model.top), "block long, codes binary, lp binary")
    scores = blocks.texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, "doc_id long, n long, lp double")
    return scores.select(
        "doc_id",
        F.col("n").alias("n_symbols"),
        F.round("lp", 3).alias("log_prob"),
        F.when(F.col("n") > 0, F.round(F.exp(-F.col("lp") / F.col("n")), 6)).alias("perplexity"),
    )


def perplexity(docs: DataFrame) -> DataFrame:
    """score() of docs by a model of docs."""
    blocks = blocked(docs)
    return score(blocks, fit(blocks))
