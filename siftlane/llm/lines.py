"""Operator 3, line deduplication by an exact set-similarity join.

A line (text between newlines) is the set of its lower-case tokens, split by ASCII white space. Of two
lines with Jaccard >= threshold the later is removed, in the order of doc_id (null last), then of the
text's hash, then of the line number; whether the earlier line is itself removed makes no difference.

The join is prefix filtering with positional, length and bitmap filters. Tokens are ordered by rarity: counts of
all the corpus's tokens, in a table of 2**20 hashed cells whose size never grows (tokens that share a
cell share a count, which changes their order alone, never the result). Equal sets are grouped first,
so that the join sees each set once. Token identity is a 58-bit hash.

A line goes as soon as one earlier line is known to be similar, so that the likeliest candidates are verified first,
each set's where near copies of it are. Of each set at most KEEP candidates in a partition are noted, of a crowd of near
copies the likeliest of each tile, and whether there are more; what those leave open is searched again, among all
candidates, so that no bound costs a result. A crowd of n near copies has n * n / 2 pairs, and few of its sets stay open.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.llm.common import U64, bitmap, chunks, group_by_part, hits, materialize, may_hold, mix, partitions, runs, space_tokens, unpack, with_key, with_row

THRESHOLD = 0.8
_CELLS, _BLOCK = 1 << 20, 1 << 12


# rarity
def _count(batches):
    total = np.zeros(_CELLS, np.int64)
    held, size = [], 0
    for batch in batches:
        for _, data, offs in chunks(batch.column("text")):
            _, h = space_tokens(data, offs)
            held.append((h >> U64(44)).astype(np.int32))
            size += len(h)
            if size > _CELLS:
                total += np.bincount(np.concatenate(held), minlength=_CELLS)
                held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=_CELLS)
    if total.max():
        small = total.max() < 2**31
        for b in range(0, _CELLS, _BLOCK):
            part = total[b : b + _BLOCK]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([small], pa.bool_()), pa.array([zlib.compress((part.astype(np.int32) if small else part).tobytes(), 1)], pa.binary())],
                names=["block", "small", "counts"],
            )


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for small, x in zip(table.column("small").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total += np.frombuffer(zlib.decompress(x), np.int32 if small else np.int64)
    rank = np.minimum(63, np.ceil(2 * np.log2(total + 1))).astype(np.uint8)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rank": pa.array([rank.tobytes()], pa.binary()), "n": pa.array([int(total.sum())], pa.int64())})


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each cell twice the binary logarithm of its count, 6 bits: 1 MB whatever the corpus. And the number of tokens."""
    rows = docs.select("text").mapInArrow(_count, "block int, small boolean, counts binary").groupBy("block").applyInArrow(_add, "block int, rank binary, n long").collect()
    out = np.zeros(_CELLS, np.uint8)
    for r in rows:
        out[r["block"] : r["block"] + _BLOCK] = np.frombuffer(r["rank"], np.uint8)
    return out, sum(r["n"] for r in rows)


# lines as sets
class Lines:
    """The distinct tokens of a chunk's lines, each line's rarest first."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, rank: np.ndarray):
        start, h = space_tokens(data, offs)
        self.n = 0
        if not len(start):
            return
        newline = np.flatnonzero(data == 10)
        doc = np.searchsorted(offs, start, side="right") - 1
        line = np.searchsorted(newline, start) - np.searchsorted(newline, offs[:-1])[doc]
        at = runs(doc, line)
        gid = np.repeat(np.arange(len(at), dtype=np.uint16 if len(at) < 65536 else np.int64), np.diff(at, append=len(start)))
        key = rank[(h >> U64(44)).astype(np.int64)].astype(U64) << U64(58) | h & U64(2**58 - 1)
        order = np.argsort(key)
        order = order[np.argsort(gid[order], kind="stable")]
        key, gid = key[order], gid[order]
        one = runs(gid, key)
        self.key, gid = key[one], gid[one]
        self.first = runs(gid)
        self.size = np.diff(self.first, append=len(gid))
        self.doc, self.line, self.n = doc[at], line[at], len(at)
        self.sig = mix(np.add.reduceat(mix(self.key), self.first) ^ self.size.astype(U64))
        bit, word = U64(1) << (self.key & U64(63)), self.key & U64(64)
        self.bits = [np.bitwise_xor.reduceat(np.where(word == k, bit, U64(0)), self.first) for k in (0, 64)]


_OCC = np.dtype([("sig", "<u8"), ("id", "<i8"), ("text", "<i8"), ("line", "<i4")])
_ENTRY = np.dtype([("token", "<u4"), ("sig", "<u8"), ("bits", "<u8"), ("more_bits", "<u8"), ("n_pos", "<u4"), ("age", "<u4")])
_MAX_N, _MAX_POS = (1 << 20) - 1, (1 << 12) - 1  # beyond these the filters let a pair pass
_LONE = 2  # the rarity of a cell that one token of the corpus fell in
KEEP, WINDOW = 32, 4096
CROWD = 16  # one in so many pairs of a tile near: of these each entry's likeliest are taken alone
TILED, _TILE = 1024, (64, 2048)  # pairs of a group from which on it is compared in tiles, and entries by entries in a tile
PART_BYTES = 32 << 20  # of prefix entries in a partition, by an estimate of 6 bytes a token


def _age(ids: np.ndarray) -> np.ndarray:
    """32 bits that never fall as doc_id rises: the order of the entries, where equal ages count both ways."""
    x = ids.astype(np.float64).view(np.int64)
    return ((np.where(x < 0, ~x, x ^ np.int64(-(2**63))).view(U64)) >> U64(32)).astype(np.uint32)


def _prefix(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return size - -(-num * size // den) + 1


def _signatures(rank: np.ndarray, num: int, den: int, parts: int, only: np.ndarray | None = None):
    """Occurrences (kind 0) and prefix entries (kind 1); with only no occurrences, and entries of the tokens that it may hold."""

    def run(batches):
        for batch in batches:
            ids = batch.column("k_id").to_numpy(zero_copy_only=False)
            text = batch.column("k_text").to_numpy(zero_copy_only=False)
            occs, entries = [], []
            for row, data, offs in chunks(batch.column("text")):
                x = Lines(data, offs, rank)
                if not x.n:
                    continue
                occ = np.empty(x.n, _OCC)
                occ["sig"], occ["id"], occ["text"], occ["line"] = x.sig, ids[row + x.doc], text[row + x.doc], x.line
                if only is None:
                    occs.append(occ)
                _, one = np.unique(x.sig, return_index=True)  # the first line of each set
                n, age = x.size[one], _age(np.minimum.reduceat(occ["id"][np.argsort(x.sig, kind="stable")], runs(np.sort(x.sig))))
                prefix = _prefix(n, num, den)
                owner = np.repeat(np.arange(len(one)), prefix)
                pos = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                key = x.key[x.first[one][owner] + pos]
                token = mix(key)
                # a token that the corpus has once meets no other line
                met = key >> U64(58) != _LONE
                if only is not None:
                    met &= hits(only, token)
                owner, pos, token = owner[met], pos[met], token[met]
                e = np.empty(len(owner), _ENTRY)
                # half of a token's hash is enough to meet at: tokens that share it only add candidates
                e["token"], e["sig"] = token >> U64(32), x.sig[one][owner]
                e["bits"], e["more_bits"] = (b[one][owner] for b in x.bits)
                e["age"] = age[owner]
                e["n_pos"] = np.minimum(n, _MAX_N)[owner] << 12 | np.minimum(pos, _MAX_POS)
                entries.append(e)
            for kind, recs, name in ((0, occs, "sig"), (1, entries, "token")):
                if recs and sum(map(len, recs)):
                    rec = np.concatenate(recs)
                    out = group_by_part(rec, rec[name].astype(U64), parts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * out.num_rows, pa.int32()), *out.columns], names=["kind", "part", "rows"])

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("others", pa.list_(pa.int64())), ("apart", pa.int32()), ("more", pa.bool_()), ("k_id", pa.int64()), ("k_text", pa.int64()), ("line", pa.int32()), ("m_id", pa.int64()), ("m_text", pa.int64()), ("m_line", pa.int32())])
_FOUND_SQL = "kind int, a long, others array<long>, apart int, more boolean, k_id long, k_text long, line int, m_id long, m_text long, m_line int"


def _firsts(o: np.ndarray) -> dict:
    """The first line of each set (kind 0) and each later one with its first (kind 1)."""
    o = o[np.lexsort((o["line"], o["text"], o["id"], o["sig"]))]
    o = o[runs(o["sig"], o["id"], o["text"], o["line"])]
    at = runs(o["sig"])
    owner = np.repeat(at, np.diff(at, append=len(o)))
    late = owner != np.arange(len(o))
    match = {f"m_{c}": pa.array(o[c][owner], mask=~late) for c in ("id", "text", "line")}
    return {"kind": late, "a": o["sig"].view(np.int64), "k_id": o["id"], "k_text": o["text"], "line": o["line"]} | match


class Likeliest:
    """Of each late set the keep candidates with the fewest differing bits, and the sets that have more."""

    def __init__(self, keep: int | None):
        self.keep, self.held, self.size, self.more = keep, [], 0, [np.zeros(0, U64)]
        self.limit = 1 << 20

    def add(self, late: np.ndarray, early: np.ndarray, apart: np.ndarray) -> None:
        self.held.append((late, early, apart))
        self.size += len(late)
        if self.size > self.limit:
            self.held = [self.best()]
            self.size = len(self.held[0][0])
            # what stays may be more than the limit: sorted again only when as much has come in addition
            self.limit = max(1 << 20, 2 * self.size)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint8)
        late, early, apart = (np.concatenate(x) for x in zip(*self.held, strict=True))
        o = np.lexsort((early, apart, late))
        o = o[runs(late[o], early[o])]
        late, early, apart = late[o], early[o], apart[o]
        if self.keep:
            at = runs(late)
            rank = np.arange(len(late)) - np.repeat(at, np.diff(at, append=len(late)))
            top = rank < self.keep
            self.more.append(np.unique(late[rank == self.keep]))
            late, early, apart = late[top], early[top], apart[top]
        return late, early, apart


def _closest(apart: np.ndarray, near: np.ndarray, row_age: np.ndarray, col_age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the near pairs of a tile that have the fewest differing bits of all in which a row, or a column, is the later."""
    none, row_age = np.uint8(255), row_age[:, None]
    x = np.where(near & (row_age >= col_age), apart, none)
    col = x.argmin(1)
    rows = np.flatnonzero(x[np.arange(len(x)), col] < none)
    x = np.where(near & (row_age <= col_age), apart, none)
    row = x.argmin(0)
    cols = np.flatnonzero(x[row, np.arange(x.shape[1])] < none)
    return np.append(rows, row[cols]), np.append(col[rows], cols)


def _within(bits: tuple[np.ndarray, np.ndarray], bound: np.ndarray, group: np.ndarray, one: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, step: int, age: np.ndarray, crowded: np.ndarray | None = None):
    """Yields (a, b, apart): each entry a of one with those of target[lo:hi] whose bitmaps differ in at most bound[a] places.

    Entries are in the order of their groups, and lo and hi rise within each. Large groups are compared in tiles, which
    costs a few nanoseconds a pair; the others pair by pair, step at once. With crowded only the closest pairs of a tile
    where one in CROWD is near, and crowded is set for all entries of the others.
    """
    count = np.maximum(hi - lo, 0)
    at = runs(group[one])
    if not len(at):
        return
    end = np.append(at[1:], len(one))
    tiled = np.add.reduceat(count, at) >= TILED
    rows = np.flatnonzero(np.repeat(~tiled, end - at) & (count > 0))
    ends = np.cumsum(count[rows])
    p = 0
    while p < len(rows):
        q = max(p + 1, int(np.searchsorted(ends, ends[p] - count[rows[p]] + step, side="right")))
        r = rows[p:q]
        c = count[r]
        a = np.repeat(one[r], c)
        b = target[np.repeat(lo[r] - np.cumsum(c) + c, c) + np.arange(len(a))]
        apart = np.bitwise_count(bits[0][a] ^ bits[0][b])
        apart += np.bitwise_count(bits[1][a] ^ bits[1][b])
        ok = np.flatnonzero(apart <= bound[a])
        yield a[ok], b[ok], apart[ok]
        p = q
    for s, t in zip(at[tiled], end[tiled], strict=True):
        asking = s + np.flatnonzero(count[s:t])
        for p in range(0, len(asking), _TILE[0]):
            r = asking[p : p + _TILE[0]]
            x = [w[one[r], None] for w in bits]
            most = bound[one[r], None]
            last = int(hi[r].max())
            for u in range(int(lo[r].min()), last, _TILE[1]):
                col = target[u : min(u + _TILE[1], last)]
                apart = np.bitwise_count(x[0] ^ bits[0][col])
                apart += np.bitwise_count(x[1] ^ bits[1][col])
                near = apart <= most
                if crowded is not None and np.count_nonzero(near) * CROWD > near.size:
                    place = np.arange(u, u + len(col))
                    near &= (place >= lo[r, None]) & (place < hi[r, None])
                    crowded[one[r[near.any(1)]]] = True
                    crowded[col[near.any(0)]] = True
                    row, c = _closest(apart, near, age[one[r]], age[col])
                    yield one[r[row]], col[c], apart[row, c]
                    continue
                row, c = np.divmod(np.flatnonzero(near), len(col))
                ok = (u + c >= lo[r[row]]) & (u + c < hi[r[row]])
                row, c = row[ok], c[ok]
                yield one[r[row]], col[c], apart[row, c]


def _pairs(e: np.ndarray, num: int, den: int, keep: int | None, window: int | None, only: np.ndarray | None, step: int) -> list[dict]:
    """Of a partition's prefix entries the candidates of each set (kind 2) and all sets in them (kind 3).

    Candidates are the sets of earlier lines that pass the length and positional filters and the bitmap filter (a token
    flips one of 128 bits, so that bits differ in no more places than sets do). With keep the likeliest of them, from
    the next `window` entries of each token by length, and of a crowd's tile the likeliest alone; `more` says that there
    may be others. With only all candidates of those sets that it may hold, and no others'.
    """
    e = e[np.argsort(e["token"])]
    at = runs(e["token"])
    size = np.diff(at, append=len(e))
    e = e[np.repeat(size > 1, size)]
    e = e[np.lexsort((e["age"], e["sig"], e["n_pos"] >> np.uint32(12), e["token"]))]
    at = runs(e["token"], e["sig"])
    place = np.minimum.reduceat(e["n_pos"], at) if len(at) else e["n_pos"]
    e = e[at]
    e["n_pos"] = place
    at = runs(e["token"])
    group = np.repeat(np.arange(len(at)), np.diff(at, append=len(e)))
    n, pos = (e["n_pos"] >> np.uint32(12)).astype(np.int64), (e["n_pos"] & np.uint32(_MAX_POS)).astype(np.int64)
    far = np.searchsorted(group << 32 | n, group << 32 | np.where(n == _MAX_N, _MAX_N, den * n // num), side="right")
    i = np.arange(len(e))
    likeliest = Likeliest(keep)
    unseen = np.zeros(len(e), bool)
    crowded = unseen if keep else None
    if only is None:
        asked = [(i, i + 1, far if window is None else np.minimum(far, i + 1 + window), i)]
        if window is not None:
            unseen |= far > i + 1 + window
            back = np.maximum(i - window - 1, 0)
            unseen |= (i > window) & (far[back] > i)  # the entry before the window reaches this one
    else:
        mine = hits(only, e["sig"])
        those, rest = i[mine], i[~mine]
        asked = [(those, those + 1, far[those], i), (rest, np.searchsorted(those, rest), np.searchsorted(those, far[rest]), those)]
    # of a similar pair the shorter set meets the other in its first tokens: n - pos is what both can share from there on
    reach = np.where(n == _MAX_N, _MAX_N, den * n // num) >= _MAX_N
    short = (n - pos < -(-2 * num * n // (num + den))) & ~reach
    # sets of n and at most n * den / num tokens differ in at most so many
    bound = np.where(reach, 255, np.minimum(255, n * (den - num) // num)).astype(np.uint8)
    bits = np.ascontiguousarray(e["bits"]), np.ascontiguousarray(e["more_bits"])
    for one, lo, hi, target in asked:
        for a, b, apart in _within(bits, bound, group, one, lo, np.where(short[one], lo, hi), target, step, e["age"], crowded):
            need = -(-num * (n[a] + n[b]) // (num + den))
            ok = (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need) & (apart <= n[a] + n[b] - 2 * need) | (n[b] == _MAX_N)
            a, b, apart = a[ok], b[ok], apart[ok]
            for late, early in ((a, b), (b, a)):
                way = e["age"][late] >= e["age"][early]
                if only is not None:
                    way &= mine[late]
                likeliest.add(e["sig"][late[way]], e["sig"][early[way]], apart[way])
    late, early, apart = likeliest.best()
    more = np.unique(np.concatenate([*likeliest.more, e["sig"][unseen]]))
    every = np.union1d(late, more)
    ends = np.searchsorted(late, np.append(every, U64(2**64 - 1)), side="left").astype(np.int32)
    ends[-1] = len(late)
    first = np.where(ends[1:] > ends[:-1], apart[np.minimum(ends[:-1], max(len(apart) - 1, 0))] if len(apart) else 0, 255)
    met = np.union1d(every, early)
    return [
        {"kind": np.full(len(every), 2), "a": every.view(np.int64), "others": pa.ListArray.from_arrays(pa.array(ends), pa.array(early.view(np.int64))), "apart": first, "more": np.isin(every, more)},
        {"kind": np.full(len(met), 3), "a": met.view(np.int64)},
    ]


def _candidates(num: int, den: int, keep: int | None = KEEP, window: int | None = WINDOW, only: np.ndarray | None = None, step: int = 1 << 18):
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        made = [_firsts(unpack(table, _OCC))] if kind == 0 else _pairs(unpack(table, _ENTRY), num, den, keep, window, only, step)
        out = []
        for columns in made:
            cells = [columns.get(f.name, pa.nulls(len(columns["a"]), f.type)) for f in _FOUND]
            cells = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cells]
            out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cells, _FOUND, strict=True)], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _sets(rank: np.ndarray, docs_filter: np.ndarray, pair_filter: np.ndarray):
    def run(batches):
        for batch in batches:
            own = batch.column("k_text").to_numpy(zero_copy_only=False).view(U64)
            hit = hits(docs_filter, own)
            text, own = batch.column("text").filter(pa.array(hit)), own[hit]
            for row, data, offs in chunks(text):
                x = Lines(data, offs, rank)
                if not x.n:
                    continue
                one = np.flatnonzero(hits(pair_filter, x.sig ^ own[row + x.doc]))
                one = one[np.unique(x.sig[one], return_index=True)[1]]
                size = x.size[one]
                ends = np.append(0, np.cumsum(size))
                at = np.repeat(x.first[one] - ends[:-1], size) + np.arange(ends[-1])
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.key[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x.sig[one].view(np.int64)), sets], names=["sig", "tokens"])

    return run


def _prefix_tokens(num: int, den: int):
    """Hashes of the prefix tokens of sets (their tokens are in the order of rarity)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            size = lists.value_lengths().to_numpy().astype(np.int64)
            prefix = _prefix(size, num, den)
            at = np.repeat(np.cumsum(size) - size - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())
            h = np.unique(mix(lists.flatten().to_numpy()[at].view(U64)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return run


# the operator
_HIT = ("a", "k_id", "k_text", "line", "m_id", "m_text", "m_line")


_HIT_SCHEMA = pa.schema([("a", pa.int64()), ("k_id", pa.int64()), ("k_text", pa.int64()), ("line", pa.int32()), ("m_id", pa.int64()), ("m_text", pa.int64()), ("m_line", pa.int32())])
_HIT_SQL = "a long, k_id long, k_text long, line int, m_id long, m_text long, m_line int"


def _settle(num: int, den: int, step: int = 256):
    """Of each set (a, others: lists of candidates) the first candidate that comes earlier and is similar enough, the
    likeliest of each list first; sets: those of all of them."""

    def run(asked: pa.Table, sets: pa.Table) -> pa.Table:
        sig = sets.column("sig").to_numpy()
        order = np.argsort(sig)
        lists = sets.column("tokens").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        token = lists.flatten().to_numpy()
        key = [sets.column(c).to_numpy() for c in ("k_id", "k_text", "line")]
        rank = np.empty(len(sig), np.int64)
        rank[np.lexsort(key[::-1])] = np.arange(len(sig))
        out = []
        for a, others in zip(asked.column("a").to_pylist(), asked.column("others"), strict=True):
            i = int(order[np.searchsorted(sig, a, sorter=order)])
            mine = np.sort(token[first[i] : first[i] + size[i]])
            lists_ = [x.values.to_numpy() for x in others]
            cand = np.concatenate(lists_)
            turn = np.concatenate([np.arange(len(x)) for x in lists_])
            cand = cand[np.argsort(turn, kind="stable")]
            cand = cand[np.sort(np.unique(cand, return_index=True)[1])]
            cand = order[np.searchsorted(sig, cand, sorter=order)]
            cand = cand[rank[cand] < rank[i]]
            for k in range(0, len(cand), step):
                c = cand[k : k + step]
                n = size[c]
                at = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
                theirs = token[at]
                same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64)
                hit = np.flatnonzero(den * both >= num * (len(mine) + n - both))
                if len(hit):
                    out.append((a, i, c[hit[0]]))
                    break
        a, i, j = (np.array([r[k] for r in out], np.int64) for k in range(3))
        return pa.Table.from_arrays([pa.array(x).cast(f.type) for x, f in zip((a, *(k[i] for k in key), *(k[j] for k in key)), _HIT_SCHEMA, strict=True)], schema=_HIT_SCHEMA)

    return run


def _settled(near: DataFrame, sets: DataFrame, num: int, den: int, homes: int) -> DataFrame:
    """Verify the candidates of near (a, others, least hash of them), each set's in the group of that candidate, so that
    near copies have their tokens brought to one place."""
    asked = materialize(near.groupBy("a").agg(F.pmod(F.min("least"), F.lit(homes)).cast("int").alias("home"), F.collect_list("others").alias("others")), "asked")
    need = asked.select(F.col("home").alias("at"), F.explode(F.array_append(F.array_distinct(F.flatten("others")), F.col("a"))).alias("sig")).distinct()
    return asked.groupBy("home").cogroup(sets.join(need, "sig").groupBy("at")).applyInArrow(_settle(num, den), _HIT_SQL)


def _listed(near: DataFrame) -> DataFrame:
    return near.where("size(others) > 0").select("a", "others", F.array_min(F.transform("others", lambda b: F.xxhash64(b))).alias("least"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, keep: int = KEEP, window: int = WINDOW) -> DataFrame:
    """Each line that goes: row key, line (from 0), and key and line of a line that it matches: the first line with an
    equal set, or for that line itself an earlier similar one.

    keep, window: candidates noted at once and entries looked at for them; they change the work, never which lines go.
    """
    f = Fraction(str(threshold))
    if not 0 < f <= 1:
        raise ValueError("threshold must be over 0, and 1 at most")
    num, den = f.numerator, f.denominator
    spark, keyed = docs.sparkSession, with_key(docs)
    rank, total = rarity(docs)
    parts = max(partitions(spark), -(-6 * total // PART_BYTES))
    texts = keyed.select("k_id", "k_text", "text")
    packed = "kind int, part int, rows binary"
    found = materialize(texts.mapInArrow(_signatures(rank, num, den, parts), packed).groupBy("kind", "part").applyInArrow(_candidates(num, den, keep, window), _FOUND_SQL), "lines")
    first = found.where("kind = 0").select(F.col("a").alias("sig"), "k_id", "k_text", "line")

    def sets_of(sigs: DataFrame) -> DataFrame:
        """Each set from the text that has its first line; what the bitmaps let through besides, the join drops."""
        need = materialize(sigs.distinct().join(first, "sig"), "need")
        once = need.select("k_text", F.col("sig").bitwiseXOR(F.col("k_text")).alias("pair")).distinct()
        filters = bitmap(once.select("k_text").distinct(), "k_text"), bitmap(once, "pair")
        return materialize(keyed.select("k_text", "text").mapInArrow(_sets(rank, *filters), "sig long, tokens array<long>").join(need, "sig"), "sets")

    sets = sets_of(found.where("kind = 3").select(F.col("a").alias("sig")))
    near = found.where("kind = 2")
    # the likeliest candidate of all settles most of the sets that go at all; only the others have all theirs brought together
    best = near.where("size(others) > 0").groupBy("a").agg(F.min(F.struct("apart", F.col("others")[0].alias("b")))["b"].alias("b"))
    settled = [materialize(_settled(best.select("a", F.array("b").alias("others"), F.xxhash64("b").alias("least")), sets, num, den, parts), "hits")]
    left = near.join(settled[0].select("a"), "a", "left_anti")
    settled.append(materialize(_settled(_listed(left), sets, num, den, parts), "hits"))
    # what is still open, and has candidates that were not noted, is searched among all
    opened = materialize(left.where("more").select(F.col("a").alias("sig")).distinct().join(settled[1].select(F.col("a").alias("sig")), "sig", "left_anti"), "open")
    count = opened.count()
    if count:
        asked = bitmap(opened, "sig", count)
        tokens_ = bitmap(sets.join(opened, "sig", "left_semi").select("tokens").mapInArrow(_prefix_tokens(num, den), "h long"), "h")
        again = texts.mapInArrow(_signatures(rank, num, den, parts, tokens_), packed).groupBy("kind", "part").applyInArrow(_candidates(num, den, None, None, asked), _FOUND_SQL)
        again = materialize(again.where("kind = 2").join(opened.select(F.col("sig").alias("a")), "a", "left_semi").select("a", "others"), "all")
        settled.append(_settled(_listed(again), sets_of(again.select(F.explode(F.array_append("others", F.col("a"))).alias("sig"))), num, den, parts))
    # a later copy of a set whose first line has an earlier match still has that first line as a match
    out = found.where("kind = 1").select(*_HIT)
    for s in settled:
        out = out.unionByName(s.select(*_HIT))
    return out.drop("a")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of those numbers; a text with none of them as it is."""

    def one(text, numbers):
        if text is None or numbers is None:
            return text
        drop = set(numbers)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def drop_similar_lines(docs: DataFrame, threshold: float = THRESHOLD, counted: bool = False, keep_emptied: bool = True, length: str | None = None) -> DataFrame:
    """docs with the later of any two similar lines removed from text; with counted the columns doc_id, text,
    n_lines and n_removed instead. Without keep_emptied documents that lost a line and have only white space left go.
    length: a column that gets the text's new length (in characters) where the text changes.

    A line without tokens is no line to compare and stays. A null or empty text stays as it is. Rows that
    repeat doc_id and text are one document that occurs twice: they lose the same lines. Lines with equal sets
    are similar at every threshold; of lines with the same key (repeated rows) none is the other's match. A null doc_id
    comes after all others. Very long texts, lines and tokens are compared whole. An empty table gives none. Other
    columns are kept as they are, whatever their names.
    """
    gone = removed_lines(docs, threshold).groupBy("k_id", "k_text").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone, "gone")
    # only documents that may lose a line are shuffled: a bitmap lets the others past the join
    touched = may_hold(bitmap(gone.select("k_text").distinct(), "k_text"))
    rows = with_row(docs).withColumn("touched", touched(F.col("k_text")))
    joined = rows.where("touched").join(gone, ["k_id", "k_text"], "left")
    # the new text is made by one UDF, whose result no filter above it makes Spark compute again
    joined = joined.withColumn("new", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("gone"))))
    rows = rows.where("not touched").withColumns({"gone": F.lit(None).cast("array<int>"), "new": F.col("row.text")}).unionByName(joined)
    if not keep_emptied:
        rows = rows.where(F.col("gone").isNull() | F.col("new").rlike("[^ \\t\\n\\r\\f\\x0b]"))
    text = F.col("new")
    if counted:
        breaks = F.length("row.text") - F.length(F.replace(F.col("row.text"), F.lit("\n"), F.lit("")))
        return rows.select(
            F.col("row.doc_id").alias("doc_id"),
            text.alias("text"),
            F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        )
    changed = {"text": text}
    if length is not None:
        changed[length] = F.when(F.col("gone").isNull(), F.col("row")[length]).otherwise(F.length(text).cast(docs.schema[length].dataType))
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
