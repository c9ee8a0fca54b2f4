"""Suffix-array dedup: every string of a fixed length that also starts elsewhere, as bytes and as words.

Positions of all texts can't be sorted in one place, so shards are formed by content. Every window of a unit's `length`
symbols is routed by the smallest hash among its strings of `k` symbols; equal windows have equal smallest hashes and meet
in one shard. Windows whose smallest hash occurs once in the corpus can't repeat and stop there. The rest travels as
segments, runs of windows with the same smallest hash, equal segments as one.

A shard builds the suffix array of its segments by Larsson-Sadakane refinement and common prefixes by Kasai's scan. A
hash with more segments than a shard may hold is dealt to several shards; these are merged by exchanging sorted window
digests, cut by value, which are looked up in each other by binary search.

Symbols are bytes, or words as 32-bit codes: a passage of 50 words is 200 to 450 bytes long, so that no one length in
bytes finds all passages of so many words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, key_filter, map_batches, may_hold, mix64, packed, partitions, release, table, written

LENGTH, PASSAGE = 400, 50
#: Symbols hashed at once, bytes of a suffix array, of one hash's share in it, and about those of a task, array by array.
PIECE, SHARD, SHARE, TASK = 1 << 16, 1 << 18, 1 << 18, 1 << 25
#: Windows that Kasai's scan passes through one after another.
LANE = 64

_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA24BAED4963EE407)
_AT = np.uint64((1 << 20) - 1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(1 << bits, np.uint64), np.ones(1 << bits, np.uint64)
    up[1:], down[1:] = _BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, start, end) of the text's words: runs of ASCII letters, digits and bytes from 0x80, A-Z as a-z. A code is 32
    bits of the word's hash: that 50 words in a row agree in their codes but not in themselves won't happen."""
    text, first, out = text.translate(_LOWER), 0, []
    while first < len(text) or not out:
        stop = min(len(text), first + PIECE)
        while stop < len(text) and _IN_WORD[text[stop]]:
            stop += 1
        x = np.frombuffer(text, np.uint8, stop - first, first) if stop > first else np.zeros(0, np.uint8)
        inside = np.concatenate([[False], _IN_WORD[x], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = _powers(max(12, len(x).bit_length()))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[0][x] * up[: len(x)], out=total[1:])
        code = mix64((total[end] - total[start]) * down[start]) >> np.uint64(32)
        out.append((code.astype(np.uint32), start + first, end + first))
        first = max(stop, first + 1)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of; `length` symbols make a repeated string, at most `run` windows a segment."""

    name: str
    length: int
    k: int
    run: int
    #: Bytes of a symbol.
    width: int

    def sequences(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.width == 1:
            return [np.frombuffer(t, np.uint8) for t in texts]
        out, at = [], 0
        while at < len(texts):  # texts of a few MB are cut into words at once
            size, a = 0, at
            while at < len(texts) and (at == a or size + len(texts[at]) < 16 * PIECE):
                size, at = size + len(texts[at]) + 1, at + 1
            code, start, _ = words(b" ".join(texts[a:at]))
            ends = np.cumsum([len(t) + 1 for t in texts[a:at]])
            out += np.split(code, np.searchsorted(start, ends[:-1]))
        return out

    def of(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8 if self.width == 1 else np.uint32)

    @property
    def least(self) -> int:
        """Bytes of the shortest text with a window: as words, letters with something between them."""
        return self.length if self.width == 1 else 2 * self.length - 1


BYTES = Unit("bytes", LENGTH, 128, 512, 1)
WORDS = Unit("words", PASSAGE, 16, 128, 4)
#: Hashes carry the place of their unit above HASH_BITS bits.
UNITS, HASH_BITS = (BYTES, WORDS), 44


def rolling(x: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of k symbols of x."""
    up, down = _powers(max(12, len(x).bit_length()))
    total = np.zeros(len(x) + 1, np.uint64)
    value = _BYTE[which][x] if x.dtype == np.uint8 else mix64(x.astype(np.uint64) + _BYTE[which, 0])
    np.cumsum(value * up[: len(x)], out=total[1:])
    return mix64((total[k:] - total[: len(x) - k + 1]) * down[: len(x) - k + 1])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from prefix and suffix minima of blocks of w."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(seqs: list[np.ndarray], unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    """Of about PIECE symbols at once, longer sequences in pieces: of each run its sequence, first window, number of windows
    and the hash that all its windows have as smallest; and sequence and hash of each distinct place of a smallest hash."""
    held: list[tuple[int, int, np.ndarray]] = []

    def found() -> tuple[np.ndarray, ...]:
        of, first, size = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held]), np.array([len(x) for _, _, x in held])
        start, count = np.cumsum(size) - size, size - unit.length + 1
        h = rolling(np.concatenate([x for _, _, x in held]), unit.k)
        low = _sliding_min((h & ~_AT) | np.arange(len(h), dtype=np.uint64), unit.length - unit.k + 1)
        piece = np.repeat(np.arange(len(held)), count)
        window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        low = low[start[piece] + window]  # windows across two pieces are left out
        value, other = low >> np.uint64(64 - HASH_BITS), piece[1:] != piece[:-1]
        edge = np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | other) + 1])
        place = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | other) + 1])
        held.clear()
        return of[piece[edge]], first[piece[edge]] + window[edge], np.diff(np.append(edge, len(low))), value[edge], of[piece[place]], value[place]

    total = 0
    for i, x in enumerate(seqs):
        for a in range(0, max(0, len(x) - unit.length + 1), PIECE):
            held.append((i, a, x[a : a + PIECE + unit.length - 1]))
            total += len(held[-1][2])
            if total >= PIECE:
                yield found()
                total = 0
    if held:
        yield found()


def anchors(texts: list[bytes], units: tuple[Unit, ...] = UNITS) -> tuple[pa.Array, list[list[int]]]:
    """For each text the hashes by which its windows are routed, one entry for each place; and by unit its lengths."""
    of, hashes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for u, unit in enumerate(units):
        seqs = unit.sequences(texts)
        sizes.append([len(x) for x in seqs])
        for *_, seq, value in runs(seqs, unit):
            of.append(seq)
            hashes.append(value.astype(np.int64) | u << HASH_BITS)
    of = np.concatenate(of)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)[np.argsort(of, kind="stable")])), sizes


def segments(seqs: list[np.ndarray], unit: Unit, of: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(sequence, hash, first window, windows) of the runs with a hash wanted of their sequence, at most unit.run windows
    each. of: the sequences of the wanted hashes."""
    pairs = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | wanted
    for seq, first, n, value, _, _ in runs(seqs, unit):
        keep = np.isin((seq.astype(np.uint64) << np.uint64(HASH_BITS)) | value, pairs)
        seq, first, n, value = seq[keep], first[keep], n[keep], value[keep]
        parts = -(-n // unit.run)
        at = np.repeat(np.arange(len(n)), parts)
        skip = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)) * unit.run
        yield from zip(*(c.tolist() for c in (seq[at], value[at], first[at] + skip, np.minimum(n[at] - skip, unit.run))), strict=True)


def eight_bytes(x: np.ndarray) -> np.ndarray:
    """For each place the eight bytes of symbols from there on, as a number; zeros beyond the end."""
    n, w = len(x), x.dtype.itemsize
    raw = np.concatenate([x, np.zeros(16 // w, x.dtype)])
    raw = (raw if w == 1 else raw.byteswap()).view(np.uint8)
    per = 8 // w
    out = np.empty(n, np.uint64)
    for j in range(min(per, n)):
        out[j::per] = raw[j * w : j * w + 8 * len(range(j, n, per))].view(">u8")
    return out


def _heads(new: np.ndarray) -> np.ndarray:
    """For each slot the first of its group; new: where groups begin."""
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(new))))


def suffix_array(x: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, word): suffixes of x by their first `deepest` symbols, then by place; word: 8 bytes of symbols from each place.

    Groups of suffixes that agree in h symbols are refined by their ranks h further on, h doubling; only groups with
    more than one suffix are sorted again.
    """
    n = len(x)
    word = eight_bytes(x)
    order = np.argsort(word).astype(np.int32)
    sorted_, new = word[order], np.ones(n + 1, bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:n])
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = _heads(new[:n]), -1
    at = np.flatnonzero(~(new[:-1] & new[1:])).astype(np.int32)  # slots of unsorted groups
    h = 8 // x.dtype.itemsize
    while h < deepest and len(at):
        here = order[at]
        key = (rank[here].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(here + h, n)] + 1).astype(np.uint64)
        by = np.argsort(key)
        here, key = here[by], key[by]
        order[at] = here
        new = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        rank[here] = at[_heads(new[:-1])]
        at = at[~(new[:-1] & new[1:])]
        h *= 2
    here = order[at]
    order[at] = here[np.argsort((rank[here].astype(np.uint64) << np.uint64(32)) | here.astype(np.uint64))]
    return order, word


def common_prefixes(word: np.ndarray, width: int, order: np.ndarray, start: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Kasai's scan for the `count` windows from each start: their common prefix, up to `most` symbols, with the window before
    them in order; and that window. order holds windows only: other suffixes, that run into the next segment, could part
    equal windows.

    Windows are dealt to lanes of LANE that advance side by side, each by 8 bytes or to its next window at a time.
    """
    n, per = len(word), 8 // width
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.full(n + 1, n, np.int64)
    slot[order] = np.arange(len(order))
    lanes = -(-count // LANE)
    at = np.repeat(start, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    last = np.minimum(at + LANE, np.repeat(start + count, lanes))
    h, other, lcp = np.zeros(len(at), np.int64), before[at], np.zeros(n, np.int64)
    while len(at):
        differ = word[at + h] ^ word[np.maximum(other, 0) + h]
        h = np.minimum(h + np.where(differ == 0, per, _equal_bytes(differ) // width), most)
        h[other < 0] = 0  # the first window in order has none before it
        done = np.flatnonzero((differ != 0) | (h == most) | (other < 0))
        was, here = other[done], at[done]
        lcp[here] = h[done]
        # one symbol on, the prefix is one shorter, if what follows the window before it is a window that is still before it
        at[done] = here + 1
        h[done] = np.where((was >= 0) & (slot[was + 1] < slot[here + 1]), np.maximum(h[done] - 1, 0), 0)
        other[done] = before[here + 1]
        live = at < last
        if not live.all():
            at, h, last, other = at[live], h[live], last[live], other[live]
    return lcp, before[:n]


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of nonzero words."""
    n = np.zeros(len(differ), np.int64)
    for bits in (32, 16, 8):
        clear = differ < np.uint64(1) << np.uint64(64 - bits)
        n += np.where(clear, bits // 8, 0)
        differ = np.where(clear, differ << np.uint64(bits), differ)
    return n


def repeated(parts: list[np.ndarray], known: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit, heads, start): of the segments laid end to end, from start on each, which places begin a window that also
    starts elsewhere, and the places of one window of each content. known: segments that occur more than once, whose
    windows all do."""
    size = np.array(list(map(len, parts)))
    start, count = np.cumsum(size) - size, size - unit.length + 1
    x = np.concatenate(parts)
    window, hit = np.zeros(len(x) + 1, np.int8), np.zeros(len(x), bool)
    window[start] += 1
    window[start + count] -= 1
    window = np.cumsum(window[:-1]).astype(bool)
    order, word = suffix_array(x, unit.length)
    lcp, before = common_prefixes(word, unit.width, order[window[order]], start, count, unit.length)
    again = np.flatnonzero(lcp >= unit.length)
    hit[again] = hit[before[again]] = True
    return hit | (window & np.repeat(known, size)), np.flatnonzero(window & (lcp < unit.length)), start


def _spans(hit: np.ndarray) -> np.ndarray:
    """Flat [first, past the last, ...] of the true runs."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (h, part, parts, d, many, s), those of one hash and part together, in lists of about SHARD bytes and one unit."""
    held, size, now = [], 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:2] != now and (size >= SHARD or row[0] >> HASH_BITS != now[0] >> HASH_BITS):
                yield held
                held, size = [], 0
            now = row[:2]
            held.append(row)
            size += len(row[5])
    if held:
        yield held
    release()


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, d, spans) of segments with repeated windows; for hashes in several parts also digests (h, cut, part, digests):
    sorted by value, of one window of each content, with its segment and place, or -1 if it is known to repeat."""
    for rows in _shards(batches):
        unit = UNITS[rows[0][0] >> HASH_BITS]
        texts, known = [unit.of(r[5]) for r in rows], np.array([r[4] for r in rows])
        hit, heads, start = repeated(texts, known, unit)
        edges = _spans(hit)  # a segment's last places begin no window, so runs end with it
        k = np.searchsorted(start, edges, side="right") - 1
        k[1::2] = k[::2]
        cut = np.flatnonzero(np.diff(k)) + 1
        out = [(rows[i][0], rows[i][3], v, None, None, None) for i, v in zip(k[np.concatenate([[0], cut])].tolist() if len(k) else [], np.split((edges - start[k]).astype(np.int32), cut), strict=len(k) > 0)]
        split: dict[tuple[int, int], list[int]] = {}
        for k, r in enumerate(rows):
            if r[2] > 1:
                split.setdefault(r[:2], []).append(k)
        for (h, part), members in split.items():
            parts, found = rows[members[0]][2], []
            for k in members:
                one, two = rolling(texts[k], unit.length), rolling(texts[k], unit.length, 1)
                mine = heads[(heads >= start[k]) & (heads < start[k] + len(one))] - start[k]
                at = np.where(hit[start[k] + mine], -1, (k << 20) + mine)
                found.append(np.stack([one[mine], two[mine], at.astype(np.int64).view(np.uint64)], 1))
            found = np.concatenate(found)
            found = found[np.argsort(found[:, 0], kind="stable")]
            cut = (found[:, 0] % np.uint64(parts)).astype(np.int64)
            names = [rows[k][3] for k in range(len(rows))]
            for c in range(parts):
                f = found[cut == c]
                at = f[:, 2].view(np.int64)
                used = sorted(set((at[at >= 0] >> 20).tolist()))
                place = {k: i for i, k in enumerate(used)}
                f[:, 2] = np.array([-1 if v < 0 else (place[int(v) >> 20] << 20) + (int(v) & 0xFFFFF) for v in at], np.int64).view(np.uint64)
                out.append((h, b"".join(names[k] for k in used), [], c, part, f.tobytes()))
        if out:
            yield batch(
                h=pa.array([o[0] for o in out], pa.int64()), d=pa.array([o[1] for o in out], pa.binary()), spans=pa.array([o[2] for o in out], pa.list_(pa.int32())),
                cut=pa.array([o[3] for o in out], pa.int32()), part=pa.array([o[4] for o in out], pa.int32()), digests=pa.array([o[5] for o in out], pa.binary()),
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, d, spans) of windows that repeat in another part of their hash. Each part's sorted digests are looked up in
    those merged so far by binary search."""

    def merge(h: int, parts: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, bytes, int]]:
        top = np.zeros((0, 4), np.uint64)  # digest, digest, place, part
        for p, (_, raw) in enumerate(parts):
            f = np.frombuffer(raw, np.uint64).reshape(-1, 3)
            f = np.hstack([f, np.full((len(f), 1), p, np.uint64)])
            lo, hi = np.searchsorted(top[:, 0], f[:, 0]), np.searchsorted(top[:, 0], f[:, 0], side="right")
            new = np.ones(len(f), bool)
            for i in np.flatnonzero(hi > lo):
                for j in range(lo[i], hi[i]):
                    if top[j, 1] == f[i, 1]:
                        new[i] = False
                        for q, at in ((p, f[i, 2]), (int(top[j, 3]), top[j, 2])):
                            if (v := int(np.uint64(at).view(np.int64))) >= 0:
                                yield h, parts[q][0][16 * (v >> 20) : 16 * (v >> 20) + 16], v & 0xFFFFF
            add = np.searchsorted(top[:, 0], f[new, 0])
            top = np.insert(top, add, f[new], axis=0)

    now, held = None, []

    def done() -> pa.RecordBatch | None:
        found: dict[bytes, list[int]] = {}
        for _, d, v in merge(now[0], held):
            found.setdefault(d, []).append(v)
        if not found:
            return None
        spans = []
        for v in found.values():
            hit = np.zeros(UNITS[now[0] >> HASH_BITS].run, bool)
            hit[v] = True
            spans.append(_spans(hit))
        return batch(h=pa.array([now[0]] * len(found), pa.int64()), d=pa.array(list(found), pa.binary()), spans=pa.array(spans, pa.list_(pa.int32())))

    for b in batches:
        for h, d, cut, digests in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (h, cut) != now:
                if held and (out := done()) is not None:
                    yield out
                now, held = (h, cut), []
            held.append((d, digests))
    if held and (out := done()) is not None:
        yield out


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)), 1, 16)


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (key, ...) with the text of each key. Few other texts travel, and of equal ones one from each task."""
    ready = key_filter(chosen.select("key"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(may_hold(ready.value, b.column(0).to_pylist())))

    keyed = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= min(u.least for u in UNITS))
    return map_batches(keyed, run, "key binary, text binary").groupBy("key").agg(F.first("text").alias("text")).join(chosen, "key")


def _digests(h: np.ndarray) -> np.ndarray:
    """16 bytes for each hash, by which a key filter finds it."""
    return np.stack([mix64(h.view(np.uint64)), mix64(h.view(np.uint64) ^ _BASE)], 1)


def found_windows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, u, spans): for each distinct text with repeated windows of a unit, flat starts and ends of runs of window starts."""
    texts = rows.groupBy("key").agg(F.first("anchors").alias("anchors"))
    often = written(texts.select(F.explode("anchors").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "often")

    def digested(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = _digests(b.column(0).to_numpy(zero_copy_only=False)).tobytes()
        return batch(key=pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b.num_rows, [None, pa.py_buffer(raw)]).cast(pa.binary()))

    ready = key_filter(map_batches(often, digested, "key binary"))

    def known(b: pa.RecordBatch) -> pa.RecordBatch:
        hs = b.column(1)
        flat, owner = hs.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(hs)), hs.value_lengths().to_numpy(zero_copy_only=False))
        held = may_hold(ready.value, _digests(flat))
        flat, owner = flat[held], owner[held]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(hs)))]).astype(np.int32)
        return batch(key=b.column(0), hs=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))).filter(pa.array(np.diff(ends) > 0))

    # the filter spares most hashes the way to the join, which then decides
    maybe = map_batches(rows.filter(F.size("anchors") > 0).select("key", "anchors"), known, "key binary, hs array<long>").groupBy("key").agg(F.first("hs").alias("hs"))
    wanted = maybe.select("key", F.explode(F.array_distinct("hs")).alias("h")).join(often, "h").groupBy("key").agg(F.collect_list("h").alias("hs"))
    wanted = written(wanted, "wanted", rows)
    source = written(chosen_texts(docs, wanted), "candidates", docs)

    def cut(b: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        keys, texts, hs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        flat, owner = hs.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(hs)), hs.value_lengths().to_numpy(zero_copy_only=False))
        key, h, d, first, s = [], [], [], [], []
        for u, unit in enumerate(UNITS):
            mine = flat >> HASH_BITS == u
            of, at = np.unique(owner[mine], return_inverse=True)
            seqs = unit.sequences([texts[i] for i in of])
            for i, value, a, n in segments(seqs, unit, at, (flat[mine] & ((1 << HASH_BITS) - 1)).astype(np.uint64)):
                part = seqs[i][a : a + n + unit.length - 1].tobytes()
                key.append(keys[of[i]])
                h.append(value | u << HASH_BITS)
                d.append(xxhash.xxh3_128_digest(part))
                first.append(a)
                if whole:
                    s.append(part)
        return batch(key=pa.array(key, pa.binary()), h=pa.array(h, pa.int64()), d=pa.array(d, pa.binary()), first=pa.array(first, pa.int32()), s=pa.array(s if whole else [None] * len(key), pa.binary()))

    schema = "key binary, h long, d binary, first int, s binary"
    pieces = map_batches(source, lambda b: cut(b, True), schema).groupBy("h", "d").agg(F.count("*").alias("n"), F.first("s").alias("s"))
    pieces = written(pieces, "pieces")
    sizes = written(pieces.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("s")).alias("size")).withColumn("parts", F.ceil(F.col("size") / SHARE).cast("int")), "sizes")
    sized = pieces.join(sizes, "h")
    # all windows of a hash's only segment repeat if it occurs again; if not, it can still repeat within itself
    u = F.shiftright("h", HASH_BITS).cast("int")
    windows = F.coalesce(*(F.when(u == i, F.octet_length("s") / v.width - (v.length - 1)) for i, v in enumerate(UNITS))).cast("int")
    alone = sized.filter("kinds = 1 AND n > 1").select("h", "d", F.array(F.lit(0), windows).alias("spans"))
    shards = sized.filter("kinds > 1 OR n = 1").select("h", F.pmod(F.xxhash64("d"), "parts").cast("int").alias("part"), "parts", "d", (F.col("n") > 1).alias("many"), "s")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = shards.repartition(max(partitions(docs.sparkSession), total // TASK), "h", "part").sortWithinPartitions("h", "part")
    sorted_ = written(shards.mapInArrow(_sorted_shards, "h long, d binary, spans array<int>, cut int, part int, digests binary"), "shards", pieces)
    hits = sorted_.filter("digests IS NULL").select("h", "d", "spans").unionByName(alone)
    digests = sorted_.filter("digests IS NOT NULL").select("h", "d", "cut", "digests")
    if not digests.isEmpty():
        hits = hits.unionByName(written(digests.repartition("h", "cut").sortWithinPartitions("h", "cut").mapInArrow(_merged, "h long, d binary, spans array<int>"), "merged"))
    places = map_batches(source, lambda b: cut(b, False), schema).select("key", "h", "d", "first")
    moved = places.join(hits, ["h", "d"]).select("key", u.alias("u"), F.transform("spans", lambda v: v + F.col("first")).alias("spans"))
    return moved.groupBy("key", "u").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(n: int, spans: list[int] | None, unit: Unit) -> np.ndarray:
    """Which of n symbols are covered by windows that start in the spans."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        v = np.array(spans, np.int64).reshape(-1, 2)
        np.add.at(edge, v[:, 0], 1)
        np.add.at(edge, np.minimum(v[:, 1] + unit.length - 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def gone_bytes(text: bytes, spans: list[int] | None, passages: list[int] | None) -> np.ndarray:
    """Which bytes are covered by repeated strings of bytes, or lie within a passage, from its first word to its last."""
    gone = covered(len(text), spans, BYTES)
    if passages:
        _, start, end = words(text)
        within = _spans(covered(len(start), passages, WORDS))
        for a, z in zip(start[within[::2]], end[within[1::2] - 1], strict=True):
            gone[a:z] = True
    return gone


def sketched(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, key, n_bytes, n_words, sha, anchors) of each row; sha: of the whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(b.column(2))
        at, (n_bytes, n_words) = anchors(texts)
        sha = [hashlib.sha256(t).hexdigest() for t in texts]
        return batch(id=b.column(0), key=b.column(1), n_bytes=pa.array(n_bytes, pa.int64()), n_words=pa.array(n_words, pa.int64()), sha=pa.array(sha, pa.string()), anchors=at)

    columns = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return map_batches(columns, run, "id long, key binary, n_bytes long, n_words long, sha string, anchors array<long>")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): sketched() rows, written, and (key, bytes, words) of the distinct texts with repeated windows: by unit flat
    starts and ends of runs of window starts.

    Null texts are empty; texts under a unit's length have no windows. Texts that occur as several rows repeat as a whole:
    their spans are all their windows.
    """
    rows = written(sketched(docs), "sketched")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n0"), F.first("n_words").alias("n1")).filter("copies > 1")
    whole = [copies.filter(F.col(f"n{i}") >= u.length).select("key", F.lit(i).alias("u"), F.array(F.lit(0), (F.col(f"n{i}") - (u.length - 1)).cast("int")).alias("spans")) for i, u in enumerate(UNITS)]
    found = found_windows(docs, rows).unionByName(whole[0]).unionByName(whole[1])
    lists = [F.flatten(F.collect_list(F.when(F.col("u") == i, F.col("spans")))).alias(u.name) for i, u in enumerate(UNITS)]
    return rows, written(found.groupBy("key").agg(*lists), "spans", rows)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) for each row of docs.

    The first five follow from repeated strings of LENGTH bytes. n_passages counts the maximal runs of words covered by
    PASSAGE words that also start elsewhere, whatever stands between the words and whether A-Z or a-z; n_passage_words
    their words. Null texts are empty; a null id and repeated rows stay rows.
    """
    rows, spans = repeats(docs)
    source = chosen_texts(docs, spans)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, m, sha, passages, inside = [], [], [], [], []
        for text, s, p in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            gone = covered(len(text), s, BYTES)
            n.append(int(gone.sum()))
            m.append(len(_spans(gone)) // 2)
            sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            held = covered(max(p) + PASSAGE - 1 if p else 0, p, WORDS)
            passages.append(len(_spans(held)) // 2)
            inside.append(int(held.sum()))
        whole = {k: pa.array(v, pa.int64()) for k, v in (("n_removed", n), ("n_spans", m), ("n_passages", passages), ("n_passage_words", inside))}
        return batch(key=b.column(0), kept=pa.array(sha, pa.string()), **whole)

    changed = map_batches(source.select("key", "text", "bytes", "words"), run, "key binary, kept string, n_removed long, n_spans long, n_passages long, n_passage_words long")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = rows.select(F.col("id").alias("doc_id"), "key", "n_bytes", "sha").join(changed, "key", "left")
    return packed(whole.select("doc_id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), number("n_passages"), number("n_passage_words")), rows)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
