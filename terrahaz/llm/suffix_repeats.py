"""Suffix-array dedup of byte strings.

No task can sort all suffixes of a corpus, so windows of 100 bytes are dealt by
content: each belongs to the place of its smallest 16-byte hash, its anchor, and
equal windows have equal anchors.  Neighbouring windows of one anchor form a
segment.  Segments whose anchor occurs once are done with.  The others meet by
anchor; identical segments fold into their earliest, and those that share enough
bytes with another to hold an equal window go through suffix arrays, each of a
lot of whole anchors, built by Lyndon groups (``lyndon_suffixes``)
over the texts from the anchors on, in symbols of 16 bytes.  In suffix order,
windows that agree from the anchor on are neighbours; those that also agree
before it are equal, and all but the earliest are repeats.

A passage that many documents share makes crowded anchors: the segments at its
edges differ in every document.  Segments of a crowded anchor are cut where the
next smallest hashes of their windows change and dealt again, still packed, by
all of these hashes and their distances; so equal windows still meet, and the
same suffix arrays judge them.  The levels end, for windows that agree in all
their hashes are equal and fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.block_repeats import NAMES, PACKED, _joined, _slices, _table, checked_broadcast, from_planes, planes
from terrahaz.llm.common import documents, keyed, written
from terrahaz.llm.hashing import mixed
from terrahaz.llm.lyndon_suffixes import suffix_order

WINDOW = 100
SEED = 16
REACH = WINDOW - SEED  # an anchor lies at most so far behind its window's first byte
CHUNK = 200_000  # bytes that are hashed at once, in a processor's cache; their places must fit PLACE_BITS
PLACE_BITS = 26
SYMBOL = 16
CROWD = 2_000  # different segments of one key from which on they are dealt by more hashes
DEALS = (4, 16, REACH + 1)  # smallest hashes of a window that make its key, level by level; the last are all
PORTION = 4_000_000  # bytes of crowded segments that a task cuts at once
STEP = 10_000  # windows whose hashes are ordered at once
BAND = 29  # windows that begin at most so far apart are looked for by the bytes they share
LOT = 2_000  # segments of whole keys that meet in one suffix array


class _Segments:
    """Segments of a batch of texts: owner, first window, bytes up to the last window's end, anchor, anchor's hash."""

    def __init__(self, texts: list[bytes], ranges: Iterable[tuple[int, int, int]] | None = None):
        """``ranges``: owner, begin and end of the bytes whose windows count, all bytes if left out."""
        self.texts = texts
        parts = []
        pieces, size = [], 0
        for owner, begin, end in ((i, 0, len(t)) for i, t in enumerate(texts)) if ranges is None else ranges:
            for at in range(begin, end - WINDOW + 1, CHUNK):
                piece = texts[owner][at:min(at + CHUNK + WINDOW - 1, end)]
                if size + len(piece) > CHUNK and pieces:
                    parts.append(self._chunk(pieces))
                    pieces, size = [], 0
                pieces.append((owner, at, piece))
                size += len(piece)
        if pieces:
            parts.append(self._chunk(pieces))
        self.owner, self.first, self.end, self.anchor, self.hash = (
            np.concatenate(c) if parts else np.zeros(0, np.uint64 if k == 4 else np.int64)
            for k, c in enumerate(zip(*parts, strict=True) if parts else [[]] * 5))

    @staticmethod
    def _chunk(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(p for *_, p in pieces) + bytes(SEED), np.uint8)
        n = len(raw) - SEED
        eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (n + 8,), (1,))
        h = mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(eight[8:n + 8]))
        low = ((h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        width, need = 1, REACH + 1
        while 2 * width <= need:  # minima of doubled reach
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:len(low) - (need - width)], low[need - width:])
        anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        lengths = np.array([len(p) for *_, p in pieces])
        starts = np.cumsum(lengths) - lengths
        stops = starts + lengths - WINDOW + 1  # after a piece's last window
        begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        begin = np.union1d(begin, starts)
        piece = np.searchsorted(starts, begin, "right") - 1
        inside = begin < stops[piece]
        begin, piece = begin[inside], piece[inside]
        last = np.minimum(np.r_[begin[1:], n], stops[piece]) - 1
        shift = (np.array([a for _, a, _ in pieces]) - starts)[piece]
        owners = np.array([o for o, *_ in pieces])[piece]
        at = anchor[begin]
        return owners, begin + shift, last + shift + WINDOW, at + shift, h[at]

    def bytes_of(self, i: int) -> bytes:
        return self.texts[self.owner[i]][self.first[i]:self.end[i]]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]


def _anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _Segments(_texts(batch))
            if not len(s.hash):
                continue
            ids, ths = batch.column("_id").to_numpy()[s.owner], batch.column("_th").to_numpy()[s.owner]
            found, back, count = np.unique(s.hash, return_inverse=True, return_counts=True)
            here = count[back] > 1
            rows = []
            if here.any():
                rows.append((-1 - int(s.hash[0] % np.uint64(parts)), b"", b"", ids[here].tobytes(), ths[here].tobytes(),
                             s.anchor[here].astype(np.int32).tobytes(), b""))
            probes = np.concatenate([found, found[count > 1]])
            part, key = (probes % np.uint64(parts)).astype(np.int32), (probes >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((key, part))
            part, key = part[order], key[order]
            ask = np.flatnonzero(~here)
            ask = ask[np.lexsort((ids[ask], s.hash[ask] % np.uint64(parts)))]
            apart, akey = (s.hash[ask] % np.uint64(parts)).astype(np.int32), (s.hash[ask] >> np.uint64(32)).astype(np.uint32)
            mine = dict(_slices(apart))
            for p, k in _slices(part):
                a = mine.get(p, slice(0, 0))
                i = ask[a]
                rows.append((p, planes(key[k]), akey[a].tobytes(), ids[i].tobytes(), ths[i].tobytes(), s.anchor[i].astype(np.int32).tobytes(), b""))
            yield _table(rows)

    return run


def _repeated_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    ids, ths, places = _joined(rows, "ids", np.int64), _joined(rows, "ths", np.int64), _joined(rows, "places", np.int32)
    if rows["part"].iloc[0] >= 0:
        probes = np.sort(np.concatenate([from_planes(b) for b in rows["hashes"]]))
        hit = np.isin(_joined(rows, "seconds", np.uint32), probes[1:][probes[1:] == probes[:-1]])
        ids, ths, places = ids[hit], ths[hit], places[hit]
    return pd.DataFrame({"_id": ids, "_th": ths, "place": places})


def _earliest(digests: np.ndarray, ids: np.ndarray, ths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of equal digests, which row begins first."""
    order = np.lexsort((ths, first, ids, digests))
    d = digests[order]
    out = np.zeros(len(d), bool)
    out[order[np.r_[True, d[1:] != d[:-1]]]] = True
    # the same text under the same id, repeated, is no earlier than itself
    lead = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    head = np.repeat(order[lead], np.diff(np.r_[lead, len(d)]))
    out[order[(ids[order] == ids[head]) & (first[order] == first[head])]] = True
    return out


def _around(texts: list[bytes], owner: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Owner, begin and end of the bytes that windows of these anchors (ascending by owner and place) can cover."""
    begin = np.maximum(anchor - REACH, 0)
    end = np.minimum(anchor + WINDOW, np.array([len(t) for t in texts], np.int64)[owner])
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])]) if len(owner) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(owner)][:len(new)] - 1
    return zip(owner[new].tolist(), begin[new].tolist(), end[last].tolist(), strict=True)


def _segments_of(parts: int):
    """Flagged segments: repeats within the batch as spans, the earliest of each as bytes for their anchor's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flags = _texts(batch), batch.column("places")
            fowner = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
            flag = np.sort((fowner << 32) | np.asarray(flags.flatten()).astype(np.int64))
            s = _Segments(texts, _around(texts, flag >> 32, flag & 0xFFFFFFFF))
            flagged = np.isin((s.owner << 32) | s.anchor, flag)
            pick = np.flatnonzero(flagged)
            if not len(pick):
                continue
            owner, first, end, h = s.owner[pick], s.first[pick], s.end[pick], s.hash[pick]
            ids, ths = batch.column("_id").to_numpy()[owner], batch.column("_th").to_numpy()[owner]
            yield _table(_packed([s.bytes_of(i) for i in pick.tolist()], s.anchor[pick] - first, h, ids, ths, first, owner, parts))

    return run


def _packed(contexts: list[bytes], back: np.ndarray, h: np.ndarray, ids: np.ndarray, ths: np.ndarray, first: np.ndarray,
            owner: np.ndarray, parts: int) -> list[tuple]:
    """Rows for segments of a batch: of equal ones all but the earliest as spans, the others by the part of their key ``h``."""
    end = first + np.array([len(c) for c in contexts])
    lead = _earliest(_digests(contexts, back), ids, ths, first)
    rows = []
    late = np.flatnonzero(~lead)
    if len(late):
        late = late[np.lexsort((first[late], owner[late]))]
        o, f, e = owner[late], first[late], end[late]
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (f[1:] > e[:-1])])
        tails = np.r_[new[1:], len(late)] - 1
        rows.append((-1 - int(h[0] % np.uint64(parts)), b"", b"", ids[late[new]].tobytes(), ths[late[new]].tobytes(),
                     f[new].astype(np.int32).tobytes(), e[tails].astype(np.int32).tobytes()))
    go = np.flatnonzero(lead)
    part = (h[go] % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((back[go], h[go], part))
    go, part = go[order], part[order]
    for p, k in _slices(part):
        i = go[k]
        blob = zstandard.compress(b"".join(contexts[j] for j in i.tolist()), 3)
        rows.append((p, h[i].tobytes(), blob, ids[i].tobytes(), ths[i].tobytes(), first[i].astype(np.int32).tobytes(),
                     np.stack([end[i] - first[i], back[i]], 1).astype(np.int32).tobytes()))
    return rows


def _digests(contexts: list[bytes], back: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(c, seed=b) for c, b in zip(contexts, back.tolist(), strict=True)), np.uint64, len(contexts))


def _unpacked(row: dict, pick: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, anchors' places in them, keys, ids, ths and first bytes of a packed row's segments."""
    pairs = np.frombuffer(row["counts"], np.int32).reshape(-1, 2).astype(np.int64)
    ends, raw = np.cumsum(pairs[:, 0]), zstandard.decompress(row["seconds"])
    pick = np.arange(len(pairs)) if pick is None else pick
    contexts = [raw[ends[i] - pairs[i, 0]:ends[i]] for i in pick.tolist()]
    return (contexts, pairs[pick, 1], *(np.frombuffer(row[c], kind)[pick] for c, kind in (
        ("hashes", np.uint64), ("ids", np.int64), ("ths", np.int64), ("places", np.int32))))


def _frequent(most: int):
    """part, keys: the keys of a part with more than ``most`` segments, equal ones of other batches counted again."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, count = np.unique(_joined(rows, "hashes", np.int64), return_counts=True)
        keys = keys[count > most]
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "keys": [keys]}).iloc[:min(len(keys), 1)]

    return run


def _segment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different segments that a batch holds of every key among ``keys``, as digests."""
    for batch in batches:
        for row in batch.to_pylist():
            pick = np.flatnonzero(_hit(row))
            if len(pick):
                contexts, back, h, *_ = _unpacked(row, pick)
                found = np.unique(np.stack([h, _digests(contexts, back)], 1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["part"], np.int32)), pa.array(found[:, 0].copy()),
                                                  pa.array(found[:, 1].copy())], ["part", "key", "digest"])


def crowded_keys(segments: DataFrame, most: int) -> DataFrame:
    """part, keys: the keys of a part with more than ``most`` different segments.

    Different ones are counted of keys that have so many segments at all.
    """
    frequent = written(segments.where("part >= 0").select("part", "hashes").groupBy("part").applyInPandas(
        _frequent(most), "part int, keys array<long>"), "suffix-frequent")
    each = segments.join(checked_broadcast(frequent, "keys"), "part").mapInArrow(_segment_counts, "part int, key long, digest long").distinct()
    crowded = each.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return crowded.groupBy("part").agg(F.collect_list("key").alias("keys"))


def _hit(row: dict) -> np.ndarray:
    return np.isin(np.frombuffer(row["hashes"], np.int64), row["keys"] or [])


def _uncrowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed segments without those of crowded keys."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            stay = ~_hit(row) if row["part"] >= 0 and row["keys"] else None
            if stay is not None and not stay.all():
                contexts, back, h, ids, ths, first = _unpacked(row, np.flatnonzero(stay))
                lengths = np.array([len(c) for c in contexts], np.int64)
                row |= {"hashes": h.tobytes(), "seconds": zstandard.compress(b"".join(contexts), 3), "ids": ids.tobytes(), "ths": ths.tobytes(),
                        "places": first.tobytes(), "counts": np.stack([lengths, back], 1).astype(np.int32).tobytes()}
            if stay is None or stay.any():
                rows.append(tuple(row[n] for n in NAMES))
        yield _table(rows)


def cut_by_hashes(contexts: list[bytes], back: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of segments whose windows share the places of their ``upto`` smallest hashes.

    Returns segment, first window, last window and key of each piece.  The key
    depends on the window's bytes alone: the hashes and their distances from the
    least one.
    """
    raw = np.frombuffer(b"".join(contexts) + bytes(SEED), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 8,), (1,))
    n = len(raw) - SEED
    h = mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(eight[8:n + 8]))
    lengths = np.array([len(c) for c in contexts], np.int64)
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(lengths) - lengths)[owner] + within
    low, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
    keys, new = [], []
    before = None
    for a in range(0, len(start), STEP):
        at = start[a:a + STEP, None] + np.arange(REACH + 1)
        ordered = (h[at] >> low << low) | np.arange(REACH + 1, dtype=np.uint64)  # as the anchors were chosen
        if upto <= REACH:
            ordered = np.partition(ordered, upto - 1, axis=1)[:, :upto]
        places = (np.sort(ordered, axis=1) & mask).astype(np.int64) + start[a:a + STEP, None]
        key = np.zeros(len(places), np.uint64)
        for k in range(upto):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[places[:, k]] + (places[:, k] - places[:, 0]).astype(np.uint64))
        keys.append(key)
        previous = np.concatenate([places[:1] if before is None else before, places[:-1]])
        new.append((places != previous).any(1))
        before = places[-1:]
    keys, new = np.concatenate(keys), np.concatenate(new) | (within == 0)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(new)] - 1
    return owner[begin], within[begin], within[last], keys[begin]


def _redealt(parts: int, upto: int):
    """Segments of crowded keys, cut and packed by the keys of their ``upto`` smallest hashes."""
    def pack(held: list[tuple]) -> list[tuple]:
        contexts = [c for row in held for c in row[0]]
        back, _, ids, ths, first = (np.concatenate([row[k] for row in held]) for k in range(1, 6))
        owner, begin, last, key = cut_by_hashes(contexts, back, upto)
        pieces = [contexts[o][b:e + WINDOW] for o, b, e in zip(owner.tolist(), begin.tolist(), last.tolist(), strict=True)]
        _, text = np.unique(np.stack([ids, ths], 1), axis=0, return_inverse=True)
        return _packed(pieces, back[owner] - begin, key, ids[owner], ths[owner], first[owner] + begin, text.ravel()[owner], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                pick = np.flatnonzero(_hit(row)) if row["part"] >= 0 and row["keys"] else []
                if len(pick):
                    held.append(_unpacked(row, pick))
                    size += sum(map(len, held[-1][0]))
                if size >= PORTION:
                    yield _table(pack(held))
                    held, size = [], 0
        if held:
            yield _table(pack(held))

    return run


def repeats_by_suffixes(contexts: list[bytes], back: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Windows (rows: contexts, columns: bytes before the anchor) equal to one of smaller rank.

    ``back`` is the anchor's place in each context; equal ranks are not earlier
    than each other.
    """
    n = len(contexts)
    rights = [c[b:] for c, b in zip(contexts, back.tolist(), strict=True)]
    right = np.array([len(r) for r in rights])
    width = -(-WINDOW // SYMBOL)
    table = np.frombuffer(b"".join(r.ljust(width * SYMBOL, b"\0") for r in rights), np.uint8).reshape(n, -1)
    numbered: dict[bytes, int] = {}  # equal texts from the anchor on share a place in the order
    which = np.array([numbered.setdefault(r, len(numbered)) for r in rights])
    first = np.zeros(len(numbered), np.int64)
    first[which[::-1]] = np.arange(n - 1, -1, -1)
    _, halves = np.unique(table[first].view(">u8").astype(np.uint64), return_inverse=True)
    halves = halves.reshape(len(first), -1)
    symbols = halves[:, ::2] * (halves.max() + 1) + halves[:, 1::2]
    held = np.arange(width) * SYMBOL < right[first, None]
    _, numbers = np.unique(symbols[held], return_inverse=True)
    text = np.zeros((len(first), width + 1), np.int64)  # 0 closes a context
    text[:, :-1][held] = numbers + 1
    inside = np.c_[held, np.ones(len(first), bool)]
    begins = np.cumsum(inside.sum(1)) - inside.sum(1)
    at = np.full(int(inside.sum()), -1)
    at[begins] = np.arange(len(first))
    order = at[suffix_order(text[inside])]
    place = np.empty(len(first), np.int64)
    place[order[order >= 0]] = np.arange(len(first))
    order = np.argsort(place[which], kind="stable")
    rows = table[order]
    shared = np.r_[0, np.minimum(np.argmin(np.c_[rows[1:] == rows[:-1], np.zeros(n - 1, bool)], 1), np.minimum(right[order[1:]], right[order[:-1]]))]
    out = np.zeros((n, REACH + 1), bool)
    left = np.zeros((n, REACH + 1), np.uint64)  # hash of the r bytes before the anchor
    lefts = np.frombuffer(b"".join(c[:b][::-1].ljust(REACH, b"\0") for c, b in zip(contexts, back.tolist(), strict=True)), np.uint8).reshape(n, REACH)
    for r in range(REACH):
        left[:, r + 1] = mixed(left[:, r] * np.uint64(0x9E3779B97F4A7C15) + lefts[:, r] + np.uint64(1))
    left, back_, right_, rank_ = left[order], back[order], right[order], rank[order]
    for r in range(REACH + 1):
        has = np.flatnonzero((back_ >= r) & (right_ >= WINDOW - r))
        if len(has) < 2:
            continue
        run = np.cumsum(shared < WINDOW - r)[has]
        key, k = left[has, r], rank_[has]
        o = np.lexsort((k, key, run))
        new = np.r_[True, (run[o][1:] != run[o][:-1]) | (key[o][1:] != key[o][:-1])]
        least = k[o][new][np.cumsum(new) - 1]
        out[order[has[o]], r] = k[o] > least
    return out


def agreeing(contexts: list[bytes], back: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Segments of which another one of their key has all the bytes that some windows of a ``BAND`` share.

    No window of the others is equal to any: equal windows lie in one band, at the
    same distance before the anchor.
    """
    back = np.minimum(back, REACH)
    right = np.array([len(c) for c in contexts], np.int64) - back
    out = np.zeros(len(contexts), bool)
    for low in range(0, REACH + 1, BAND):
        high = min(low + BAND - 1, REACH)
        has = np.flatnonzero((back >= low) & (right >= WINDOW - high))
        shared = np.fromiter((xxhash.xxh3_64_intdigest(contexts[i][b - low:b + WINDOW - high])
                              for i, b in zip(has.tolist(), back[has].tolist(), strict=True)), np.uint64, len(has))
        _, group, count = np.unique(mixed(key[has]) ^ shared, return_inverse=True, return_counts=True)
        out[has[count[group] > 1]] = True
    return out


def _lots(key: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of segments in lots of whole keys, of at least ``LOT`` segments but for the last."""
    order = np.argsort(key, kind="stable")
    ends = np.r_[np.flatnonzero(key[order[1:]] != key[order[:-1]]) + 1, len(key)] if len(key) else np.zeros(0, np.int64)
    at = 0
    while at < len(key):
        to = int(ends[np.searchsorted(ends, min(at + LOT, len(key)))])
        yield order[at:to]
        at = to


def _spans(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans of repeated bytes of the segments of one part."""
    ids, ths, first = _joined(rows, "ids", np.int64), _joined(rows, "ths", np.int64), _joined(rows, "places", np.int32)
    counts = _joined(rows, "counts", np.int32)
    if rows["part"].iloc[0] < 0:
        return pd.DataFrame({"_id": ids, "_th": ths, "begin": first, "end": counts})
    counts = counts.reshape(-1, 2).astype(np.int64)
    length, back = counts[:, 0], counts[:, 1]
    h = _joined(rows, "hashes", np.uint64)
    blob = b"".join(map(zstandard.decompress, rows["seconds"]))
    offset = np.cumsum(length) - length
    contexts = [blob[a:a + n] for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
    lead = _earliest(_digests(contexts, back), ids, ths, first)
    late = np.flatnonzero(~lead)
    out = [(ids[late], ths[late], first[late], first[late] + length[late])]
    go = np.flatnonzero(lead)
    go = go[agreeing([contexts[i] for i in go.tolist()], back[go], h[go])]
    for lot in _lots(h[go]):
        some = go[lot]
        starts = np.lexsort((first[some] + back[some], ids[some]))
        place = np.stack([ids[some], first[some] + back[some]], 1)[starts]
        rank = np.empty(len(some), np.int64)  # order of the anchors is the order of their windows at one distance
        rank[starts] = np.cumsum(np.r_[0, (place[1:] != place[:-1]).any(1)])
        hit = repeats_by_suffixes([contexts[i] for i in some.tolist()], back[some], rank)
        i, r = np.nonzero(hit)
        if len(i):
            begin = first[some[i]] + back[some[i]] - r
            o = np.lexsort((begin, i))
            i, begin = i[o], begin[o]
            new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (begin[1:] > begin[:-1] + WINDOW)])
            tails = np.r_[new[1:], len(i)] - 1
            g = some[i[new]]
            out.append((ids[g], ths[g], begin[new], begin[tails] + WINDOW))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("_id", "_th", "begin", "end"), cols, strict=True))).astype({"begin": np.int32, "end": np.int32})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        flat = spans.flatten()
        begin, end = (np.asarray(flat.field(n)).astype(np.int64) for n in ("begin", "end"))
        edges = np.asarray(spans.offsets).astype(np.int64)
        edges -= edges[0]
        text = np.repeat(np.arange(len(spans)), np.diff(edges))
        reach = np.maximum.accumulate((text << 32) | end) & 0xFFFFFFFF  # farthest end of a text's spans so far; spans are sorted
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (begin[1:] > reach[:-1])][:len(text)])
        last = np.r_[new[1:], len(text)][:len(new)] - 1
        offsets = pa.array(np.searchsorted(new, edges), pa.int32())
        begins, ends = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (begin[new], reach[last]))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), begins, ends], ["_id", "_th", "begins", "ends"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, spans, digests, kept = [], [], [], [], []
        for text, b, e in zip(_texts(batch), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            rest = text
            if b:
                edges = [0, *[x for pair in zip(b, e, strict=True) for x in pair], len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            size.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(len(b or []))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        longs = [pa.array(c, pa.int64()) for c in (size, removed, spans)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, most: int = CROWD) -> DataFrame:
    """_id, _th, begins, ends: bytes under 100-byte strings that also start earlier.

    A key with more than ``most`` different segments is dealt on by more hashes.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, "text")
    anchors = texts.mapInArrow(_anchors(parts), PACKED).groupBy("part").applyInPandas(_repeated_anchors, "_id long, _th long, place int")
    flagged = written(anchors.groupBy("_id", "_th").agg(F.collect_set("place").alias("places")), "suffix-anchors")
    held = texts.join(flagged, ["_id", "_th"]).select("_id", "_th", "text", "places")
    segments = written(held.mapInArrow(_segments_of(parts), PACKED), "suffix-segments")
    judged = []
    for upto in DEALS:
        crowded = written(crowded_keys(segments, most), "suffix-crowded")
        if crowded.isEmpty():
            break
        split = segments.join(checked_broadcast(crowded, "keys"), "part", "left").select(*NAMES, "keys")
        judged.append(split.mapInArrow(_uncrowded, PACKED))
        segments = written(split.where(F.col("keys").isNotNull()).mapInArrow(_redealt(parts, upto), PACKED), "suffix-segments")
    spans = reduce(DataFrame.unionByName, [frame.groupBy("part").applyInPandas(_spans, "_id long, _th long, begin int, end int")
                                           for frame in [*judged, segments]])
    per_text = spans.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    return written(per_text.mapInArrow(_merged, "_id long, _th long, begins array<int>, ends array<int>"), "suffix-spans")


def cut_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Removed is each byte under a 100-byte string that also starts earlier:
    under a smaller doc_id (null comes first), or earlier in the same document.
    Null texts are empty; texts under 100 bytes lose nothing; two rows with one
    id and one text are one document, so neither is earlier; an empty table gives
    an empty result; other columns are not looked at.
    """
    found = checked_broadcast(repeated_spans(docs), "begins")
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, ["_id", "_th"], "left")
    return rows.select("doc_id", "text", "begins", "ends").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return cut_spans(documents(spark, sf_dir)).drop("kept")
