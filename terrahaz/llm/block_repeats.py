"""Substring dedup with fixed-block anchors.

Every text is cut into non-overlapping blocks of words, the index.  Every
rolling window of a block's length probes it.  A block that a probe from
elsewhere hits is an anchor; around anchors, hits are extended to the maximal
runs of exactly repeated 35-word windows.  (35 words hold a whole block wherever
they begin, so no repeat can miss the index.)

Tasks trade packed arrays of hashes, dealt by hash, instead of one row per
word.  What one batch of documents already settles, such as a passage that many
of them share, travels once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import documents, keyed, written
from terrahaz.llm.hashing import mixed, runs, word_hashes

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
PORTION = 8_000_000  # bytes of text that a task holds as numbers at once
BROADCAST_ROWS, BROADCAST_NUMBERS = 400_000, 8_000_000
PACKED = "part int, hashes binary, seconds binary, ids binary, ths binary, places binary, counts binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]


def planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte by byte of significance (compresses well)."""
    d = np.diff(x.astype(np.int64), prepend=0).astype(np.uint32)
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]
    return np.cumsum(d.astype(np.int64)).astype(np.uint32)


def _joined(frame: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in frame[column]]) if len(frame) else np.zeros(0, kind)


class _Words:
    """The words of a batch of texts in a row: hashes, place in the text, room to the text's end."""

    def __init__(self, texts: pa.Array):
        lists = [word_hashes(t.as_buffer()) if t.is_valid else np.zeros(0, np.uint64) for t in texts]
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.hashes = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(lists)), self.lengths)
        self.place = np.arange(len(self.hashes)) - self.starts[self.owner]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window that lies in one text, and the index of its first word."""
        h = runs(self.hashes, size)
        at = np.flatnonzero(self.place[:len(h)] + size <= self.lengths[self.owner[:len(h)]])
        return h[at], at


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 6
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def _slices(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in an ascending array."""
    edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else np.zeros(0, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(parts[a]), slice(a, b)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where their texts pass ``PORTION`` bytes (a longer text stays whole)."""
    for batch in batches:
        ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")])
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PORTION, "right")))
            yield batch.slice(at, to - at)
            at = to


def _index_and_probes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            w = _Words(batch.column("text"))
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            h, at = w.windows(BLOCK)
            if not len(h):
                continue
            found, back, count = np.unique(h, return_inverse=True, return_counts=True)
            is_block = w.place[at] % BLOCK == 0
            here = is_block & (count[back] > 1)  # settled within the batch
            rows = []
            if here.any():
                o = w.owner[at[here]]
                rows.append((-1 - int(h[0] % np.uint64(parts)), b"", b"", ids[o].tobytes(), ths[o].tobytes(),
                             (w.place[at[here]] // BLOCK).astype(np.int32).tobytes(), b""))
            probes = np.concatenate([found, found[count > 1]])
            part, key = (probes % np.uint64(parts)).astype(np.int32), (probes >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((key, part))
            part, key = part[order], key[order]
            ask = np.flatnonzero(is_block & ~here)
            bpart, bkey = (h[ask] % np.uint64(parts)).astype(np.int32), (h[ask] >> np.uint64(32)).astype(np.uint32)
            border = np.argsort(bpart, kind="stable")
            bpart, bkey, ask = bpart[border], bkey[border], ask[border]
            owner, block = w.owner[at[ask]], (w.place[at[ask]] // BLOCK).astype(np.int32)
            mine = dict(_slices(bpart))
            for p, s in _slices(part):
                b = mine.get(p, slice(0, 0))
                rows.append((p, planes(key[s]), bkey[b].tobytes(), ids[owner[b]].tobytes(), ths[owner[b]].tobytes(), block[b].tobytes(), b""))
            yield _table(rows)

    return run


def _hit_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks whose hash some other window has as well."""
    ids, ths, places = _joined(rows, "ids", np.int64), _joined(rows, "ths", np.int64), _joined(rows, "places", np.int32)
    if rows["part"].iloc[0] >= 0:
        probes = np.sort(np.concatenate([from_planes(b) for b in rows["hashes"]]))
        twice = probes[1:][probes[1:] == probes[:-1]]
        hit = np.isin(_joined(rows, "seconds", np.uint32), twice)
        ids, ths, places = ids[hit], ths[hit], places[hit]
    return pd.DataFrame({"_id": ids, "_th": ths, "place": places})


def _candidate_windows(parts: int):
    """Windows around anchors, gathered in segments of neighbours that share their smallest block hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            w = _Words(batch.column("text"))
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            h, at = w.windows(WINDOW)
            anchors = batch.column("places")
            if not len(h):
                continue
            # a window is a candidate if it holds a whole anchor
            first = np.repeat(w.starts, [len(a) for a in anchors]) + np.asarray(anchors.flatten()).astype(np.int64) * BLOCK
            near = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
            np.add.at(near, np.maximum(first + BLOCK - WINDOW, 0), 1)
            np.add.at(near, first + 1, -1)
            keep = np.cumsum(near)[at] > 0
            h, at = h[keep], at[keep]
            if not len(h):
                continue
            blocks = runs(w.hashes, BLOCK)
            lows = np.lib.stride_tricks.sliding_window_view(blocks, WINDOW - BLOCK + 1)[at]
            low = lows.min(1)
            pivot = at + lows.argmin(1)
            new = np.r_[True, (pivot[1:] != pivot[:-1]) | (at[1:] != at[:-1] + 1)]
            seg = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            found, back, count = np.unique(h, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            bit = np.left_shift(1, at - at[starts][seg])
            local = np.add.reduceat(np.where(twice, bit, 0), starts)
            whole = np.add.reduceat(bit, starts)
            owner, place = w.owner[at[starts]], w.place[at[starts]].astype(np.int32)
            rows = []
            some = local > 0
            if some.any():
                o = owner[some]
                rows.append((-1 - int(h[0] % np.uint64(parts)), b"", b"", ids[o].tobytes(), ths[o].tobytes(), place[some].tobytes(),
                             local[some].astype(np.int32).tobytes()))
            part = (mixed(low) % np.uint64(parts)).astype(np.int32)
            # hashes that the batch holds twice go along once, marked, without owners
            once = np.zeros(len(h), bool)
            once[np.unique(back, return_index=True)[1]] = True
            marked = np.flatnonzero(once & twice)
            marked = marked[np.argsort(part[marked], kind="stable")]
            ask_seg = np.flatnonzero(local != whole)
            ask_seg = ask_seg[np.argsort(part[starts[ask_seg]], kind="stable")]
            sizes = np.diff(np.r_[starts, len(h)])[ask_seg]
            # the words of the chosen segments, segment after segment
            offset = np.cumsum(sizes) - sizes
            index = np.repeat(starts[ask_seg] - offset, sizes) + np.arange(sizes.sum())
            hashes = h[index]
            of_marked = dict(_slices(part[marked]))
            of_asked = dict(_slices(part[starts[ask_seg]]))
            for p in sorted({*of_marked, *of_asked}):
                a, m = of_asked.get(p, slice(0, 0)), of_marked.get(p, slice(0, 0))
                lo = int(offset[a.start]) if a.stop > a.start else 0
                hi = int(offset[a.stop - 1] + sizes[a.stop - 1]) if a.stop > a.start else 0
                o = owner[ask_seg[a]]
                rows.append((p, hashes[lo:hi].tobytes(), h[marked[m]].tobytes(), ids[o].tobytes(), ths[o].tobytes(),
                             place[ask_seg[a]].tobytes(), sizes[a].astype(np.int32).tobytes()))
            yield _table(rows)

    return run


def _repeated_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Segments with a mask of their windows that occur more than once."""
    ids, ths = _joined(rows, "ids", np.int64), _joined(rows, "ths", np.int64)
    places, counts = _joined(rows, "places", np.int32), _joined(rows, "counts", np.int32).astype(np.int64)
    if rows["part"].iloc[0] < 0:
        return pd.DataFrame({"_id": ids, "_th": ths, "place": places, "mask": counts.astype(np.int32)})
    h, marked = _joined(rows, "hashes", np.uint64), _joined(rows, "seconds", np.uint64)
    everything = np.sort(np.concatenate([h, marked, marked]))
    twice = everything[1:][everything[1:] == everything[:-1]]
    if not len(h):
        return pd.DataFrame({"_id": ids[:0], "_th": ths[:0], "place": places[:0], "mask": places[:0]})
    starts = np.cumsum(counts) - counts
    bit = np.left_shift(1, np.arange(len(h)) - np.repeat(starts, counts))
    mask = np.add.reduceat(np.where(np.isin(h, twice), bit, 0), starts).astype(np.int32)
    some = mask > 0
    return pd.DataFrame({"_id": ids[some], "_th": ths[some], "place": places[some], "mask": mask[some]})


def covered(places: np.ndarray, masks: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal runs of words under the repeated windows: first words and ends."""
    bits = (masks[:, None] >> np.arange(32)) & 1
    at = np.unique((places[:, None] + np.arange(32))[bits == 1])
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + WINDOW])
    return at[new].tolist(), (at[np.r_[new[1:] - 1, len(at) - 1]] + WINDOW).tolist()


def _runs_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [covered(np.array([x["place"] for x in v], np.int64), np.array([x["mask"] for x in v], np.int64))
               for v in batch.column("found").to_pylist()]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array([g[0] for g in got], ints),
                                          pa.array([g[1] for g in got], ints)], ["_id", "_th", "begins", "ends"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_, removed, digests, texts = [], [], [], []
        for text, begins, ends in zip(batch.column("text").to_pylist(), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            words = text.encode().split() if text else []
            n = len(words)
            for a, b in zip(reversed(begins or []), reversed(ends or []), strict=True):
                del words[a:b]
            kept = b" ".join(words)
            words_.append(n)
            removed.append(n - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def checked_broadcast(df: DataFrame, numbers: str) -> DataFrame:
    """Broadcasts a stored frame of arrays if rows and numbers are few; else the join is shuffled."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_NUMBERS else df


def repeated_runs(docs: DataFrame) -> DataFrame:
    """_id, _th, begins, ends: the runs of words under windows that also start anywhere else.

    Rows that share id and text are told apart by how often the pair occurs: a
    text of at least a window's length that occurs twice is repeated as a whole.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, "text")
    packed = texts.mapInArrow(_index_and_probes(parts), PACKED)
    hits = packed.groupBy("part").applyInPandas(_hit_blocks, "_id long, _th long, place int")
    anchors = written(hits.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("place")).alias("places")), "block-anchors")
    around = texts.join(checked_broadcast(anchors, "places"), ["_id", "_th"])
    windows = around.select("_id", "_th", "text", "places").mapInArrow(_candidate_windows(parts), PACKED)
    found = windows.groupBy("part").applyInPandas(_repeated_windows, "_id long, _th long, place int, mask int")
    per_text = found.groupBy("_id", "_th").agg(F.collect_list(F.struct("place", "mask")).alias("found"))
    return written(per_text.mapInArrow(_runs_of_words, "_id long, _th long, begins array<int>, ends array<int>"), "block-runs")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space).

    Removed is each word under a 35-word window that also starts anywhere else,
    the same text included; all copies go, also the first.  Null texts have no
    words; texts shorter than a window lose nothing; repeated rows count as
    repeats of each other; an empty table gives an empty result; other columns
    are not looked at.
    """
    found = checked_broadcast(repeated_runs(docs), "begins")
    joined = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, ["_id", "_th"], "left")
    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_block_repeats(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).drop("kept")


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from win) where c > 1
), gone as (
  select doc_id, p from (select distinct doc_id, unnest(range(i, i + 35)) as p from rep)
), words as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w
), kept as (
  select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from words anti join gone using (doc_id, p) group by doc_id
)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""
