"""Word hashes and the grouping of sorted batches, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from terrahaz.llm.hashing import LONG, PIECE, word_hashes
from terrahaz.llm.odd_sketch_dedup import _common, _links_of_block, band_keys, grouped, min_hashes, odd_sketch


@pytest.mark.parametrize("lower", [False, True])
def test_word_hashes_tell_words_apart_and_nothing_else(lower):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"aAbZ \t\n\v\f\r\x1c\xc3\x85") for _ in range(n)) for n in (0, 1, 40, PIECE - 1, PIECE + 1, 3 * PIECE)]
    texts += [b" ", b"q" * (2 * PIECE), b"q" * LONG + b" " + b"Q" * (LONG + 1) + b" " + b"q" * (LONG + 1),
              b" " * (PIECE - 3) + b"across the edge"]
    of_word, of_hash = {}, {}
    for text in texts:
        words = (text.lower() if lower else text).split()
        hashes = word_hashes(text, lower).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert of_word.setdefault(w, h) == h and of_hash.setdefault(h, w) == w


def test_groups_reach_over_batches():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 4, 9):
        rows = pa.RecordBatch.from_pydict({"k": keys, "at": list(range(len(keys)))})
        batches = [rows.slice(0, 0), *(rows.slice(at, size) for at in range(0, len(keys), size))]
        got = [(t["k"].to_pylist(), t["at"].to_pylist()) for t in grouped(iter(batches), ["k"])]
        assert [set(k) for k, _ in got] == [{1}, {2}, {3}, {4}]
        assert [at for _, group in got for at in group] == list(range(len(keys)))
    assert list(grouped(iter([]), ["k"])) == []


def test_links_of_a_block_are_those_of_the_full_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.r_[base[:300 - cut], rng.integers(0, 2**64, cut, np.uint64)]) for cut in (0, 10, 20, 43, 60, 150, 290)]
    rows, keys = [], [band_keys(min_hashes(s))[0] for s in sets]
    for node, (s, bands) in enumerate(zip(sets, keys, strict=True)):
        bands = bands.copy()
        bands[0] = 77  # the bucket they all share
        sketch, bins, samples = odd_sketch(s)
        rows += [{"key": 77, "i": 0, "j": 0, "open": o, "node": node, "comp": node, "n_shingles": len(s), "samples": samples,
                  "sketch": sketch.tolist(), "bins": bins.tolist(), "bands": bands.tolist(), "set": s.view(np.int64).tolist()} for o in (True, False)]
    want = {(a, b) for a in range(7) for b in range(a + 1, 7)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert want and _links_of_block(pa.Table.from_pylist(rows)) == want
    assert _common(sets[0], sets[5]) == len(np.intersect1d(sets[0], sets[5]))
    alone = [r | {"comp": 1} for r in rows]
    assert _links_of_block(pa.Table.from_pylist(alone)) == set()
