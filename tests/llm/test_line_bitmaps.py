"""Line bitmaps against brute force, edge cases and hot lines."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrahaz.llm import block_repeats, line_bitmaps

EDGES = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_documents, min_chars=1, keep_first=False):
    """(n_lines, n_dropped, kept text) of every row, one after another."""
    key = lambda line: line.strip(EDGES).translate(LOWER)
    places = {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            places.setdefault(key(line), set()).add(((i is not None, i or 0), t or "", pos))
    documents = {k: len({p[:2] for p in v}) for k, v in places.items()}
    first = {k: min((p[0], p[2]) for p in v) for k, v in places.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for pos, line in enumerate(lines):
            k = key(line)
            gone = len(k) >= min_chars and documents[k] >= min_documents
            if gone and keep_first:
                gone = ((i is not None, i or 0), pos) != first[k]
            if not gone:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(docs, **how):
    return [tuple(r) for r in line_bitmaps.apply_bitmaps(docs, line_bitmaps.keep_bitmaps(docs, **how)).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(60):
        lines = [f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            lines += ["\t A Common Line \r", "a common line", "à COMMON line"][: 1 + i % 2]
        out.append((i, "\n".join(lines)))
    out += [(100, None), (101, ""), (102, "\n\n"), (103, " \r\n\x0b"), (None, "line 1\nà common line"),
            (None, "a common line"), (104, "\n".join(["A COMMON LINE"] * 3 + ["own"] + ["line 2"] * 2)),
            (105, "Ünïcode Zeile "), (106, "\n".join(f"long {k}" if k % 3 else "line 3" for k in range(40_000)))]
    return out + [out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, 1, "x", 2, 3) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, _id long, _th string, pos int, runs int").repartition(5)


@pytest.mark.parametrize("how", [{"min_documents": 10}, {"min_documents": 3, "min_chars": 7},
                                 {"min_documents": 1, "keep_first": True}, {"min_documents": 2, "min_chars": 0}])
def test_against_brute_force(docs, rows, how):
    assert order(found(docs, **how)) == order(plain(rows, **how))


def test_shuffled_bitmaps(docs, rows, monkeypatch):
    monkeypatch.setattr(block_repeats, "BROADCAST_ROWS", 0)
    assert order(found(docs, min_documents=10)) == order(plain(rows, 10))


def test_runs_are_the_bitmap(spark):
    texts = [(i, "hot\nown %d\nhot\nhot\nend" % i) for i in range(4)]
    bitmaps = line_bitmaps.keep_bitmaps(spark.createDataFrame(texts, "doc_id long, text string"), min_documents=4)
    assert [(r["n_dropped"], r["runs"]) for r in bitmaps.collect()] == [(4, [0, 1, 1, 3])] * 4


def test_a_line_in_every_document_is_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\nown "), F.col("id")).alias("text"))
    lines = line_bitmaps.hashed_lines(docs, 1, 64).where("pos = 0")
    assert lines.groupBy("high", "slice").count().agg(F.max("count")).first()[0] < 4000 / 16
    assert line_bitmaps.keep_bitmaps(docs).where("n_dropped <> 1 or runs <> array(0, 1)").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty, min_documents=10) == []


def test_query(spark):
    out = line_bitmaps.op11_line_bitmaps(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain([tuple(r) for r in docs], 10)]
    assert order([tuple(r) for r in out.collect()]) == order(want)
