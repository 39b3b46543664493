"""Merkle manifest against a plain Python tree, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from terrahaz.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, node int, rank string, path string, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, n_chars + more if n_chars is not None else None, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    """(sibling or empty, whether it stands left) of every level."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else "", at % 2 == 1))
        at //= 2
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted([r for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in members[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(members[x]):
            path = siblings(trees[x], at) + siblings(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for s, left in path:
                node = h(s, node) if left else h(node, s)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*[s for s, _ in path]), node, node == top[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def found(docs):
    return [tuple(r) for r in merkle_manifest.verified(merkle_manifest.proofs(merkle_manifest.manifest(docs))).collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, rng.choice(["a", "b", None]), rng.choice(["en"] * 8 + ["de", "é", None]), rng.choice([None, 5, i]), f"text {i} ü") for i in range(700)]
    out += [(900, "s", "lone", 3, None), (901, "s", "pair", 3, ""), (902, "s", "pair", None, "x" * 3_000_000), (903, None, "", 1, "-"), (None, "s", "en", 1, "t"),
            (None, None, None, None, None), (904, "s", "-", 0, "t")]
    return out + [out[3]] * 70 + [(5, "other", "en", 1, "same id")]  # repeated rows and ties


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "r", "p", 4) for r in rows], SCHEMA).repartition(7)


def test_against_plain_tree(docs, rows):
    assert order(found(docs)) == order(plain(rows))


def test_shuffled_sides(docs, rows, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PIECES", 0)
    assert order(found(docs)) == order(plain(rows))


@pytest.mark.parametrize("n", [1, 2, 65, 4097])
def test_sizes_of_a_tree(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert order(found(docs)) == order(plain(rows))


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_records_are_found_by_content(spark, docs, rows):
    m = merkle_manifest.manifest(docs)
    records = {r["digest"]: r for r in m.records.collect()}
    assert len(records) == m.records.count()
    for name, record in records.items():
        nodes = record["children"][0]
        for level in range(record["height"]):  # a lone node is hashed too: others remain beside the record
            assert record["children"][level] == nodes
            nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        assert nodes == [name]
    some = m.leaves.where(F.col("doc_id") % 50 == 0)
    picked = merkle_manifest.verified(merkle_manifest.proofs(m, some)).collect()
    assert order([tuple(r) for r in picked]) == order([r for r in plain(rows) if r[0] is not None and r[0] % 50 == 0])
