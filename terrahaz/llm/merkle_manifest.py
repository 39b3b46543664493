"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

Leaves are hashed row by row and ranked within their tree; trees are built from
the bottom, ``2 ** DIGITS`` neighbouring nodes at a time.  What such a block
hashes to is stored as one record: digest -> the children of every node below
it.  Records are found by digest alone, so equal blocks are stored once.

A proof is found by descent.  All requested leaves go down from the root
together: at each record the next digit of a leaf's rank chooses the child, the
children beside it are collected, and requests that share a prefix of their rank
travel as one row until they part.  A path is collected from the root to the
leaf and reversed at the end, segment by segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.llm.common import bounded_broadcast, documents, written

DIGITS = 6  # binary digits of a rank that one record holds
PIECES = 200_000  # pieces of trees in range partitions that are broadcast
PATH = "array<struct<before:string,after:string>>"  # per level the siblings left and right of the path, as hex
RECORD = "digest string, height int, children array<array<string>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass(frozen=True)
class Manifest:
    """Stored parts of a manifest: ``leaves`` with their place, ``records`` of all trees, and how to enter them."""

    leaves: DataFrame  # doc_id, tree, rank, node (the leaf), tampered
    records: DataFrame  # digest, height, children
    top: DataFrame  # one row: tree, levels, root over the subroots
    subroots: DataFrame  # tree, rank (in the top tree), node (the subroot), levels
    rounds: int  # records between a subroot and its leaves, at most
    top_rounds: int


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' bytes, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def hashed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tree, node (the leaf), tampered (the leaf after tampering, else null) and a number that tells repeated rows apart.

    ``tree`` orders like ``lang`` with null first: empty for null, else ``=`` and the value.
    """
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
                       leaf_of().alias("node"), F.when(hit, leaf_of(n_chars=F.col("n_chars") + 1)).alias("tampered"),
                       F.monotonically_increasing_id().alias("tie"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 within each tree in ``order`` (nulls first).

    The rows are range-partitioned and written; a row's place in its partition
    and one count per tree and partition give the rank.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    held = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()), "merkle-ranked")
    held = held.withColumn("part", F.shiftright("at", 33))
    pieces = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = written(pieces.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift")),
                    "merkle-pieces")
    return (held.join(bounded_broadcast(shift, PIECES), ["tree", "part"])
            .withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _parents(nodes: Column) -> Column:
    """Every two consecutive digests, a last one alone too, become their digest."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda i: digest(
        F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Records and roots (tree, levels, root) of the trees over ``leaves`` (tree, rank, node), and the rounds of the highest tree."""
    # the binary length of n - 1 is the number of levels: no logarithm that could round
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select(
        "tree", F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("int").alias("levels"))
    sizes = written(sizes, "merkle-sizes")
    rounds = -(-(sizes.agg(F.max("levels")).first()[0] or 0) // DIGITS)
    nodes = leaves.select("tree", "rank", "node").join(bounded_broadcast(sizes, PIECES), "tree")
    records = nodes.sparkSession.createDataFrame([], RECORD)
    roots = nodes.where("levels = 0")
    for r in range(rounds):
        block = (nodes.where(F.col("levels") > DIGITS * r)
                 .groupBy("tree", "levels", F.shiftright("rank", DIGITS).alias("rank"))
                 .agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("members"))
                 .withColumn("height", F.least(F.lit(DIGITS), F.col("levels") - DIGITS * r)).withColumn("l0", F.col("members.node")))
        for k in range(DIGITS):
            block = block.withColumn(f"l{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
        block = written(block.select("tree", "levels", "rank", F.get(f"l{DIGITS}", F.lit(0)).alias("node"), "height", F.slice(
            F.array(*[f"l{k}" for k in range(DIGITS)]), F.lit(1), F.col("height")).alias("children")), "merkle-blocks")
        records = records.unionByName(block.select(F.col("node").alias("digest"), "height", "children"))
        nodes = block.select("tree", "rank", "node", "levels")
        roots = roots.unionByName(nodes.where(F.col("levels") <= DIGITS * (r + 1)))
    return (written(records.dropDuplicates(["digest"]), "merkle-records"),
            written(roots.select("tree", "levels", F.col("node").alias("root")), "merkle-roots"), rounds)


def manifest(docs: DataFrame) -> Manifest:
    """Builds and stores the manifest of ``docs``: one tree per lang, one over the subroots."""
    leaves = written(ranked(written(hashed_rows(docs), "merkle-leaves"), ["doc_id", "node", "tie"]).drop("tie"), "merkle-places")
    records, roots, rounds = build(leaves)
    subroots = written(ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "levels", F.col("root").alias("node")), ["of"]),
                       "merkle-subroots")
    upper, top, top_rounds = build(subroots)
    return Manifest(leaves, written(records.unionByName(upper).dropDuplicates(["digest"]), "merkle-dag"), top,
                    subroots.select(F.col("of").alias("tree"), "rank", "node", "levels"), rounds, top_rounds)


def _hop(children: Column, digit: Column, level: int) -> Column:
    """The siblings left and right of node ``digit >> level`` on a level of a record."""
    at = F.shiftright(digit, level)
    beside = F.coalesce(F.get(F.get(children, F.lit(level)), at.bitwiseXOR(F.lit(1))), F.lit(""))
    second = at % 2 == 1
    return F.struct(F.when(second, beside).otherwise(F.lit("")).alias("before"), F.when(second, F.lit("")).otherwise(beside).alias("after"))


def _segment(children: Column, height: Column, digit: Column) -> Column:
    """What is not selected on the way from a record's digest down to its lowest node number ``digit``."""
    hops = F.array(*[F.when(height > k, _hop(children, digit, k)) for k in reversed(range(DIGITS))])
    return F.filter(hops, lambda h: h.isNotNull())


def descend(records: DataFrame, starts: DataFrame, requests: DataFrame, rounds: int, carried: list[str]) -> DataFrame:
    """For each request (tree, rank, one row a leaf) its leaf, its path and the columns of ``starts``.

    ``starts`` (tree, levels, digest, path, ...) are the roots to enter at, with
    the path that led to them.  Paths run from the root; ``carried`` columns of the
    requests are returned.
    """
    extra = [c for c in starts.columns if c not in ("tree", "levels", "digest", "path")]
    asked = requests.join(bounded_broadcast(starts.select("tree", "levels"), PIECES), "tree")
    lone = starts.where("levels = 0").join(requests, "tree").select(*extra, "path", F.col("digest").alias("node"), *carried)
    frontier = None
    for r in reversed(range(rounds)):
        entering = starts.where((F.col("levels") > DIGITS * r) & (F.col("levels") <= DIGITS * (r + 1))).select(
            "tree", F.lit(0).cast("long").alias("at"), "digest", "path", *extra)
        frontier = entering if frontier is None else frontier.unionByName(entering)
        wanted = asked.where(F.col("levels") > DIGITS * r).withColumn("child", F.shiftright("rank", DIGITS * r))
        if r:
            wanted = wanted.select("tree", "child").distinct()
        digit = F.col("child").bitwiseAND(F.lit((1 << DIGITS) - 1)).cast("int").alias("digit")
        wanted = wanted.groupBy("tree", F.shiftright("child", DIGITS).alias("at")).agg(
            F.collect_list(F.struct(digit, *([] if r else carried))).alias("wanted"))
        step = frontier.join(wanted, ["tree", "at"]).join(records, "digest")
        down = step.select("tree", "at", "path", *extra, F.explode(F.transform("wanted", lambda w: F.struct(
            w.alias("ask"), F.get(F.get(F.col("children"), F.lit(0)), w["digit"]).alias("node"),
            _segment(F.col("children"), F.col("height"), w["digit"]).alias("segment")))).alias("to"))
        path = F.concat("path", "to.segment").alias("path")
        if r:
            frontier = written(down.select("tree", (F.shiftleft("at", DIGITS) + F.col("to.ask.digit")).alias("at"),
                                           F.col("to.node").alias("digest"), path, *extra), "merkle-frontier")
        else:
            lone = lone.unionByName(down.select(*extra, path, F.col("to.node").alias("node"), *[F.col(f"to.ask.{c}").alias(c) for c in carried]))
    return lone.withColumn("path", F.reverse("path"))


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root, path (from the leaf up) of the requested leaves, all if none are named."""
    start = m.top.select("tree", "levels", F.col("root").alias("digest"), F.array().cast(PATH).alias("path"), "root")
    below = descend(m.records, start, m.subroots.select(F.lit("").alias("tree"), "rank", F.col("tree").alias("of"), F.col("levels").alias("under")),
                    m.top_rounds, ["of", "under"])
    starts = written(below.select(F.col("of").alias("tree"), F.col("under").alias("levels"), F.col("node").alias("digest"),
                                  F.reverse("path").alias("path"), "root", F.col("node").alias("subroot")), "merkle-entries")
    asked = m.leaves if requests is None else requests
    return descend(m.records, starts, asked, m.rounds, ["doc_id", "tampered"]).select(
        "doc_id", F.col("node").alias("leaf"), "tampered", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, hop: digest(hop["before"], node, hop["after"]))


def verified(found: DataFrame) -> DataFrame:
    """Per proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Each row of the table is a leaf.  Rows with one doc_id are ordered by their
    leaf, null ids come first and are never tampered with; repeated rows are
    leaves of their own and share records.  Nulls hash as ``-``, which no value
    does; empty texts as ``0:``.  Long texts are hashed within their row; an empty
    table gives an empty result; other columns are not looked at.
    """
    siblings = F.array_join(F.transform("path", lambda h: F.concat(h["before"], h["after"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return verified(proofs(manifest(documents(spark, sf_dir))))


SQL = """
WITH RECURSIVE leaves AS (
    SELECT rid, doc_id, tree, tampered, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS rank
    FROM (
        SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(octet_length(encode((n_chars)::VARCHAR)) || ':' || (n_chars), '-') || tail) AS leaf,
               sha256(head || coalesce(octet_length(encode((n_chars + (crc % 7 = 0)::INT)::VARCHAR)) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || tail) AS tampered
        FROM (
            SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
                   || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                   coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
                           CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295), 1) AS crc
            FROM documents
        )
    )
), nodes AS (
    SELECT tree, 0 AS level, rank AS place, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n
), subroots AS (
    SELECT tree, level AS levels, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, rank AS place, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
    FROM upper WHERE n > 1 GROUP BY level, place // 2, n
), hops AS (
    SELECT rid, l.rank >> g.level AS place, g.level AS hop, coalesce(node, '') AS sibling
    FROM leaves l JOIN subroots s USING (tree), range(64) g(level)
    LEFT JOIN nodes b ON b.tree = l.tree AND b.level = g.level AND b.place = xor(l.rank >> g.level, 1)
    WHERE g.level < s.levels
    UNION ALL
    SELECT rid, s.rank >> g.level, s.levels + g.level, coalesce(node, '')
    FROM leaves l JOIN subroots s USING (tree), range(64) g(level)
    LEFT JOIN upper b ON b.level = g.level AND b.place = xor(s.rank >> g.level, 1)
    WHERE g.level < (SELECT max(level) FROM upper)
), folds AS (
    SELECT rid, 0 AS hop, tampered AS node FROM leaves
    UNION ALL
    SELECT f.rid, f.hop + 1, sha256(CASE WHEN h.place % 2 = 1 THEN h.sibling || f.node ELSE f.node || h.sibling END)
    FROM folds f JOIN hops h ON h.rid = f.rid AND h.hop = f.hop
), proofs AS (
    SELECT rid, sha256(coalesce(string_agg(sibling, '' ORDER BY hop), '')) AS proof_sha256 FROM leaves LEFT JOIN hops USING (rid) GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN proofs USING (rid)
JOIN (SELECT rid, arg_max(node, hop) AS folded_root FROM folds GROUP BY rid) USING (rid)
CROSS JOIN (SELECT node AS root FROM upper WHERE n = 1)
"""
