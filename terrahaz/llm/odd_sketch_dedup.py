"""Near duplicates: banded MinHash finds candidates, odd sketches sort them out, full sets confirm.

Per text: its distinct 5-word shingles, 128 MinHashes in 32 bands of 4, and an
odd sketch: the text's one-permutation MinHash samples folded into a bitmap of
parities.  The population count of two bitmaps' XOR tells how many samples
differ, precisely so for similar texts; pairs six standard deviations below the
threshold are let go, all others are compared on their full sets.

Texts with equal sets are one node.  A bucket's nodes are not paired with each
other: first each is compared with its buckets' leaders; what is then still in
different components of one bucket is compared in blocks, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from terrahaz.llm.common import bounded_broadcast, documents, keyed, matched, text_key, without, written
from terrahaz.llm.components import components
from terrahaz.llm.hashing import mixed, runs, word_hashes

SHINGLE = 5
NEAR = 0.75
BANDS, ROWS = 32, 4
BINS, BITS = 512, 1024
SIGMAS = 6.0
SMALL = 200_000
BLOCK = 2048
OPEN_BLOCK = 256
_draw = np.random.default_rng(20240501)
_FACTORS = (_draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
SHAPE = "n_shingles long, digest binary, bands array<long>, sketch array<long>, bins array<long>, samples int"


def shingles(text: pa.StringScalar) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle; no words, none."""
    words = word_hashes(text.as_buffer(), lower=True) if text.is_valid else np.zeros(0, np.uint64)
    if not len(words):
        return words
    s = runs(words, min(SHINGLE, len(words)))
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def min_hashes(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full((BANDS * ROWS, 1), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        out = np.minimum(out, (low[at:at + 4096] * _FACTORS + _SHIFTS).min(1, keepdims=True))
    return out[:, 0]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Band keys, a row for every row of MinHashes."""
    key = np.arange(BANDS, dtype=np.uint64)
    for part in np.moveaxis(hashes.reshape(-1, BANDS, ROWS), 2, 0):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Parity bitmap, bitmap of the bins that hold a sample, number of samples."""
    x = np.sort(((s % np.uint64(BINS)) << np.uint64(54)) | (s >> np.uint64(10)))
    bins = (x >> np.uint64(54)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    parity = np.bincount((mixed(x[first]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    held = np.zeros(BINS, np.uint8)
    held[bins[first]] = 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64), np.packbits(held).view(np.int64), int(first.sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text) for text in batch.column("text")]
        keys = iter(band_keys(np.stack([min_hashes(s) for s in sets if len(s)]))) if any(map(len, sets)) else iter(())
        rows = [(len(s), xxhash.xxh3_128_digest(s), next(keys), *odd_sketch(s)) if len(s) else (0, None, None, None, None, 0) for s in sets]
        cols = zip(*rows, strict=True) if rows else [()] * 6
        longs = pa.list_(pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), longs, longs, longs, pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("_id", "_th", "doc_id")] + arrays,
                                         ["_id", "_th", "doc_id", "n_shingles", "digest", "bands", "sketch", "bins", "samples"])


def features_of(docs: DataFrame) -> DataFrame:
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_features, f"_id long, _th long, doc_id long, {SHAPE}")


def nodes_of(features: DataFrame) -> DataFrame:
    """One row per different set: node, digest, least (smallest doc_id), holder of the text, features."""
    same = features.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min_by(F.struct("_id", "_th"), F.struct("_id", "_th")).alias("key"),
        *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch", "bins", "samples")])
    return same.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "key._id", "key._th",
                       "n_shingles", "bands", "sketch", "bins", "samples")


def _bits(a: Column, b: Column, both) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(both(x, y))), F.lit(0), lambda s, v: s + v)


def likely(pairs: DataFrame) -> DataFrame:
    """Adds ``guess`` to pairs carrying both sides' sketches, and drops pairs surely below the threshold."""
    z = _bits(F.col("sketch_a"), F.col("sketch_b"), lambda x, y: x.bitwiseXOR(y))
    union = _bits(F.col("bins_a"), F.col("bins_b"), lambda x, y: x.bitwiseOR(y))
    p = F.least(F.col("z") / BITS, F.lit(0.49))
    d = -BITS / 2 * F.log(1 - 2 * p)
    held = F.col("union") / F.greatest(F.col("union"), (F.col("n_a") + F.col("n_b")) / (1 + NEAR))
    error = F.sqrt(NEAR * (1 - NEAR) / F.col("union") * (1 - held) + F.pow(d * np.sqrt(2 / BITS) / (1 - 2 * p) / F.col("union"), 2))
    guess = (F.col("samples_a") + F.col("samples_b") - d) / 2 / F.col("union")
    return (pairs.withColumn("z", z).withColumn("union", union).withColumn("guess", guess)
            .where(F.col("guess") >= NEAR - SIGMAS * error - 2 / F.col("union")).select("a", "b", "guess"))


def leader_pairs(buckets: DataFrame, nodes: DataFrame, best: int) -> DataFrame:
    """Each node with the ``best`` likeliest of its buckets' leaders: the smallest and the largest node, and the smallest by hash."""
    leaders = (buckets.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.min_by("node", F.xxhash64("node")).alias("z"),
                                          F.count(F.lit(1)).alias("n"))
               .where("n > 1").select("key", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("a")))
    met = buckets.join(leaders, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("bins").alias(f"bins_{c}"),
                                  F.col("samples").alias(f"samples_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    guessed = likely(met.join(side("a"), "a").join(side("b"), "b"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("guess"), "a"))
    return guessed.withColumn("r", rank).where(F.col("r") <= best).select("a", "b")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = k[:, a].tolist()
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _links_of_block(rows: pa.Table) -> set[tuple[int, int]]:
    """Links of open nodes with nodes of other components.

    Odd sketches choose, full sets decide.  A pair is judged in the first of the
    bands its nodes share.  Once an open node is linked with a component, its
    further pairs with that component cannot change anything.
    """
    rows = rows.combine_chunks()
    key = rows["key"][0].as_py()
    opened, comp, n, k, ids = (rows[c].to_numpy() for c in ("open", "comp", "n_shingles", "samples", "node"))
    left, right = np.flatnonzero(opened), np.flatnonzero(~opened)
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
    sketch, held_bins, bands = (flat(c).view(t).reshape(len(n), -1) for c, t in (("sketch", np.uint64), ("bins", np.uint64), ("bands", np.int64)))
    rs, rb, rbands = np.ascontiguousarray(sketch[right].T), np.ascontiguousarray(held_bins[right].T), bands[right]
    rc, rn, rk, rid = comp[right], n[right], k[right], ids[right]
    sets, at = flat("set").view(np.uint64), np.r_[0, np.cumsum(n)]
    links = set()
    for x in left.tolist():
        some = np.flatnonzero((rc != comp[x]) & (np.minimum(n[x], rn) * 100 >= 75 * np.maximum(n[x], rn)))
        if not len(some):
            continue
        z = np.bitwise_count(rs[:, some] ^ sketch[x][:, None]).sum(0, dtype=np.int64)
        # similar texts differ in few samples: far more parities than half of them would give are out of reach
        close = z <= np.minimum(k[x], rk[some]) + 4
        some, z = some[close], z[close]
        union = np.bitwise_count(rb[:, some] | held_bins[x][:, None]).sum(0, dtype=np.int64)
        p = np.minimum(z / BITS, 0.49)
        d = -BITS / 2 * np.log(1 - 2 * p)
        held = union / np.maximum(union, (n[x] + rn[some]) / (1 + NEAR))
        error = np.sqrt(NEAR * (1 - NEAR) / union * (1 - held) + (d * np.sqrt(2 / BITS) / (1 - 2 * p) / union) ** 2)
        guess = (k[x] + rk[some] - d) / 2 / union
        hit = np.flatnonzero(guess >= NEAR - SIGMAS * error - 2 / union)
        hit = hit[np.argsort(-guess[hit], kind="stable")]
        shared = rbands[some[hit]]
        first = (shared == bands[x]).argmax(1) if len(hit) else hit
        here = shared[np.arange(len(hit)), first] == key
        done = set()
        for j in some[hit[here]].tolist():
            if rc[j] not in done:
                y = right[j]
                common = _common(sets[at[x]:at[x + 1]], sets[at[y]:at[y + 1]])
                if 100 * common >= 75 * (n[x] + rn[j] - common):
                    done.add(rc[j])
                    links.add((int(min(ids[x], rid[j])), int(max(ids[x], rid[j]))))
    return links


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, ["key", "i", "j"]):
        links = sorted(_links_of_block(rows))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[at] for x in links], pa.int64()) for at in (0, 1)], ["a", "b"])


def open_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between nodes of one bucket that are not yet in one component.

    Open are a bucket's nodes outside its commonest component.  Open nodes and
    all nodes are dealt into blocks of about ``BLOCK``; every block of one side
    meets every block of the other in a group of its own.  Most buckets hold a
    few nodes, so a task takes its groups in order of their keys, one at a time.
    """
    member = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mains = (sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"),
                                      F.max("n").alias("most")).where(F.col("all") > F.col("most")))
    mixed_ = member.join(mains, "key")
    opens, alls = F.ceil((F.col("all") - F.col("most")) / OPEN_BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = mixed_.where("comp <> main").select("key", "node", "comp", F.lit(True).alias("open"), cell(opens).alias("i"), F.explode(steps(alls)).alias("j"))
    right = mixed_.select("key", "node", "comp", F.lit(False).alias("open"), F.explode(steps(opens)).alias("i"), cell(alls).alias("j"))
    rows = (left.unionByName(right).join(nodes.select("node", "bands", "sketch", "bins", "samples", "n_shingles"), "node").join(sets, "node"))
    return (rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_block_links, "a long, b long").distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(t).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "set"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return both.select("a", "b", common.alias("c"), total.alias("t")).where(100 * F.col("c") >= 75 * (F.col("t") - F.col("c"))).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, plus ``_id``, ``_th`` and ``_comp`` (a number of the group).

    Linked: 100 * common shingles >= 75 * shingles of either.  component_id is
    the smallest doc_id reachable; null and empty texts are linked with nothing
    and keep their own id.  Null ids count as larger than all others.  Repeated
    rows are one text; an empty table gives an empty result; other columns are
    not looked at.
    """
    features = written(features_of(docs), "near-features")
    nodes = written(nodes_of(features), "near-nodes")
    every = nodes.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = written(every.join(shared, "key"), "near-buckets")
    in_buckets = written(buckets.select("node").distinct(), "near-candidates")
    wanted = written(nodes.join(in_buckets, "node").select("node", "_id", "_th"), "near-wanted")
    texts = (docs.withColumns(text_key()).select("_id", "_th", "text")
             .join(bounded_broadcast(wanted, SMALL), ["_id", "_th"]))
    sets = written(texts.select("node", "text").mapInArrow(_sets, "node long, set array<long>").dropDuplicates(["node"]), "near-sets")
    edges = written(confirmed(leader_pairs(buckets, nodes, 3), sets), "near-edges")
    comps = written(components(edges), "near-components")
    more = written(open_links(buckets, nodes, sets, comps), "near-edges")
    if not more.isEmpty():
        comps = written(components(edges.unionByName(more)), "near-components")
    placed = nodes.select("node", "digest", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "comp").select("digest", "component_id", F.col("comp").alias("_comp"), F.lit(True).alias("_named"))
    rows = features.select("doc_id", "n_shingles", "digest", "_id", "_th").join(named, "digest", "left")
    component = F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"), "_id", "_th", "_comp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group, all columns; of rows repeated word for word one stays."""
    judged = written(near_duplicates(docs), "near-judged")
    counted = judged.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"), F.min("_comp").alias("_comp"))
    # several texts under the smallest id (or none) in one component: the first by hash stays
    firsts = written(counted.where("kept and _comp is not null").groupBy("_comp")
                     .agg(F.min("_th").alias("_first"), F.count(F.lit(1)).alias("_texts")).where("_texts > 1").drop("_texts"), "near-firsts")
    counted = (counted.join(bounded_broadcast(firsts, SMALL), "_comp", "left")
               .withColumn("kept", F.col("kept") & F.coalesce(F.col("_th") == F.col("_first"), F.lit(True))))
    dropped = written(counted.where("not kept or n > 1").select("_id", "_th", "n", "kept"), "near-dropped")
    single = without(docs, dropped.select("_id", "_th"), SMALL)
    again, key, _ = matched(docs, bounded_broadcast(dropped.where("kept").select("_id", "_th"), SMALL), "inner")
    return single.unionByName(again.dropDuplicates(key).drop(*key))


def op5_odd_sketch_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("_id", "_th", "_comp")
