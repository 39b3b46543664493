"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots by their id.  The bytes of
each slot are aggregated; a versioned map slot -> shard (never more than
``SLOTS`` rows) says where a slot lives.  Version 1 deals the slots out in turn;
rebalancing edits the map so that the shards' bytes come out nearly equal, and
writes the next version.  Records follow their slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from terrahaz.llm.common import documents, hash_cell, numbered, written
from terrahaz.session import shared_folder
from terrahaz.sources.versions import VersionedTable

SLOTS = 4096
MAP_SCHEMA = T.StructType([T.StructField(c, T.IntegerType()) for c in ("version", "virtual_slot", "shard")])


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Id, size in bytes plus 1, CRC of the text (null: that of the empty text) and the virtual slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
            .withColumn("virtual_slot", hash_cell(slots, F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")),
                                                  F.when(F.col("doc_id").isNull(), F.col("text_crc32")))))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    return spark.range(slots, numPartitions=1).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with shards' bytes nearly equal.

    Edits are few: every shard gives up its smallest slots until it is at or
    below the mean, and the slots given up go, largest first, to the least
    filled shard.  Empty slots stay.  The map and the sizes have one row per
    slot, a number fixed when the map was made; they are edited on the driver.
    """
    rows = slot_map.join(sizes, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")).collect()
    rows.sort(key=lambda r: r["virtual_slot"])
    version = max((r["version"] for r in rows), default=0) + 1
    load, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for r in rows:
        if r["shard"] < shards:
            load[r["shard"]] += r["bytes"]
            held[r["shard"]].append((r["bytes"], r["virtual_slot"]))
        else:
            homeless.append((r["bytes"], r["virtual_slot"]))
    mean = sum(r["bytes"] for r in rows) / shards
    for s in range(shards):
        held[s].sort()
        kept = []
        for size, slot in held[s]:
            if size and load[s] > mean:
                homeless.append((size, slot))
                load[s] -= size
            else:
                kept.append((size, slot))
        held[s] = kept
    for size, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += size
        held[s].append((size, slot))
    edited = [(version, slot, s) for s in range(shards) for _, slot in held[s]]
    return slot_map.sparkSession.createDataFrame(edited, MAP_SCHEMA)


def map_table(spark, path: str) -> VersionedTable:
    """All versions of a slot map, kept where the caller says, one folder each."""
    return VersionedTable(spark, path, MAP_SCHEMA, ["version"])


def edited_map(table: VersionedTable, sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map in force after rebalancing: the newest stored version, edited and stored as the next.

    A table without versions begins with the slots dealt out in turn.  Where no
    slot has to move, nothing is stored.
    """
    if not table.version():
        table.add(first_map(table.spark, shards, slots))
    newest = max(h[0] for h in table.held())
    current = table.read(F.col("version") == newest)
    edited = rebalanced(current, sizes, shards)
    moved = current.join(edited.select("virtual_slot", F.col("shard").alias("now")), "virtual_slot").where("shard <> now")
    if moved.isEmpty():
        return current
    table.add(edited)
    return table.read(F.col("version") == newest + 1)


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard and place of every row.

    Law ``bytes``: sizes per shard nearly equal.  Returns doc_id, size,
    text_crc32, law, shard, slot (place in the shard, gapless from 0 by virtual
    slot, then doc_id, CRC and size), grown_shard (null under this law),
    virtual_slot and map_version.  Null texts have size 1; rows with a null id
    hash by their text; repeated rows share a slot and get places of their own;
    long texts are only measured; an empty table gives an empty result; other
    columns are not looked at.  ``map_path`` names the stored map: a later run
    loads its newest version and moves only the slots it has to.  Without it a
    map of the run's own is kept in the shared folder.
    """
    spark = docs.sparkSession
    records = written(slotted(docs, slots), "sharding-records")
    table = map_table(spark, map_path or shared_folder(spark, "slot-map"))
    latest = edited_map(table, slot_bytes(records), shards, slots).withColumnRenamed("version", "map_version")
    placed = records.join(F.broadcast(latest), "virtual_slot")  # SLOTS rows
    out = numbered(placed, ["shard"], "virtual_slot", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_slot_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
