"""Sharding by fixed virtual slots.

1. A record's id, size and checksum are hashed into one of SLOTS virtual slots; the number of slots never
   changes. Repeats of one record that outgrow a slot are spread over all slots by a number.
2. Bytes and rows are aggregated by slot: a table of SLOTS rows, however many records there are.
3. A map gives each slot a shard. Its versions are stored; ``rebalanced`` edits the latest one, moving
   only what the heavy shards have too much of, and ``grown`` moves slots into new shards only.

Everything is DataFrame and SQL functions; only the map's tables, of SLOTS rows, are ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.session import cut, shared_folder

SLOTS = 4096
#: Bytes that a record takes beside its text.
OVERHEAD = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, crc, nth (a number that tells repeated rows apart) of every row; texts go no further."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("nth"))


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` of records() with their virtual slot, a function of id, size and checksum.

    Rows that are the same in all three and more than 1/slots of the table are spread by ``nth``. There are
    fewer than ``slots`` such records, so that the table of them may be broadcast.
    """
    most = rows.count() // slots + 1
    repeated = rows.groupBy("id", "size", "crc").count().where(F.col("count") > most).select(*(F.col(c).alias(f"_{c}") for c in ("id", "size", "crc")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("crc") == F.col("_crc"))
    spread = F.when(F.col("_size").isNotNull(), F.col("nth")).otherwise(F.lit(-1))
    return rows.join(F.broadcast(repeated), same, "left").withColumn("vslot", F.pmod(F.xxhash64("id", "size", "crc", spread), F.lit(slots)).cast("int")).drop("_id", "_size", "_crc")


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, rows: one row for every slot, empty ones too."""
    held = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").na.fill(0, ["bytes", "rows"])


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """version, vslot, shard, bytes, rows: slots dealt in turn, before anything is known of their bytes."""
    return totals.select(F.lit(1).alias("version"), "vslot", F.pmod("vslot", F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def _placed(kept: DataFrame, moving: DataFrame, shards: int, only_from: int = 0) -> DataFrame:
    """``kept`` and ``moving`` (vslot, bytes, rows), whose slots go, the largest first, to the shard from ``only_from`` on that has least."""
    spark = kept.sparkSession
    loads = spark.range(only_from, shards).select(F.col("id").cast("int").alias("shard")).join(kept.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left")
    loads = loads.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).cast("long").alias("load")))), lambda x: x["load"]).alias("loads"))
    pool = moving.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "rows"))).alias("pool"))

    def place(acc, x):
        def at_lightest(at):
            return F.struct(
                F.transform(acc["loads"], lambda load, i: F.when(i + 1 == at, load - x["minus"]).otherwise(load)).alias("loads"),
                F.concat(acc["shards"], F.array((at - 1 + only_from).cast("int"))).alias("shards"),
            )

        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"]))  # from 1; of equals the first
        return F.transform(F.array(lightest), at_lightest)[0]  # evaluated once, not for every load

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards"))
    done = loads.crossJoin(pool).select("pool", F.aggregate("pool", start, place, lambda acc: acc["shards"]).alias("shards"))  # one row with one row
    moved = done.select(F.inline(F.arrays_zip("pool", "shards"))).select("pool.vslot", F.col("shards").alias("shard"), (-F.col("pool.minus")).alias("bytes"), "pool.rows")
    return kept.select("vslot", "shard", "bytes", "rows").unionByName(moved)


def rebalanced(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards of nearly equal bytes.

    Each shard keeps its largest slots up to its equal part; the others, the small ones, and the slots of
    shards that there are no longer, go to the lightest shards. The difference that remains is about one
    of the smallest slots, unless a single record is larger than a shard's equal part.
    """
    equal = current.agg((F.sum("bytes") / shards).alias("equal"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    judged = current.crossJoin(equal).withColumn("stays", (F.sum("bytes").over(order) <= F.col("equal")) & (F.col("shard") < shards))
    return _placed(judged.where("stays"), judged.where("NOT stays"), shards).crossJoin(current.agg((F.max("version") + 1).alias("version"))).select(*current.columns)


def grown(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with more shards: slots move into the new shards alone, from each old one as much as it is above the new equal part."""
    had = current.agg(F.max("shard") + 1).first()[0]
    if shards <= had:
        raise ValueError(f"{shards} shards are not more than {had}")
    equal = current.agg((F.sum("bytes") / shards).alias("equal"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    judged = current.crossJoin(equal).withColumn("stays", F.sum("bytes").over(order) <= F.col("equal"))
    return _placed(judged.where("stays"), judged.where("NOT stays"), shards, had).crossJoin(current.agg((F.max("version") + 1).alias("version"))).select(*current.columns)


def store_map(version: DataFrame, folder: str) -> None:
    """Writes one version of a map beside the earlier ones; a version is never overwritten."""
    version = cut(version)
    number = version.first()["version"]
    version.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={number}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of a map; the latest, if none is named."""
    every = spark.read.parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("version", "vslot", "shard", "bytes", "rows")


def assigned(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", *, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot (the row's place in its shard, from 0), grown_shard, virtual_slot, map_version of every row.

    The law is ``bytes``: sizes of shards are nearly equal, because the second version of the map, which is
    the one that holds, is the first edited by the bytes of slots; grown_shard is therefore null. Equal
    texts of different ids are different records. Null and empty texts are of size OVERHEAD; null ids are
    hashed like any other. Repeated rows stay repeated. Other columns, whatever their names, are left out.
    An empty table gives no rows. Both versions are stored in ``folder`` (the shared one by default).
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "slot-map")
    rows = cut(slotted(cut(records(docs, id_col, text_col)), slots))
    first = first_map(slot_totals(rows, slots), shards)
    store_map(first, folder)
    store_map(rebalanced(load_map(spark, folder, 1), shards), folder)
    current = load_map(spark, folder)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = current.select("vslot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("vslot").orderBy("id", "size", "crc", "nth")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(places), "vslot").select(  # as many rows as slots
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"),
    )


def write_shards(docs: DataFrame, current: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, slots: int = SLOTS) -> None:
    """Writes the rows of ``docs``, with all their columns, into a folder a shard (``shard=N``) by a map.

    Rows are shuffled once, by slot; a slot's rows stand in one file. Columns of ``docs`` must have
    different names, other than ``shard``.
    """
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    wide = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("nth"))
    rows = slotted(wide, slots).join(F.broadcast(current.select("vslot", "shard")), "vslot")
    rows.repartition("vslot").select("row.*", "shard").write.mode("errorifexists").partitionBy("shard").parquet(folder)
