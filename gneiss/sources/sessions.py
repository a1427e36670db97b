"""Session stores: a JSON file a session, delta files with what was added since, and an index kept by file time.

A part is a file: the session's own (``part`` empty) or one of its deltas, in the order of their names. Items are its messages or transcript entries as JSON texts, from place ``offset`` of the session on; where places are held already, the earlier parts count. Broken files are left out; a session whose own file is broken or missing is left out whole. Of files in several folders that name one part of one session, the least path counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as T

#: Fixed value: the folder of deltas, a folder a session.
DELTAS = "deltas"
#: Fixed value: characters of a message that the index shows.
HEAD = 100
BODY = "session_id string, created_at double, updated_at double, workspace string, messages array<string>, transcript_entries array<string>, history array<string>, msg_offset long, transcript_offset long, transcripts array<string>"
FILE = ["path", "modified", "size"]


def _file(m: str = "_metadata") -> list[Column]:
    return [T.percent_decode(F.col(f"{m}.file_path")).alias("path"), F.col(f"{m}.file_modification_time").alias("modified"), F.col(f"{m}.file_size").alias("size")]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path, time and size of the files of a store; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder).select(*_file())


def read_files(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The files of a store with ``raw``, their text; with ``since``, only those modified after that time."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.json"} | ({"modifiedAfter": since} if since else {})
    return spark.read.options(**options).text(folder, wholetext=True).select(*_file(), F.col("value").alias("raw"))


def parts(files: DataFrame) -> DataFrame:
    """Rows (``path``, ``raw``) as parts. Other columns named as those of the result are replaced; null and empty texts are broken."""
    p = F.col("path")
    delta = rf"(?:^|/){DELTAS}/([^/]+)/([^/]+)\.json$"
    is_delta = F.coalesce(p.rlike(delta), F.lit(False))
    rows = files.withColumn("session", F.when(is_delta, F.regexp_extract(p, delta, 1)).otherwise(F.regexp_extract(p, r"([^/]+)\.json$", 1)))
    rows = rows.withColumn("part", F.when(is_delta, F.regexp_extract(p, delta, 2)).otherwise(""))
    rows = rows.withColumn("body", F.from_json("raw", F.lit(BODY)))
    whole = (F.col("part") != "") | (F.col("body.session_id").isNotNull() & F.col("body.created_at").isNotNull() & F.col("body.updated_at").isNotNull() & F.col("body.workspace").isNotNull())
    return rows.withColumn("valid", F.coalesce(F.startswith(F.ltrim("raw"), F.lit("{")) & F.try_parse_json("raw").isNotNull() & whole, F.lit(False))).drop("raw")


def merged(parts: DataFrame, items: Column, offset: Column) -> DataFrame:
    """(session, place, item): the items of each valid session in order. Only three values a part are brought together a session; the items of a long one stay in many tasks."""
    rows = parts.where("valid").select("path", "session", "part", F.coalesce(items, F.array()).alias("items"), offset.alias("at"))
    rows = rows.withColumn("n", F.size("items").cast("long"))
    named = rows.groupBy("session", "part").agg(F.min_by(F.struct("path", "at", "n"), "path").alias("f")).select("session", "part", "f.*")
    sizes = named.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("part", "path", "at", "n"))).alias("s")).where(F.col("s")[0]["part"] == "")
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<path:string,start:bigint,kept:bigint>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        held, at = acc["held"], F.coalesce(x["at"], acc["held"])
        after = F.when(at >= held, held + x["n"]).otherwise(F.greatest(held, at + x["n"]))
        return F.struct(after.alias("held"), F.concat(acc["done"], F.array(F.struct(x["path"].alias("path"), held.alias("start"), (after - held).alias("kept")))).alias("done"))

    kept = sizes.select("session", F.inline(F.aggregate("s", start, step)["done"])).where("kept > 0")
    found = rows.join(kept, ["session", "path"])
    return found.select("session", "start", F.posexplode(F.expr("slice(items, int(n - kept + 1), int(kept))")).alias("i", "item")).select("session", (F.col("start") + F.col("i")).alias("place"), "item")


def messages(parts: DataFrame) -> DataFrame:
    """(session, place, role, content): a message without a role or content has null there; content that is no string is its JSON text."""
    m = merged(parts, F.col("body.messages"), F.col("body.msg_offset"))
    return m.select("session", "place", F.get_json_object("item", "$.role").alias("role"), F.get_json_object("item", "$.content").alias("content"))


def transcripts(parts: DataFrame) -> DataFrame:
    """(session, place, entry): transcript entries as JSON texts."""
    items = F.when(F.col("part") == "", F.col("body.transcript_entries")).otherwise(F.col("body.transcripts"))
    return merged(parts, items, F.col("body.transcript_offset")).withColumnRenamed("item", "entry")


def history(parts: DataFrame) -> DataFrame:
    """(session, place, line): the input lines that a session's own file holds."""
    return parts.where("valid AND part = ''").select("session", F.posexplode("body.history").alias("place", "line"))


def heads(parts: DataFrame) -> DataFrame:
    """What the index needs of each part: its base fields, offset and messages by role and first characters."""
    short = F.transform("body.messages", lambda x: F.to_json(F.struct(F.get_json_object(x, "$.role").alias("role"), F.left(F.get_json_object(x, "$.content"), F.lit(HEAD)).alias("content"))))
    body = F.struct("body.created_at", "body.updated_at", "body.workspace", "body.msg_offset", short.alias("messages"))
    return parts.select(*FILE, "session", "part", "valid", body.alias("body"))


def index(parts: DataFrame) -> DataFrame:
    """A row a session: its base fields, the number of messages, the first of a user and the last of a user or the assistant (empty if there is none), cut to ``HEAD`` characters. Partly aggregated before the shuffle, so a long session is in many tasks."""
    base = parts.where("valid AND part = ''").select("session", F.col("body.created_at").alias("created_at"), F.col("body.updated_at").alias("updated_at"), F.col("body.workspace").alias("workspace"), "path")
    base = base.groupBy("session").agg(*[F.min_by(c, "path").alias(c) for c in ("created_at", "updated_at", "workspace")])
    said = F.coalesce(F.left("content", F.lit(HEAD)), F.lit(""))
    user, either = F.col("role") == "user", F.col("role").isin("user", "assistant")
    told = messages(parts).groupBy("session").agg(F.count("*").alias("message_count"), F.min_by(said, F.when(user, F.col("place"))).alias("first_message"), F.max_by(said, F.when(either, F.col("place"))).alias("last_message"))
    rows = base.join(told, "session", "left")
    return rows.select("session", "created_at", "updated_at", "workspace", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("message_count", 0), ("first_message", ""), ("last_message", ""))])


def refresh_index(spark: SparkSession, folder: str, to: str, previous: str | None = None) -> DataFrame:
    """Writes the heads of a store's files to the new folder ``to`` and returns the index of its sessions.

    With ``previous``, an earlier ``to``, only files that are new or whose time or size changed are read; what was taken from deleted ones is dropped. Column ``read`` of the written heads says in which call a file was read. The oldest changed file's time bounds what is opened, so that a file copied with an older time is still found.
    """
    now = listing(spark, folder)
    if previous is None:
        heads(parts(read_files(spark, folder))).withColumn("read", F.lit(1)).write.parquet(to)
    else:
        old = spark.read.parquet(previous)
        run = 1 + (old.agg(F.max("read")).first()[0] or 0)
        changed = now.join(old, FILE, "left_anti")
        since = changed.agg(F.date_format(F.min("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
        kept = old.join(now, FILE, "left_semi")
        if since is not None:
            fresh = read_files(spark, folder, since).join(changed, FILE, "left_semi")
            kept = kept.unionByName(heads(parts(fresh)).withColumn("read", F.lit(run)))
        kept.write.parquet(to)
    return index(spark.read.parquet(to))


def expired(index: DataFrame, most: int) -> DataFrame:
    """The sessions beyond the ``most`` that were updated last; of equal times the smaller names stay."""
    stay = index.orderBy(F.desc("updated_at"), "session").limit(most)
    return index.join(stay.select("session"), "session", "left_anti")
