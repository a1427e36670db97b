"""File trees from lists of paths: totals of every folder, and depth-first listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that a tree leaves out.
IGNORED = (".git", "__pycache__", "venv", "env", ".tox", "node_modules", ".mypy_cache", ".pytest_cache")
#: Units of sizes.
UNITS = ("B", "KB", "MB", "GB")
#: Depths that a tree may be shown to.
DEPTHS = range(1, 11)


def size_label(n: Column) -> Column:
    """512.0B, 1.5KB, ... as a tree shows a size; a tie between two tenths goes to the even one, as C and Python have it."""

    def tenths(unit: int, mark: str) -> Column:
        whole, rest = F.shiftright(n, unit.bit_length() - 1), F.pmod(n, F.lit(unit)) * 10
        low, over = F.shiftright(rest, unit.bit_length() - 1), F.pmod(rest, F.lit(unit)) * 2
        up = low + F.when((over > unit) | ((over == unit) & (low % 2 == 1)), 1).otherwise(0)
        return F.concat((whole + F.when(up == 10, 1).otherwise(0)).cast("string"), F.lit("."), (up % 10).cast("string"), F.lit(mark))

    label = tenths(1024**4, "TB")
    for k in reversed(range(len(UNITS))):
        label = F.when(n < 1024 ** (k + 1), tenths(1024**k, UNITS[k])).otherwise(label)
    return label


def age_label(at: Column, now: Column) -> Column:
    """Minutes, hours or days ago; from a week on the day."""
    s = F.unix_seconds(now) - F.unix_seconds(at)
    ago = lambda unit, mark: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{mark} ago"))
    return F.when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).when(s < 604800, ago(86400, "d")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def age_class(at: Column, now: Column) -> Column:
    s = F.unix_seconds(now) - F.unix_seconds(at)
    return F.when(s < 3600, "hour").when(s < 86400, "day").otherwise("older")


def file_tree(files: DataFrame, now: Column, max_depth: int = 3, show_hidden: bool = False, ignored: tuple[str, ...] = IGNORED, pattern: str | None = None) -> DataFrame:
    """path, name, depth, is_dir, n_files, n_dirs, bytes, size, age, changed, more, last, branch, sort_key, in depth-first order.

    ``files``: path (parts split by /; empty parts don't count), size, ts. One row a shown file or folder;
    folders come first, then names whatever their case. n_files, n_dirs and bytes are totals of all that is
    below a folder, however deep. ``more``: a folder at ``max_depth``, whose entries aren't shown. ``last``:
    the last entry of its folder; ``branch`` draws the line. Files of one path count once, with their sizes
    added and their latest time; a name may be both a file and a folder. Hidden names, and what is below
    them, need ``show_hidden``; folders named in ``ignored`` are left out with all below. Null paths and
    null sizes: no file, no bytes. ``pattern``: only entries whose name contains it, without regard to *.

    A folder's totals are a sum over its prefixes' rows, taken before the shuffle; whether an entry is the
    last of its folder is a maximum. So a folder that holds a third of all files is in no single task.
    """
    if max_depth not in DEPTHS:
        raise ValueError("max_depth must be between 1 and 10")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = files.select(parts.alias("p"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), "ts").where("size(p) > 0")
    folders = F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))
    if not show_hidden:
        rows = rows.where(~F.exists("p", lambda x: x.startswith(".")))
    rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))) if ignored else F.lit(True))
    one = rows.groupBy("p").agg(F.sum("size").alias("bytes"), F.max("ts").alias("ts"))
    ups = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.slice("p", 1, k))
    above = one.where("size(p) > 1").select(F.explode(ups).alias("p"), "bytes", F.col("p").alias("below"))
    totals = above.groupBy("p").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
    inner = totals.where("size(p) > 1").select(F.explode(ups).alias("p")).groupBy("p").agg(F.count("*").alias("n_dirs"))
    dirs = totals.join(inner, "p", "left").select("p", F.lit(True).alias("is_dir"), "n_files", F.coalesce("n_dirs", F.lit(0)).alias("n_dirs"), "bytes", F.lit(None).cast("timestamp").alias("ts"))
    leaves = one.select("p", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_dirs"), "bytes", F.col("ts").cast("timestamp").alias("ts"))

    # Folders sort before files, and a folder before what is in it: an array that is the start of another comes first.
    def mark(x: Column, folder: Column | bool) -> Column:
        return F.concat(F.when(F.lit(folder) if isinstance(folder, bool) else folder, "0").otherwise("1"), F.lower(x), F.lit("\u0001"), x)

    shown = dirs.unionByName(leaves).where(F.size("p") <= max_depth + 1)
    n, name = F.size("p"), F.try_element_at("p", F.lit(-1))  # a filter on what follows may come before that on empty paths
    parent = F.slice("p", F.lit(1), F.greatest(n - 1, F.lit(0)))
    key = F.concat(F.transform(parent, lambda x: mark(x, True)), F.array(mark(name, F.col("is_dir"))))
    shown = shown.withColumns({"sort_key": key, "parent": parent})
    ends = shown.groupBy("parent").agg(F.max("sort_key").alias("end"))
    # Each entry asks for the last entries of the folders on its way: at most max_depth + 1 rows an entry.
    levels = F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("level"), F.slice("p", 1, k - 1).alias("parent"), F.slice("sort_key", 1, k).alias("own"))))
    asked = shown.select("sort_key", levels.alias("l")).select("sort_key", "l.*").join(ends, "parent")
    drawn = asked.groupBy("sort_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", (F.col("own") == F.col("end")).alias("last")))), lambda x: x["last"]).alias("lasts"))
    line = F.concat(
        F.array_join(F.transform(F.slice("lasts", 1, F.size("lasts") - 1), lambda x: F.when(x, "    ").otherwise("│   ")), ""),
        F.when(F.element_at("lasts", -1), "└── ").otherwise("├── "),
    )
    out = shown.join(drawn, "sort_key")
    if pattern:
        out = out.where(F.contains(name, F.lit(pattern)))
    return out.select(
        F.array_join("p", "/").alias("path"), name.alias("name"), (n - 1).alias("depth"), "is_dir", "n_files", "n_dirs", "bytes", size_label(F.col("bytes")).alias("size"),
        F.when(~F.col("is_dir"), age_label(F.col("ts"), now)).alias("age"), F.when(~F.col("is_dir"), age_class(F.col("ts"), now)).alias("changed"),
        (F.col("is_dir") & (n == max_depth + 1)).alias("more"), F.element_at("lasts", -1).alias("last"), line.alias("branch"), F.array_join("sort_key", "/").alias("sort_key"),
    ).orderBy("sort_key")
