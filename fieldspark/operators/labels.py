"""Numbers and names: subplot labels, plant ids, unique layer names, display names of rasters, path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import written

BY = ["field_id"]


def subplot_labels(cells: DataFrame, how: str = "rowcol", start_row: int = 1, start_col: int = 1, prefix: str = "", suffix: str = "", by: list[str] | None = None) -> DataFrame:
    """Adds label: R1C1 ("rowcol"), 1, 2, 3 ("sequential") or back and forth along rows ("serpentine"), between prefix and suffix."""
    by = by or BY
    if how == "rowcol":
        name: Column = F.concat(F.lit("R"), (F.col("row") + start_row).cast("string"), F.lit("C"), (F.col("col") + start_col).cast("string"))
    elif how in ("sequential", "serpentine"):
        col = F.when(F.col("row") % 2 == 1, -F.col("col")).otherwise(F.col("col")) if how == "serpentine" else F.col("col")
        name = F.row_number().over(W.partitionBy(*by).orderBy("row", col)).cast("string")
    else:
        raise ValueError(f"how may not be {how}")
    return cells.withColumn("label", F.concat(F.lit(prefix), name, F.lit(suffix)))


def plant_ids(ordered: DataFrame, how: str = "ridge", start: int = 1, ascending: bool = True, pattern: str = "R{ridge}-{plant}", by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Adds plant_id to plants on a ridge (by.., fid, ridge_id, along): "ridge" 3-7, "numeric" over the key, or "custom" by pattern.

    Plants are counted along their ridge from start, ties by fid. Others get null. With digits, places along are compared as rounded to so
    many: the last bits of a projection follow the order in which its origin is added up, and would decide between plants side by side.
    """
    by = by or BY
    place = F.col("along") if digits is None else F.round("along", digits)
    along = place if ascending else -place
    on = F.col("ridge_id") >= 0
    plant = F.row_number().over(W.partitionBy(*by, "ridge_id").orderBy(along, "fid")) + (start - 1)
    ridge = (F.col("ridge_id") + start).cast("string")
    if how == "ridge":
        name: Column = F.concat(ridge, F.lit("-"), plant.cast("string"))
    elif how == "custom":
        name = F.replace(F.replace(F.lit(pattern), F.lit("{ridge}"), ridge), F.lit("{plant}"), plant.cast("string"))
    elif how == "numeric":
        # Counts of ridges are added up over the ridges, so a key's plants are numbered ridge by ridge.
        before = ordered.where(on).groupBy(*by, "ridge_id").agg(F.count("*").alias("_n"))
        before = before.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("ridge_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        rows = ordered.join(before, [*by, "ridge_id"], "left")
        return rows.withColumn("plant_id", F.when(on, (plant + F.col("_before")).cast("string"))).drop("_before").select(*ordered.columns, "plant_id")
    else:
        raise ValueError(f"how may not be {how}")
    return ordered.withColumn("plant_id", F.when(on, name))


def unique_names(names: DataFrame, taken: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, name, unique_name): name, or the first of name_1, name_2.. that is neither taken nor given to a smaller id.

    The open rows of a name take its free numbers in order of id, at once for all names. Where two names come to the same result
    (a and a_1 both may give a_1) the smaller id has it, and the other is open for another round.
    """
    wish = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("k").cast("string")))
    open_ = names.select("id", "name")
    used = taken.select(F.col("name").alias("unique_name")).distinct()
    done: DataFrame | None = None
    for _ in range(max_rounds):
        near = used.select(F.explode(F.array_distinct(F.array("unique_name", F.regexp_replace("unique_name", "_[0-9]+$", "")))).alias("name")).groupBy("name").agg(F.count("*").alias("t"))
        many = open_.groupBy("name").agg(F.count("*").alias("n")).join(near, "name", "left")
        free = many.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.coalesce("t", F.lit(0)))).alias("k")).withColumn("unique_name", wish)
        free = free.join(used, "unique_name", "left_anti").withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy("k")))
        asked = open_.withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy("id"))).join(free, ["name", "nth"])
        first = asked.groupBy("unique_name").agg(F.min(F.struct("id", "name")).alias("r"))
        first = written(first.select("r.id", "r.name", "unique_name"), "named")
        done = first if done is None else done.unionByName(first)
        used = written(used.unionByName(first.select("unique_name")), "used-names")
        open_ = written(open_.join(first.select("id"), "id", "left_anti"), "open-names")
        if open_.isEmpty():
            return done
    raise RuntimeError(f"names are still open after {max_rounds} rounds")


def merge_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, nth): old paths, then new ones that are not among them, each once, in order of their nth."""
    rows = old.select("path", F.lit(0).alias("_from"), "nth").unionByName(new.select("path", F.lit(1).alias("_from"), "nth"))
    first = rows.groupBy("path").agg(F.min(F.struct("_from", "nth")).alias("at"))
    return first.select("path", F.col("at._from").alias("source"), F.col("at.nth").alias("nth"))


def compare_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, side) of each distinct name: "old" or "new" if only one table has it, else "both"."""
    rows = old.select("name", F.lit(1).alias("_s")).unionByName(new.select("name", F.lit(2).alias("_s")))
    sides = rows.groupBy("name").agg(F.sum_distinct("_s").alias("_s"))
    return sides.select("name", F.when(F.col("_s") == 1, "old").when(F.col("_s") == 2, "new").otherwise("both").alias("side"))


def active_raster(layers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., raster_id) of the last visible layer."""
    return layers.where("visible").groupBy(*(by or BY)).agg(F.max_by("raster_id", F.struct("layer_order", "raster_id")).alias("raster_id"))


def catalog_names(paths: DataFrame) -> DataFrame:
    """(path, name) of distinct paths: the file's stem, or stem (.../dir/...) with the first part after what same-stem parents have in common."""
    rows = paths.select("path").where("path is not null").distinct()
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = rows.withColumn("parts", parts).where(F.size("parts") > 0)
    stem = F.regexp_replace(F.element_at("parts", -1), r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumns({"stem": stem, "dirs": F.slice("parts", F.lit(1), F.size("parts") - 1)})
    count = rows.groupBy("stem").agg(F.count("*").alias("same"), F.min(F.size("dirs")).alias("shallow"))
    steps = rows.select("stem", F.posexplode("dirs").alias("at", "dir"))
    differs = steps.groupBy("stem", "at").agg(F.countDistinct("dir").alias("kinds"))
    common = differs.where("kinds > 1").groupBy("stem").agg(F.min("at").alias("differ"))
    rows = rows.join(count, "stem").join(common, "stem", "left")
    at = F.least(F.coalesce("differ", "shallow"), F.col("shallow"))
    part = F.coalesce(F.get("dirs", at), F.element_at("dirs", -1), F.lit(""))
    return rows.select("path", F.when(F.col("same") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" (.../"), part, F.lit("/...)"))).alias("name"))
