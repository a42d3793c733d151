"""Shorter ids: for each source the shortest unique tail of an id's meaningful parts.

All ids of all sources go through the same rounds at once. In round d every open
id proposes its last d parts; a proposal that is alone in its source and not
taken is assigned. A source that assigns nothing in a round is done; what it has
left gets all parts, told apart by numbers in id order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: Folder names that say nothing about a document; fixed values.
SCAFFOLD = ("plugins", "skills", "components", "cli-tool", "src", ".gemini", "claude")
#: Leaf names that say nothing about a document; fixed values.
GENERIC = ("api", "index", "main", "readme", "skill", "template")


def meaningful_parts(parts: Column) -> Column:
    """Without scaffold parts (unless all are), then without generic ones at the end (but the first)."""
    named = F.filter(parts, lambda p: ~p.isin(*SCAFFOLD))
    named = F.when(F.size(named) > 0, named).otherwise(parts)
    # the position of the last part that isn't generic, 1 at least
    last = F.aggregate(F.sequence(F.lit(1), F.size(named)), F.lit(1), lambda a, i: F.when(~F.element_at(named, i).isin(*GENERIC), i).otherwise(a))
    return F.slice(named, 1, last)


def flatten_ids(ids: DataFrame) -> DataFrame:
    """(id, new_id) for a table of unique ids."""
    parts = F.split("id", "__", -1)
    rest = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array("id"))
    rows = ids.select("id", F.element_at(parts, 1).alias("source"), meaningful_parts(rest).alias("m"))
    open_ = materialize(rows, "open-ids")
    used = None
    left = None
    depth = 1
    while not open_.isEmpty():
        size = F.least(F.lit(depth), F.size("m"))
        proposed = open_.withColumn("slug", F.array_join(F.slice("m", -size, size), "__"))
        alone = proposed.groupBy("source", "slug").agg(F.count("*").alias("n")).where("n = 1").select("source", "slug")
        if used is not None:
            alone = alone.join(used.select("source", "slug"), ["source", "slug"], "left_anti")
        now = materialize(proposed.join(alone, ["source", "slug"], "left_semi").select("id", "source", "slug"), "assigned-ids")
        used = now if used is None else used.unionByName(now)
        rest_ = open_.join(now.select("id"), "id", "left_anti")
        # Depth ends at the longest id of the source, and where a round assigns nothing.
        going = open_.groupBy("source").agg(F.max(F.size("m")).alias("longest")).where(F.col("longest") > depth).join(now.select("source").distinct(), "source", "left_semi").select("source")
        stuck = materialize(rest_.join(going, "source", "left_anti"), "stuck-ids")
        left = stuck if left is None else left.unionByName(stuck)
        open_ = materialize(rest_.join(going, "source", "left_semi"), "open-ids")
        depth += 1
    if used is None:
        return ids.select("id", F.col("id").alias("new_id"))
    base = left.select("id", "source", F.array_join("m", "__").alias("base"))
    taken = used.select("source", F.col("slug").alias("base"), F.lit(True).alias("taken")).distinct()
    # Ids that agree in all parts are few; their numbers are a window over just those.
    nth = F.row_number().over(Window.partitionBy("source", "base").orderBy("id"))
    told = base.join(taken, ["source", "base"], "left").withColumn("nth", nth)
    slug = F.when((F.col("nth") == 1) & F.col("taken").isNull(), F.col("base")).otherwise(F.concat_ws("-", "base", F.col("nth").cast("string")))
    both = used.select("id", "source", "slug").unionByName(told.select("id", "source", slug.alias("slug")))
    return both.select("id", F.concat_ws("__", "source", "slug").alias("new_id"))


def rekey(corpus: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus with new ids, (rows, changed)); ids without a mapping stay."""
    new = mapping.select(F.col("id").alias("_old"), F.col("new_id").alias("_new"))
    joined = corpus.join(new, F.col("id") == F.col("_old"), "left").withColumn("_id", F.coalesce("_new", "id"))
    counts = joined.agg(F.count("*").alias("rows"), F.count_if(F.col("_id") != F.col("id")).alias("changed"))
    return joined.withColumn("id", F.col("_id")).drop("_old", "_new", "_id"), counts
