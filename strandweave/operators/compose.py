"""Documents composed from a tree of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import cut


def compose(parts: DataFrame) -> DataFrame:
    """(id, text, topics) of each composite, from parts (id, parent, ord, kind, title, body, topics array, deprecated).

    Children follow their ord. An atom gives its body, a composite a section headed by its title; topics of all
    parts below are united; deprecated atoms are left out. Composites are folded from the lowest level up, one
    aggregation a level. Parts that hang on a cycle are reported by raising ValueError.
    """
    level = cut(parts.where("parent IS NULL"))
    levels, seen = [level], level.count()
    while True:
        level = cut(parts.join(level.select(F.col("id").alias("up")), F.col("parent") == F.col("up")).drop("up"))
        n = level.count()
        if not n:
            break
        seen += n
        levels.append(level)
    if seen != parts.count():
        raise ValueError("some parts aren't below a root: a cycle or a missing parent")
    none = F.array().cast("array<string>")
    out, below = [], None
    for rows in reversed(levels):
        own = rows.where("kind = 'composite'").select("id", "parent", "ord", "title", "topics")
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("up")).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))).alias("kids"), F.array_distinct(F.flatten(F.collect_list("topics"))).alias("more"))
            own = own.join(sums, F.col("id") == F.col("up"), "left")
        else:
            own = own.withColumn("kids", F.array().cast("array<struct<ord:int,id:string,text:string>>")).withColumn("more", none)
        body = F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<struct<ord:int,id:string,text:string>>")), lambda k: k["text"]), "\n\n")
        topics = F.array_sort(F.array_union(F.coalesce("topics", none), F.coalesce("more", none)))
        made = own.select("id", "parent", F.col("ord").cast("int").alias("ord"), F.concat(F.lit("## "), F.coalesce("title", "id"), F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise("")).alias("text"), topics.alias("topics"))
        atoms = rows.where("kind = 'atom' AND NOT coalesce(deprecated, false)")
        atoms = atoms.select("id", "parent", F.col("ord").cast("int").alias("ord"), F.coalesce("body", F.lit("")).alias("text"), F.coalesce("topics", none).alias("topics"))
        made = cut(made)
        out.append(made)
        below = made.unionByName(atoms)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.select("id", "text", "topics")
