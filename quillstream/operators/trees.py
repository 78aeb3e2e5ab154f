"""Trees and nested values of any depth, walked by recursive queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.stores import scratch

#: Spark stops a recursive query after a million rows and a hundred rounds if not told otherwise.
_LIMITS = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _LIMITS}
    for k, v in _LIMITS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def recursive(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The result of a recursive query over ``tables``, written: its rounds run once, whatever reads it, and without the
    session's limits of rows and rounds."""
    path = scratch(spark, "walk")
    with _unlimited(spark):
        found = spark.sql(sql, **tables)
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def walk(nodes: DataFrame) -> DataFrame:
    """(tree, node, name, depth, path) of adjacency rows (tree, node, parent, place, name), any number of trees at once.

    Roots have no parent and depth 0. Rows sorted by ``path`` are in depth-first order, children by ``place`` and then by
    node. A node that is its own ancestor is not entered again, and nodes that no root leads to are left out. The rows of
    a round are joined by tree and parent, so a round is one shuffle join of what the round before found.
    """
    return recursive(
        nodes.sparkSession,
        """
        with recursive found (tree, node, name, depth, path, above) as (
          select tree, node, name, 0, array(struct(cast(place as bigint) as place, cast(node as string) as node)), array(cast(node as string))
          from {nodes} where parent is null
          union all
          select n.tree, n.node, n.name, f.depth + 1, array_append(f.path, struct(cast(n.place as bigint) as place, cast(n.node as string) as node)), array_append(f.above, cast(n.node as string))
          from found f join {nodes} n on n.tree = f.tree and n.parent = f.node
          where not array_contains(f.above, cast(n.node as string)))
        select tree, node, name, depth, path from found""",
        nodes=nodes,
    )


def mermaid(nodes: DataFrame) -> DataFrame:
    """(tree, mermaid): each tree as the text of a Mermaid mind map, a line for each node, two blanks for each level."""
    line = F.when(F.col("depth") == 0, F.concat(F.lit("  root(("), "name", F.lit("))"))).otherwise(F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), "name"))
    lines = walk(nodes).groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    return lines.select("tree", F.concat(F.lit("mindmap\n"), F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("mermaid"))


def values(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """``keys`` with ``v``, a variant: every value inside the JSON text in ``json``, the whole one included. Text that is no
    JSON holds none. All in the JVM; the schema of the texts is not known and each may have its own."""
    named = ", ".join(f"`{k}`" for k in keys)
    whole = rows.select(*keys, F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    found = recursive(
        rows.sparkSession,
        f"""
        with recursive held ({named}, v) as (
          select {named}, v from {{whole}}
          union all
          select {", ".join(f"h.`{k}`" for k in keys)}, e.value from held h, lateral variant_explode(h.v) as e)
        select {named}, v from held""",
        whole=whole,
    )
    return found


def text_of(v: Column) -> Column:
    """The string in a variant, null if it is of another type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_words(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """``keys`` with ``words``: the words in all strings of JSON of any shape and depth; names of fields and numbers don't
    count. Rows whose text is no JSON, or null, have 0."""
    counts = values(rows, keys, json).groupBy(*keys).agg(F.sum(fn.word_count(text_of(F.col("v")))).alias("words"))
    return rows.select(*keys).join(counts, keys, "left").select(*keys, F.coalesce("words", F.lit(0)).cast("bigint").alias("words"))
