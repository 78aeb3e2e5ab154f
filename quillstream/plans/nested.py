"""Queries over trees and nested values of any depth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import trees
from ..sources.tables import table
from .base import query

_NODES = """nodes as (
  select r_regionkey as tree, 'r' || r_regionkey as node, cast(null as varchar) as parent, 0 as place, r_name as name from region
  union all select n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name from nation
  union all select distinct n_regionkey, 'm' || n_nationkey || c_mktsegment, 'n' || n_nationkey, length(c_mktsegment), c_mktsegment from customer join nation on c_nationkey = n_nationkey
  union all select n_regionkey, 'c' || c_custkey, 'm' || n_nationkey || c_mktsegment, c_custkey, c_name from customer join nation on c_nationkey = n_nationkey)"""
_WALK = """, walk(tree, node, name, depth, path, above) as (
  select tree, node, name, 0, [{'place': cast(place as bigint), 'node': node}], [node] from nodes where parent is null
  union all
  select n.tree, n.node, n.name, w.depth + 1, list_append(w.path, {'place': cast(n.place as bigint), 'node': n.node}), list_append(w.above, n.node)
  from walk w join nodes n on n.tree = w.tree and n.parent = w.node where not list_contains(w.above, n.node))"""


def _nodes(spark, d):
    """Regions, nations, market segments and customers: trees of four levels."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    s = lambda *xs: F.concat(*[x if not isinstance(x, str) or "_" in x else F.lit(x) for x in xs])
    of = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    row = lambda df, tree, node, parent, place, name: df.select(
        F.col(tree).alias("tree"), node.alias("node"), parent.alias("parent"), place.cast("bigint").alias("place"), F.col(name).alias("name"),
    )
    segment = s("m", "n_nationkey", "c_mktsegment")
    return (
        row(region, "r_regionkey", s("r", "r_regionkey"), F.lit(None).cast("string"), F.lit(0), "r_name")
        .unionByName(row(nation, "n_regionkey", s("n", "n_nationkey"), s("r", "n_regionkey"), F.col("n_nationkey"), "n_name"))
        .unionByName(row(of, "n_regionkey", segment, s("n", "n_nationkey"), F.length("c_mktsegment"), "c_mktsegment").distinct())
        .unionByName(row(of, "n_regionkey", s("c", "c_custkey"), segment, F.col("c_custkey"), "c_name"))
    )


@query("tree_walk", f"with recursive {_NODES}{_WALK} select tree, node, depth, row_number() over (partition by tree order by path) as nth from walk")
def tree_walk(spark, d):
    found = trees.walk(_nodes(spark, d))
    return found.select("tree", "node", "depth", F.row_number().over(Window.partitionBy("tree").orderBy("path")).cast("bigint").alias("nth"))


@query("tree_mermaid", f"""with recursive {_NODES}{_WALK}
select tree, 'mindmap' || chr(10) || string_agg(case when depth = 0 then '  root((' || name || '))' else repeat('  ', depth + 1) || name end, chr(10) order by path) as mermaid from walk group by tree""")
def tree_mermaid(spark, d):
    return trees.mermaid(_nodes(spark, d))


_LINES = "string_split(text, chr(10))"


@query(
    "json_word_count",
    f"""with free as (
  select doc_id, case doc_id % 5
    when 0 then cast(to_json({{'title': source, 'lines': {_LINES}}}) as varchar)
    when 1 then cast(to_json({{'a': {{'b': {{'c': text, 'n': 5}}}}, 'lang': lang}}) as varchar)
    when 2 then cast(to_json(list_transform({_LINES}, lambda x: [[x], [source, lang]])) as varchar)
    when 3 then cast(to_json(list_transform({_LINES}, lambda x, i: {{'head': source, 'kids': [{{'k': x, 'place': i}}]}})) as varchar)
    else '{{broken ' || text end as j from documents),
atoms as (select doc_id, t.atom ->> '$' as s from (select * from free where doc_id % 5 < 4) f, json_tree(f.j) t where t.type = 'VARCHAR')
select doc_id, cast(coalesce(sum(len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'))), 0) as bigint) as words from documents left join atoms using (doc_id) group by doc_id""",
)
def json_word_count(spark, d):
    """Words of free-form JSON: objects, lists in lists, lists of objects, and text that is none."""
    lines, i = F.split("text", "\n"), F.col("doc_id") % 5
    free = (
        F.when(i == 0, F.to_json(F.struct(F.col("source").alias("title"), lines.alias("lines"))))
        .when(i == 1, F.to_json(F.struct(F.struct(F.struct(F.col("text").alias("c"), F.lit(5).alias("n")).alias("b")).alias("a"), "lang")))
        .when(i == 2, F.to_json(F.transform(lines, lambda x: F.array(F.array(x), F.array("source", "lang")))))
        .when(i == 3, F.to_json(F.transform(lines, lambda x, k: F.struct(F.col("source").alias("head"), F.array(F.struct(x.alias("k"), k.alias("place"))).alias("kids")))))
        .otherwise(F.concat(F.lit("{broken "), "text"))
    )
    return trees.json_words(table(spark, d, "documents").withColumn("j", free), ["doc_id"], "j")
