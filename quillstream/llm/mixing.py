r"""Mixing sources to target weights by a multivariate hypergeometric splitting tree, in DataFrame functions only.

A source's documents, in an order drawn by hashes of their ids, are one stream of words, and its target says how far the
mix reads into it: into a second pass where the target is above the source's size. What is read is dealt out as blocks of
``block_words`` words, so a source has an exact quota of blocks. The tree starts with all quotas at its root. A node
halves its output shards and draws what its left half gets: of each source as many blocks as a draw without
replacement from all the node's blocks would bring; the right half gets the rest. Its leaves are the shards, their
counts add up to the quotas exactly. Each shard then takes its count of blocks from a permutation of the source's blocks,
disjoint from all other shards, and orders what it got by a hash.

The draw for many sources is a chain of draws for one. It goes through groups of ``FAN`` sources, and groups of groups,
so that no row holds more than ``FAN`` counts. Positions in a source's stream are sums over buckets of some
``BUCKET_ROWS`` rows and sums inside a bucket, so a source of any size is spread over the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, cut, keyed, release, text_or_empty

SHARE, MOST, WEIGHTS = 150, 2, (3, 1, 2)
BLOCK_WORDS, SHARDS, SEED = 16_384, 16, 13
FAN, BUCKET_ROWS, KEY_BITS = 64, 4096, 60
#: A prime above every number of blocks of a source, so multiplying by it permutes them.
STEP = 2_147_483_647


def _long(c: Column) -> Column:
    return c.cast("bigint")


def words_in(text: Column) -> Column:
    return _long(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")))


def drawn_key(seed: int, key: Column) -> Column:
    """60 bits that a document's place in its source's stream is drawn by."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return _long(F.conv(F.substring(hashed, 1, KEY_BITS // 4), 16, 10))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``s``: 0, 1, ... by code points, null last. Each range of sources counts its own, a range starts where those
    before it end."""
    by = F.col("source").asc_nulls_last()
    at = F.col("__at")
    placed = cut(sources.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright(at, 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")  # a row for each range
    starts = ranges.select("__range", before.alias("__before"))
    inside = at.bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("__range")).withColumn("s", F.col("__before") + inside).drop("__at", "__range", "__before")


def _level(sources: DataFrame, total: float, most: int) -> float:
    """Words for a weight of one, where no source gets above ``most`` times its size; each round reshares the excess."""
    level, cap = 0.0, F.col("source_size") * most
    while True:
        full = F.lit(level) * F.col("weight") > cap
        row = sources.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row.open:
            return math.inf
        found = (total - (row.full or 0)) / row.open
        if found == level:
            return level
        level = found


def targets(sources: DataFrame, share: int = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(s, source, source_size, weight, target) of (source, source_size): ``share`` percent of all words, shared by
    weights that repeat over the sources in order of code points; a target stops at ``most`` times its source's size and
    the rest of its share goes to the others."""
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    known = cut(_numbered(sources).withColumn("weight", F.get(cycle, (F.col("s") % len(weights)).cast("int"))))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    cap = (F.col("source_size") * most).cast("double")
    level = _level(known, share * total / 100, most)
    return known.withColumn("target", cap if math.isinf(level) else F.least(cap, F.lit(level) * F.col("weight")))


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once; inside lambdas Spark would compute it at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` blocks, drawn from ``total`` without replacement, are among the ``good`` ones.

    Inversion from the mode: probabilities relative to the mode's follow by ratios, up and down, as far as 12 standard
    deviations and 40 more, beyond which nothing of a double's precision is left.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    t, g, m = total.cast("double"), good.cast("double"), n.cast("double")
    low, high = F.greatest(zero, n - (total - good)), F.least(good, n)
    center = F.greatest(low, F.least(high, _long(F.floor((m + 1) * (g + 1) / (t + 2)))))
    size = F.greatest(t, F.lit(1.0))
    reach = _long(F.ceil(12 * F.sqrt(m * (g / size) * ((t - g) / size) * ((t - m) / F.greatest(t - 1, F.lit(1.0)))))) + 40
    rise = lambda k: (g - k + 1) * (m - k + 1) / (k * (t - g - m + k))  # noqa: E731  p(k) / p(k - 1)
    fall = lambda k: (k + 1) * (t - g - m + k + 1) / ((g - k) * (m - k))  # noqa: E731  p(k) / p(k + 1)

    def outwards(ratio, ks: Column, left: Column, k: Column) -> Column:
        """Goes over the values of one side: ``left`` less their probabilities, and the value at which it fell below 0."""

        def step(a: Column, x: Column) -> Column:
            after = lambda p: F.struct(p.alias("p"), (a["left"] - p).alias("left"), F.when((a["k"] < 0) & (a["left"] < p), x).otherwise(a["k"]).alias("k"))
            return _let(a["p"] * ratio(x.cast("double")), after)

        return F.aggregate(ks, F.struct(F.lit(1.0).alias("p"), left.alias("left"), k.alias("k")), step)

    def drawn(mode: Column) -> Column:
        top, bottom, one = F.least(high, mode + reach), F.greatest(low, mode - reach), F.lit(1).cast("bigint")
        above = F.when(mode < top, F.sequence(mode + 1, top, one)).otherwise(none)
        below = F.when(mode > bottom, F.sequence(mode - 1, bottom, -one)).otherwise(none)
        mass = 1 - outwards(rise, above, F.lit(0.0), zero)["left"] - outwards(fall, below, F.lit(0.0), zero)["left"]
        first = lambda aim: outwards(rise, above, aim - 1, F.when(aim < 1, mode).otherwise(-one))
        both = lambda up: outwards(fall, below, up["left"], up["k"])
        return _let(_let(_let(u * mass, first), both), lambda x: F.when(x["k"] < 0, mode).otherwise(x["k"]))

    return _let(center, drawn)


def _drawn(counts: DataFrame, wanted: DataFrame, seed: int, depth: int) -> DataFrame:
    """(node, s, k): what each node's draw of ``wanted.n`` blocks takes of the ``counts`` (node, s, q) of its sources.

    Groups of ``FAN`` sources draw first, by their sums; then each group's members share what it drew.
    """
    uppers = [counts]
    for _ in range(depth):
        uppers.append(uppers[-1].groupBy("node", F.shiftright("s", 6).alias("s")).agg(F.sum("q").alias("q")))
    need = wanted.select("node", "width", F.lit(0).cast("bigint").alias("g"), "n")
    for level, table in reversed(list(enumerate(uppers))):
        members = table.groupBy("node", F.shiftright("s", 6).alias("g")).agg(F.sort_array(F.collect_list(F.struct("s", "q"))).alias("m"))
        empty = F.array().cast("array<struct<s:bigint,k:bigint>>")
        start = F.struct(F.col("n").alias("n"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x["q"]).alias("t"), empty.alias("out"))

        def step(a: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.col("width"), x["s"]), F.lit(1 << 52)).cast("double") / float(1 << 52)
            took = lambda k: F.concat(a["out"], F.array(F.struct(x["s"].alias("s"), k.alias("k"))))  # noqa: E731, B023
            return _let(_hypergeometric(a["t"], x["q"], a["n"], u), lambda k: F.struct((a["n"] - k).alias("n"), (a["t"] - x["q"]).alias("t"), took(k).alias("out")))

        drawn = members.join(need, ["node", "g"]).select("node", "width", F.explode(F.aggregate("m", start, step)["out"]).alias("x"))
        need = drawn.select("node", "width", F.col("x.s").alias("g"), F.col("x.k").alias("n"))
    return need.select("node", F.col("g").alias("s"), F.col("n").alias("k"))


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, s, q): the blocks of each source that each shard gets, of ``quotas`` (s, q); q may be 0.

    A node is a range of shards, ``node`` its first and ``width`` their number. Blocks are shared by the number of shards.
    """
    top = quotas.agg(F.max("s")).first()[0] or 0
    depth = 0
    while top >= FAN ** (depth + 1):
        depth += 1
    nodes = cut(quotas.select(F.lit(0).cast("bigint").alias("node"), F.lit(shards).cast("bigint").alias("width"), "s", "q"))
    for _ in range(max(0, shards - 1).bit_length()):
        half = F.floor(F.col("width") / 2)
        sizes = nodes.groupBy("node", "width").agg(F.sum("q").alias("t"))
        wanted = sizes.select("node", "width", F.floor(F.col("t") * half / F.col("width")).alias("n"))
        drawn = _drawn(nodes.select("node", "s", "q"), wanted, seed, depth)
        both = nodes.join(drawn, ["node", "s"])
        left = F.struct(F.col("node").alias("node"), half.alias("width"), F.col("k").alias("q"))
        right = F.struct((F.col("node") + half).alias("node"), (F.col("width") - half).alias("width"), (F.col("q") - F.col("k")).alias("q"))
        wide = F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(F.struct("node", "width", "q")))
        below = cut(both.select("s", F.explode(wide).alias("x")).select("x.node", "x.width", "s", "x.q"))
        release(nodes)
        nodes = below
    return nodes.select(F.col("node").alias("shard"), "s", "q")


def blocks(parts: DataFrame, seed: int = SEED) -> DataFrame:
    """(s, block, shard): which shard has each block of a source. Shards take their counts one after the other from the
    blocks in the order ``STEP * i + offset`` modulo their number, a permutation."""
    by = Window.partitionBy("s")
    end = F.sum("q").over(by.orderBy("shard"))
    placed = parts.select("s", "shard", "q", (end - F.col("q")).alias("first"), F.sum("q").over(by).alias("all")).where("q > 0")
    each = placed.select("s", "shard", "all", F.explode(F.sequence("first", F.col("first") + F.col("q") - 1)).alias("i"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("s")), F.col("all"))
    return each.select("s", F.pmod(F.lit(STEP).cast("bigint") * F.col("i") + offset, F.col("all")).alias("block"), "shard")


def placed(docs: DataFrame, id_col: str, text: str, source: str, share: int, most: int, weights: tuple[int, ...], seed: int) -> DataFrame:
    """Every document with ``size``, its source's number ``s``, ``source_size``, ``target`` and ``limit`` (words that the mix
    takes of the source), and ``start``, its place in the source's stream; written, without texts."""
    sized = cut(
        keyed(docs, id_col).select(
            ROW, F.col(id_col).alias("id"), F.col(source).alias("source"), words_in(text_or_empty(text)).alias("size"),
            drawn_key(seed, F.col(id_col)).alias("drawn"),
        )
    )
    n_bits = max(0, math.ceil(math.log2(max(1, sized.count() / BUCKET_ROWS))))
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    limit = F.least(_long(F.floor(F.col("target") + 0.5)), F.col("source_size") * most)
    wanted = wanted.withColumn("limit", limit).withColumnRenamed("source", "__source")
    known = sized.join(wanted, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight").withColumn("bucket", F.shiftright("drawn", KEY_BITS - n_bits))
    sums = known.groupBy("s", "bucket").agg(F.sum("size").alias("__words"))
    before = (F.sum("__words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("__words")).alias("__before")
    inside = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("drawn", ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    out = known.withColumn("__inside", inside).join(sums.select("s", "bucket", before), ["s", "bucket"])
    return cut(out.withColumn("start", F.col("__before") + F.col("__inside")).drop("__before", "__inside", "bucket", "drawn"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: int = SHARE, most: int = MOST,
    weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of the mix.

    Documents: ``ROW``, id, source, size, s, source_size, target, limit, start. Spans, a row for each stretch of a document
    in a block: ``ROW``, id, shard, place, s, block, round (0 in the first pass over the source, 1 in the second), first
    (the document's word that it begins with), n (words). A shard's training order is by ``place``.

    Each source's spans add up to its target, rounded; a document is taken ``most`` times at most, and in part where the
    stream is cut. Runs agree, as all draws are hashes of ids. Null and empty texts have no words, no span, and appear
    among the documents; a null source is a source of its own, the last; rows with a null or repeated id are documents of
    their own; columns of any other name are ignored; an empty table gives empty ones.
    """
    documents = placed(docs, id_col, text, source, share, most, weights, seed)
    quota = F.floor((F.col("limit") + block_words - 1) / block_words)
    quotas = documents.groupBy("s").agg(F.first("limit").alias("limit")).select("s", quota.alias("q"))
    shard_of = blocks(split(quotas, shards, seed), seed)
    begin = F.col("source_size") * F.col("round") + F.col("start")
    stretches = (
        documents.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint"))))
        .withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("limit"))).where("begin < end")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    )
    first, last = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    place = F.xxhash64(F.lit(seed), "shard", "s", "block", "round", ROW)
    spans = stretches.join(shard_of, ["s", "block"]).select(
        ROW, "id", "shard", place.alias("place"), "s", "block", "round", (first - F.col("begin")).alias("first"), (last - first).alias("n"),
    )
    return documents, spans


def write_mix(spans: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the spans with their words as ``text``, a folder for each shard, its rows in training order over its files."""
    words = F.array_remove(F.split(text_or_empty(text), r"[ \t\n\x0B\f\r]+"), "")
    whole = keyed(docs, id_col).select(ROW, words.alias("__words"))
    out = spans.join(whole, ROW).withColumn("text", F.array_join(F.slice("__words", (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")).drop("__words")
    out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    documents, spans = mix(docs)
    taken = spans.groupBy(ROW).agg(F.sum("n").alias("taken"))
    return documents.join(taken, ROW, "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


#: The words taken follow from the targets and the order of each source's stream alone.
SQL = rf"""with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as bigint) as size,
         cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, {KEY_BITS // 4}) as bigint) as drawn
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
         [{", ".join(map(str, WEIGHTS))}][(row_number() over (order by encode(source) nulls last) - 1) % {len(WEIGHTS)} + 1] as weight
  from sized group by source),
ordered as (
  select *, {MOST} * source_size as cap, row_number() over (order by {MOST} * source_size / weight, source) as k from sources),
levels as (
  select *, ({SHARE} * sum(source_size) over () / 100 - (sum(cap) over (order by k) - cap)) / (sum(weight) over () - (sum(weight) over (order by k) - weight)) as level
  from ordered),
level as (select level from levels where level * weight <= cap order by k limit 1),
wanted as (
  select source, source_size, least(cast(cap as double), coalesce((select level from level) * weight, cap)) as target,
         least(cast(floor(least(cast(cap as double), coalesce((select level from level) * weight, cap)) + 0.5) as bigint), cap) as lim
  from ordered),
placed as (
  select doc_id, size, source_size, target, lim,
         cast(sum(size) over (partition by sized.source order by drawn, doc_id rows unbounded preceding) as bigint) - size as start
  from sized join wanted on sized.source is not distinct from wanted.source)
select doc_id, size, source_size, target,
       cast(greatest(0, least(start + size, lim) - start) + greatest(0, least(source_size + start + size, lim) - source_size - start) as bigint) as taken
from placed"""


# Brute force, for tests.
def brute_targets(sizes: list[int], share: int = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Targets of sources in order: shares of what is left go round until no source is above its limit."""
    found: dict[int, float] = {}
    while True:
        rest = share * sum(sizes) / 100 - sum(found.values())
        open_ = [i for i in range(len(sizes)) if i not in found]
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if rest * weights[i % len(weights)] / total > most * sizes[i]]
        if not over:
            return [found.get(i, rest * weights[i % len(weights)] / total if total else 0.0) for i in range(len(sizes))]
        found |= {i: float(most * sizes[i]) for i in over}
