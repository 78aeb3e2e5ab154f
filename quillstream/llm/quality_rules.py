r"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets counts; five rates of these counts go into one quantile sketch per language, source and rate; fences
drawn from the sketches replace fixed cutoffs; a join with the fences filters.

The sketch is a histogram whose bins keep the seven leading bits of a value, so a quantile is within 1/64 of its value.
Adding bin counts merges sketches: partial counts merge in the shuffle, sources merge into their language, languages
into the corpus. It needs no random choice, so a task that runs again gives the same fences.

Fence of a rate in a group: ``q75 + max(slack, reach * (q75 - q25))`` at the upper end, and for the mean word length
also ``q25 - max(slack, reach * (q75 - q25))`` at the lower end. A group of fewer than ``min_group`` rows that passed
the base rules takes its language's fences, a language of fewer the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, packed, text_or_empty

#: Rate: (least distance of the fence from its quartile, whether there is a lower fence as well).
#: Per thousand word characters or words or lines; the mean word length is in hundredths of a character.
RATES = {
    "symbol_rate": (30, False),
    "upper_rate": (250, False),
    "dup_line_rate": (500, False),
    "repeat_rate": (400, False),
    "mean_word": (300, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REACH, MIN_GROUP = 3, 50


def _repeat_words(spare: int = 0) -> tuple[Column, Column, Column, Column]:
    """Words in a 3-word window found twice or more, in steps that are columns of their own.

    Windows as hashes above their positions, sorted: equal neighbours may be repeats. The longer the text, the fewer bits
    of the hash are left, so what these find is sorted again by the windows' words, which decide. ``spare`` bits less of
    the hash are used.
    """
    n = F.size("__words") - 2
    bits = F.length(F.bin(n.cast("bigint"))) + spare
    packed = F.sort_array(
        F.transform(
            F.slice("__words", 1, n),
            lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)), bits).bitwiseOR(i.cast("bigint")),
        )
    )
    window = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    met = F.filter("__packed", lambda x, i: (window(x) == window(F.get("__packed", i - 1))) | (window(x) == window(F.get("__packed", i + 1))))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bits")) - 1).cast("int")
    word = lambda i: F.get("__words", i)
    spelled = F.sort_array(F.transform(met, lambda x: F.struct(F.concat_ws(" ", word(at(x)), word(at(x) + 1), word(at(x) + 2)).alias("w"), at(x).alias("i"))))
    same = F.filter("__met", lambda x, k: (x["w"] == F.get("__met", k - 1)["w"]) | (x["w"] == F.get("__met", k + 1)["w"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return bits, packed, spelled, covered


def with_counts(docs: DataFrame, text: str = "text", spare: int = 0) -> DataFrame:
    """Adds the base counts, ``base_failed`` and the rates to ``docs``; null and empty texts count nothing."""
    bits, packed, spelled, covered = _repeat_words(spare)
    whole = text_or_empty(text)
    has_word = lambda line: line.rlike(r"[^ \t\n\x0B\f\r]")
    bare = F.col("__bare")
    rate = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("bigint")
    return (
        docs.withColumn("__words", F.array_remove(F.split(whole, SPACE_CLASS + "+"), ""))
        .withColumn("__lines", F.filter(F.split(whole, "\n"), has_word))
        .withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("__bare", F.array_join("__words", ""))
        .withColumn("word_chars", F.char_length("__bare").cast("bigint"))
        .withColumn("n_symbols", F.char_length(F.regexp_replace(bare, r"[^#*$%&|<>]+", "")).cast("bigint"))
        .withColumn("__upper", F.char_length(F.regexp_replace(bare, "[^A-ZÀ-ÖØ-Þ]+", "")).cast("bigint"))
        .withColumn("__n_lines", F.size("__lines").cast("bigint"))
        .withColumn("n_dup_lines", (F.col("__n_lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("__bits", F.when(F.col("n_words") > 3, bits).otherwise(1))
        .withColumn("__packed", F.when(F.col("n_words") > 3, packed))
        .withColumn("__met", F.when(F.col("n_words") > 3, spelled))
        .withColumn("n_repeat_words", F.when(F.col("n_words") > 3, covered).otherwise(0).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("symbol_rate", rate("n_symbols", "word_chars"))
        .withColumn("upper_rate", rate("__upper", "word_chars"))
        .withColumn("dup_line_rate", rate("n_dup_lines", "__n_lines"))
        .withColumn("repeat_rate", rate("n_repeat_words", "n_words"))
        .withColumn("mean_word", F.floor(100 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).cast("bigint"))
        .drop("__words", "__lines", "__bare", "__upper", "__n_lines", "__packed", "__met", "__bits")
    )


def _bin(x: Column) -> Column:
    """x with all but its seven leading bits cleared."""
    over = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, over), over)


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bin, n) over the rows that passed the base rules."""
    rates = F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(F.col(r)).alias("bin")) for r in RATES]))
    return counted.where(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), rates,
    ).groupBy("lang", "source", "rate", "bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """One row for each group ``by``: its size and a low and a high fence for each rate."""
    from pyspark.sql import Window

    bins = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rate")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("size", F.sum("n").over(w))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("size"), F.col("bin")))
    q = ranked.groupBy(*by, "rate").agg(F.max("size").alias("size"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.coalesce(*[F.when(F.col("rate") == r, F.lit(s)) for r, (s, _) in RATES.items()])
    far = F.greatest(slack, reach * (F.col("q3") - F.col("q1")))
    q = q.withColumn("low", F.col("q1") - far).withColumn("high", F.col("q3") + far)
    pick = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{r}_{c}")
    return q.groupBy(*by).agg(F.max("size").alias("size"), *[pick(r, c) for r, (_, both) in RATES.items() for c in (["low"] if both else []) + ["high"]])


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """The fences that hold for each (lang, source), written: one row each, also where no row passed the base rules."""
    sketch = cut(sketches(counted, lang, source))
    groups = counted.select(F.col(lang).alias("lang"), F.col(source).alias("source")).distinct()
    own, by_lang, all_ = fences(sketch, ["lang", "source"], reach), fences(sketch, ["lang"], reach), fences(sketch, [], reach)
    names = [c for c in all_.columns if c != "size"]
    own = own.select(F.col("lang").alias("l1"), F.col("source").alias("s1"), F.col("size").alias("n1"), *[F.col(c).alias(f"{c}_1") for c in names])
    by_lang = by_lang.select(F.col("lang").alias("l2"), F.col("size").alias("n2"), *[F.col(c).alias(f"{c}_2") for c in names])
    all_ = all_.select(*[F.col(c).alias(f"{c}_3") for c in names])
    met = (
        groups.join(own, F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("l2")), "left")
        .join(F.broadcast(all_), F.lit(True), "left")  # one row
    )
    chosen = lambda c: F.when(F.col("n1") >= min_group, F.col(f"{c}_1")).when(F.col("n2") >= min_group, F.col(f"{c}_2")).otherwise(F.col(f"{c}_3")).alias(f"__{c}")
    return cut(met.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[chosen(c) for c in names]))


def judge(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``kept``. Spark broadcasts the fences if their written size allows, else it shuffles and splits hot groups."""
    within = ~F.col("base_failed")
    for r, (_, both) in RATES.items():
        within &= F.col(r) <= F.col(f"__{r}_high")
        if both:
            within &= F.col(r) >= F.col(f"__{r}_low")
    met = counted.join(limits, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    return met.withColumn("kept", F.coalesce(within, F.lit(False))).drop(*limits.columns)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with counts, rates and ``kept``.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own.
    Rows are judged one by one, so repeated rows and ids get the same verdict each. An empty table gives an empty one. The counted rows are
    written once; sketches and verdicts read them. Columns of ``docs`` with the names of new ones are replaced.
    """
    counted = cut(with_counts(docs, text))
    return judge(counted, thresholds(counted, lang, source), lang, source)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = cut(with_counts(docs).drop("text"))
    return judge(counted, thresholds(counted)).select("doc_id", *COUNTS, "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the others keep all their columns, whatever their names.

    Rows are judged one by one: repeated rows and ids get the same verdict each. Null and empty texts go; an empty table
    stays one. A long text is one row of arrays of its words.
    """
    return quality_rules(packed(docs, "text", "lang", "source")).where("kept").select("__doc.*")


_WS = r"[ \t\n\x0B\f\r]"
_Q = "min(bin) filter (where 4 * upto >= {q} * size)"


def _fences_sql(name: str, by: str) -> str:
    keys, using = (by + ", ", f"partition by {by}, rate") if by else ("", "partition by rate")
    slack = " ".join(f"when rate = '{r}' then {s}" for r, (s, _) in RATES.items())
    cols = ", ".join(f"max(case when rate = '{r}' then {c} end) as {r}_{c}" for r, (_, both) in RATES.items() for c in (["low"] if both else []) + ["high"])
    return f"""
{name}_b as (select {keys}rate, bin, sum(n) as n from sketch group by {keys}rate, bin),
{name}_r as (select *, sum(n) over ({using} order by bin) as upto, sum(n) over ({using}) as size from {name}_b),
{name}_q as (select {keys}rate, max(size) as size, {_Q.format(q=1)} as q1, {_Q.format(q=3)} as q3 from {name}_r group by {keys}rate),
{name}_f as (select {keys}rate, size, q1 - greatest(case {slack} end, {REACH} * (q3 - q1)) as low, q3 + greatest(case {slack} end, {REACH} * (q3 - q1)) as high from {name}_q),
{name} as (select {keys}max(size) as size, {cols} from {name}_f {"group by " + by if by else ""})"""


def sql_parts(docs: str = "documents") -> str:
    """The common table expressions that end in ``judged``: every column of ``docs`` with counts and kept."""
    names = [f"{r}_{c}" for r, (_, both) in RATES.items() for c in (["low"] if both else []) + ["high"]]
    chosen = ", ".join(f"case when o.size >= {MIN_GROUP} then o.{c} when l.size >= {MIN_GROUP} then l.{c} else a.{c} end as {c}" for c in names)
    within = " and ".join(f"{r} <= {r}_high" + (f" and {r} >= {r}_low" if both else "") for r, (_, both) in RATES.items())
    bins = " union all ".join(f"select lang, source, '{r}' as rate, {r} as v from counted where not base_failed" for r in RATES)
    return f"""
worded as (
  select *, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as texts
  from {docs}),
windows as (
  select doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as w,
         unnest(range(1, len(words) - 1)) as i from worded where len(words) > 3),
met as (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows),
spread as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from met where n > 1) group by doc_id),
raw as (
  select worded.*, cast(len(words) as bigint) as n_words, array_to_string(words, '') as bare, len(texts) as n_texts,
         cast(len(texts) - len(list_distinct(texts)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from worded left join spread using (doc_id)),
counted as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         1000 * n_symbols // greatest(word_chars, 1) as symbol_rate, 1000 * n_upper // greatest(word_chars, 1) as upper_rate,
         1000 * n_dup_lines // greatest(n_texts, 1) as dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate,
         100 * word_chars // greatest(n_words, 1) as mean_word
  from (select *, length(bare) as word_chars, length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
               length(regexp_replace(bare, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) as n_upper from raw)),
rated as ({bins}),
sketch as (select lang, source, rate, (v >> o) << o as bin, count(*) as n
           from (select *, cast(greatest(length(bin(v)) - 7, 0) as bigint) as o from rated) group by all),
{_fences_sql("own", "lang, source")}, {_fences_sql("by_lang", "lang")}, {_fences_sql("overall", "")},
limits as (
  select g.lang as g_lang, g.source as g_source, {chosen} from (select distinct lang, source from counted) g
  left join own o on g.lang is not distinct from o.lang and g.source is not distinct from o.source
  left join by_lang l on g.lang is not distinct from l.lang left join overall a on true),
judged as (
  select counted.*, coalesce(not base_failed and {within}, false) as kept from counted
  left join limits on lang is not distinct from g_lang and source is not distinct from g_source)"""


SQL = "with " + sql_parts() + " select doc_id, " + ", ".join(COUNTS) + ", base_failed, kept from judged"
