"""Text functions as column expressions."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that are no keywords.
STOP_WORDS = (
    "the and for with that this from are was were your their into have has had not can will may shall should would could "
    "there here about been each when what which where how why through using use used our its it a an of to in on at by is as or"
).split()
#: What headings begin with.
HEADING_PREFIXES = ["chapter", "unit", "module", "topic", "lecture", "lesson", "section", "part"]
#: Topic and the substrings that give it, in the order in which they are tried.
TOPIC_RULES = [
    ("nlp", ["nlp", "bert", "token", "text", "language"]),
    ("ml", ["ml", "model", "tree", "forest", "regression", "classification"]),
    ("ds", ["data structure", "linked list", "stack", "queue", "graph", "tree"]),
]
#: File types that are taken.
ALLOWED = ["pdf", "docx", "txt", "md", "ppt", "pptx", "png", "jpg", "jpeg"]
#: Words that mark a diagram.
DIAGRAM_WORDS = ["diagram", "architecture", "flow", "model", "lifecycle", "layer", "pipeline"]
PAGE_MARK = r"\[\[PAGE_(\d+)\]\]"
#: What ``\\s`` matches.
SPACES = " \t\n\x0b\f\r"
TOKEN = r"[a-z][a-z0-9_\-]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(SPACES))


def title_case(c: Column) -> Column:
    """Every run of letters with its first one raised and the rest lowered, whatever stands before it."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def clean(c: Column) -> Column:
    """Line ends as newlines; no bullets; single blanks; at most one empty line; every line stripped."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("•", ""), ("●", ""), ("◦", ""), ("\t", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


def pages(c: Column) -> Column:
    """array<struct<page, text>>: spans between page marks; text before the first mark is no page."""
    numbers = F.regexp_extract_all(c, F.lit(PAGE_MARK), F.lit(1))
    texts = F.split(c, r"\[\[PAGE_\d+\]\]")
    named = lambda x: F.transform(F.slice(x["texts"], 2, F.size(x["numbers"])), lambda t, i: F.struct(F.get(x["numbers"], i).cast("int").alias("page"), strip(t).alias("text")))
    found = F.filter(once(F.struct(numbers.alias("numbers"), texts.alias("texts")), named), lambda p: p.text != "")
    whole = F.array(F.struct(F.lit(1).alias("page"), c.alias("text")))
    return once(found, lambda f: F.when(F.size(f) == 0, whole).otherwise(f))


def paragraphs(c: Column) -> Column:
    """Parts between empty lines, or lines where there is no such part."""
    parts = lambda p: F.filter(F.transform(F.split(c, p), strip), lambda x: x != "")
    return once(parts(r"\n\s*\n+"), lambda by_blank: F.when(F.size(by_blank) > 0, by_blank).otherwise(parts("\n")))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def is_heading(c: Column) -> Column:
    """Whether a line looks like a heading. Lambdas share nothing, so each part of it is bound once; the cheap tests come
    first, and long lines see no pattern."""

    def titled(bare: Column) -> Column:
        words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
        return once(words, lambda ws: (F.size(ws) <= 9) & (F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}"))) >= F.greatest(F.lit(1), F.size(ws) - 2)))

    def judged(bare: Column) -> Column:
        prefixed = F.lower(bare).rlike("^(" + "|".join(HEADING_PREFIXES) + ")")
        numbered = bare.rlike(r"^[0-9]+(\.[0-9]+)*\s+[A-Za-z].+$")
        return (bare != "") & (F.length(bare) <= 90) & (prefixed | numbered | titled(bare))

    return once(strip(F.btrim(c, F.lit(":"))), judged)


def heading_text(c: Column, fallback: Column) -> Column:
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"^[0-9]+(\.[0-9]+)*\s*", ""), "^[:\\- ]+|[:\\- ]+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), fallback)


#: Keywords of a text.
KEYWORDS = 8
# tokens of three characters or more: a token goes on as long as it can, so a shorter one is followed by none of these
_LONG_TOKEN = re.compile(r"[a-z][a-z0-9_\-]{2,}")


@F.pandas_udf(ArrayType(StringType()))
def _most_frequent(lowered: pd.Series) -> pd.Series:
    def one(text: str) -> list[str]:
        counts = Counter(_LONG_TOKEN.findall(text))
        for word in STOP_WORDS:
            counts.pop(word, None)
        return [w.replace("_", " ") for w, _ in counts.most_common(KEYWORDS)]

    return lowered.map(one)


def top_keywords(c: Column) -> Column:
    """The most frequent tokens of one text, ties by first occurrence; ``_`` becomes a blank after counting. Null has none.

    Counting in a hash table took a sixth of the time (check_s, 1.8 s for 10.9) that higher-order functions took to sort the tokens.
    """
    return _most_frequent(F.lower(F.coalesce(c, F.lit(""))))


def once(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is evaluated once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def definition(c: Column) -> Column:
    """``term: meaning.`` of a sentence that defines something, else null."""
    p = r"(?i)^([A-Za-z][A-Za-z0-9\s()/\-]{1,60})\s+(is|are|refers to|means)\s+(.+)"
    meaning = F.regexp_replace(strip(F.regexp_extract(c, p, 3)), r"\.+$", "")
    return F.when(c.rlike(p), F.concat(strip(F.regexp_extract(c, p, 1)), F.lit(": "), meaning, F.lit(".")))


def defined(c: Column) -> Column:
    """The definitions among the sentences of a text; the pattern is tried only where a defining word stands."""
    told = F.filter(sentences(c), lambda x: x.rlike(r"(?i)\s(is|are|refers to|means)\s"))
    return F.filter(F.transform(told, definition), lambda x: x.isNotNull())


def first_of_each(items: Column, key) -> Column:
    """The first of items with equal keys, in their order: neighbours in a sorted array, so n log n."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    heads = once(placed, lambda p: F.filter(F.transform(p, lambda e, k: F.when((k == 0) | (F.get(p, k - 1)["k"] != e["k"]), F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e.isNotNull()))
    return F.transform(F.sort_array(heads), lambda e: e["x"])


def dedupe(items: Column, limit: int | None = None) -> Column:
    """The first of items that are equal but for case and white space; single blanks; no empty ones."""
    flat = F.filter(F.transform(items, lambda x: strip(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    kept = first_of_each(flat, F.lower)
    return F.slice(kept, 1, limit) if limit else kept


def dedupe_stripped(items: Column) -> Column:
    """The first of items that are equal but for case and white space at their ends; inner white space counts."""
    return first_of_each(F.filter(F.transform(items, strip), lambda x: x != ""), F.lower)


def _lowered(value, most: int):
    if isinstance(value, dict):
        return {k.lower(): _lowered(v, most) for k, v in value.items()}
    if isinstance(value, list):
        return [_lowered(v, most) for v in value]
    return value.strip()[:most] if isinstance(value, str) else value


@F.pandas_udf(StringType())
def lower_keys(values: pd.Series) -> pd.Series:
    """JSON text with lower-case object keys and stripped strings of 2000 characters at most, at any depth; null where it
    is no JSON. (Values of any depth are beyond SQL functions.)"""

    def one(text):
        try:
            return json.dumps(_lowered(json.loads(text), 2000), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return values.map(one)


def topic(filename: Column, c: Column) -> Column:
    low = F.lower(F.concat(filename, F.lit(" "), c))
    return F.coalesce(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in TOPIC_RULES])


def difficulty(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 1500, "beginner").when(n < 6000, "intermediate").otherwise("advanced")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def title_of_file(name: Column) -> Column:
    return title_case(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def caption(page: Column, near: Column) -> Column:
    flat = strip(F.regexp_replace(near, r"\s+", " "))
    return F.when(near != "", F.substring(flat, 1, 140)).otherwise(F.concat(F.lit("Diagram extracted from page "), page))


def is_diagram(width: Column, height: Column, near: Column) -> Column:
    return F.lower(near).rlike("|".join(DIAGRAM_WORDS)) | (width * height >= 30000)


def markdown(c: Column) -> Column:
    for pattern, tag in ((r"\*\*(.*?)\*\*", "strong"), (r"\*(.*?)\*", "em"), (r"`(.*?)`", "code")):
        c = F.regexp_replace(c, pattern, f"<{tag}>$1</{tag}>")
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def asset_url(path: Column, base: str) -> Column:
    whole = F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(whole)


def mermaid(title: Column, label: Column, third: str, fourth: str) -> Column:
    """A flow chart from a title to a label and two fixed steps."""
    return F.concat(F.lit("flowchart TD\n  A["), title, F.lit("] --> B["), label, F.lit(f"]\n  B --> C[{third}]\n  C --> D[{fourth}]"))


def target_pages(n: Column) -> tuple[Column, Column]:
    least = F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.bround(n * 0.35)))
    most = F.when(n <= 1, 2).otherwise(F.greatest(F.lit(2), F.bround(n * 0.55)))
    return least.cast("bigint"), most.cast("bigint")


def data_url(content: Column, kind: Column) -> Column:
    """Bytes as a data URL of a media type."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s+", ""))
