"""Items matched to sections and images by ranked rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .quiz import missing

#: What a diagram that lacks them says, around its section's title.
CAPTION = "Relevant diagram for "
EXPLANATION = ("This diagram supports the section on ", ". Use it to explain the structure, flow, or relationship between the main concepts in your own words.")
STEPS = ("Key structure or flow", "Exam explanation point")
BELONGS = ("This diagram belongs with ", ". Use it to explain the structure, flow, or relationship shown in the uploaded material.")
SHOWN = ("Structure or flow", "Exam explanation")
GAP, NEAREST, HINTS = 120, 3, 3
#: Characters that captions and patterns meet by, and the width of a cell of a page.
ANCHOR, CELL = 4, 128


def _grams(text: Column) -> Column:
    """What a pattern found in ``text`` may begin with: every stretch of up to ``ANCHOR`` characters, each once."""
    of = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(q)))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(q) for q in range(1, ANCHOR + 1)]))


def best_section(diagrams: DataFrame, sections: DataFrame) -> DataFrame:
    """(diagram_id, section_id, score): each diagram's best section of its note, the earliest on ties, even at score 0.

    A page in common counts 5, each topic in the caption 3, the title in it 4. ``diagrams`` has (note_id, diagram_id, page,
    caption), ``sections`` (note_id, nth, section_id, title, topics, pages). A diagram whose note has no section has no row.

    Diagrams and sections of a note are not paired. A caption meets the topics and titles that begin with some stretch of
    it, by an equality join, and those that it really holds count; pages meet by equality too; a diagram that meets
    nothing has its note's first section. So the work grows with captions, patterns and hits.
    """
    keys = ["note_id", "nth", "section_id"]
    topic = sections.select(*keys, F.explode("topics").alias("pattern"), F.lit(3).alias("weight")).withColumn("pattern", F.lower("pattern"))
    title = sections.where(F.coalesce("title", F.lit("")) != "").select(*keys, F.lower("title").alias("pattern"), F.lit(4).alias("weight"))
    patterns = topic.unionByName(title).where("pattern is not null").withColumn("gram", F.substring("pattern", 1, ANCHOR))
    captions = diagrams.select("note_id", "diagram_id", F.lower("caption").alias("low")).where("low is not null")
    met = captions.select("*", F.explode(_grams(F.col("low"))).alias("gram")).join(patterns, ["note_id", "gram"])
    held = met.where(F.contains("low", "pattern")).select("diagram_id", "nth", "section_id", "weight")
    pages = sections.select(*keys, F.explode(F.array_distinct("pages")).alias("page"), F.lit(5).alias("weight"))
    paged = diagrams.select("note_id", "diagram_id", "page").join(pages, ["note_id", "page"]).select(*held.columns)
    first = sections.groupBy("note_id").agg(F.min(F.struct("nth", "section_id")).alias("f"))
    least = diagrams.select("note_id", "diagram_id").join(first, "note_id").select("diagram_id", "f.nth", "f.section_id", F.lit(0).alias("weight"))
    scored = held.unionByName(paged).unionByName(least).groupBy("diagram_id", "nth", "section_id").agg(F.sum("weight").alias("score"))
    best = scored.groupBy("diagram_id").agg(F.max_by(F.struct("section_id", "score"), F.struct("score", -F.col("nth"))).alias("b"))
    return best.select("diagram_id", "b.*")


def attached(diagrams: DataFrame, sections: DataFrame) -> DataFrame:
    """(note_id, nth, section_id, diagram_id, page, caption, explanation, mermaid_code): diagrams with their best section,
    explained and charted by its title."""
    best = best_section(diagrams, sections).drop("score")
    titles = sections.select("note_id", "section_id", "nth", "title")
    met = diagrams.join(best, "diagram_id").join(titles, ["note_id", "section_id"])
    told = F.concat(F.lit(BELONGS[0]), "title", F.lit(BELONGS[1]))
    chart = fn.mermaid(F.col("title"), F.col("caption"), *SHOWN)
    return met.select("note_id", "nth", "section_id", "diagram_id", "page", "caption", told.alias("explanation"), chart.alias("mermaid_code"))


def hints(diagrams: DataFrame, sections: DataFrame) -> DataFrame:
    """(note_id, nth, diagram_id, rank): at most three diagrams on a section's pages, in their order."""
    on_page = sections.select("note_id", "nth", F.explode("pages").alias("page"))
    w = Window.partitionBy("note_id", "nth").orderBy("diagram_id")
    met = diagrams.join(on_page, ["note_id", "page"]).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return met.where(F.col("rank") <= HINTS).select("note_id", "nth", "diagram_id", "rank")


def enrich(diagrams: DataFrame) -> DataFrame:
    """Fills in the caption, explanation and chart that a section's diagrams (title, caption, explanation, mermaid_code)
    lack; empty strings count as lacking."""
    given = diagrams.withColumn("caption", F.coalesce(missing("caption"), F.concat(F.lit(CAPTION), "title")))
    given = given.withColumn("explanation", F.coalesce(missing("explanation"), F.concat(F.lit(EXPLANATION[0]), "title", F.lit(EXPLANATION[1]))))
    return given.withColumn("mermaid_code", F.coalesce(missing("mermaid_code"), fn.mermaid(F.col("title"), F.col("caption"), *STEPS)))


def nearby_text(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(image_id, near): the three nearest blocks within the gap above or below an image, or overlapping it sideways.

    Blocks and images of a page meet in bands of the gap's height, by the edges that are compared, and in cells of the
    page's width, so those that are far apart are not compared. ``blocks`` has (page_id, nth, x0, y0, x1, y1, text), ``images`` (image_id,
    page_id, left, top, right, bottom).
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    written = blocks.withColumn("text", text).where("text <> ''")
    above, below = F.abs(F.col("y1") - F.col("top")), F.abs(F.col("y0") - F.col("bottom"))
    beside = ~((F.col("x1") < F.col("left")) | (F.col("x0") > F.col("right")))
    band = lambda c: F.floor(F.col(c) / GAP)
    three_bands = lambda c: F.explode(F.array(*[band(c) + i for i in (-1, 0, 1)])).alias("cell")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.greatest(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL)))).alias("cell")
    meet = lambda image, block: images.select("*", image).join(written.select("*", block), ["page_id", "cell"])
    under = meet(three_bands("top"), band("y1").alias("cell")).where(above <= GAP)
    over = meet(three_bands("bottom"), band("y0").alias("cell")).where((below <= GAP) & (above > GAP))
    owner = F.col("cell") == F.floor(F.greatest("left", "x0") / CELL)  # of the cells that both are in
    level = meet(cells("left", "right"), cells("x0", "x1")).where(owner & beside & (above > GAP) & (below > GAP))
    near = under.unionByName(over).unionByName(level).withColumn("gap", F.least(above, below))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("gap", "nth"))
    three = near.withColumn("rank", rank).where(F.col("rank") <= NEAREST)
    found = three.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t"))
    return images.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce(F.array_join(F.transform("t", lambda x: x.text), " "), F.lit("")).alias("near"))


def first_choice(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The row of each ``key`` that comes first in ``order``: lookups with a priority."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
