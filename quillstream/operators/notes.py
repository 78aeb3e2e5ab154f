"""Documents to study notes: chunks, sections, the five note layouts, questions and the normalised tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..sources.tables import dealt

FLUSH, SMALL, EXCERPT = 2200, 350, 600
FORMATS = ["cornell", "outline", "mindmap", "chart", "sentence"]
_CHUNK = T.StructType(
    [
        T.StructField("section_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("raw_text", T.StringType()),
        T.StructField("pages", T.ArrayType(T.IntegerType())),
    ]
)

#: The sentences of a section. In braces are columns of a section: its title, the document's, its first
#: four keywords (or a stand-in), its first and second keyword.
NO_TEXT = "No extracted text found."
EXPLANATION = (
    "{title} in {document_title} concentrates on {named_or_central}. This part should be studied as a connected idea rather than as isolated lines "
    "from the source material. For exam preparation, focus on what the concept does, how it fits into the larger system, and where it is typically "
    "applied."
)
KEY_POINTS = [
    "{title} should be understood by purpose, flow, and relationship to surrounding concepts.",
    "Important keywords in this section include {named_or_title}.",
    "Learners should be ready to define the concept, describe its working, and explain one practical use.",
    "Revision should include comparison, application, and common exam phrasing.",
]
EXAMPLES = ["Explain {title} using a short real-world or software-oriented example.", "Relate {focus} to one implementation or workflow scenario."]
USE_CASES = ["Use {title} while discussing architecture, workflow, or implementation decisions.", "Use the concept to justify design choices or explain system behavior in a written answer."]
IMPORTANT_NOTES = ["Do not memorize the section line by line; focus on meaning and relationships.", "In exams, strong answers usually include definition, working, use case, and one comparison."]
WHY_THIS_MATTERS = "This section matters because exams typically test whether the learner can explain the concept clearly, connect it to architecture or workflow, and apply it in context."
COMMON_MISTAKES = [
    "Confusing {focus} with nearby related terms.", "Writing only a definition without explaining working or significance.",
    "Skipping the practical implication or architecture link in long answers.",
]
TEST_YOURSELF = [
    "Can you explain {title} without looking at the source text?", "Can you compare {focus} with another related concept?",
    "Can you draw or describe the process/architecture from memory if asked in an exam?",
]
CUE = ["What problem does {title} solve?", "How would you explain the flow or working of {title}?", "Where can {title} appear in an exam answer or application scenario?"]
SUMMARY = "{title} should be revised through concept, flow, and application."
SENTENCE = "{title} is best revised as a connected study topic that combines definition, role, flow, examples, and likely exam framing."
DEFINITION_PROMPT = ": a core idea that should be defined in your own words during revision."
OUTLINE_HEADINGS = ["{title} - Core Idea", "{title} - Definitions and Use", "{title} - Exam Notes"]
CHART_COLUMNS = ["Topic", "Key Idea", "Explanation"]
CHART_EXPLANATION = "Study the concept through definition, flow, and exam relevance rather than line-by-line copying."
#: Type, difficulty, question and hint of a section's questions; then their options and explanations.
QUESTIONS = [
    ("mcq", "medium", "Which option best identifies the main focus of {title}?", "Look for the option that captures the core role of {focus}."),
    ("conceptual", "medium", "Why is {focus} important when studying {title}?", "Explain the role of {focus}, the problem it solves, and how it connects to {compare}."),
    ("theory", "hard", "Explain {title} in an exam-style answer and include the role of {term} and {compare}.", "Structure the answer with definition, working, significance, and one example or comparison."),
    ("application", "hard", "How would you apply the ideas from {title} in a practical scenario or system design discussion?", "Describe a use case where {focus} influences design decisions, implementation, or troubleshooting."),
]
QUESTION_OPTIONS = {"mcq": ["Understanding {focus} and its role", "Only memorizing isolated syntax", "Ignoring system interactions", "Studying unrelated background trivia"]}
QUESTION_EXPLANATIONS = {
    "mcq": "The section centers on {focus} as a core concept rather than isolated facts.",
    "conceptual": "Strong answers should connect {focus} to purpose, flow, and exam relevance.",
    "theory": "This question checks whether the learner can write a full descriptive answer, not just a definition.",
    "application": "Application questions measure whether the concept can be used beyond rote memorization.",
}
#: Revision strategies: for one section, by difficulty, and for all others.
STRATEGIES = {
    "single": "Review the note once on the same day, then answer the conceptual and theory questions aloud.",
    "advanced": "Use a 1-3-7 day revision cycle, redraw the diagrams, and practice long-form theory answers for each section.",
    "intermediate": "Use a 1-3-7 day revision cycle and alternate between explanation recall, diagram review, and exam-style questions.",
    "other": "Start with the section summaries, then test yourself with the cue questions and application prompts.",
}
VOLUME_RULE = "Generated notes should preserve proportional depth instead of collapsing the document into a short summary."
#: What a format without content holds.
EMPTY_FORMATS = {"cornell": '{"cue":[],"notes":"","summary":""}', "outline": '{"sections":[]}', "mindmap": '{"root":"","branches":[]}', "chart": '{"columns":[],"rows":[]}', "sentence": '""'}
#: Preferences that are not given.
PREFERENCES = {"note_depth": "deep", "preferred_format": "cornell", "exam_focus": True, "include_examples": True, "include_diagrams": True}


def say(template: str) -> Column:
    """A template as a column; names in braces are columns."""
    return F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x])


def say_sql(template: str) -> str:
    """The same for DuckDB."""
    return " || ".join(x if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x)


def _bounds(items: Column, title: Column) -> Column:
    """(title, head_page, start, stop) of each chunk of (page, text, head) items: a heading or over 2200 characters end
    one; the title stays until the next heading.

    No window frame resets on a threshold, so a document's items are folded in its own row; the fold carries a length and
    places, never text, and adds to its result only where a chunk ends.
    """
    done_type = "array<struct<title: string, head_page: int, start: int, stop: int>>"

    def state(title, head_page, start, n, done):
        return F.struct(title.cast("string").alias("title"), head_page.cast("int").alias("head_page"), start.cast("int").alias("start"), n.cast("int").alias("n"), done.cast(done_type).alias("done"))

    def ended(a, start, stop):
        return F.concat(a.done, F.array(F.struct(a.title.alias("title"), a.head_page.alias("head_page"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))))

    none, zero = F.lit(-1), F.lit(0)

    def step(a, x):
        head = state(fn.heading_text(x.text, a.title), x.page, none, zero, F.when(a.start >= 0, ended(a, a.start, x.i)).otherwise(a.done))
        start = F.when(a.start < 0, x.i).otherwise(a.start)
        n = F.when(a.start < 0, F.length(x.text)).otherwise(a.n + 1 + F.length(x.text))
        more = F.when(n > FLUSH, state(a.title, F.lit(None), none, zero, ended(a, start, x.i + 1))).otherwise(state(a.title, a.head_page, start, n, a.done))
        return F.when(x.head, head).otherwise(more)

    numbered = F.transform(items, lambda x, i: F.struct(x.page.alias("page"), x.text.alias("text"), x.head.alias("head"), i.alias("i")))
    return F.aggregate(numbered, state(title, F.lit(None), none, zero, F.array()), step, lambda a: F.when(a.start >= 0, ended(a, a.start, F.size(items))).otherwise(a.done))


def _chunks_of(items: Column, bounds: Column) -> Column:
    def chunk(b, k):
        own = F.slice(items, b.start + 1, b.stop - b.start)
        pages = F.concat(F.transform(own, lambda x: x.page), F.when(b.head_page.isNotNull(), F.array(b.head_page)).otherwise(F.array().cast("array<int>")))
        return F.struct(
            F.concat(F.lit("section-"), k + 1).alias("section_id"), b.title.alias("title"),
            F.array_join(F.transform(own, lambda x: x.text), "\n\n").alias("raw_text"), F.array_sort(F.array_distinct(pages)).alias("pages"),
        )

    return F.transform(bounds, chunk)


def _merge(chunks: Column) -> Column:
    """Chunks under 350 characters joined to the one before; the first always stays."""

    def joined(c):
        heads = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.length(F.get(c, i)["raw_text"]) >= SMALL))

        def one(hs, h, j):
            own = F.slice(c, h + 1, F.coalesce(F.get(hs, j + 1), F.size(c)) - h)
            first = F.get(c, h)
            return F.struct(
                first["section_id"].alias("section_id"), first["title"].alias("title"),
                F.array_join(F.transform(own, lambda x: x["raw_text"]), "\n\n").alias("raw_text"),
                F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda x: x["pages"])))).alias("pages"),
            )

        return fn.once(heads, lambda hs: F.transform(hs, lambda h, j: one(hs, h, j)))

    return fn.once(chunks, joined)


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, document_title, __clean, level, source_pages, __items): the clean text, its difficulty, and its paragraphs as
    (page, text, head)."""
    base = docs.select("doc_id", fn.title_of_file(F.col("filename")).alias("document_title"), fn.clean(F.coalesce("text", F.lit(""))).alias("__clean"))
    base = base.withColumn("level", fn.difficulty(F.col("__clean")))
    base = base.withColumn("__pages", fn.pages(F.col("__clean"))).withColumn("source_pages", F.size("__pages").cast("bigint"))
    items = F.flatten(F.transform("__pages", lambda p: F.transform(fn.paragraphs(p.text), lambda x: F.struct(p.page.alias("page"), x.alias("text"), fn.is_heading(x).alias("head")))))
    return base.withColumn("__items", items).drop("__pages")


def chunks(docs: DataFrame, merge: bool = True) -> DataFrame:
    """(doc_id, nth, section_id, title, raw_text, pages, document_title, source_pages, level) from (doc_id, filename, text).
    No shuffle."""
    base = cleaned(docs).withColumn("__bounds", _bounds(F.col("__items"), F.col("document_title")))
    base = base.withColumn("__chunks", _chunks_of(F.col("__items"), F.col("__bounds")))
    base = base.withColumn("__found", F.when(F.size("__chunks") > 0, F.col("__chunks")).otherwise(lone_chunk()))
    found = base.select("doc_id", "document_title", "source_pages", "level", F.posexplode_outer(_merge(F.col("__found")) if merge else fn.once(F.col("__found"), lambda c: c)).alias("nth", "c"))
    return found.select("doc_id", F.col("nth").cast("bigint").alias("nth"), "c.*", "document_title", "source_pages", "level")


def lone_chunk() -> Column:
    """The chunk of a document without any: all its text."""
    text = F.coalesce(F.nullif("__clean", F.lit("")), F.lit(NO_TEXT))
    return F.array(F.struct(F.lit("section-1").alias("section_id"), F.col("document_title").alias("title"), text.alias("raw_text"), F.array(F.lit(1)).alias("pages"))).cast(T.ArrayType(_CHUNK))


def keywords(rows: DataFrame, keys: list[str], text: str, n: int = fn.KEYWORDS) -> DataFrame:
    """``keys`` with ``keywords``, as :func:`fn.top_keywords`; texts of equal keys count as one, and those without any go.

    A text with keys of its own is counted in its row: nothing but keys is grouped for it. Only where keys repeat, or more
    keywords are wanted than a row gives, tokens are counted before they are shuffled, over as many tasks as there are.
    """
    if n > fn.KEYWORDS:
        return _grouped_keywords(rows, keys, text, n)
    held = F.array(F.struct(F.slice(fn.top_keywords(F.col(text)), 1, n).alias("keywords")))
    alone = lambda r: dealt(r.select(*keys, text), *keys, text).select(*keys, F.inline_outer(held)).where(F.size("keywords") > 0)
    again = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").drop("__rows")
    if again.isEmpty():
        return alone(rows)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return alone(rows.join(again, same, "left_anti")).unionByName(_grouped_keywords(rows.join(again, same, "left_semi"), keys, text, n))


def _grouped_keywords(rows: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    tokens = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(fn.TOKEN), F.lit(0))).alias("pos", "word"))
    tokens = tokens.where((F.length("word") > 2) & ~F.col("word").isin(fn.STOP_WORDS))
    counts = tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= n)
    listed = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return listed.select(*keys, F.transform("w", lambda x: F.replace(x.word, F.lit("_"), F.lit(" "))).alias("keywords"))


def definitions(text: Column, words: Column) -> Column:
    """At most four definitions found in the text, else a prompt for each of the first three keywords."""
    prompts = F.transform(F.slice(words, 1, 3), lambda w: F.concat(fn.title_case(w), F.lit(DEFINITION_PROMPT)))
    return fn.once(fn.dedupe(fn.defined(text), 4), lambda found: F.when(F.size(found) > 0, found).otherwise(prompts))


def branches(title: Column, words: Column) -> Column:
    """array<struct<name, sub>>: every other keyword of six with the two that follow it."""
    head = F.when(F.size(words) > 0, F.slice(words, 1, 6)).otherwise(F.array(F.lower(title)))
    return F.transform(
        F.filter(F.transform(head, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.i % 2 == 0),
        lambda x: F.struct(fn.title_case(x.w).alias("name"), F.transform(F.slice(head, x.i + 2, 2), fn.title_case).alias("sub")),
    )


def branch_lines(tree: Column, depth: int) -> Column:
    """The lines of branches and their children, depth first."""
    pad = "  " * depth
    return F.array_join(F.transform(tree, lambda b: F.concat(F.lit(f"\n{pad}"), b["name"], F.array_join(F.transform(b["sub"], lambda s: F.concat(F.lit(f"\n{pad}  "), s)), ""))), "")


def mindmap(root: Column, lines: Column) -> Column:
    return F.concat(F.lit("mindmap\n  root(("), root, F.lit("))"), lines)


def sections(docs: DataFrame) -> DataFrame:
    """One row for each section, with what the template says about it. No shuffle."""
    rows = chunks(docs).withColumn("keywords", fn.top_keywords(F.col("raw_text")))
    rows = rows.withColumn("titles", F.transform("keywords", fn.title_case)).withColumn("definitions", definitions(F.col("raw_text"), F.col("keywords")))
    named = F.nullif(F.array_join(F.slice("titles", 1, 4), ", "), F.lit(""))
    t = F.col("title")
    rows = rows.withColumns({
        "named_or_central": F.coalesce(named, F.lit("the central topic")), "named_or_title": F.coalesce(named, t),
        "focus": F.coalesce(F.get("titles", F.lit(0)), fn.title_case(t)), "relate": F.coalesce(F.get("titles", F.lit(0)), t),
        "compare": F.coalesce(F.get("titles", F.lit(1)), F.lit("Related Concepts")),
    })
    rows = rows.withColumn("term", F.when(F.size("definitions") > 0, F.split(F.get("definitions", F.lit(0)), ":", 2)[0]).otherwise(F.col("focus")))
    # in these lists the first keyword stands as it is, or else the title
    listed = lambda xs: F.array(*[say(x.replace("{focus}", "{relate}")) for x in xs])
    return rows.withColumns({
        "branches": branches(t, F.col("keywords")), "excerpt": F.substring("raw_text", 1, EXCERPT),
        "topics": F.when(F.size("keywords") > 0, F.slice("titles", 1, 5)).otherwise(F.array(t)), "explanation": say(EXPLANATION), "key_points": listed(KEY_POINTS), "examples": listed(EXAMPLES), "use_cases": listed(USE_CASES),
        "important_notes": listed(IMPORTANT_NOTES), "why_this_matters": F.lit(WHY_THIS_MATTERS), "common_mistakes": listed(COMMON_MISTAKES), "test_yourself": listed(TEST_YOURSELF), "cue": listed(CUE), "summary": say(SUMMARY), "sentence": say(SENTENCE),
        "chart": F.array(t, F.coalesce(F.nullif(F.array_join(F.slice("titles", 1, 3), ", "), F.lit("")), F.lit("Core ideas")), F.lit(CHART_EXPLANATION)),
    }).withColumn("cornell", F.array_join(F.concat("key_points", "examples", F.slice("use_cases", 1, 1)), "\n")).withColumn("outline", outline())


def outline() -> Column:
    """array<struct<heading, points>>: the three parts of a section's outline."""
    points = [F.slice("key_points", 1, 2), F.concat(F.slice("definitions", 1, 2), F.slice("use_cases", 1, 1)), F.concat(F.slice("important_notes", 1, 2), F.slice("common_mistakes", 1, 1))]
    return F.array(*[F.struct(say(h).alias("heading"), p.alias("points")) for h, p in zip(OUTLINE_HEADINGS, points, strict=True)])


def questions_of() -> Column:
    """The four questions of a section: type, difficulty, question, options, answer_index, answer_hint, explanation."""
    none = F.array().cast("array<string>")

    def one(kind: str, hard: str, question: str, hint: str) -> Column:
        options = F.array(*map(say, QUESTION_OPTIONS[kind])) if kind in QUESTION_OPTIONS else none
        told = say(QUESTION_EXPLANATIONS[kind]).alias("explanation")
        return F.struct(
            F.lit(kind).alias("type"), F.lit(hard).alias("difficulty"), say(question).alias("question"), options.alias("options"),
            F.lit(0).alias("answer_index"), say(hint).alias("answer_hint"), told,
        )

    return F.array(*[one(*q) for q in QUESTIONS])


def exam_questions(s: DataFrame) -> DataFrame:
    """Four questions for each section: (doc_id, nth, place) and the fields of :func:`questions_of`."""
    return s.select("doc_id", "nth", F.posexplode(questions_of()).alias("place", "q")).select("doc_id", "nth", F.col("place").cast("bigint").alias("place"), "q.*")


def tree_of(branches: Column) -> Column:
    """Branches as nodes with ``sub_branches``."""
    leaf = lambda name: F.struct(name.alias("name"), F.array().cast("array<string>").alias("sub_branches"))
    return F.transform(branches, lambda b: F.struct(b["name"].alias("name"), F.transform(b["sub"], leaf).alias("sub_branches")))


#: What the full view of a package has of each section, after its place.
SECTION_FIELDS = {
    "section_id": "section_id", "title": "title", "page_numbers": "pages", "source_excerpt": "excerpt", "topics": "topics", "explanation": "explanation", "key_points": "key_points",
    "definitions": "definitions", "examples": "examples", "use_cases": "use_cases", "important_notes": "important_notes", "why_this_matters": "why_this_matters",
    "common_mistakes": "common_mistakes", "test_yourself": "test_yourself",
}


#: What of its sections each column of a package is made of.
PACKAGE_PARTS = {
    "cue": ["cue"], "notes": ["title", "cornell"], "summary": ["summary"], "outline": ["outline"], "mindmap": ["title", "branches"], "tree": ["title", "branches"],
    "chart": ["chart"], "sentence": ["title", "summary", "sentence"], "global_summary": ["title", "summary"],
}


def package(s: DataFrame, diagrams: DataFrame | None = None, full: bool = False, only: list[str] | None = None) -> DataFrame:
    """One row for each document: the five layouts over all its sections, summary and totals.

    ``diagrams`` has a row with ``doc_id`` for each diagram. One shuffle, of the sections' notes without their texts. With
    ``full`` also ``sections`` and ``questions``, as lists, and ``diagrams``, which then are those of
    :func:`matching.attached`, with ``doc_id``. ``only`` names, of the columns in :data:`PACKAGE_PARTS`, those that are
    wanted: nothing is evaluated or gathered for the others, which are left out.
    """
    wanted = list(PACKAGE_PARTS) if only is None else only
    columns = sorted({c for x in wanted for c in PACKAGE_PARTS[x]})
    if full:
        s = s.withColumn("section", F.struct(*[F.col(c).alias(k) for k, c in SECTION_FIELDS.items()])).withColumn("questions", questions_of())
        columns += ["section", "questions"]
    whole = s.groupBy("doc_id", "document_title", "source_pages", "level").agg(F.sort_array(F.collect_list(F.struct("nth", *columns))).alias("s"))
    each = lambda f: F.transform("s", f)
    overview = lambda: F.array_join(F.slice(each(lambda x: F.concat(x.title, F.lit(": "), x.summary)), 1, 4), " ")
    lines = lambda: F.array_join(each(lambda x: F.concat(F.lit("\n    "), x.title, branch_lines(x.branches, 3))), "")
    parts = {
        "cue": lambda: fn.dedupe(F.flatten(each(lambda x: x.cue)), 15),
        "notes": lambda: F.array_join(each(lambda x: F.concat(x.title, F.lit("\n"), x.cornell)), "\n\n"),
        "summary": lambda: F.array_join(F.slice(each(lambda x: x.summary), 1, 6), " "),
        "outline": lambda: F.flatten(each(lambda x: x.outline)),
        "mindmap": lambda: mindmap(F.col("document_title"), lines()),
        "tree": lambda: each(lambda x: F.struct(x.title.alias("name"), tree_of(x.branches).alias("sub_branches"))),
        "chart": lambda: each(lambda x: x.chart),
        "sentence": lambda: F.concat(overview(), F.lit("\n\n"), F.array_join(each(lambda x: x.sentence), "\n\n")),
        "global_summary": overview,
    }
    least, most = fn.target_pages(F.col("source_pages"))
    named = lambda kind: F.concat("document_title", F.lit(f" - {kind}"))
    lists = [each(lambda x: x.section).alias("sections"), F.flatten(each(lambda x: x.questions)).alias("questions")] if full else []
    made = whole.select(
        "doc_id", "document_title", F.size("s").cast("bigint").alias("total_sections"), (F.size("s") * len(QUESTIONS)).cast("bigint").alias("total_questions"),
        "source_pages", least.alias("least_pages"), most.alias("most_pages"), F.lit(VOLUME_RULE).alias("volume_rule"),
        named("Cornell Notes").alias("cornell_title"), named("Outline").alias("outline_title"), named("Mind Map").alias("mindmap_title"), named("Chart").alias("chart_title"),
        *[parts[x]().alias(x) for x in wanted], F.col("level").alias("difficulty_level"), revision_strategy(F.size("s"), F.col("level")).alias("revision"), *lists,
    )
    if diagrams is None:
        none = made.withColumn("total_diagrams", F.lit(0).cast("bigint"))
        return none.withColumn("diagrams", F.array().cast("array<string>")) if full else none
    shown = F.struct("diagram_id", "section_id", F.col("page").alias("page_number"), "caption", "explanation", "mermaid_code") if full else None
    counts = diagrams.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_diagrams"), *([F.sort_array(F.collect_list(shown)).alias("diagrams")] if full else []))
    met = made.join(counts, "doc_id", "left").withColumn("total_diagrams", F.coalesce("total_diagrams", F.lit(0).cast("bigint")))
    return met.withColumn("diagrams", F.coalesce("diagrams", F.array().cast(counts.schema["diagrams"].dataType))) if full else met


def layouts(p: DataFrame) -> dict[str, Column]:
    """The layouts of a package as structs, the sentence as text."""
    called = lambda kind: (F.col(f"{kind}_title").alias("title"), F.lit(kind).alias("format"))
    return {
        "cornell": F.struct(*called("cornell"), "cue", "notes", "summary"),
        "outline": F.struct(*called("outline"), F.col("outline").alias("sections")),
        "mindmap": F.struct(*called("mindmap"), F.col("document_title").alias("root"), F.col("mindmap").alias("mermaid"), F.col("tree").alias("branches")),
        "chart": F.struct(*called("chart"), F.array(*map(F.lit, CHART_COLUMNS)).alias("columns"), F.col("chart").alias("rows")),
        "sentence": F.col("sentence"),
    }


def full_view(p: DataFrame) -> Column:
    """A full package as JSON: its sections, layouts, diagrams, questions, summary, difficulty, strategy and volume."""
    notes = F.struct(*[c.alias(k) for k, c in layouts(p).items()]).alias("notes")
    least_most = F.struct(F.col("least_pages").alias("min"), F.col("most_pages").alias("max")).alias("target_note_pages")
    policy = F.struct("source_pages", least_most, F.col("volume_rule").alias("rule")).alias("note_volume_policy")
    strategy = F.col("revision").alias("recommended_revision_strategy")
    return F.to_json(F.struct("document_title", "total_sections", "sections", notes, "diagrams", "questions", "global_summary", "difficulty_level", strategy, policy))


def format_view(p: DataFrame, wanted: Column) -> Column:
    """The content of a package in the wanted format: the sentences as text, all else as JSON; ``full`` is the whole package,
    where it was built with ``full``, and unknown formats are Cornell."""
    low, known = F.lower(wanted), layouts(p)
    view = F.when(low == "full", full_view(p)) if "sections" in p.columns else F.when(F.lit(False), F.lit(""))
    for kind in ("sentence", "mindmap", "outline", "chart"):
        view = view.when(low == kind, known[kind] if kind == "sentence" else F.to_json(known[kind]))
    return view.otherwise(F.to_json(known["cornell"]))


def revision_strategy(n_sections: Column, level: Column) -> Column:
    return F.when(n_sections <= 1, STRATEGIES["single"]).when(level == "advanced", STRATEGIES["advanced"]).when(level == "intermediate", STRATEGIES["intermediate"]).otherwise(STRATEGIES["other"])


def words_of(value: Column, kind: T.DataType) -> Column:
    """The words in all strings of a value, arrays and structs at any depth; keys and numbers don't count."""
    zero = F.lit(0).cast("bigint")
    if isinstance(kind, T.StringType):
        return F.coalesce(fn.word_count(value).cast("bigint"), zero)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, zero, lambda n, x: n + words_of(x, kind.elementType)), zero)
    if isinstance(kind, T.StructType):
        return sum((words_of(value[f.name], f.dataType) for f in kind.fields), zero)
    return zero


def section_words(s: DataFrame) -> Column:
    """The words of a section's title, topics and five layouts."""
    mapped = mindmap(F.col("title"), branch_lines(F.col("branches"), 2)).alias("mermaid")
    shapes = [
        F.struct("cue", F.col("cornell").alias("notes"), "summary").alias("cornell"), F.struct("title", "outline").alias("outline"),
        F.struct(F.col("title").alias("root"), mapped, "branches").alias("mindmap"), "chart", "sentence",
    ]
    whole = F.struct("title", "topics", F.struct(*shapes).alias("formats"))
    return words_of(whole, s.select(whole.alias("w")).schema["w"].dataType)


def sections_table(s: DataFrame) -> DataFrame:
    """(id, note_id, title, order_index, word_count): untitled sections go, then the rest are numbered from 0. The count
    is of the title, the topics and all five layouts."""
    w = Window.partitionBy("doc_id").orderBy("nth")
    kept = s.where(F.coalesce("title", F.lit("")) != "").withColumn("order_index", (F.row_number().over(w) - 1).cast("bigint"))
    return kept.select(F.sha2(F.concat_ws("|", "doc_id", "order_index"), 256).alias("id"), F.col("doc_id").alias("note_id"), "title", "order_index", section_words(kept).alias("word_count"))


def format_rows() -> Column:
    """array<struct<format_type, content>>: a section's layouts as JSON, or the empty structure where one is null."""
    content = {
        "cornell": ("cornell", F.struct("cue", F.col("cornell").alias("notes"), "summary")), "outline": ("outline", F.struct("title", F.col("outline").alias("sections"))),
        "mindmap": ("branches", F.struct(F.col("title").alias("root"), "branches")), "chart": ("chart", F.struct(F.array(*map(F.lit, CHART_COLUMNS)).alias("columns"), F.array("chart").alias("rows"))),
        "sentence": ("sentence", None),
    }
    made = lambda k, given, c: F.when(F.col(given).isNull(), F.lit(EMPTY_FORMATS[k])).otherwise(F.col("sentence") if c is None else F.to_json(c))
    return F.array(*[F.struct(F.lit(k).alias("format_type"), made(k, *content[k]).alias("content")) for k in FORMATS])


def formats_table(s: DataFrame) -> DataFrame:
    """Five rows for each section: :func:`format_rows`."""
    return s.select("doc_id", "nth", F.inline(format_rows()))


def read_time(words: Column, n_sections: Column) -> Column:
    """Minutes for the words of all sections, 180 a minute, half to even, 1 at least; 0 without sections."""
    return F.when(n_sections == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(words / 180))).cast("bigint")


def note_record(s: DataFrame) -> DataFrame:
    """(note_id, total_sections, word_count, estimated_read_time, progress, is_favorite) of each normalised note."""
    n = sections_table(s).groupBy("note_id").agg(F.count(F.lit(1)).alias("total_sections"), F.sum("word_count").alias("word_count"))
    return n.select(
        "note_id", "total_sections", "word_count", read_time(F.col("word_count"), F.col("total_sections")).alias("estimated_read_time"),
        F.lit(0).alias("progress"), F.lit(False).alias("is_favorite"),
    )


def preferences(given: DataFrame) -> DataFrame:
    """Fills in the preferences that ``given`` has as null."""
    return given.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in PREFERENCES.items()})


def hint_images(images: DataFrame, most: int = 2, max_bytes: int = 4_000_000) -> DataFrame:
    """(note_id, nth, image_url): data URLs of the images, of at most ``max_bytes``, among each note's first ``most``
    hints. ``images`` has (note_id, nth, path, content)."""
    w = Window.partitionBy("note_id").orderBy("nth")
    first = images.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")
    kind = F.when(fn.extension(F.col("path")).isin("jpg", "jpeg"), "image/jpeg").otherwise("image/png")
    taken = first.where((F.coalesce("path", F.lit("")) != "") & F.col("content").isNotNull() & (F.octet_length("content") <= max_bytes))
    return taken.select("note_id", "nth", fn.data_url(F.col("content"), kind).alias("image_url"))


def hint_files(hints: DataFrame, path: str, most: int = 2, max_bytes: int = 4_000_000) -> DataFrame:
    """(note_id, nth, image_url): :func:`hint_images` of files, in folders ``image=<name>`` under ``path``. ``hints`` has
    (note_id, nth, path), ``path`` being the image's name.

    The sizes come from the listing, so files over ``max_bytes`` are never opened, and names prune folders.
    """
    spark = hints.sparkSession
    w = Window.partitionBy("note_id").orderBy("nth")
    first = hints.withColumn("__rank", F.row_number().over(w)).where((F.col("__rank") <= most) & (F.coalesce("path", F.lit("")) != ""))
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes).select("image", "content")
    met = first.join(files, first.path == files.image)
    kind = F.when(fn.extension(F.col("image")).isin("jpg", "jpeg"), "image/jpeg").otherwise("image/png")
    return met.select("note_id", "nth", fn.data_url(F.col("content"), kind).alias("image_url"))


def list_notes(static: DataFrame, generated: DataFrame) -> DataFrame:
    """(origin, id, title, topic, source, progress, is_favorite): static notes (0) before generated ones (1)."""
    def listed(rows, origin):
        return rows.select(
            F.lit(origin).alias("origin"), "id", "title", "topic", F.coalesce("source", F.lit("generated")).alias("source"),
            F.coalesce("progress", F.lit(0)).alias("progress"), F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        )

    return listed(static, 0).unionByName(listed(generated, 1))


def note_content(wanted: DataFrame, packages: DataFrame, static: DataFrame) -> DataFrame:
    """(note_id, format, content) for (note_id, format): of a generated note the view of its package, else of a static
    note its format or else its Cornell layout, else nothing. Packages have ``note_id``, static notes (note_id, layouts)
    with a map from format to content."""
    made = packages.join(wanted, "note_id").select("note_id", "format", format_view(packages, F.col("format")).alias("__made"))
    layout = lambda k: F.try_element_at("layouts", k)
    met = wanted.join(made, ["note_id", "format"], "left").join(static, "note_id", "left")
    return met.select("note_id", "format", F.coalesce("__made", layout(F.col("format")), layout(F.lit("cornell")), F.lit("")).alias("content"))


def stored_record(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(note_id, record): the stored normalised note as JSON, an empty object where there is none."""
    fields = [c for c in records.columns if c != "note_id"]
    found = records.select("note_id", F.to_json(F.struct(*fields)).alias("record"))
    return wanted.join(found, "note_id", "left").select("note_id", F.coalesce("record", F.lit("{}")).alias("record"))
