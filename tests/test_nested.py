"""Trees, free-form JSON, chunks of documents that are rows, quizzes, matching and normalised tables, against Python."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.operators import chunking, matching, normalize, notes, quiz, trees
from quillstream.sources import stores

NODES = "tree long, node string, parent string, place long, name string"


def test_tree_of_four_levels_as_mermaid(spark):
    rows = [
        (1, "r", None, 0, "Root"), (1, "b", "r", 2, "Second"), (1, "a", "r", 1, "First"), (1, "c", "a", 1, "Child"), (1, "d", "c", 5, "Leaf five"), (1, "e", "c", 4, "Leaf four"),
        (1, "lost", "nowhere", 1, "Lost"), (2, "r", None, 0, "Other"), (2, "x", "y", 1, "Loop"), (2, "y", "x", 1, "Loop"),
    ]
    found = {r.tree: r.mermaid for r in trees.mermaid(spark.createDataFrame(rows, NODES).repartition(3)).collect()}
    assert found == {1: "mindmap\n  root((Root))\n    First\n      Child\n        Leaf four\n        Leaf five\n    Second", 2: "mindmap\n  root((Other))"}


def test_trees_deeper_than_the_session_allows_and_cycles_below_a_root(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None, 0, f"N{i}") for i in range(130)]
    rows = [*chain, (3, "r", None, 0, "R"), (3, "a", "r", 0, "A"), (3, "b", "a", 0, "B"), (3, "a", "b", 0, "A")]
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    found = trees.walk(spark.createDataFrame(rows, NODES)).collect()
    assert max(r.depth for r in found if r.tree == 1) == 129 and sorted((r.node, r.depth) for r in found if r.tree == 3) == [("a", 1), ("b", 2), ("r", 0)]
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before
    assert trees.walk(spark.createDataFrame([], NODES)).count() == 0


def test_words_of_json_of_any_shape(spark):
    r = random.Random(4)

    def value(depth: int):
        kind = r.choice(["text", "number", "null", "list", "object"] if depth else ["list", "object"])
        if kind == "list" and depth < 5:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        if kind == "object" and depth < 5:
            return {r.choice("abc") + str(i): value(depth + 1) for i in range(r.randrange(4))}
        return {"text": r.choice(["two words", "naïve_x 1", "", "…", 'a "b" c']), "number": r.choice([3, 2.5, True])}.get(kind)

    def words(v) -> int:
        if isinstance(v, str):
            return len(re.findall(r"\w+", v))
        return sum(map(words, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []))

    given = [(i, json.dumps(v), words(v)) for i, v in enumerate(value(0) for _ in range(80))]
    given += [(100, '"just a text"', 3), (101, "{broken", 0), (102, None, 0), (103, "12", 0), (104, '{"k": [[[["deep"]]]]}', 1)]
    found = trees.json_words(spark.createDataFrame(given, "id long, j string, want long"), ["id", "want"], "j").collect()
    assert len(found) == len(given) and all(x.words == x.want for x in found)


def python_chunks(items, title) -> list[tuple]:
    """(section, title, text, pages) of (page, text, head): one after the other."""
    done, parts, pages = [], [], []

    def flush() -> None:
        if parts:
            done.append((f"section-{len(done) + 1}", title, "\n\n".join(parts), sorted(set(pages))))
        parts.clear()
        pages.clear()

    for page, text, head in items:
        if head:
            flush()
            title, pages = text, [page]
            continue
        parts.append(text)
        pages.append(page)
        if len(" ".join(parts)) > notes.FLUSH:
            flush()
    flush()
    return done


@pytest.mark.parametrize("heads", [0.0, 0.002, 0.2])
def test_chunks_of_a_document_dealt_over_many_tasks(spark, monkeypatch, heads):
    monkeypatch.setattr(chunking, "SLICE", 64)
    r = random.Random(int(heads * 1000))
    docs = {}
    for doc, n in ((1, 2500), (2, 1), (3, 40), (4, 3)):
        texts = ["x" * r.choice([1, 2, 30, 300, 2199, 2200, 2201, 5000] if r.random() < 0.1 else [1, 5, 80, 120]) for _ in range(n)]
        docs[doc] = [(1 + i // 9, f"Title {i}" if r.random() < heads else t, False) for i, t in enumerate(texts)]
        docs[doc] = [(p, t, t.startswith("Title")) for p, t, _ in docs[doc]]
    docs[4] = [(1, "Title a", True), (2, "Title b", True)]
    rows = [(d, k, p, t, h, "Doc") for d, items in docs.items() for k, (p, t, h) in enumerate(items)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, k long, page int, text string, head boolean, document_title string").repartition(9)
    found: dict = {}
    for c in chunking.chunk_rows(df).orderBy("doc_id", "nth").collect():
        found.setdefault(c.doc_id, []).append((c.section_id, c.title, c.raw_text, list(c.pages)))
    assert found == {d: chunks for d, items in docs.items() if (chunks := python_chunks(items, "Doc"))}


def test_chunks_longer_than_slices_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SLICE", 4)
    monkeypatch.setattr(chunking, "BUCKET", 512)
    r = random.Random(5)
    docs = {d: [(1 + i // 5, "Title" if r.random() < 0.03 else "y" * r.choice([1, 60, 300, 2500 if d == 1 else 90]), False) for i in range(n)] for d, n in ((1, 120), (2, 4), (3, 5), (4, 33))}
    docs = {d: [(p, t, t == "Title") for p, t, _ in items] for d, items in docs.items()}
    rows = [(d, k, p, t, h, "Doc") for d, items in docs.items() for k, (p, t, h) in enumerate(items)] + [(None, 0, 1, "of no document", False, "Doc")]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, k long, page int, text string, head boolean, document_title string")
    found: dict = {}
    for c in chunking.chunk_rows(df).orderBy("doc_id", "nth").collect():
        found.setdefault(c.doc_id, []).append((c.section_id, c.title, c.raw_text, list(c.pages)))
    assert found == {d: chunks for d, items in docs.items() if (chunks := python_chunks(items, "Doc"))}


def test_texts_of_chunks_are_shuffled_once_and_not_written(spark, tmp_path, monkeypatch):
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {i}")), 512) for i in range(8)])
    head = F.col("k") % 50 == 7
    spark.range(6000).select((F.col("id") / 1500).cast("long").alias("doc_id"), (F.col("id") % 1500).alias("k"), F.lit(1).alias("page"), text.alias("text"), F.lit("Doc").alias("document_title")).withColumn("head", head).withColumn(
        "text", F.when(head, "Head").otherwise(F.col("text"))
    ).write.parquet(f"{tmp_path}/paragraphs")
    shared = tmp_path / "shared"
    monkeypatch.setattr(chunking, "scratch", lambda spark, name: f"file://{shared}/{name}-{len(list(shared.glob('*')))}-{random.random()}")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict[int, int]:
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=-1)
    size = 6000 * 49 // 50 * 1024
    assert chunking.chunk_rows(spark.read.parquet(f"{tmp_path}/paragraphs")).agg(F.sum(F.length("raw_text"))).first()[0] > size
    assert sum(n for at, n in stages().items() if at > before) < 1.3 * size  # 2.9 when texts went through each join
    assert sum(f.stat().st_size for f in shared.rglob("*") if f.is_file()) < 0.1 * size  # 1.05 when they were written with the sums
    assert len(list(shared.iterdir())) == 2  # the other tables are gone


def test_quiz_requests(spark):
    bank = spark.createDataFrame([("ML" if i % 3 else "nlp", i) for i in range(30)], "topic string, id long")
    own = spark.createDataFrame([("n1", k, 100 + k) for k in (3, 1, 2)], "note_id string, nth long, id long")
    titles = spark.createDataFrame([("n1", "ds", "My Note"), ("n2", None, "")], "note_id string, topic string, title string")
    asked = [(1, "all", None, 50), (2, "Ml", None, 5), (3, "nothing", None, 5), (4, "all", "n1", 2), (5, "all", "n2", 2), (6, "nlp", None, 0), (7, "nlp", None, -3), (8, "ml", None, 5)]
    got: dict = {}
    for x in quiz.serve(spark.createDataFrame(asked, "request_id long, topic string, note_id string, limit int"), bank, own, titles).orderBy("request_id", "nth").collect():
        got.setdefault(x.request_id, []).append(x)
    assert sorted(x.id for x in got[1]) == list(range(30)) and got[1][0].topic_label == "Mixed Quiz" and got[1][0].total == 30
    assert len({x.id for x in got[2]}) == 5 and all(x.id % 3 and x.total == 20 and x.topic_label == "ML" for x in got[2])
    assert [x.id for x in got[2]] != [x.id for x in got[8]]
    assert [(x.id, x.total, x.topic_label) for x in got[3]] == [(None, 0, "NOTHING")]
    assert [(x.id, x.total, x.topic, x.topic_label) for x in got[4]] == [(101, 3, "ds", "My Note"), (102, 3, "ds", "My Note")]
    assert [(x.id, x.total, x.topic, x.topic_label) for x in got[5]] == [(None, 0, "generated", "Generated Note")]
    assert [(x.id, x.total) for x in got[6] + got[7]] == [(None, 10), (None, 10)]


def test_best_sections_equal_all_pairs(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abc", k=r.randint(0, 6)))
    sections = [(n % 4, n, f"s{n}", r.choice([word(), "", None]), [word() for _ in range(r.randrange(4))], [r.randrange(5), r.randrange(5)]) for n in range(60)]
    diagrams = [(n % 5, n, r.randrange(6), r.choice([None, " ".join(word().upper() for _ in range(6))]) if n % 7 else word()) for n in range(80)]
    d = spark.createDataFrame(diagrams, "note_id long, diagram_id long, page int, caption string")
    s = spark.createDataFrame(sections, "note_id long, nth long, section_id string, title string, topics array<string>, pages array<int>")
    got = {x.diagram_id: (x.section_id, x.score) for x in matching.best_section(d, s).collect()}
    want = {}
    for note, diagram, page, caption in diagrams:
        low, own = (caption or "").lower(), []
        for of, nth, section, title, topics, pages in sections:
            if of == note:
                told = caption is not None
                score = 5 * (page in pages) + 3 * sum(t in low for t in topics if told) + 4 * bool(told and title and title in low)
                own.append((score, -nth, section))
        if own:
            want[diagram] = (max(own)[2], max(own)[0])
    assert got == want


def test_nearby_blocks_equal_all_pairs(spark):
    r = random.Random(3)
    box = lambda: (x := r.uniform(-50, 600), y := r.uniform(-50, 900), x + r.choice([0, 10, 90, 700]), y + r.choice([0, 12, 300]))
    images = [(i, i % 3, *box()) for i in range(30)]
    blocks = [(i % 3, i, *(float(round(v)) for v in box()), r.choice(["a", " b ", ""]) + str(i)) for i in range(150)]
    got = matching.nearby_text(
        spark.createDataFrame(images, "image_id long, page_id long, left double, top double, right double, bottom double"),
        spark.createDataFrame(blocks, "page_id long, nth long, x0 double, y0 double, x1 double, y1 double, text string"),
    )
    want = {}
    for i, page, left, top, right, bottom in images:
        near = []
        for of, nth, x0, y0, x1, y1, text in blocks:
            gap = min(abs(y1 - top), abs(y0 - bottom))
            if of == page and (gap <= 120 or not (x1 < left or x0 > right)):
                near.append((gap, nth, text.strip()))
        want[i] = " ".join(t for _, _, t in sorted(near)[:3])
    assert {x.image_id: x.near for x in got.collect()} == want


def test_large_files_are_not_opened(spark, tmp_path):
    for name, size in (("a.png", 10), ("b.jpg", 50), ("c.png", 5)):
        (tmp_path / f"image={name}").mkdir()
        (tmp_path / f"image={name}" / "part-0").write_bytes(b"x" * size)
    hints = spark.createDataFrame([(1, 1, "b.jpg"), (1, 2, "a.png"), (1, 3, "c.png"), (2, 1, ""), (2, 2, "c.png"), (3, 1, None), (3, 2, "none.png")], "note_id long, nth long, path string")
    df = notes.hint_files(hints, f"file://{tmp_path}", max_bytes=20)
    assert {(x.note_id, x.nth): x.image_url for x in df.collect()} == {(1, 2): "data:image/png;base64,eHh4eHh4eHh4eA==", (2, 2): "data:image/png;base64,eHh4eHg="}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,20)" in plan[plan.index("PushedFilters") :]


def test_normalised_tables_are_linked(spark):
    docs = spark.createDataFrame([(1, "my_file.txt", "Chapter 1\n\nA stack is a list.\n\nChapter 2\n\n" + "A graph is a set. " * 30), (2, ".txt", ""), (3, "x.txt", None)], "doc_id long, filename string, text string")
    sections = notes.sections(docs)
    sections = sections.withColumn("title", F.when(F.col("doc_id") != 2, F.col("title")).otherwise(""))
    sections = sections.withColumn("topics", F.array(*map(F.lit, (" A ", "a", "", "B")))).withColumn("explanation", F.concat(F.lit("  "), F.repeat(F.lit("y"), 3000)))
    subjects = spark.createDataFrame([(1, "ML"), (2, None)], "note_id long, subject string")
    shown = spark.createDataFrame([(1, 7, 1, "a stack"), (3, 8, 9, "other")], "note_id long, diagram_id long, page int, caption string")
    tables = normalize.normalize(sections, subjects, matching.attached(shown, sections.withColumnRenamed("doc_id", "note_id")))
    found = {x.note_id: x for x in tables.note.collect()}
    assert (found[1].subject, found[1].tags, found[1].difficulty) == ("ML", ["ML"], "beginner") and found[1].total_sections >= 1
    assert (found[2].subject, found[2].tags, found[2].total_sections, found[2].estimated_read_time) == ("general", [], 0, 0) and found[3].total_sections == 1
    assert all((x.topics, x.explanation) == (["A", "B"], "y" * 2000) for x in tables.section_content.collect())
    n = tables.sections.count()
    assert {(x.child, x.parent): (x.rows, x.orphans) for x in tables.orphans().collect()} == {
        ("section_content", "sections"): (n, 0), ("formats", "sections"): (5 * n, 0), ("diagrams", "sections"): (2, 0), ("sections", "note"): (n, 0), ("quiz", "note"): (4 * n, 0),
    }
    kinds = [(x.kind, x.place) for x in tables.quiz.where("note_id = 3").collect()]
    assert sorted(kinds) == [("long", 0), ("long", 1), ("mcq", 0), ("short", 0)]
    again = normalize.normalize(sections, subjects, matching.attached(shown, sections.withColumnRenamed("doc_id", "note_id")))
    assert {x.section_id for x in again.sections.collect()} == {x.section_id for x in tables.sections.collect()}


def test_full_view_holds_the_whole_package(spark):
    docs = spark.createDataFrame([(1, "a_b.txt", "A node is a thing. " * 40)], "doc_id long, filename string, text string")
    s = notes.sections(docs)
    shown = spark.createDataFrame([(1, 7, 1, "node")], "note_id long, diagram_id long, page int, caption string")
    attached = matching.attached(shown, s.withColumnRenamed("doc_id", "note_id")).withColumnRenamed("note_id", "doc_id")
    p = notes.package(s, attached, full=True)
    view = lambda p, kind: p.select(notes.format_view(p, F.lit(kind)).alias("v")).first().v
    full = json.loads(view(p, "FULL"))
    assert list(full) == ["document_title", "total_sections", "sections", "notes", "diagrams", "questions", "global_summary", "difficulty_level", "recommended_revision_strategy", "note_volume_policy"]
    assert full["sections"][0]["page_numbers"] == [1] and len(full["questions"]) == 4 and full["questions"][0]["options"][0] == "Understanding Node and its role"
    assert full["diagrams"][0]["explanation"].startswith("This diagram belongs with") and full["notes"]["mindmap"]["branches"][0]["sub_branches"][0]["sub_branches"] is not None
    assert json.loads(view(p, "anything"))["format"] == "cornell" and json.loads(view(notes.package(s), "full"))["cue"]
    assert notes.package(s, full=True).select("diagrams").first().diagrams == []


def test_scratch_folders_are_shared(spark):
    assert stores.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
