"""Order-dependent operators and edge cases against hand-written rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillstream.functions import text as fn
from quillstream.operators import activity, matching, notes, planner, quiz
from quillstream.sources import files, stores
from quillstream.streaming import log as streams

LOG = "event_id long, user_id long, ts timestamp_ntz, kind string, topic string, score int, filename string, note_id string, task_id int, done boolean, message string"


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOG)


def event(user=1, day="2024-01-10", kind="chat_message", topic=None, score=None, task=None, done=None):
    return (user, dt.datetime.fromisoformat(day + "T08:00:00"), kind, topic, score, None, None, task, done, None)


def one(df):
    return df.collect()[0]


def value(spark, expr, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_streak_needs_today_and_stops_at_gaps(spark):
    events = log(spark, event(1, "2024-01-10"), event(1, "2024-01-09"), event(1, "2024-01-09"), event(1, "2024-01-07"), event(2, "2024-01-09"))
    assert {r.user_id: r.streak for r in activity.current_streak(events, "2024-01-10").collect()} == {1: 2, 2: 0}
    assert {r.user_id: r.longest for r in activity.longest_streak(events).collect()} == {1: 2, 2: 1}


def test_topics_have_three_base_rows_and_six_at_most(spark):
    events = log(spark, *[event(topic=t) for t in ["a", "b", "b", "c", "d", "nlp"]], event(kind="quiz_completed", topic="ml", score=62), event(kind="quiz_completed", topic="ml", score=63))
    rows = {r.id: r for r in activity.topic_summary(events).collect()}
    assert sorted(rows, key=lambda i: rows[i].place) == ["nlp", "ml", "ds", "b", "a", "c"]
    assert (rows["nlp"].pct, rows["ml"].pct, rows["ds"].pct, rows["b"].pct) == (12, 62, 0, 20)  # 62.5 rounds to even
    assert rows["ds"].sub == "Start studying to build this topic" and rows["b"].color == "teal"


def test_heatmap_and_bars_fill_zeros(spark):
    events = log(spark, *[event(day="2024-03-31")] * 5, event(day="2024-03-30"))
    cells = activity.heatmap(events, "2024-03-31").collect()
    assert len(cells) == 126 and sum(c.level == "" for c in cells) == 124
    assert {(c.level, c.tip) for c in cells if c.level} == {("l4", "5 activities"), ("l1", "1 activity")}
    bars = activity.monthly_bar(events, "2024-03-31").orderBy("place").collect()
    assert [b.month for b in bars][-1] == "Mar" and [b.value for b in bars] == [0] * 11 + [36]


def test_tips_keep_order_and_planner_last_toggle_wins(spark):
    events = log(spark, event(kind="planner_task_done", task=1, done=True), event(kind="planner_task_done", task=2, done=True), event(kind="planner_task_done", task=1, done=False), event(kind="quiz_completed", score=0))
    assert [(t.title, t.body[:30]) for t in activity.tips(events).orderBy("place").collect()] == [("Quiz Feedback", "Your latest quiz score was 0%."), ("Planner Momentum", "You completed 2 planner task(s")]
    assert {r.task_id: r.done for r in planner.board(events).collect() if r.done} == {2: True}
    assert one(planner.progress(events)).percent == 20


def test_empty_log(spark):
    empty = log(spark).limit(0)
    for f in (activity.dashboard, activity.heatmap, activity.topic_summary, activity.tips, activity.monthly_bar, planner.board):
        assert f(empty).count() == 0


def test_attempts_given_values_win_but_a_score_of_zero(spark):
    rows = [(1, 1, p, 0.0, None, t, "mcq", ok) for p, (t, ok) in enumerate([("x", False), ("y", False), ("x", False), ("z", True)])]
    responses = spark.createDataFrame(rows, "attempt_id long, l_linenumber int, l_partkey long, l_extendedprice double, l_shipdate timestamp, topic string, type string, is_correct boolean")
    made = one(quiz.attempts(responses))
    assert (made.total, made.correct, made.score, made.weak_topics) == (4, 1, 25, ["x", "y"])
    assert made.types == {"mcq": 4}
    given = spark.createDataFrame([(1, 8, 5, 0, None)], "attempt_id long, total long, correct long, score long, weak_topics array<string>")
    assert one(quiz.attempts(responses, given)).score == 62 and one(quiz.attempts(responses, given)).weak_topics == ["x", "y"]
    assert one(quiz.attempts(responses, given.withColumn("weak_topics", F.array(*map(F.lit, "qpq"))))).weak_topics == ["q", "p"]
    assert quiz.last_attempts(quiz.attempts(responses), "total", 0).count() == 0


def test_text_functions(spark):
    t = F.col("t")
    assert value(spark, fn.clean(t), t="\r\n• a\t\tb \r c\n\n\n\nd\r\n") == "a b\nc\n\nd"
    assert value(spark, fn.paragraphs(t), t="a\n \nb\nc\n\n\n") == ["a", "b\nc"]
    assert [tuple(p) for p in value(spark, fn.pages(t), t="x [[PAGE_1]] a [[PAGE_2]]  [[PAGE_3]]b")] == [(1, "a"), (3, "b")]
    assert [tuple(p) for p in value(spark, fn.pages(t), t="[[PAGE_1]] ")] == [(1, "[[PAGE_1]] ")]
    heads = {"Chapter 3": True, "1.2 Title here": True, "particular words that go on": True, "Big Title": True, "a plain line of text": False, "": False, "X" * 91: False, ":::": False}
    for line, expected in heads.items():
        assert value(spark, fn.is_heading(t), t=line) is expected, line
    assert value(spark, fn.dedupe(t), t=["A", "a", " a  b", "a b", "", "c"]) == ["A", "a b", "c"]
    assert value(spark, fn.definition(t), t="A stack is a list...") == "A stack: a list."
    assert value(spark, fn.markdown(t), t="**a** *b* `c`\n") == "<strong>a</strong> <em>b</em> <code>c</code><br>"
    assert [value(spark, fn.extension(t), t=x) for x in ("a.b.PDF", "none")] == ["pdf", ""]


def python_chunks(items, title):
    done, parts, pages = [], [], []

    def flush():
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
        if len(" ".join(parts)) > 2200:
            flush()
    flush()
    merged = []
    for c in done:
        if merged and len(c[2]) < 350:
            m = merged[-1]
            merged[-1] = (m[0], m[1], m[2] + "\n\n" + c[2], sorted(set(m[3] + c[3])))
        else:
            merged.append(c)
    return merged


def test_chunks_equal_a_python_model(spark):
    body = lambda n: ("word " * n).strip()
    items = [(1, body(30), False), (1, "Chapter One", True), (1, body(300), False), (2, body(200), False), (2, "Chapter Two", True), (2, body(20), False), (3, "Chapter Three", True), (3, body(30), False), (3, body(440), False), (3, body(10), False)]
    pages = {p: "\n\n".join(t for q, t, _ in items if q == p) for p in (1, 2, 3)}
    text = "".join(f"[[PAGE_{p}]]\n{t}\n" for p, t in pages.items())
    docs = spark.createDataFrame([(1, "my_file-x.txt", text), (2, "a.txt", ""), (3, "b.txt", None)], "doc_id long, filename string, text string")
    found = [(r.section_id, r.title, r.raw_text, r.pages) for r in notes.chunks(docs).where("doc_id = 1").orderBy("nth").collect()]
    assert found == python_chunks(items, "My File X")
    assert {r.doc_id: r.raw_text for r in notes.chunks(docs).where("doc_id > 1").collect()} == {2: "No extracted text found.", 3: "No extracted text found."}


def test_keywords_and_package(spark):
    docs = spark.createDataFrame([(1, "a_b.txt", "graph graph tree_map tree_map the node. A node is a thing. A NODE is a thing.")], "doc_id long, filename string, text string")
    s = notes.sections(docs)
    row = one(s)
    assert row.keywords == ["node", "graph", "tree map", "thing"]
    assert row.definitions == ["A node: a thing."]
    assert row.topics == ["Node", "Graph", "Tree Map", "Thing"] and row.focus == "Node" and row.compare == "Graph"
    assert row.common_mistakes[0] == "Confusing Node with nearby related terms." and row.why_this_matters.startswith("This section matters")
    assert [tuple(x) for x in row.outline][1] == ("A B - Definitions and Use", ["A node: a thing.", "Use A B while discussing architecture, workflow, or implementation decisions."])
    p = one(notes.package(s))
    assert (p.total_sections, p.total_questions, p.total_diagrams, len(p.cue), len(p.outline)) == (1, 4, 0, 3, 3)
    assert p.mindmap == "mindmap\n  root((A B))\n    A B\n      Node\n        Graph\n        Tree Map\n      Tree Map\n        Thing"
    assert [list(x)[:2] for x in p.chart] == [["A B", "Node, Graph, Tree Map"]] and (p.least_pages, p.most_pages) == (1, 2)
    assert notes.exam_questions(s).count() == 4 and notes.formats_table(s).count() == 5 and one(notes.sections_table(s)).order_index == 0


def test_matching_ties_and_nearest(spark):
    diagrams = spark.createDataFrame([(1, 7, 9, "no match")], "note_id long, diagram_id long, page int, caption string")
    sections = spark.createDataFrame([(1, n, f"s{n}", "T", ["x"], [1]) for n in (2, 1)], "note_id long, nth long, section_id string, title string, topics array<string>, pages array<int>")
    best = one(matching.best_section(diagrams.withColumn("caption", F.lit("zzz")), sections))
    assert (best.section_id, best.score) == ("s1", 0)
    images = spark.createDataFrame([(1, 1, 0.0, 200.0, 50.0, 300.0), (2, 2, 0.0, 0.0, 1.0, 1.0)], "image_id long, page_id long, left double, top double, right double, bottom double")
    blocks = spark.createDataFrame([(1, 1, 90.0, 0.0, 99.0, 80.0, " gap 120 "), (1, 2, 90.0, 0.0, 99.0, 79.0, "gap 121"), (1, 3, 0.0, 900.0, 9.0, 950.0, "beside"), (1, 4, 0.0, 190.0, 9.0, 199.0, "")], "page_id long, nth long, x0 double, y0 double, x1 double, y1 double, text string")
    assert {r.image_id: r.near for r in matching.nearby_text(images, blocks).collect()} == {1: "gap 120 beside", 2: ""}


def test_title_case_starts_at_every_run_of_letters(spark):
    for x in ("b-o'neil 2x_émile", "ABC def", "x1y", "", "don't stop"):
        assert value(spark, fn.title_case(F.col("t")), t=x) == x.title()


def test_first_of_each_keeps_order(spark):
    assert value(spark, fn.dedupe_stripped(F.col("t")), t=[" b ", "A", "B", "a  x", "a x", " ", "c"]) == ["b", "A", "a  x", "a x", "c"]
    assert value(spark, fn.dedupe(F.col("t"), 2), t=["z", "Z ", "y", "x"]) == ["z", "y"]


def test_lower_keys(spark):
    given = '{"A b": " x ", "L": [{"K": "\\"Q\\": "}, 3, null, true], "É": {"Deep": "' + "y" * 3000 + '"}}'
    found = value(spark, fn.lower_keys(F.col("t")), t=given)
    assert found == '{"a b":"x","l":[{"k":"\\"Q\\":"},3,null,true],"é":{"deep":"' + "y" * 2000 + '"}}'
    assert value(spark, fn.lower_keys(F.col("t")), t="nope") is None


def test_tips_name_weak_topics(spark):
    events = log(spark, event(kind="quiz_completed", score=40)).withColumn("weak_topics", F.array(*map(F.lit, "abcd")))
    found = activity.tips(events).orderBy("place").collect()
    assert [(t.icon, t.title) for t in found] == [("🎯", "Quiz Feedback"), ("!", "Recommended Revision")] and found[1].body.startswith("Focus next on a, b, c. ")


def test_correctness_of_choices_and_own_words(spark):
    rows = [(["x"], "mcq", 1, 1, None, True), (["x"], "mcq", None, 1, True, False), (["x"], None, 0, 1, True, False), ([], "mcq", 1, 1, None, False), (["x"], "theory", 1, 1, True, True), (["x"], "theory", 1, 1, False, False)]
    df = spark.createDataFrame(rows, "options array<string>, kind string, selected int, answer int, own boolean, want boolean")
    got = df.select("want", quiz.correct(*[F.col(c) for c in ("options", "kind", "selected", "answer", "own")]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_files_are_read_as_text(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("é ok".encode() + b"\xff!")
    (tmp_path / "B.MD").write_text("# head")
    (tmp_path / "x.pptx").write_text("zip")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        p = "".join(f"<w:p><w:r><w:t>{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p>" for a, b in (("one ", "two"), ("", "")))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{p}</w:body></w:document>')
    (tmp_path / "bad.docx").write_text("no zip")
    found = files.read_files(spark, f"file://{tmp_path}")
    texts = {r.filename: r.text for r in files.extract_text(found).collect()}
    assert texts["a.txt"] == "é ok\ufffd!" and texts["B.MD"] == "# head" and texts["w.docx"] == "one two\n"
    assert all(texts[n] == f"[Extracted text from {n} - install PyPDF2/python-docx for real extraction]" for n in ("x.pptx", "bad.docx"))
    strict = {r.filename: (r.text, r.status) for r in files.extract_text_strict(found).collect()}
    assert strict["B.MD"] == (None, 400) and strict["w.docx"] == ("one two\n", 200) and strict["a.txt"][1] == 200


def test_damaged_files_are_no_text(monkeypatch):
    import io
    import sys
    import types
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a>" + "text " * 500 + "</a>")
    good = packed.getvalue()
    broken = good[:60] + bytes(b ^ 255 for b in good[60:90]) + good[90:]
    locked = bytearray(good)
    for at in (6, good.rindex(b"PK\x01\x02") + 8):  # says that the member is encrypted
        locked[at] |= 1
    assert files.docx_text(good) == "" and [files.docx_text(x) for x in (broken, bytes(locked), good[:40], b"", None)] == [None] * 5

    class Reader:
        def __init__(self, stream):
            text = stream.read().decode()
            if not text:
                raise ValueError("damaged")
            self.pages = [types.SimpleNamespace(extract_text=lambda x=x: x) for x in text.split("|")]

    monkeypatch.setitem(sys.modules, "PyPDF2", types.SimpleNamespace(PdfReader=Reader))
    assert files.pdf_text(b"a||b", True) == "[[PAGE_1]]\na\n\n[[PAGE_2]]\n\n\n[[PAGE_3]]\nb" and files.pdf_text(b"a||b", False) == "a\nb\n"
    assert files.pdf_text(b"", True) is None and files.pdf_text(None, False) is None


def test_stores_append_and_tolerate(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert stores.read(spark, path, stores.NOTE).count() == 0
    spark.createDataFrame([("k1", "ML")], "id string, topic string").write.json(path)
    (tmp_path / "s" / "part-x.json").write_text('{"id": "z", "progress": "many"}\n[]\n{oops\n')
    found = stores.read(spark, path, stores.NOTE).collect()
    assert sorted(r.topic or "" for r in found) == ["", "ML"] and [r.progress for r in found if r.id == "z"] == [None]


def test_notes_registered_again_replace_their_record(spark, tmp_path):
    store = stores.note_store(spark, f"file://{tmp_path}/s")
    made = spark.createDataFrame([("k1", "T", None), ("k2", "U", "ml")], "note_key string, document_title string, topic string")
    assert stores.register(made, store, "2024-01-02 10:00").count() == 2
    stores.register(made.withColumn("document_title", F.lit("newer")).limit(1), store, "2024-01-03 10:00")
    stores.register(made.withColumn("document_title", F.lit("older")), store, "2024-01-01 10:00")
    assert sorted((r.title, r.topic) for r in store.read().collect()) == [("U", "ML"), ("newer", "UPLOAD")]


def test_streams_keep_the_last_state_over_batches(spark, tmp_path):
    rows = [log(spark, event(kind="planner_task_done", task=1, done=True)), log(spark, event(kind="planner_task_done", task=1, done=False), event(2, kind="planner_task_done", task=3, done=True)).withColumn("event_id", F.col("event_id") + 10)]
    rows[0].write.parquet(f"{tmp_path}/in")
    for k in range(2):
        if k:
            rows[1].write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows[0].schema).parquet(f"{tmp_path}/in")
        found = streams.drain(streams.planner_state(stream), ["user_id", "task_id"], f"file://{tmp_path}/out")
        assert {tuple(r) for r in found.collect()} == ({(1, 1, False), (2, 3, True)} if k else {(1, 1, True)})


def test_sequence_ratio(spark):
    import difflib

    from quillstream.plans import documents

    pairs = [("abcd efgh", "abcd efgx"), ("", "x"), ("same", "same"), ("a" * 50, "b" * 50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", documents._ratio("a", "b").alias("r")).collect()
    assert all(abs(x.r - difflib.SequenceMatcher(None, x.a, x.b).ratio()) < 1e-12 for x in got)
    d = "/root/testdata/sf0.001"
    items = {r.item_id: " ".join(r.text.lower().split())[:2500] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert {r.item_id: r.too_similar for r in documents.too_similar(spark, d).collect()} == {i: difflib.SequenceMatcher(None, items[i], items[i + 1]).ratio() > 0.82 for i in items if i + 1 in items}


def test_uploads_are_the_same_with_and_without_written_sections(spark, tmp_path):
    from quillstream.operators.upload import upload
    from quillstream.sources import stores

    text = "1.1 Study Of Trees:\n\nA tree is a graph. Trees have leaves.\n\n\nMore about leaves and graphs."
    files = spark.createDataFrame([("a.txt", text.encode()), ("b.exe", b"x"), ("c.md", b"")], "filename string, content binary")
    shown = spark.createDataFrame([("a.txt", 1, 1, "a tree diagram")], "filename string, diagram_id long, page int, caption string")
    got = []
    for i, written in enumerate((True, False)):
        store = stores.note_store(spark, f"file://{tmp_path}/notes{i}")
        tables = upload(files, shown, store, f"file://{tmp_path}/log{i}", "2024-01-31 10:00", written)
        got.append([sorted(map(str, t.collect())) for t in tables] + [store.read().count()])
    assert got[0] == got[1] and list(map(len, got[0][:3])) == [3, 2, 1] and got[0][3] == 2
