"""What the section queries evaluate: each costly step once for a row, and results that stay what they were."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillstream.functions import text as fn
from quillstream.operators import notes
from quillstream.plans import registry
from quillstream.sources.tables import notebooks

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_marks_are_read_once(spark):
    df = spark.createDataFrame([("[[PAGE_2]] a \n[[PAGE_3]]  [[PAGE_9]]\tb",), ("no mark",), ("[[PAGE_1]] ",), ("",)], "t string")
    got = df.select(fn.pages(F.col("t")).alias("p"))
    assert [[tuple(x) for x in r.p] for r in got.collect()] == [[(2, "a"), (9, "b")], [(1, "no mark")], [(1, "[[PAGE_1]] ")], [(1, "")]]
    assert plan(got).count("regexp_extract_all") == 1  # once, not again for every page


def test_chunks_are_merged_from_one_list_of_heads(spark):
    docs = spark.createDataFrame([(1, "a.txt", "x")], "doc_id long, filename string, text string")
    assert plan(notes.chunks(docs)).count("sequence(0") == 1


def test_sections_are_not_evaluated_again_by_a_filter(spark):
    for name in ("branch_tree", "chunk_merge"):
        text = plan(registry.QUERIES[name](spark, DIR))
        assert "Filter" not in text.replace("Filter isnotnull(name", ""), name


def test_keywords_of_odd_texts(spark):
    texts = ["b_b aa bbb aaa bbb B_B the The ab-", None, "", "été İi x1 K9-k9", " ".join(f"w{i:03}" for i in range(500)) + " w499 w100"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.top_keywords(F.col("t")).alias("k")).collect()]
    assert got[0] == ["b b", "bbb", "aaa", "ab-"] and got[1] == got[2] == []
    assert got[4] == ["w100", "w499", "w000", "w001", "w002", "w003", "w004", "w005"]
    assert Counter(map(len, got))[8] == 1


def test_strip_and_clean(spark):
    rows = [(" \t\x0b a  b \n\r\x0c",), ("a \u0085",), ("•x\r\n\r\r\n\n y\t\t z ",), ("   ",)]
    got = spark.createDataFrame(rows, "t string").select(fn.strip(F.col("t")).alias("s"), fn.clean(F.col("t")).alias("c")).collect()
    assert [r.s for r in got] == ["a  b", "a \u0085", "•x\r\n\r\r\n\n y\t\t z", ""]
    assert got[2].c == "x\n\ny z"


def test_one_row_group_is_dealt_out(spark, tmp_path):
    n = 2000
    rows = {"doc_id": list(range(n)), "text": [f"text {i * i} " * 20 for i in range(n)], "lang": ["en"] * n, "source": ["web"] * n}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    size = (tmp_path / "documents.parquet").stat().st_size
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 16))
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() >= 8  # parts, of which one has the rows
        got = notebooks(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in got) == n and len(got) >= 8 and max(r["count"] for r in got) < n / 4


def test_one_normalised_table_evaluates_its_own_columns(spark):
    for name in ("normalized_sections", "normalized_note"):
        text = plan(registry.QUERIES[name](spark, DIR))
        assert "_most_frequent" in text and "to_json" not in text and notes.WHY_THIS_MATTERS not in text, name  # sections, not the written rows


def test_summaries_take_no_keywords(spark):
    for name in ("global_summary", "package_totals"):
        assert "_most_frequent" not in plan(registry.QUERIES[name](spark, DIR)), name


def test_uploads_are_told_from_what_was_written(spark):
    assert "PAGE_" not in plan(registry.QUERIES["upload_flow"](spark, DIR))  # no preview from a text that is read again


def test_keywords_of_rows_and_of_repeated_keys(spark):
    rows = [(1, "bbb aaa aaa the"), (2, "ccc"), (2, "ddd ddd ccc_c"), (None, "eee"), (None, "fff eee"), (3, "a the"), (4, None)]
    got = {r.k: r.keywords for r in notes.keywords(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect()}
    assert {k: sorted(v) if k == 2 else v for k, v in got.items()} == {1: ["aaa", "bbb"], 2: ["ccc", "ccc c", "ddd"], None: ["eee", "fff"]}
    text = plan(registry.QUERIES["doc_keywords"](spark, DIR))
    assert text.count("_most_frequent") == 1 and "Aggregate" not in text  # a text is counted once, in its row
