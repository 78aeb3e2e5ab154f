"""Conversation repair, ranked search and mixing against brute force, SQL and edge cases."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import conversation_repair as repair
from quillstream.llm import common, line_dedup, mixing, registry, shingle_join
from quillstream.llm import ranked_search as search
from quillstream.llm.common import ROW, keyed

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_ranked_search", "op13_mixing"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    found, wanted = registry.QUERIES[name](spark, DIR), con.sql(registry.SQL[name])
    columns = sorted(found.columns)
    assert sorted(wanted.columns) == columns
    rows = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == sorted(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


# Conversation repair.
def conversation(r, conv, n) -> list[tuple]:
    texts = ["Fine.", "What?", "cut off", " \t", "", "Again!", None, *[f"text {i}." for i in range(6)]]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(conv, r.choice([None, i, i, i, i // 2]), r.choice(roles[:2] if r.random() < 0.6 else roles), r.choice(texts)) for i in range(n)]


def repaired(turns) -> dict:
    out: dict = {}
    for t in turns.collect():
        out.setdefault(t.conv, []).append(t)
    return out


@pytest.mark.parametrize("bits", [repair.PIECE_BITS, 2])
def test_repair_equals_brute_force(spark, bits):
    r = random.Random(bits)
    rows = [row for conv in [None, *range(60)] for row in conversation(r, conv, r.randint(1, 14))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), CONVERSATIONS).repartition(5)
    report, turns = repair.repair(df, piece_bits=bits)
    costs, plans = {x.conv: x.cost for x in report.collect()}, repaired(turns)
    for conv, (cost, audit, text) in repair.brute_force(rows).items():
        name = None if conv is None else str(conv)
        own = sorted(plans[name], key=lambda t: t.step)
        assert (costs[name], "".join(t.action for t in own)) == (cost, audit)
        assert tuple(f"{t.role}:{t.text}" for t in own if t.action != "D") == text
    hashed = {x.conv: x for x in repair.digested(turns).collect()}
    assert all(hashed[c].audit == "".join(t.action for t in own) for c, own in plans.items())


def test_long_conversation_lies_in_many_pieces(spark):
    r = random.Random(3)
    rows = [(7, i, r.choice(["user", "assistant", "system"]), r.choice([f"t{i}.", f"t{i}", "same."])) for i in range(900)]
    report, turns = repair.repair(spark.createDataFrame(rows, CONVERSATIONS).repartition(7), piece_bits=4)
    cost, audit, text = repair.brute_force(rows)[7]
    (got,), own = report.collect(), turns.orderBy("step").collect()
    assert got.cost == cost and "".join(t.action for t in own) == audit
    assert tuple(f"{t.role}:{t.text}" for t in own if t.action != "D") == text


def test_ties_go_to_the_least_audit():
    """Costs alone leave several paths; letters that only differ late decide, whatever the length."""
    for initials, faults, audit in (((1, 2), (0, 0), b"KK"), ((2, 1, 2), (0, 0, 0), b"DKK"), ((1, 1, 2), (0, 0, 0), b"DKK"), ((2, 2), (0, 0), b"RK")):
        codes = np.array([3 * i + f for i, f in zip(initials, faults, strict=True)], np.uint8)
        (four,), behind = repair.ranked_audits(codes, np.array([0]), np.array([len(codes)]), repair.AT_END[None])
        assert four[0] == audit and behind[0, 0] in (0, 3)
    codes = np.array([3 * (1 + i % 2) for i in range(3001)], np.uint8)  # one user turn too many, anywhere
    (four,), _ = repair.ranked_audits(codes, np.array([0]), np.array([len(codes)]), repair.AT_END[None])
    assert four[0] == b"K" * 3000 + b"D"


def test_repair_of_odd_tables(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 9, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("mine") for c in ("conv", "pos", "h1", "fault", "step", "kind", "read")})
    report, turns = repair.repair(df)
    got = {x.conv: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost) for x in report.collect()}
    assert got == {None: (0, 2, 0, 0, 1, 4), "1": (3, 0, 1, 0, 1, 2)}
    assert {k: "".join(t.action for t in v) for k, v in repaired(turns).items()} == {None: "DD", "1": "KDK"}
    report, turns = repair.repair(df.limit(0))
    assert report.count() == 0 and turns.count() == 0


def test_rows_that_all_go_leave_an_empty_conversation(spark, tmp_path):
    conv = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Hi.")], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert (row.conv_id, row.gaps, row.cost, row.audit) == (conv, 0, 0, "") and row.repaired_sha256.startswith("e3b0c442")


# Ranked search.
R = random.Random(11)
VOCABULARY = ["".join(R.choices("abcdeé", k=R.randint(1, 6))) for _ in range(150)]
POWER = [1 / (i + 1) for i in range(len(VOCABULARY))]


def prose(n: int) -> str:
    return "".join(w.title() + R.choice([" ", ", ", "_", "\n"]) for w in R.choices(VOCABULARY, POWER, k=n))


TEXTS = [(i, prose(R.randint(0, 120))) for i in range(120)] + [(120, None), (121, ""), (122, "..."), (123, prose(4000))] + [(130 + i, "tie word") for i in range(15)]
ITEMS = [(i, prose(R.randint(1, 25))) for i in range(20)] + [(20, None), (21, "nowhere"), (22, "word word tie")]


def answers(df) -> list:
    return sorted((r.item, r.rank, r.id, r.score) for r in df.collect())


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = sorted(search.brute_force(TEXTS, ITEMS))
    assert answers(search.search(docs, items)) == wanted
    assert [r[2] for r in wanted if r[0] == 22] == list(range(130, 140))
    monkeypatch.setattr(search, "SHARD_POSTINGS", 500)
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    assert answers(search.search(docs, items)) == wanted
    assert answers(search.search(docs, items, k=3)) == sorted(search.brute_force(TEXTS, ITEMS, 3))


def test_search_on_odd_tables(spark):
    docs = spark.createDataFrame([(None, "red fox"), (5, "red"), (5, "red"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("term", "shard", "block", "n", "item", "score")})
    items = spark.createDataFrame([(None, "fox"), (1, "Red fox"), (1, "red")], "item_id long, text string").withColumn("w", F.lit("mine"))
    got = sorted(((r.item, r.rank, r.id) for r in search.search(docs, items).collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, 1, None)] and len(got) == 7
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0


def test_reading_ends_when_bounds_are_resolved():
    """Exact best ones on random lists, with ties; on lists of two heights without reading all."""
    r = np.random.default_rng(4)
    for trial in range(60):
        n, n_terms = int(r.integers(1, 400)), int(r.integers(1, 9))
        have = r.random((n, n_terms)) < r.random(n_terms)
        owners, codes = np.nonzero(have)
        if not len(owners):
            continue
        tfs, m = r.integers(1, 4, len(owners)), r.integers(10, 13, n)
        lists = search.Lists(pa.array([str(c) for c in codes]), owners, tfs, m)
        weights = r.integers(1, 5, len(lists.terms))
        scores = np.zeros(n, np.int64)
        np.add.at(scores, owners, weights[np.array([lists.terms.to_pylist().index(str(c)) for c in codes])] * ((10**9 * tfs) // (1000 * tfs + 8 * m[owners])))
        order = [i for i in np.lexsort((np.arange(n), -scores)) if scores[i] > 0][:10]
        docs, found, _ = search.best_of(lists, np.arange(len(lists.terms)), weights, 10, 2)
        assert docs.tolist() == order and found.tolist() == scores[order].tolist()
    n = 20_000
    tfs = np.where(np.arange(n) < 10, 50, 1)
    lists = search.Lists(pa.array(["a"] * n + ["b"] * n), np.tile(np.arange(n), 2), np.tile(tfs, 2), np.full(n, 50))
    docs, _, read = search.best_of(lists, np.array([0, 1]), np.array([3, 2]))
    assert docs.tolist() == list(range(10)) and read < n / 50


def test_slices_break_at_no_word(monkeypatch):
    texts = ["", "ab cd" * 50, "x" * 300, "é" * 40 + " fin", "", "one two", "z"]
    counts, whole = search._words(pa.array(texts), None)
    monkeypatch.setattr(search, "SLICE_BYTES", 16)
    again, parts = search._words(pa.array(texts), None)
    rows = lambda t: sorted(map(tuple, zip(*(t.column(c).to_pylist() for c in ("doc", "term", "tf")), strict=True)))
    assert counts.tolist() == again.tolist() and rows(whole) == rows(parts)
    assert rows(whole) == sorted((i, w, n) for i, t in enumerate(texts) for w, n in Counter(t.split()).items())


# Mixing.
def test_hypergeometric_draws(spark):
    steps = 4000
    for total, good, n in ((10, 4, 5), (50, 50, 7), (9, 0, 3), (400, 130, 260), (1, 1, 0), (30, 12, 30)):
        u = ((F.col("id") + 0.5) / steps).cast("double")
        drawn = mixing._hypergeometric(*(F.lit(x).cast("bigint") for x in (total, good, n)), u)
        got = Counter(r[0] for r in spark.range(steps).select(drawn).collect())
        for k in range(good + 1):
            p = math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) if 0 <= n - k <= total - good else 0
            assert abs(got[k] - p * steps) <= 1.01, (total, good, n, k)


def test_splitting_keeps_every_quota(spark):
    quotas = [(s, (s * 37) % 11) for s in range(150)]
    rows = mixing.split(spark.createDataFrame(quotas, "s long, q long"), 6).collect()
    assert Counter({s: q for s, q in quotas if q}) == sum((Counter({r.s: r.q}) for r in rows if r.q), Counter())
    sizes = Counter()
    for r in rows:
        assert r.q >= 0
        sizes[r.shard] += r.q
    assert sorted(sizes) == list(range(6)) and max(sizes.values()) - min(sizes.values()) <= 3
    parts = mixing.blocks(spark.createDataFrame(rows)).collect()
    assert sorted((r.s, r.block) for r in parts) == sorted((s, b) for s, q in quotas for b in range(q))


def documents(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 90 if i % 50 else 3000))), ["b", "a", "é", "z", None, "aa"][min(5, int(r.expovariate(1)))]) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_comes_to_its_targets(spark):
    rows, df = documents(spark)
    docs, spans = mixing.mix(df, shards=5, block_words=64)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    wanted = dict(zip(order, mixing.brute_targets([sizes[s] for s in order]), strict=True))
    found, parts = docs.collect(), spans.collect()
    assert all(math.isclose(d.target, wanted[d.source]) and d.source_size == sizes[d.source] for d in found)
    taken, by_source = Counter(), Counter()
    own = {d[ROW]: d for d in found}
    for p in parts:
        taken[p[ROW]] += p.n
        by_source[own[p[ROW]].source] += p.n
        assert 0 < p.n <= 64 and 0 <= p["first"] and p["first"] + p.n <= own[p[ROW]].size
    assert all(taken[d[ROW]] <= 2 * d.size for d in found)
    assert all(by_source[s] == math.floor(wanted[s] + 0.5) for s in order)
    shards: dict = {}
    for p in parts:
        assert shards.setdefault((p.s, p.block), p.shard) == p.shard
    again = mixing.mix(df.repartition(4), shards=5, block_words=64)[1]
    key = lambda p: (p.id, p.shard, p.place, p.block, p["round"], p["first"], p.n)
    assert sorted(map(key, parts)) == sorted(map(key, again.collect()))


def test_mix_is_written_by_shard(spark, tmp_path):
    rows, df = documents(spark)
    _, spans = mixing.mix(df, shards=3, block_words=128)
    mixing.write_mix(spans, df, str(tmp_path / "mix"))
    texts = dict((i, t.split()) for i, t, _ in rows)
    got = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert len(got) == spans.count() and all(texts[r.id][r["first"] : r["first"] + r.n] == r.text.split() for r in got)


def test_mix_of_odd_tables(spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (1, None, "s"), (1, "", "s"), (2, "x " * 5000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("size", "s", "target", "drawn", "bucket", "id")})
    docs, spans = mixing.mix(df, block_words=100)
    assert sorted(((d.source, d.size, d.source_size) for d in docs.collect()), key=str) == [("s", 0, 0), ("s", 0, 0), ("t", 5000, 5000), (None, 3, 6), (None, 3, 6)]
    assert spans.agg(F.sum("n")).first()[0] == 7509
    docs, spans = mixing.mix(df.limit(0))
    assert docs.count() == 0 and spans.count() == 0


# Row keys.
def test_ids_decide_and_not_the_order_of_reading(spark):
    """The smallest id keeps a shared line, although another id is repeated and one is null."""
    shared = "a line that is in all of them"
    rows = [(50, shared), (3, shared), (9, "own " * 5), (9, "own " * 6), (None, shared)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {r.doc_id: r.kept_text for r in line_dedup.line_dedup(df).collect() if r.doc_id != 9} == {3: shared, 50: "", None: ""}
        assert [r.doc_id for r in keyed(df).orderBy(ROW).collect()] == [3, 9, 9, 50, None]


def test_joined_classes_are_named_by_ids(spark, tmp_path):
    """Ids are printed, not row keys, although one is repeated and one is null; groups by chains of near copies."""
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = words[:100] + ["other"] + words[101:]
    rows = [(50, " ".join(words)), (30, " ".join(words)), (None, " ".join(words)), (9, "alone " * 9), (9, "apart " * 9), (70, " ".join(near)), (None, "lost")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((x.doc_id, x.class_id, x.copies, x.n_links, x.group_id) for x in shingle_join.op10_shingle_join(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(50, 30, 3, 1, 30), (30, 30, 3, 1, 30), (None, 30, 3, 1, 30), (9, 9, 1, 0, 9), (9, 9, 1, 0, 9), (70, 70, 1, 1, 30), (None, None, 1, 0, None)], key=str)


def test_hashes_of_long_texts_leave_no_tables(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", 1000)
    monkeypatch.setattr(common, "_POWERS", {})
    monkeypatch.setattr(common, "_WRAPPED", {})
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    for values in (data, data[:700], np.concatenate([data, data])):
        hashes, short = common.PrefixHash(values), common.ShortHash(values)
        twice = common.PrefixHash(np.concatenate([values, values]))
        at = np.arange(0, len(values) - 50, 7)
        assert (hashes.of(at, 50) == twice.of(at + len(values), 50)).all()
        assert (short.of(at[1:], 9) == common.ShortHash(values[7:]).of(at[1:] - 7, 9)).all()
        assert len(common.gram_hashes(values, 20)) == len(values) - 19
    assert all(len(x) <= 1000 for x in [*common._POWERS.values(), *common._WRAPPED.values()])
