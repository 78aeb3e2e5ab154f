"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set intersections decide.

1. Every text becomes the set of its shingles (five consecutive words); texts with equal sets are one class, and only
   the classes' representatives, their smallest row keys, go on.
2. Each has a label in ``TREES`` prefix tries: ``DEEPEST`` minima of its own for each tree. The tries are a table sorted by
   tree and label, so the rows of a node lie together. Only subtrees are stored that two share at the floor: the depth at
   which pairs at the threshold share a prefix in some tree with the target recall (:func:`floor_for`).
3. Long prefixes first: what shares ``TRUNK`` minima in a row is one family at once. Then the matched prefixes are
   shortened one minimum at a time, down to the floor. A node is looked into only if it holds several families; there
   signatures that agree in ``LIKELY`` of their places join their families (eight standard deviations below the
   threshold). So large groups of near copies are one family before their shallow nodes, which are large, come up.
   A node's rows meet in cells of two blocks of ``BLOCK`` rows; those of its largest family only meet the others.
4. A family's sets meet in cells of two blocks of ``BLOCK`` representatives, so a large family is many tasks. A cell
   counts all intersections exactly, by products of 0/1 matrices, adds up each representative's links and gives one edge
   for each member of a linked group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import row_slices
from .common import ROW, PrefixHash, cut, keyed, mix, packed, release, utf8_parts
from .substring_dedup import word_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99999
TREES, DEEPEST, TRUNK, LIKELY = 32, 8, 24, 0.6
BLOCK, COLUMNS, SLICE = 512, 8192, 1_000_000


def floor_for(threshold: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs at ``threshold`` share one in some tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, as hashes back to back, and where each text's begin.

    A text of fewer than five words, but not none, is one shingle.
    """
    words, first = word_hashes(data, starts)
    n = np.diff(first)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = PrefixHash(words).of(first[:-1][owner] + nth, size[owner])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, begins: np.ndarray, places: int) -> np.ndarray:
    """A row of ``places`` minima for each text; texts without shingles get the largest value everywhere."""
    full = np.flatnonzero(np.diff(begins) > 0)
    out = np.full((len(begins) - 1, places), 0xFFFFFFFF, np.uint32)
    if not len(full):
        return out
    seeds = mix(np.arange(1, places + 1, dtype=np.uint64))
    low, at = (hashes >> np.uint64(16)).astype(np.uint32), begins[full]
    for k, seed in enumerate(seeds.tolist()):
        v = (low ^ np.uint32(seed & 0xFFFFFFFF)) * np.uint32((seed >> 32) | 1)
        v ^= v >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(v, at)
    return out


def sketch(docs: DataFrame, text: str, floor: int) -> DataFrame:
    """``docs`` (without the text) with the set's hash (s1, s2), its size ``n``, for each tree the key of its prefix of
    ``floor`` minima, and the signature: a byte of each of ``DEEPEST`` minima for each tree."""
    names = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(len(names)))
            for a, b in row_slices(starts, SLICE):
                hashes, begins = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)))]) for salt in (1, 2)]
                s1, s2 = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
                sig = signatures(hashes, begins, TREES * DEEPEST)
                keys = np.zeros((b - a, TREES), np.uint64)
                for t in range(TREES):
                    k = np.full(b - a, t + 1, np.uint64)
                    for d in range(floor):
                        k = mix(k ^ mix(sig[:, t * DEEPEST + d].astype(np.uint64) + np.uint64(d)))
                    keys[:, t] = k
                raw = (sig & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(whole.column(i).slice(a, b - a) for i in range(len(names))),
                        pa.array(s1),
                        pa.array(s2),
                        pa.array(np.diff(begins).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * TREES, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                    ],
                    names=[*names, "s1", "s2", "n", "keys", "sig"],
                )

    return docs.select(*names, text).mapInArrow(run, f"{kinds}, s1 bigint, s2 bigint, n int, keys array<bigint>, sig binary")


def grouped(batches, column: int):
    """Tables of whole groups, from batches in which the rows of a group, by ``column``, follow each other."""
    rest = None
    for batch in (*batches, None):
        have = [x for x in (rest, batch) if x is not None and x.num_rows]
        if not have:
            continue
        table = pa.Table.from_batches(have).combine_chunks().to_batches()[0]
        if batch is not None:
            key = table.column(column).to_numpy()
            other = key != key[-1]
            last = len(key) - int(np.argmax(other[::-1])) if other.any() else 0
            table, rest = table.slice(0, last), table.slice(last)
        if table.num_rows:
            key = table.column(column).to_numpy()
            yield table, np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))


def node_edges(nodes: DataFrame, likely: float) -> DataFrame:
    """(a, b): edges between families of one node that a likely pair of their rows connects.

    ``nodes`` has (node, row, root, sig), and of each node the number ``n`` of its rows, its largest family ``major`` and
    the number ``k`` of the rows outside it. The others meet each other and the largest family, in cells of two blocks of
    about ``BLOCK`` rows, so a large node is many tasks. A cell gives one edge for each family that it connects.
    """
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    dealt = nodes.withColumn("g", blocks(F.col("k"))).withColumn("h", blocks(F.col("n") - F.col("k"))).withColumn("in_major", F.col("root") == F.col("major"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("row"), F.when(F.col("in_major"), F.col("h")).otherwise(F.col("g"))).cast("int"))
    i, upto = F.col("i"), lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(F.col("g")), lambda j: F.struct(F.least(i, j).alias("x"), F.greatest(i, j).alias("y"), F.lit(False).alias("m")))
    facing = F.transform(upto(F.col("h")), lambda j: F.struct(i.alias("x"), j.alias("y"), F.lit(True).alias("m")))
    faced = F.transform(upto(F.col("g")), lambda j: F.struct(j.alias("x"), i.alias("y"), F.lit(True).alias("m")))
    cells = dealt.select("node", "row", "root", "sig", F.explode(F.when(F.col("in_major"), faced).otherwise(F.concat(among, facing))).alias("c"))
    cells = cells.select(F.xxhash64("node", "c.x", "c.y", "c.m").alias("cell"), "row", "root", "sig")

    def run(batches):
        for table, edges in grouped(batches, 0):
            roots = table.column(2).to_numpy()
            sig = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(roots), -1)
            need, out = likely * sig.shape[1], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, (names, family) = sig[a:b], np.unique(roots[a:b], return_inverse=True)
                rows_of = np.split(np.argsort(family, kind="stable"), np.cumsum(np.bincount(family))[:-1])
                left = np.ones(b - a, bool)
                for f in sorted(range(len(names)), key=lambda f: len(rows_of[f])) if len(names) > 1 else ():
                    if not left[rows_of[f][0]]:
                        continue
                    reached, wave = [f], rows_of[f].tolist()
                    left[wave] = False
                    while wave and left.any():  # all that a chain of likely pairs reaches
                        x, rest = wave.pop(), np.flatnonzero(left)
                        for g in np.unique(family[rest[(own[rest] == own[x]).sum(axis=1) >= need]]).tolist():
                            reached.append(g)
                            wave += rows_of[g].tolist()
                            left[rows_of[g]] = False
                    low = names[reached].min()
                    out += [(low, x) for x in names[reached] if x != low]
            if out:
                pairs = np.unique(np.array(out, np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node to. Smallest labels pass along the edges and
    then to where they point, in written rounds, until none changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("a")).select("node", "root", F.least("root", "heard").alias("new"))
        ends = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = cut(nearer.join(ends, F.col("new") == F.col("at"), "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new")))
        if new.where("new != root").isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("root"))


def linked(a: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted arrays) have at least the threshold's Jaccard similarity, counted exactly."""
    sizes = np.array([len(x) for x in a])
    values, where = np.unique(np.concatenate(a), return_inverse=True) if len(a) else (np.zeros(0), np.zeros(0, int))
    shared = np.flatnonzero(np.bincount(where, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    row, col = np.repeat(np.arange(len(a)), sizes), column[where]
    both = np.zeros((len(a), len(a)), np.float32)  # counts below 2 ** 24 are exact in float32
    for c in range(0, len(shared), COLUMNS):
        here = (col >= c) & (col < c + COLUMNS)
        m = np.zeros((len(a), min(COLUMNS, len(shared) - c)), np.float32)
        m[row[here], col[here] - c] = 1
        both += m @ m.T
    out = both.astype(np.float64) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(out, False)
    return out


def verify(docs: DataFrame, families: DataFrame, text: str, threshold: float, pairs: bool = False) -> DataFrame:
    """(a, b, n): for b null, n of a's links in one cell; else an edge of a linked group, or with ``pairs`` a link.

    ``families`` has (node, root).
    """
    sizes = families.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    blocked = families.join(sizes.where("m > 1"), "root").select("node", "root", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    blocked = blocked.withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))

    def sets(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(4))
            for a, b in row_slices(starts, SLICE):
                hashes, begins = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                raw = [hashes[s:e].tobytes() for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(whole.column(k).slice(a, b - a) for k in range(4)), pa.array(raw, pa.binary())], names=["node", "root", "g", "i", "items"])

    with_sets = docs.select(ROW, text).join(blocked.hint("shuffle_hash"), F.col(ROW) == F.col("node")).select("node", "root", "g", "i", text).mapInArrow(
        sets, "node bigint, root bigint, g int, i int, items binary",
    )
    cells = with_sets.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j")).select(
        F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "node", "i", (F.col("i") == F.col("j")).alias("own"), "items"
    )

    def run(batches):
        for table, edges in grouped(batches, 0):
            nodes, block, own = table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3).to_numpy(zero_copy_only=False)
            ends_a, ends_b, ends_n = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                close = linked([np.frombuffer(x, np.uint64) for x in table.column(4).slice(a, b - a).to_pylist()], threshold)
                if not own[a]:  # a cell of two blocks: links inside a block belong to the block's own cell
                    close &= block[a:b, None] != block[None, a:b]
                degree, names = close.sum(axis=1), nodes[a:b]
                some = np.flatnonzero(degree)
                ends_a += names[some].tolist()
                ends_b += [None] * len(some)
                ends_n += degree[some].tolist()
                if pairs:
                    x, y = np.nonzero(np.triu(close))
                    ends_a += np.minimum(names[x], names[y]).tolist()
                    ends_b += np.maximum(names[x], names[y]).tolist()
                    ends_n += [1] * len(x)
                    continue
                left = set(some.tolist())
                while left:
                    top = left.pop()
                    group, wave = [top], [top]
                    while wave and left:
                        near = [k for k in np.flatnonzero(close[wave.pop()]).tolist() if k in left]
                        left.difference_update(near)
                        wave += near
                        group += near
                    low = names[group].min()
                    ends_a += [int(low)] * (len(group) - 1)
                    ends_b += [int(x) for x in names[group] if x != low]
                    ends_n += [0] * (len(group) - 1)
            if ends_a:
                yield pa.RecordBatch.from_arrays([pa.array(ends_a, pa.int64()), pa.array(ends_b, pa.int64()), pa.array(ends_n, pa.int64())], names=["a", "b", "n"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint, n bigint")


def forest(sketched: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, label, row): the written tries, sorted. ``key`` is a tree's subtree at the floor, ``label`` the minima from the
    tree's first on, ``TRUNK`` of them. Subtrees with one row are left out."""
    keys = cut(reps.select(F.posexplode("keys").alias("tree", "key"), F.col(ROW).alias("row")))
    met = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    label = F.substring(F.concat("sig", "sig"), F.col("tree") * DEEPEST + 1, F.lit(TRUNK))
    shared = keys.join(met, "key").join(sketched.select(F.col(ROW).alias("row"), "sig"), "row").select("key", label.alias("label"), "row")
    order = ["key", "label", "row"]
    tries = cut(shared.repartitionByRange(*order).sortWithinPartitions(*order))
    release(keys, met)
    return tries


def descend(tries: DataFrame, signatures: DataFrame, floor: int, likely: float) -> DataFrame:
    """(row, root): the family of each row of the tries, found by shortening matched prefixes down to the floor."""
    if tries.isEmpty():  # no two texts share a prefix
        return cut(tries.select("row", F.col("row").alias("root")))
    at = tries.select(F.xxhash64("key", "label").alias("node"), "row")
    heads = at.groupBy("node").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "a")
    labels = components(at.join(heads, "node").where("row != a").select("a", F.col("row").alias("b")).distinct())
    roots = tries.select("row").distinct().join(labels, F.col("row") == F.col("node"), "left")
    roots = cut(roots.select("row", F.coalesce("root", "row").alias("root")))
    for depth in range(max(DEEPEST, floor), floor - 1, -1):
        placed = tries.select(F.xxhash64("key", F.substring("label", 1, depth)).alias("node"), "row").join(roots, "row")
        families = placed.groupBy("node", "root").agg(F.count(F.lit(1)).alias("m"))
        mixed = families.groupBy("node").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("f"), F.max_by("root", F.struct("m", "root")).alias("major"), F.max("m").alias("most"))
        mixed = cut(mixed.where("f > 1").select("node", "n", "major", (F.col("n") - F.col("most")).alias("k")))
        if mixed.isEmpty():
            continue
        edges = cut(node_edges(placed.join(mixed, "node").join(signatures, "row").select("node", "row", "root", "sig", "n", "major", "k"), likely).distinct())
        labels = components(edges).select(F.col("node").alias("old"), F.col("root").alias("new"))
        roots = cut(roots.join(labels, F.col("root") == F.col("old"), "left").select("row", F.coalesce("new", "root").alias("root")))
    return roots


def candidates(sketched: DataFrame, floor: int, likely: float = LIKELY) -> tuple[DataFrame, DataFrame]:
    """(classes, families) of written sketches: classes as (s1, s2, rep, copies), with ``rep_id`` where sketches have ``id``;
    families of reps as (node, root)."""
    named = [F.min_by("id", ROW).alias("rep_id")] if "id" in sketched.columns else []
    classes = cut(sketched.groupBy("s1", "s2").agg(F.min(ROW).alias("rep"), F.count(F.lit(1)).alias("copies"), *named))
    reps = sketched.where("n > 0").join(classes.select(F.col("rep").alias(ROW)), ROW)
    tries = forest(sketched, reps)
    roots = descend(tries, sketched.select(F.col(ROW).alias("row"), "sig"), floor, likely)
    release(tries)
    return classes, roots.select(F.col("row").alias("node"), "root")


def shingle_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: (ROW, id, class_id, copies, n_links, group_id, class_doc, group_doc).

    ``class_id`` is the smallest row key with the same set of shingles, ``copies`` the rows of that class, ``n_links``
    the number of other classes whose sets have a Jaccard similarity of ``threshold`` or more, and ``group_id`` the
    smallest row key that a chain of such links reaches. ``class_doc`` and ``group_doc`` are the ids of these two rows:
    row keys are in the order of ids, so they are the smallest ids, null only where no row has one.

    Words lie between ASCII white space. A text of one to four words is one shingle. Null and empty texts have no
    shingles; they are one class, without links. Rows with a null or repeated id are documents of their own. An empty
    table gives an empty one. Other columns of ``docs`` are not read, whatever their names.
    """
    docs = keyed(docs, id_col)
    likely, floor = LIKELY * threshold / THRESHOLD, floor_for(threshold, recall)
    sketched = cut(sketch(docs.select(ROW, F.col(id_col).alias("id"), text), text, floor))
    classes, families = candidates(sketched, floor, likely)
    checked = cut(verify(docs, families, text, threshold))
    degrees = checked.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    groups = components(checked.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), F.col("root").alias("group_id"))
    roots = groups.join(classes.select(F.col("rep").alias("group_id"), F.col("rep_id").alias("group_doc")), "group_id")
    per_class = cut(classes.join(degrees, "rep", "left").join(roots, "rep", "left"))
    in_group = F.col("group_id").isNotNull()
    return sketched.select(ROW, "id", "s1", "s2").join(per_class, ["s1", "s2"]).select(
        ROW, "id", F.col("rep").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("group_id", "rep").alias("group_id"), F.col("rep_id").alias("class_doc"), F.when(in_group, F.col("group_doc")).otherwise(F.col("rep_id")).alias("group_doc"),
    )


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): all links between class representatives, a < b. As many rows as there are links; rows without shingles
    (null and empty texts) have none, and an empty table gives none. See :func:`shingle_join` for ids."""
    docs, floor = keyed(docs, id_col), floor_for(threshold)
    sketched = cut(sketch(docs.select(ROW, text), text, floor))
    _, families = candidates(sketched, floor, LIKELY * threshold / THRESHOLD)
    return verify(docs, families, text, threshold, pairs=True).where("b is not null").select("a", "b").distinct()


def op10_shingle_join(spark, sf_dir: str) -> DataFrame:
    found = shingle_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("class_doc").alias("class_id"), "copies", "n_links", F.col("group_doc").alias("group_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies, and of exact ones, the document with the smallest key stays.

    Rows with a null or repeated id are documents of their own; of documents without words one stays; an empty table stays
    one. Memory is some 90 bytes for each byte of the longest text, which its task holds whole.
    """
    docs_k = keyed(packed(docs, "doc_id", "text"))
    found = shingle_join(docs_k, id_col=ROW)
    gone = cut(found.where(F.col(ROW) != F.col("group_id")).select(ROW))
    return docs_k.join(gone, ROW, "left_anti").select("__doc.*")


def brute_force(docs: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """For tests."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().split()
        n = min(len(w), SHINGLE)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    first, copies = {}, {}
    for (i, _), s in sorted(zip(docs, sets, strict=True), key=lambda x: x[0][0]):
        first.setdefault(s, i)
        copies[s] = copies.get(s, 0) + 1
    distinct = sorted(first, key=first.get)
    near = {i: set() for i in first.values()}
    index: dict = {}
    for s in distinct:
        hits: dict = {}
        for g in s:
            for o in index.get(g, ()):
                hits[o] = hits.get(o, 0) + 1
            index.setdefault(g, []).append(s)
        for o, n in hits.items():
            if n / (len(s) + len(o) - n) >= threshold - 1e-9:
                near[first[s]].add(first[o])
                near[first[o]].add(first[s])
    root: dict = {}
    for i in sorted(near):
        wave = [i]
        while wave:
            x = wave.pop()
            if x not in root:
                root[x] = i
                wave += near[x]
    return [(i, first[s], copies[s], len(near[first[s]]), root[first[s]]) for (i, _), s in zip(docs, sets, strict=True)]


SQL = rf"""with recursive worded as (
  select doc_id, words, least(len(words), {SHINGLE}) as n
  from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as words from documents)),
shingles as (
  select distinct doc_id, array_to_string(words[i : i + n - 1], ' ') as g
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from worded where n > 0)),
sets as (select doc_id, coalesce(string_agg(g, chr(10) order by g), '') as s, count(g) as n from worded left join shingles using (doc_id) group by doc_id),
classes as (select s, min(doc_id) as rep, count(*) as copies, any_value(n) as n from sets group by s),
own as (select rep, n, g from classes join shingles on doc_id = rep),
links as (
  select a.rep as a, b.rep as b from own a join own b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n
  having 10 * count(*) >= {round(10 * THRESHOLD)} * (a.n + b.n - count(*))),
reached as (select rep as a, rep as b from classes union select r.a, l.b from reached r join links l on r.b = l.a)
select sets.doc_id, rep as class_id, copies, coalesce(n_links, 0) as n_links, group_id
from sets join classes using (s) join (select a as rep, min(b) as group_id from reached group by a) using (rep)
left join (select a as rep, count(*) as n_links from links group by a) using (rep)"""
