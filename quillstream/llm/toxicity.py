"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words, and of the beginnings of words, four to eight bytes long, those that mark the positive label.
A term's weight is its TF-IDF, with document frequencies over all documents. Marking terms (at least ``MIN_SUPPORT``
positive examples, ``MIN_LIFT`` times the positive label's share) keep it; all other words share a part of the vector
whose length grows with the text's, ``BACKGROUND`` for one word. No term of an example is left out. A word that no example
has counts in a text's length as a word that no document has.

The examples, ``MAX_EXAMPLES`` labelled rows in the order of a hash of their texts, form an inverted index. A term's
postings lie in blocks with their largest weight. A query reads its terms from the one that can add most, in rounds; after
each, the ``K``-th largest sum so far is a bound from below. A block is read only if its largest weight, with the most that
the other terms can add, reaches the bound; once few examples can still reach it, theirs are added up in full. So the
neighbours are exact. Their labels, weighted by nearness, are a vote; a monotone curve fitted on the examples' own votes,
each without itself, turns it into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import row_slices
from .common import PrefixHash, ShortHash, cut, ranges, utf8_parts, word_bounds

MAX_EXAMPLES, MIN_SUPPORT, MIN_LIFT = 10_000, 5, 2.5
BLOCK, K, PRIOR, BACKGROUND, CUTOFF = 128, 15, 0.5, 0.05, 0.3
#: Postings that a round reads, and examples that are few enough to be added up in full.
ROUND, FEW = 60_000, 400
STARTS = (4, 5, 6, 7, 8)
SLICE = 1_000_000
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[128:] = True
_START = np.uint64(0xA5A5A5A5A5A5A5A5)


def lowered(column: pa.Array):
    """(first row, row after the last, bytes, starts) of the lower-cased texts, about 1 MB at a time."""
    _, starts = utf8_parts(column)
    for a, b in row_slices(starts, SLICE):
        yield a, b, *utf8_parts(pc.utf8_lower(column.slice(a, b - a)))


def tallied(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times), sorted by text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[head], term[head], np.diff(np.append(head, len(text)))


def hashed_terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(text and hash of each word, words of each text, text and hash of the beginnings of words by length)."""
    begins, ends, first = word_bounds(_IN_WORD[data], starts)
    hashes, size = PrefixHash(data), ends - begins
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    short = ShortHash(data)
    heads = [(owner[size > n], short.of(begins[size > n], n) ^ (_START + np.uint64(n))) for n in STARTS]
    return owner, hashes.of(begins, size), np.diff(first), heads


def places(wanted: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The place of each term in ``wanted``, sorted hashes, or -1."""
    if not len(wanted):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
    return np.where(wanted[at] == terms, at, -1)


class Terms:
    """The index's terms: ``told`` (marking words and beginnings, sorted hashes) and ``words`` (all other words)."""

    def __init__(self, told: np.ndarray, words: np.ndarray):
        self.told, self.words, self.size = told, words, len(told) + len(words)

    def count(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times, words of each text), sorted by text; the term of a word that is none is ``size``."""
        owner, hashes, n_words, heads = hashed_terms(data, starts)
        text, term, times = tallied(owner, hashes)
        at = places(self.told, term)
        rest = at < 0
        found = places(self.words, term[rest])
        at[rest] = np.where(found < 0, self.size, found + len(self.told))
        parts = [(text, at, times)]
        for own, head in heads:
            hit = places(self.told, head)
            parts.append(tallied(own[hit >= 0], hit[hit >= 0]))
        text, term, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(text, kind="stable")
        return text[order], term[order], times[order], n_words


def select_terms(labelled: DataFrame, base: float, text: str) -> Terms:
    """Every word of the labelled texts, and the terms that mark the positive label; counted in Spark."""

    def run(batches):
        for whole in batches:
            label = whole.column(1).to_numpy()
            for a, b, data, starts in lowered(whole.column(0)):
                owner, hashes, _, heads = hashed_terms(data, starts)
                for word, own, term in [(True, owner, hashes), *((False, *h) for h in heads)]:
                    own, term, _ = tallied(own, term)
                    values, place = np.unique(term, return_inverse=True)
                    n, pos = np.bincount(place, minlength=len(values)), np.bincount(place, weights=label[a:b][own], minlength=len(values))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values.view(np.int64)), pa.array(np.full(len(values), word)), pa.array(n), pa.array(pos.astype(np.int64))],
                        names=["term", "word", "n", "pos"],
                    )

    counts = labelled.select(text, "label").mapInArrow(
        run, "term bigint, word boolean, n bigint, pos bigint",
    ).groupBy("term", "word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    told = (F.col("pos") >= MIN_SUPPORT) & (F.col("pos") / F.col("n") >= MIN_LIFT * max(base, 1e-6))
    found = counts.select("term", told.alias("told"), "word").where("told or word").toArrow()
    term, is_told = found.column("term").to_numpy().view(np.uint64), found.column("told").to_numpy()
    return Terms(np.unique(term[is_told]), np.unique(term[~is_told]))


def document_frequencies(docs: DataFrame, terms: Terms, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # the vocabulary of MAX_EXAMPLES texts, as hashes

    def run(batches):
        total, rows = np.zeros(sent.value.size + 1, np.int64), 0
        for whole in batches:
            rows += whole.num_rows
            for _, _, data, starts in lowered(whole.column(0)):
                _, term, _, _ = sent.value.count(data, starts)
                total += np.bincount(term, minlength=len(total))
        total[-1] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counts = docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    df = np.zeros(terms.size + 1, np.int64)
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return df[:-1], int(df[-1])


class Index:
    """The examples' vectors in blocks, with each term's largest weight in each block."""

    def __init__(self, terms: Terms, df: np.ndarray, n_docs: int):
        self.terms, self.n_told = terms, len(terms.told)
        self.idf = np.log((1 + n_docs) / (1 + np.append(df, 0))).astype(np.float32)  # the last is of unknown words

    def vectors(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, dims, weights): the unit vector of each text, without its words that no example has."""
        text, term, times, n_words = self.terms.count(data, starts)
        weight = (1 + np.log(times)) * self.idf[term]
        rest = term >= self.n_told
        length = np.sqrt(np.bincount(text[rest], weight[rest] ** 2, len(n_words)))
        share = BACKGROUND * np.sqrt(n_words)
        weight[rest] *= (share / np.where(length > 0, length, 1))[text[rest]]
        norm = np.sqrt(np.bincount(text, weight**2, len(n_words)))
        weight /= np.where(norm > 0, norm, 1)[text]
        known = (term < self.terms.size) & (weight > 0)
        return np.searchsorted(text[known], np.arange(len(n_words) + 1)), term[known], weight[known]

    def build(self, labels: np.ndarray, ids: np.ndarray, begins: np.ndarray, dims: np.ndarray, weights: np.ndarray) -> Index:
        self.labels, self.ids = labels, ids
        self.begins, self.dims, self.weights = begins, dims.astype(np.int32), weights.astype(np.float32)
        return self.inverted()

    def __getstate__(self) -> dict:
        """What is sent: the vectors; each worker inverts them for itself."""
        return {k: v for k, v in self.__dict__.items() if k in ("terms", "n_told", "idf", "labels", "ids", "begins", "dims", "weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if "dims" in state:
            self.inverted()

    def inverted(self) -> Index:
        size = self.terms.size
        owner = np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(self.begins))
        order = np.lexsort((owner, self.dims))
        self.owner, self.weight = owner[order], self.weights[order]
        at = np.searchsorted(self.dims[order], np.arange(size + 1))
        blocks = -(-np.diff(at) // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])  # of each term
        self.block_start = np.repeat(at[:-1], blocks) + ranges(np.zeros(size, np.int64), blocks) * BLOCK
        self.block_size = np.minimum(BLOCK, np.repeat(at[1:], blocks) - self.block_start)
        self.block_max = np.maximum.reduceat(self.weight, self.block_start) if len(self.block_start) else np.zeros(0, np.float32)
        self.term_max = np.zeros(size)
        np.maximum.at(self.term_max, np.repeat(np.arange(size), blocks), self.block_max)
        self.query = np.zeros(size)
        return self

    def cosines(self, who: np.ndarray, dims: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The whole sums of some examples."""
        self.query[dims] = q
        n = self.begins[who + 1] - self.begins[who]
        i = ranges(self.begins[who], n)
        out = np.bincount(np.repeat(np.arange(len(who)), n), self.query[self.dims[i]] * self.weights[i], len(who))
        self.query[dims] = 0
        return out

    def nearest(self, dims: np.ndarray, weights: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosines, above 0, ties by place, and the cosines; ``skip`` is left out."""
        n, want = len(self.labels), k + (skip >= 0)
        most = weights * self.term_max[dims]
        order = np.argsort(-most)
        terms, q, most = dims[order], weights[order], most[order]
        total, after = most.sum(), most.sum() - np.cumsum(most)  # what the terms can add, and those after each
        n_blocks = self.first_block[terms + 1] - self.first_block[terms]
        upto = np.cumsum(n_blocks) * BLOCK
        sums, bound, done = np.zeros(n), 0.0, 0
        while done < len(terms):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + ROUND)))
            block = ranges(self.first_block[terms[done:stop]], n_blocks[done:stop])
            of = np.repeat(np.arange(done, min(stop, len(terms))), n_blocks[done:stop])
            if bound:
                keep = q[of] * self.block_max[block] + (total - most[of]) >= bound - 1e-6
                block, of = block[keep], of[keep]
            i = ranges(self.block_start[block], self.block_size[block])
            sums += np.bincount(self.owner[i], np.repeat(q[of], self.block_size[block]) * self.weight[i], n)
            done = min(stop, len(terms))
            bound = np.partition(sums, n - want)[n - want] if n > want else 0.0
            left = after[done - 1]
            if bound > left and np.count_nonzero(sums + left >= bound - 1e-6) <= max(FEW, 2 * want):
                break
        who = np.flatnonzero((sums > 0) & (sums + (after[done - 1] if done else 0) >= bound - 1e-6))
        cosine = self.cosines(who, dims, weights)
        keep = (who != skip) & (cosine > 0)
        who, cosine = who[keep], cosine[keep]
        best = np.lexsort((who, -np.round(cosine, 9)))[:k]
        return who[best], cosine[best]

    def vote(self, dims: np.ndarray, weights: np.ndarray, base: float, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        who, cosine = self.nearest(dims, weights, skip=skip)
        return (float(cosine @ self.labels[who]) + PRIOR * base) / (float(cosine.sum()) + PRIOR), who, cosine


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nondecreasing curve nearest to (x, y) by squares: neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    # one row of each label is added to a pool, so that no score is 0 or 1 for lack of rows
    return np.array([t / n for _, n, t in pools]), np.array([(s + 0.05) / (n + 1) for s, n, _ in pools])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_examples: int) -> tuple[Broadcast | None, float, np.ndarray, np.ndarray]:
    """(index, sent to the workers, share of positives, curve) from at most ``max_examples`` labelled rows.

    Ids join labels to texts and name the evidence; which rows are examples, and their order, follow from their texts.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    hashed = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h")).join(rows, id_col)
    some = hashed.orderBy("__h", "label", id_col).limit(max_examples).select(id_col, "label").distinct()  # small enough to broadcast
    labelled = cut(docs.select(id_col, text).join(F.broadcast(some), id_col).groupBy(id_col, "label").agg(F.min(text).alias(text)).select(id_col, text, "label"))
    base = labelled.agg(F.avg("label")).first()[0]
    if base is None:
        return None, 0.0, np.zeros(1), np.zeros(1)
    terms = select_terms(labelled, base, text)
    index = Index(terms, *document_frequencies(docs, terms, text))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def run(batches):
        for whole in batches:
            for a, b, data, starts in lowered(whole.column(1)):
                begins, dims, weights = sent.value.vectors(data, starts)
                at = pa.array(begins, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(a, b - a).cast(pa.string()), whole.column(2).slice(a, b - a),
                        pa.ListArray.from_arrays(at, pa.array(dims, pa.int32())), pa.ListArray.from_arrays(at, pa.array(weights, pa.float32())),
                    ],
                    names=["id", "label", "dims", "weights"],
                )

    in_order = labelled.orderBy(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "label")
    found = in_order.mapInArrow(run, "id string, label int, dims array<int>, weights array<float>").toArrow().combine_chunks()  # max_examples rows
    lists = found.column("dims").combine_chunks()
    begins = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    sent.destroy()
    index.build(
        found.column("label").to_numpy().astype(float), np.array(found.column("id").to_pylist(), object), begins, lists.flatten().to_numpy(),
        found.column("weights").combine_chunks().flatten().to_numpy(),
    )
    sent = spark.sparkContext.broadcast(index)

    def own(batches):
        x = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            votes = [x.vote(x.dims[x.begins[i] : x.begins[i + 1]], x.weights[x.begins[i] : x.begins[i + 1]].astype(float), base, skip=i)[0] for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes)], names=["id", "vote"])

    votes = spark.range(0, len(index.labels), 1, 64).mapInArrow(own, "id bigint, vote double").toArrow()
    xs, ys = monotone(votes.column("vote").to_numpy(), index.labels[votes.column("id").to_numpy()])
    return sent, base, xs, ys


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", cutoff: float = CUTOFF,
    max_examples: int = MAX_EXAMPLES,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 if the score is ``cutoff`` or more) and the evidence:
    ``neighbours`` (ids of the nearest examples, nearest first) and ``nearness`` (their cosines).

    Only the texts of ``labels``' rows and their ``label`` are learned from. Null and empty texts have no terms, hence no
    neighbours, and score by the share of positives among examples. Ties between examples go by their texts. Labelled ids that ``docs`` lacks, null ids and null
    labels are skipped; of repeated labels the larger counts. Without any labelled text every score is 0. Rows are scored
    one by one; an empty table gives an empty one. Columns of ``docs`` with the names of new ones are replaced.
    """
    docs = docs.drop("score", "predicted", "neighbours", "nearness")
    sent, base, xs, ys = fit(docs, labels, id_col, text, label, max_examples)
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        index = sent.value if sent else None
        for whole in batches:
            for a, b, data, starts in lowered(whole.column(names.index(text))):
                votes, ids, near = [], [], []
                if index is not None:
                    begins, dims, weights = index.vectors(data, starts)
                for i in range(b - a):
                    if index is None:
                        who, cosine, vote = np.zeros(0, int), np.zeros(0), 0.0
                    else:
                        vote, who, cosine = index.vote(dims[begins[i] : begins[i + 1]], weights[begins[i] : begins[i + 1]], base)
                    votes.append(vote)
                    ids.append([str(index.ids[x]) for x in who])
                    near.append(cosine.tolist())
                score = np.interp(votes, xs, ys)
                yield pa.RecordBatch.from_arrays(
                    [*whole.slice(a, b - a).columns, pa.array(score, pa.float64()), pa.array((score >= cutoff).astype(np.int32)), pa.array(ids, pa.list_(pa.string())), pa.array(near, pa.list_(pa.float64()))],
                    names=[*names, "score", "predicted", "neighbours", "nearness"],
                )

    return docs.mapInArrow(run, f"{fields}, score double, predicted int, neighbours array<string>, nearness array<double>")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return toxicity(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours")
