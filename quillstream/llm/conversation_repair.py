r"""Conversation structure repair by cost DP and prefix-doubling path ranking.

A repair is a path through nodes (row, state); the states are the start, after a system turn, after a user turn and after
an assistant turn. Its arcs are the edits: Keep, Rerole, Delete, Insert. Dynamic programming from the end gives each
node's least cost; arcs on least-cost paths are optimal. Of all least-cost paths the one with the ASCII-least audit (the
edits' initials) is wanted. Nodes are ranked by their least audits of one letter, then two, four, eight and so on: the
rank for 2k letters follows from the ranks for k at the node and at the node that its k letters lead to, whose pointer
doubles too. A state and an edit decide the next state, so equal audits are one path. Ranks choose among a node's optimal
arcs, and the doubled pointers lay out the chosen path in as many steps as its length has bits.

Rows are sorted over the whole table, so a long conversation lies in many tasks. Runs of at most 4,096 rows of a
conversation are pieces. A piece is summed up by its 4 x 4 matrix of costs from state to state; one pass over a
conversation's pieces, backwards, gives each the costs that follow it, and then its least audit from each of the four
states. One pass forwards chooses between them, and applies the edits to the rows. Both passes hold a few numbers.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, ranges

#: Places of a piece's rows agree but for so many bits, so it has 4,096 rows at most.
PIECE_BITS = 12
#: Rows of pieces that are ranked at once.
BATCH_ROWS = 1 << 16
#: Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
_FAR = np.int64(1) << np.int64(40)
#: States: start, after system, after user, after assistant. Where a user or an assistant turn leads, whichever may follow.
FORCED = np.array([2, 2, 3, 2])
FORCED_ROLE = ("user", "user", "assistant", "user")
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_NO_ARC = 9


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a row's code, 3 * initial + fault (none, must go, truncated), with initials s, u, a and other: the state that
    Keep leads to and its cost, for each state; and the cost of Rerole."""
    follows = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
    to, keep, rerole = np.zeros((12, 4), np.int64), np.full((12, 4), _FAR), np.full(12, _FAR)
    for initial in range(4):
        for fault, extra in ((0, 0), (2, TRUNCATED)):
            rerole[3 * initial + fault] = REROLE + extra
            for state in range(4):
                if (state, initial) in follows:
                    to[3 * initial + fault, state] = follows[state, initial]
                    keep[3 * initial + fault, state] = extra
    return to, keep, rerole


KEEP_TO, KEEP_COST, REROLE_COST = _tables()
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _inserted(cost: np.ndarray) -> np.ndarray:
    """The costs of a column's states once inserted turns may come first; two of them reach every state."""
    once = np.minimum(cost, INSERT + cost[:, FORCED])
    return np.minimum(cost, INSERT + once[:, FORCED])


#: What is left to pay at a conversation's end, by state: it must be at the start or after an assistant turn.
AT_END = _inserted(np.array([[0, _FAR, _FAR, 0]]))[0]


def _backwards(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, keep: bool) -> np.ndarray:
    """Costs of all pieces in step, last rows first: ``ends[p, state, ...]`` is what follows piece p. Gives the costs at
    each piece's first row, or those of all columns, piece by piece (one column more than rows), with ``keep``."""
    order = np.argsort(-lengths, kind="stable")
    now, first = ends[order].copy(), starts[order]
    column = starts + np.arange(len(starts))  # a piece's first column
    every = np.zeros((len(codes) + len(starts), *ends.shape[1:]), np.int64) if keep else None
    if keep:
        every[column + lengths] = ends
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        n = active[t]
        code, after = codes[first[:n] + t], now[:n]
        wide = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
        kept = after[np.arange(n)[:, None], KEEP_TO[code]] + KEEP_COST[code][wide]
        rerole = REROLE_COST[code][(slice(None), None) + (None,) * (after.ndim - 2)] + after[:, FORCED]
        now[:n] = _inserted(np.minimum(np.minimum(kept, rerole), DELETE + after))
        if keep:
            every[column[order[:n]] + t] = now[:n]
    if keep:
        return every
    out = np.empty_like(now)
    out[order] = now
    return out


def matrices(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[piece, state before, state behind]: the least cost of a piece from state to state."""
    ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(starts), 4, 4))
    return _backwards(codes, starts, lengths, ends, False)


def ranked_audits(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
    """For each piece and state before it, the least audit of its least-cost paths, and the state behind it."""
    cost = _backwards(codes, starts, lengths, ends, True)
    n_columns, pieces = len(cost), np.arange(len(starts))
    last = starts + pieces + lengths
    inner = np.ones(n_columns, bool)
    inner[last] = False
    column = np.flatnonzero(inner)  # of each row
    node = np.arange(4 * n_columns).reshape(n_columns, 4)
    here, flat, ends_at = cost[column], cost.ravel(), node[column + 1]
    letter, target = np.zeros((4, 4 * n_columns), np.int64), np.tile(node.ravel(), (4, 1))
    arcs = (
        (DELETE, ends_at),
        (INSERT, node[column][:, FORCED]),
        (KEEP_COST[codes], np.take_along_axis(ends_at, KEEP_TO[codes], 1)),
        (REROLE_COST[codes][:, None], ends_at[:, FORCED]),
    )
    for k, (price, to) in enumerate(arcs):
        letter[k][node[column]] = np.where(here == price + flat[to], k + 1, _NO_ARC)
        target[k][node[column]] = to
    least = letter.argmin(0)
    every_node = np.arange(4 * n_columns)
    rank, pointer = letter[least, every_node], target[least, every_node]
    length, pointers = (rank > 0).astype(np.int64), [pointer]
    while not (pointer[pointer] == pointer).all():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        length = length + length[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    # The ranks are those of whole audits now: of a node's optimal arcs, the least letter and then the least rank behind it.
    chosen = (letter * (rank.max() + 1) + rank[target]).argmin(0)
    label, following = letter[chosen, every_node], target[chosen, every_node]
    begin = node[starts + pieces].ravel()
    steps = length[begin]
    step = ranges(np.zeros(len(begin), np.int64), steps)
    first = np.repeat(begin, steps)
    at = following[first]
    for k, hop in enumerate(pointers):
        at = np.where(((step - 1) >> k) & 1, hop[at], at)
    at = np.where(step == 0, first, at)
    letters, bounds = LETTERS[label[at]].tobytes(), np.concatenate([[0], np.cumsum(steps)]).tolist()
    audits = [letters[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    behind = pointer[begin] % 4
    return [audits[4 * p : 4 * p + 4] for p in range(len(starts))], behind.reshape(-1, 4)


def sorted_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows in order of conversations and turns, with ``pos``, their place; written.

    The sort is over all rows, and its last key is the place of reading, so that neither a long conversation nor a row
    that stands a million times is in one task. Equal turns are in order of roles and texts.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, bare = space(text_col), F.rtrim(space(text_col), F.lit(SPACES))
    made = rows.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), text.alias("text"),
        F.xxhash64(space(role_col), text).alias("h1"), F.xxhash64(F.lit("turn"), text, space(role_col)).alias("h2"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("read"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("h1"), F.col("h2"), F.col("read")]
    return cut(made.repartitionByRange(*order).sortWithinPartitions(*order).drop("read").withColumn("pos", F.monotonically_increasing_id()))


def with_faults(placed: DataFrame) -> DataFrame:
    """(conv, pos, turn, initial, fault): each row's first fault, 1 blank, 2 duplicate, 3 truncated, else 0."""
    narrow = placed.drop("text").withColumn("initial", F.instr(F.lit("sua"), F.substring("role", 1, 1)))
    narrow = narrow.withColumn("initial", F.when((F.col("initial") == 0) | (F.col("role") == ""), 3).otherwise(F.col("initial") - 1)).drop("role")
    keys = ["conv", "h1", "h2"]
    repeated = narrow.groupBy(*keys).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last")
    repeated = cut(repeated.select(*[F.col(k).alias(f"__{k}") for k in keys], "first"))
    met = narrow["conv"].eqNullSafe(repeated["__conv"]) & (narrow["h1"] == repeated["__h1"]) & (narrow["h2"] == repeated["__h2"])
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("open"), 3).otherwise(0)
    return narrow.join(repeated, met, "left").select("conv", "pos", "turn", "initial", fault.alias("fault"))


def pieces(faulty: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """(conv, pos, codes, costs): runs of rows of a conversation whose places agree but for ``bits`` bits; written."""

    def run(batches):
        conv, pos, codes = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for batch in _then_none(batches):
            if batch is not None:
                conv = pa.concat_arrays([conv, batch.column(0)])
                pos = np.concatenate([pos, batch.column(1).to_numpy()])
                codes = np.concatenate([codes, batch.column(2).to_numpy().astype(np.uint8)])
            if not len(pos):
                continue
            names = conv.dictionary_encode().indices.fill_null(-1).to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(pos >> bits) != 0) | (np.diff(names) != 0)]))
            ends = np.append(heads[1:], len(pos))
            done = len(heads) if batch is None else len(heads) - 1  # the last may go on
            if done:
                starts, lengths = heads[:done], (ends - heads)[:done]
                stop = int(ends[done - 1])
                costs = matrices(codes[:stop], starts, lengths).reshape(-1, 16)
                raw = codes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        conv.take(pa.array(starts)),
                        pa.array(pos[starts]),
                        pa.array([raw[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, costs.size + 1, 16), pa.int32()), pa.array(costs.ravel())),
                    ],
                    names=["conv", "pos", "codes", "costs"],
                )
                conv, pos, codes = conv.slice(stop), pos[stop:], codes[stop:]

    code = 3 * F.col("initial") + F.get(F.array(*map(F.lit, (0, 1, 1, 2))), "fault")
    dealt = faulty.select("conv", "pos", code.cast("int").alias("code")).repartition(F.shiftright("pos", bits)).sortWithinPartitions("pos")
    return cut(dealt.mapInArrow(run, "conv string, pos bigint, codes binary, costs array<bigint>"))


def _then_none(batches):
    yield from batches
    yield None


def audited(found: DataFrame) -> DataFrame:
    """Each piece with its least audits from the four states, ``audits``, the states behind, ``behind``, the cost from the
    start on, ``cost``, and its ``illegal`` pairs of neighbours, the one with the next piece's first row among them; written."""

    def run(batches):
        before: tuple | None = None  # of the piece read last, which comes next in the conversation: its name, costs, first initial
        for batch in batches:
            names, codes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            costs = batch.column(3).flatten().to_numpy().reshape(-1, 4, 4)
            ends, illegal = np.zeros((len(names), 4), np.int64), np.zeros(len(names), np.int64)
            starting = np.zeros(len(names), np.int64)
            for i, name in enumerate(names):
                initials = np.frombuffer(codes[i], np.uint8) // 3
                illegal[i] = np.count_nonzero(~_LEGAL[initials[:-1], initials[1:]])
                if before and before[0] == name:
                    ends[i] = before[1]
                    illegal[i] += not _LEGAL[initials[-1], before[2]]
                else:
                    ends[i] = AT_END
                cost = (costs[i] + ends[i]).min(1)
                starting[i] = cost[0]
                before = (name, cost, initials[0])
            lengths = np.array([len(c) for c in codes], np.int64)
            load = np.cumsum(lengths) // BATCH_ROWS
            audits, behind = [], []
            for a, b in ((int(x[0]), int(x[-1]) + 1) for x in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(load)) + 1) if len(x)):
                flat = np.frombuffer(b"".join(codes[a:b]), np.uint8)
                some, then = ranked_audits(flat, np.cumsum(lengths[a:b]) - lengths[a:b], lengths[a:b], ends[a:b])
                audits += some
                behind.append(then)
            four = pa.array(np.arange(0, 4 * len(names) + 1, 4), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.ListArray.from_arrays(four, pa.array([x for some in audits for x in some], pa.binary())),
                    pa.ListArray.from_arrays(four, pa.array(np.concatenate(behind).ravel() if behind else np.zeros(0), pa.int32())),
                    pa.array(starting), pa.array(illegal),
                ],
                names=["conv", "pos", "audits", "behind", "cost", "illegal"],
            )

    dealt = found.repartition("conv").sortWithinPartitions("conv", F.desc("pos"))
    return cut(dealt.mapInArrow(run, "conv string, pos bigint, audits array<binary>, behind array<int>, cost bigint, illegal bigint"))


TURNS = "conv string, step bigint, action string, turn bigint, role string, text string"


def edited(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """``TURNS``: the edits of each conversation in order, one row each; a deleted row has no role and text.

    Each conversation's rows are together and in order within a partition; what follows may rely on it.
    """

    def run(batches):
        name, state, step, letters, open_ = None, 0, 0, iter(b""), False
        out: list[tuple] = []

        def insert() -> None:
            nonlocal state, step
            out.append((name, step, "I", None, FORCED_ROLE[state], ""))
            state, step = int(FORCED[state]), step + 1

        def finish() -> None:
            while AT_END[state]:
                insert()

        for batch in _then_none(batches):
            if batch is None:
                if open_:
                    finish()
            else:
                for conv, kind, turn, role, text, audits in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "audits")), strict=True):
                    if not kind:
                        if open_ and conv != name:
                            finish()
                        if not open_ or conv != name:
                            name, state, step, open_ = conv, 0, 0, True
                        letters = iter(audits[state].decode())
                        continue
                    while (letter := next(letters)) == "I":
                        insert()
                    if letter == "D":
                        out.append((name, step, "D", turn, None, None))
                    elif letter == "K":
                        out.append((name, step, "K", turn, role, text))
                        state = {"s": 1, "u": 2, "a": 3}[role[0]]
                    else:
                        out.append((name, step, "R", turn, FORCED_ROLE[state], text))
                        state = int(FORCED[state])
                    step += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _TURN_TYPES, strict=True)], names=_TURN_NAMES)
                out = []

    null = lambda kind: F.lit(None).cast(kind)
    rows = placed.select("conv", "pos", F.lit(1).alias("kind"), "turn", "role", "text", null("array<binary>").alias("audits"))
    heads = plans.select("conv", "pos", F.lit(0).alias("kind"), null("bigint").alias("turn"), null("string").alias("role"), null("string").alias("text"), "audits")
    return rows.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "pos", "kind").mapInArrow(run, TURNS)


_TURN_NAMES = [x.split(" ")[0] for x in TURNS.split(", ")]
_TURN_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bits: int = PIECE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations. ``conv`` in both is the id as a string, null where it is.

    Report, a row for each conversation: gaps, blank, duplicate, truncated, illegal, cost. Turns: ``TURNS``, the edits in
    order with the repaired role and text, of the cheapest edits those with the ASCII-least audit.

    A null role or text is one space, so it has no initial and is blank; a role other than s, u or a in its first letter
    can't be kept, an empty one neither. Turns in order, nulls first, equal turns by role and text. Repeated rows are
    duplicates; texts are compared by 128 bits of hash. A null id is a conversation of its own. Columns of other names are
    ignored. An empty table gives empty ones.
    """
    placed = sorted_rows(rows, conv_col, turn_col, role_col, text_col)
    faulty = cut(with_faults(placed))
    plans = audited(pieces(faulty, piece_bits))
    count = lambda k: F.sum((F.col("fault") == k).cast("bigint"))
    by_turn = faulty.groupBy("conv", "turn").agg(count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counts = by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    costs = plans.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "pos").alias("cost")).withColumnRenamed("conv", "__conv")
    return counts.join(costs, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv"), edited(placed, plans)


def digested(turns: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits' initials, and the hash of the repaired ``role:text``, newline-joined.

    A hash over a whole conversation reads it in order, so its rows pass through one task, a batch at a time.
    """

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "action", "role", "text")), strict=True)

        out: list[tuple] = []
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            audit, digest, mark = bytearray(), hashlib.sha256(), b""
            for _, action, role, text in own:
                audit += action.encode()
                if action != "D":
                    digest.update(mark + f"{role}:{text}".encode())
                    mark = b"\n"
            out.append((conv, audit.decode(), digest.hexdigest()))
            if len(out) == 5000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return turns.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def _digests(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["conv", "audit", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage of conversations, by the remainder of a checksum of id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("__copy")).drop("__copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, turns = repair(damaged(rows))
    digests = digested(turns).withColumnRenamed("conv", "__conv")
    found = report.join(digests, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")
    ids = rows.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


# The same in SQL: a fold over each conversation's rows, the cheapest and then least audit that reaches each state.
_TEXT = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_BEST = lambda *xs: "list_min([" + ", ".join(xs) + "])"
_ADD = lambda x, price, letter, turn: f"{{'c': {x}.c + {price}, 'a': {x}.a || '{letter}', 't': {x}.t || {turn}}}"
_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_IF = lambda test, x: f"case when {test} then {x} else {_NONE} end"
_MAY, _EXTRA = "x.fault not in (1, 2)", "(case when x.fault = 3 then 5 else 0 end)"
_KEPT = lambda a, initial: _IF(f"{_MAY} and x.initial = '{initial}'", _ADD(a, _EXTRA, "K", "x.role || ':' || x.text || chr(10)"))
_REROLED = lambda a, role: _IF(_MAY, _ADD(a, f"1 + {_EXTRA}", "R", f"'{role}:' || x.text || chr(10)"))
_GONE = lambda a: _ADD(a, 2, "D", "''")
_INSERTED = lambda a, role: _ADD(a, 5, "I", f"'{role}:' || chr(10)")
_ROW = (
    f"[{_GONE('a[1]')}, {_BEST(_GONE('a[2]'), _KEPT('a[1]', 's'))},"
    f" {_BEST(_GONE('a[3]'), *[f(a, x) for a in ('a[1]', 'a[2]', 'a[4]') for f, x in ((_KEPT, 'u'), (_REROLED, 'user'))])},"
    f" {_BEST(_GONE('a[4]'), _KEPT('a[3]', 'a'), _REROLED('a[3]', 'assistant'))}]"
)
_INSERTS = f"[b[1], b[2], {_BEST('b[3]', *[_INSERTED(x, 'user') for x in ('b[1]', 'b[2]', 'b[4]')])}, {_BEST('b[4]', _INSERTED('b[3]', 'assistant'))}]"


def _with_inserts(table: str) -> str:
    """Of (conv_id, i, b) the same with up to two inserted turns."""
    again = f"select conv_id, i, {_INSERTS} as b from {table}"
    return f"select conv_id, i, {_INSERTS} as a from ({again})"


_START = _with_inserts(f"(select conv_id, 0 as i, [{{'c': 0, 'a': '', 't': ''}}, {_NONE}, {_NONE}, {_NONE}] as b from counted)")
_STEP = _with_inserts(f"(select conv_id, i + 1 as i, {_ROW} as b from (select conv_id, i, a, xs[i + 1] as x from walk join counted using (conv_id) where i < len(xs)))")
SQL = f"""with crcs as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)),
                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as kind
  from conversations, crcs),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case when kind = 3 then 2 else 1 end)) from keyed where kind > 0)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged),
faulty as (
  select *, left(role, 1) as initial,
         case when trim(text, {_TEXT}) = '' then 1 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
              when right(rtrim(text, {_TEXT}), 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as pair
  from placed),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank,
         count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
         list({{'role': role, 'text': text, 'initial': initial, 'fault': fault}} order by pos) as xs
  from faulty group by conv_id),
ends as (
  with recursive walk as ({_START} union all {_STEP})
  select conv_id, {_BEST("a[1]", "a[4]")} as best from walk join counted using (conv_id) where i = len(xs))
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit,
       sha256(case when coalesce(best.t, '') = '' then '' else left(best.t, length(best.t) - 1) end) as repaired_sha256
from (select distinct conv_id from conversations) c left join counted using (conv_id) left join ends using (conv_id)"""


# Brute force, for tests.
def brute_force(rows: list[tuple]) -> dict:
    """Per conversation (cost, audit, repaired text) of (conv, turn, role, text): all states, row by row, whole audits compared."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACES)
            marked.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        best = {0: (0, "", ())}
        for i in range(len(marked) + 1):
            for _ in range(3):
                for s in list(best):
                    c, a, t = best[s]
                    to, role = int(FORCED[s]), FORCED_ROLE[s]
                    best[to] = min(best.get(to, (c + 6, "", ())), (c + 5, a + "I", (*t, f"{role}:")))
            if i == len(marked):
                break
            role, text, fault = marked[i]
            after: dict = {}
            for s, (c, a, t) in best.items():
                extra = 5 if fault == 3 else 0
                ways = [(s, c + 2, "D", ())]
                if fault in (0, 3):
                    ways.append((int(FORCED[s]), c + 1 + extra, "R", (f"{FORCED_ROLE[s]}:{text}",)))
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                    if to:
                        ways.append((to, c + extra, "K", (f"{role}:{text}",)))
                for to, cost, letter, more in ways:
                    way = (cost, a + letter, t + more)
                    after[to] = min(after.get(to, way), way)
            best = after
        out[conv] = min(best[s] for s in (0, 3) if s in best)
    return out
