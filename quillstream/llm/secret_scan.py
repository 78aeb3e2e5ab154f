"""Secret scans: candidates by shape, then a random forest removes false positives.

A candidate is a run of 12 or more letters, digits, ``+``, ``/``, ``_`` or ``-`` with a digit or with four changes from
lower to upper case in it; every match of a format in ``KNOWN``, also inside a run; the password of a URL; and the whole
value after a name that ``NAMED`` matches, of any length and characters: up to its closing quote on the line, or else up
to white space, without closing signs at its end. Candidates may overlap; equal ones are one.

A candidate's features: its length; shares of character classes; entropy; changes between classes; longest run of digits;
the share of it that the corpus's common letter sequences cover (a dictionary of fragments of four letters, counted over
all documents: 26 ** 4 at most); marks of placeholders; how the text before it ends; hashes of its neighbouring words and
of its path. The forest is trained on labelled findings: (value, before, after, path, label).

The test tables hold no labelled findings. :func:`labelled_findings` makes a table of them from templates: secrets of
many kinds, and what looks like them but is none: digests, numbers, addresses, placeholders, identifiers. The query trains
on ``FINDINGS`` of them. Labels come from the templates, not from any rule over features.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import row_slices
from .common import ROW, cut, keyed, utf8_parts

MIN_LENGTH, FINDINGS, TREES, DEPTH, SEED = 12, 8_000, 40, 10, 7
WORD_BUCKETS, PATH_BUCKETS, CONTEXT, SLICE = 48, 8, 40, 1_000_000
#: Fragments of four letters are common from this share of all fragments on.
COMMON = 1 / 50_000
#: Formats of secrets that are known by themselves.
KNOWN = [
    r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36}", r"xox[abprs]-[0-9A-Za-z-]{10,}", r"sk_live_[0-9A-Za-z]{20,}", r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]{4,}", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,30}PRIVATE KEY-----",
]
#: What assigns a secret to a name.
NAMED = r"(?i)(token|secret|passw(or)?d|passphrase|pwd|api_?key|auth|credential)s?[\"']?\s*[:=]\s*[\"']?$"
#: Words of values that stand in for a secret.
STAND_INS = ("example", "changeme", "your", "dummy", "sample", "placeholder", "xxxx", "****", "null", "none", "todo", "redacted", "insert")
_FORMATS = [re.compile(p.encode()) for p in KNOWN]
_KNOWN = re.compile("|".join(KNOWN))
_URL = re.compile(rb"://[^\s:/@]*+:([^\s/@]++)@")
_ASSIGNED = re.compile(NAMED.removesuffix("$").encode())
_QUOTED = {q: re.compile(rb"(?:\\.|[^%c\\\r\n])++(?=%c)" % (q, q)) for q in b"\"'"}
_BARE = re.compile(rb"\S+")

_CLASS = np.zeros(256, np.uint8)  # 1 digit, 2 upper, 3 lower, 4 sign
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[ord(c) for c in "+/_-"]] = 4
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_LETTER = np.full(256, -1, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)


def fragments(data: np.ndarray) -> np.ndarray:
    """At each byte the number of the four letters that begin there, case aside, or -1."""
    x = _LETTER[data]
    if len(x) < 4:
        return np.full(len(x), -1)
    parts = np.stack([x[k : len(x) - 3 + k] for k in range(4)])
    codes = np.where((parts >= 0).all(axis=0), ((parts[0] * 26 + parts[1]) * 26 + parts[2]) * 26 + parts[3], -1)
    return np.concatenate([codes, np.full(3, -1)])


def common_fragments(docs: DataFrame, text: str) -> np.ndarray:
    """Which fragments of four letters are common, counted over all documents: 26 ** 4 booleans."""

    def run(batches):
        total = np.zeros(26**4 + 1, np.int64)
        for whole in batches:
            data, starts = utf8_parts(whole.column(0))
            for a, b in row_slices(starts, SLICE):
                codes = fragments(data[starts[a] : starts[b]])
                total += np.bincount(codes + 1, minlength=len(total))
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1:][some])], names=["code", "n"])

    counts = cut(docs.select(text).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = np.zeros(26**4, bool)
    found[counts.where(F.col("n") >= F.lit(total * COMMON)).select("code").toArrow().column("code").to_numpy()] = True
    return found


def coverage(raw: np.ndarray, common: np.ndarray) -> float:
    """The share of the bytes that common fragments cover."""
    codes = fragments(raw)
    hit = np.flatnonzero((codes >= 0) & common[np.maximum(codes, 0)])
    covered = np.zeros(len(raw) + 4, bool)
    for k in range(4):
        covered[hit + k] = True
    return float(covered.sum()) / max(1, len(raw))


def _bucket(word: str, n: int) -> int:
    return sum((i + 1) * b for i, b in enumerate(word.encode())) % n


def features(value: str, before: str, after: str, path: str, common: np.ndarray) -> list[float]:
    raw = np.frombuffer(value.encode(), np.uint8)
    kind = _CLASS[raw]
    share = np.bincount(raw)[np.unique(raw)] / max(1, len(raw))
    changes = np.count_nonzero(kind[1:] != kind[:-1])
    pairs = np.bincount(kind[:-1].astype(int) * 5 + kind[1:], minlength=25)[[6, 7, 8, 11, 12, 13, 16, 17, 18]] / max(1, len(raw) - 1)
    longest = max((len(x) for x in re.findall(r"\d+", value)), default=0)
    left, low = re.findall(r"\w+", before), value.lower()
    neighbours = np.zeros(2 * WORD_BUCKETS)
    for w in left[-2:]:
        neighbours[_bucket(w.lower(), WORD_BUCKETS)] = 1
    if right := re.findall(r"\w+", after):
        neighbours[WORD_BUCKETS + _bucket(right[0].lower(), WORD_BUCKETS)] = 1
    place = np.zeros(PATH_BUCKETS)
    place[_bucket(path, PATH_BUCKETS)] = 1
    tail = before[-2:]
    return [
        float(len(raw)), *(float((kind == k).mean()) if len(raw) else 0.0 for k in range(5)), float(_HEX[raw].mean()) if len(raw) else 0.0, float(-(share * np.log2(share)).sum()), changes / max(1, len(raw)), *pairs.tolist(), float(longest),
        coverage(raw, common), float(any(w in low for w in STAND_INS)), float(bool(re.search(r"[$<{%]", value))), float(len(set(value)) <= 3), float(bool(_KNOWN.fullmatch(value))), float(value.isdigit()),
        float("=" in before[-4:] or ":" in before[-4:]), float(tail[-1:] in "\"'" and tail != ""), float(bool(re.search(NAMED, before))), float(after[:1] in "\"'" and after != ""), float(tail[-1:] == "@"), float(after[:1] == "@"), float(after[:1] == "."), float(tail[-1:] == "."), float(tail[-1:] == "/"),
        *neighbours.tolist(), *place.tolist(),
    ]


def told(raw: bytes, start: int, stop: int) -> set[tuple[int, int]]:
    """(begin, end) in ``raw`` of what has a known format, is a URL's password or is assigned to a secret's name, within
    one text."""
    out = {m.span() for p in _FORMATS for m in p.finditer(raw, start, stop)} | {m.span(1) for m in _URL.finditer(raw, start, stop)}
    for name in _ASSIGNED.finditer(raw, start, stop):
        at = name.end()
        quoted = _QUOTED.get(raw[at - 1])
        if quoted and (m := quoted.match(raw, at, stop)):
            out.add(m.span())
        elif m := _BARE.match(raw, at, stop):
            out.add((at, at + (len(m[0].rstrip(b",;)]}>\"'`")) or len(m[0]))))
    return out


def spans_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(begin, end) of every candidate in texts that lie back to back, sorted."""
    kind = _CLASS[data]
    inside = np.concatenate([[False], kind > 0, [False]])
    bounds = starts[1:-1]
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    joined = bounds[inside[bounds] & inside[bounds + 1]]
    opens[joined] = closes[joined] = True
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    digits = np.concatenate([[0], np.cumsum(kind == 1)])
    rises = np.concatenate([[0, 0], np.cumsum((kind[1:] == 2) & (kind[:-1] == 3))])[: len(data) + 1]
    keep = (b - a >= MIN_LENGTH) & ((digits[b] > digits[a]) | (rises[b] - rises[np.minimum(a + 1, len(data))] >= 4))
    raw = data.tobytes()
    spans = set(zip(a[keep].tolist(), b[keep].tolist(), strict=True)).union(*(told(raw, s, e) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)))
    return np.array(sorted(spans), np.int64).reshape(-1, 2)


def candidates(docs: DataFrame, text: str, path: str | None, common: np.ndarray) -> DataFrame:
    """(row, start, stop, value, before, features) of every candidate; positions count code points."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # 26 ** 4 booleans

    def run(batches):
        for batch in batches:
            for x, y in row_slices(utf8_parts(batch.column(1))[1], SLICE):
                whole = batch.slice(x, y - x)
                data, starts = utf8_parts(whole.column(1))
                raw, (a, b) = data.tobytes(), spans_of(data, starts).T
                owner = np.searchsorted(starts, a, "right") - 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # a code point for each leading byte
                rows, paths = whole.column(0).to_pylist(), whole.column(2).to_pylist()
                out = []
                for s, e, k in zip(a.tolist(), b.tolist(), owner.tolist(), strict=True):
                    value = raw[s:e].decode("utf-8", "replace")
                    before = raw[max(int(starts[k]), s - CONTEXT) : s].decode("utf-8", "ignore")
                    after = raw[e : min(int(starts[k + 1]), e + CONTEXT)].decode("utf-8", "ignore")
                    base = int(points[starts[k]])
                    out.append((rows[k], int(points[s]) - base, int(points[e]) - base, value, before, features(value, before, after, paths[k] or "", sent.value)))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "start", "stop", "value", "before", "features"])

    place = F.col(path) if path else F.lit("")
    chosen = docs.select(ROW, text, place.cast("string").alias("path"))
    return chosen.mapInArrow(run, "row bigint, start bigint, stop bigint, value string, before string, features array<double>")


#: Names and contexts of made findings; the second of each pair is kept for tests.
_NAMES = ["token", "secret", "password", "api_key", "auth", "pwd", "client_secret", "access_token"], ["credential", "passphrase", "apikey", "db_password", "auth_token"]
_AROUND = [
    ("{w} {n} = \"", "\" {w}"), ("{n}: ", "\n{w}"), ("{w}\n{n}='", "'; {w}"), ("\"{n}\": \"", "\", \"{w}\": 1"), ("export {n}=", "\n{w}"),
], [("{w} my {n}: \"", "\". {w}"), ("<{n}=\"", "\"> {w}"), ("{n} = ", " # {w}")]
_PLAIN = [("{w} ", " {w}"), ("{w}, ", ". {w}"), ("({w} ", ") {w}"), ("{w}\n", "\n{w}")], [("see {w}: ", " {w}"), ("{w} | ", " | {w}")]
_HASHES = [
    ("commit ", " {w}"), ("sha256: ", "\n{w}"), ("md5 = \"", "\" {w}"), ("etag: \"", "\"\n{w}"), ("checksum=", " {w}"),
], [("revision ", ". {w}"), ("digest: ", " {w}"), ("blob ", "\n")]
_IDS = [
    ("id=", "&{w}=1"), ("order ", " {w}"), ("user_id: ", ", {w}"), ("uuid = \"", "\" {w}"), ("build-", " {w}"),
], [("session page ", " {w}"), ("ticket #", ": {w}"), ("trace ", " {w}")]
_PATHS = ["config/app.yml", "src/main.py", "docs/readme.md", "deploy/prod.env", "notes.txt", "web", "src1", "src12"], ["settings.ini", "log/run.log", "src7"]


def _made(r: random.Random, held_out: bool) -> tuple[str, str, str, str, int]:
    pick = lambda pair: r.choice(pair[held_out])
    word = lambda: "".join(r.choice(["th", "en", "or", "ing", "a", "re", "st", "ou", "le", "der", "ci"]) for _ in range(r.randint(1, 4)))
    some = lambda letters, low, high: "".join(r.choices(letters, k=r.randint(low, high)))
    hexes, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    camel = lambda: "".join(word().capitalize() for _ in range(r.randint(2, 4)))
    uuid = lambda: "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12))
    weak = lambda: r.choice(
        [
            lambda: word() + some(string.digits, 1, 4), lambda: some(mixed + "!@#._", 3, 9),
            lambda: word() + r.choice(".!@_\\ ") + word() + r.choice(["", ".", "!", " "]) + some(mixed, 0, 2),
            lambda: word().replace("a", "ä").replace("o", "ö") + some("äöüé1", 1, 3),
        ]
    )()
    random_value = lambda: r.choice(
        [
            weak, weak, weak, lambda: some(hexes, 24, 64), lambda: some(mixed, 16, 48), lambda: some(mixed + "+/_-", 20, 60),
            lambda: camel() + some("0123456789!#%", 1, 4), lambda: camel(), lambda: some(mixed + "!@#%^&*.", 8, 20),
        ]
    )()
    known = lambda: r.choice([
        lambda: "AKIA" + some(upper, 16, 16), lambda: "gh" + r.choice("pousr") + "_" + some(mixed, 36, 36), lambda: "xox" + r.choice("abprs") + "-" + some(mixed, 12, 40), lambda: "sk_live_" + some(mixed, 20, 30), lambda: "AIza" + some(mixed, 35, 35),
        lambda: "eyJ" + some(mixed, 20, 40) + "." + some(mixed, 20, 80) + "." + some(mixed + "_-", 30, 43), lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + some(mixed + "+/", 60, 200) + "\n-----END RSA PRIVATE KEY-----",
    ])()
    fake = lambda: r.choice(
        [
            lambda: r.choice(
                [
                    "changeme", "your-token-here", "example", "xxxxxxxxxxxx", "****", "<token>", "${TOKEN}", "{{ secret }}", "null", "None", "TODO",
                    "placeholder", "%ENV%", "redacted",
                ]
            ),
            lambda: "your_" + word(), lambda: "${" + word().upper() + "}", lambda: "x" * r.randint(4, 30), lambda: word(), lambda: "<" + word() + ">",
        ]
    )()
    number = lambda: r.choice(
        [
            lambda: some("0123456789", 12, 19), lambda: f"+1 ({some(string.digits, 3, 3)}) 555-{some(string.digits, 4, 4)}",
            lambda: f"20{some(string.digits, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}-{some(string.digits, 2, 6)}",
            lambda: f"v{r.randint(0, 20)}_{some(string.digits, 8, 12)}",
        ]
    )()
    named = lambda: r.choice(
        [
            lambda: word() + "_" + some(string.digits, 6, 12), lambda: f"img/{word()}/{word()}-{some(string.digits, 2, 6)}",
            lambda: word() + "-" + word() + "-" + some(string.digits, 4, 8), lambda: "get" + camel() + camel() + str(r.randint(1, 9)),
            lambda: camel() + camel(),
        ]
    )()
    kind = r.choice(["assigned", "assigned", "assigned", "known", "url", "fake", "fake", "hash", "number", "id", "name"])
    if kind == "assigned":
        value, (before, after) = random_value(), pick(_AROUND)
    elif kind == "known":
        value, (before, after) = known(), pick(r.choice([_AROUND, _PLAIN]))
    elif kind == "url":
        value, before, after = random_value(), f"{r.choice(['postgres', 'https', 'redis'])}://{word()}:", f"@{word()}.example.com/{word()}"
    elif kind == "fake":
        value, (before, after) = fake(), pick(_AROUND)
    elif kind == "hash":
        value, (before, after) = some(hexes, r.choice([32, 40, 64]), 64), pick(_HASHES)
    elif kind == "number":
        value, (before, after) = number(), pick(r.choice([_PLAIN, _IDS]))
    elif kind == "id":
        value, (before, after) = r.choice([uuid, lambda: some(hexes, 12, 24), lambda: some(upper, 12, 14)])(), pick(_IDS)
    else:
        value, (before, after) = named(), pick(_PLAIN)
    for key, of in (("{n}", lambda: r.choice([str, str.upper, str.capitalize])(pick(_NAMES))), ("{w}", word)):
        before, after = (x.replace(key, of()) for x in (before, after))
    return value, (word() + " " + before)[-CONTEXT:], after[:CONTEXT], pick(_PATHS), int(kind in ("assigned", "known", "url"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED, held_out: bool = False) -> DataFrame:
    """(value, before, after, path, label): ``n`` made findings; those held out have names, contexts and paths of their
    own."""
    r = random.Random(seed)
    return spark.createDataFrame([_made(r, held_out) for _ in range(n)], "value string, before string, after string, path string, label int")


def with_features(findings: DataFrame, common: np.ndarray) -> DataFrame:
    """``findings`` with their ``features``. Null contexts and paths count as empty; null values and labels go."""
    sent = findings.sparkSession.sparkContext.broadcast(common)
    names = ["value", "before", "after", "path"]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            found = [features(v, b or "", a or "", p or "", sent.value) for v, b, a, p in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*names, "label", "features"])

    given = findings.where("value is not null and label is not null").select(*[F.col(c).cast("string") for c in names], F.col("label").cast("int"))
    return given.mapInArrow(run, "value string, before string, after string, path string, label int, features array<double>")


def rule():
    """Whether a candidate is a secret by its format or by the name it is assigned to."""
    return F.col("value").rlike("^(" + "|".join(KNOWN) + ")$") | F.col("before").rlike(NAMED)


def train(findings: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from (features, label); None where the findings don't have both labels."""
    if findings.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(findings.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label")))


def scored(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    if model is None:
        return found.withColumn("score", rule().cast("double"))
    return model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(ROW, id, start, stop, value, score, is_secret) of every candidate in ``docs``.

    ``findings`` are labelled findings (value, before, after, path, label) of a size to train on; without them, see
    :func:`labelled_findings`. Null and empty texts have no candidates, an empty table none. Findings of only one label
    train no forest; each candidate is then scored 0 or 1 by :func:`rule`. Rows with a null or repeated id are scanned
    each by itself; a null path counts as empty. Other columns of ``docs`` are not read, whatever their names.
    """
    docs = keyed(docs.select(*dict.fromkeys([id_col, text, *([path] if path else []), *([ROW] if ROW in docs.columns else [])])), id_col)
    common = common_fragments(docs, text)
    found = cut(candidates(docs, text, path, common))
    model = train(cut(with_features(findings if findings is not None else labelled_findings(docs.sparkSession), common)))
    ids = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"))
    return scored(found, model).join(ids, "row").select(F.col("row").alias(ROW), "id", "start", "stop", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = secret_scan(docs)
    return found.select(F.col("id").alias("doc_id"), "start", "stop", F.sha2(F.col("value"), 256).alias("value_sha256"), "score", "is_secret")


def brute_force(text: str | None) -> set[tuple[int, int]]:
    """For tests: the candidates of one text, in code points, by plain patterns."""
    text = text or ""
    out = {m.span() for m in re.finditer(r"[0-9A-Za-z+/_-]{12,}", text) if re.search(r"[0-9]", m[0]) or len(re.findall(r"[a-z](?=[A-Z])", m[0])) >= 4}
    out |= {m.span() for p in KNOWN for m in re.finditer(p, text, re.ASCII)} | {m.span(1) for m in re.finditer(r"(?a)://[^\s:/@]*:([^\s/@]+)@", text)}
    for m in re.finditer("(?a)" + NAMED.removesuffix("$"), text):
        rest, quote = text[m.end() :], text[m.end() - 1]
        closed = re.match(r"(?:\\.|[^%s\\\r\n])+(?=%s)" % (quote, quote), rest) if quote in "\"'" else None
        bare = re.match(r"(?a)\S+", rest)
        if closed:
            out.add((m.end(), m.end() + closed.end()))
        elif bare:
            out.add((m.end(), m.end() + (len(bare[0].rstrip(",;)]}>\"'`")) or len(bare[0]))))
    return out
