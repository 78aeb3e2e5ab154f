"""Stores of attempts, events and imported notes: folders of JSON lines that are appended to and read with tolerance; and
of registered notes, which are replaced by id.

Appending never rewrites what is there, so a store may grow without bound and many jobs may write to it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedStore, last_wins

NOTE = "id string, title string, topic string, updated string, source string, progress int, is_favorite boolean"
ATTEMPT = "id string, note_id string, topic string, topic_label string, score int, total int, correct int, weak_topics array<string>, duration_seconds int"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share; one is set where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a store. A missing folder is an empty store; lines that are no JSON object are left out, and
    fields of the wrong type are null."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    try:
        lines = spark.read.schema(f"{schema}, __broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__broken")
        lines.isEmpty()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    some = F.lit(False)
    for n in names:
        some |= F.col(n).isNotNull()
    return lines.where(some).select(*names)


def note_store(spark: SparkSession, path: str) -> VersionedStore:
    """Registered notes by id; of an id's records the one with the latest ``version`` counts."""
    names = [f.split(" ")[0] for f in NOTE.split(", ")]
    return VersionedStore(spark, path, f"{NOTE}, version bigint", ["id"], last_wins([*names[1:], "version"]))


def register(notes: DataFrame, store: VersionedStore, now: str) -> DataFrame:
    """Puts notes (note_key, document_title, topic) into a store under new ids; gives (note_key, id).

    The id is a hash of the key, so a job that runs again gives the same one, and a note that is registered again replaces
    its record, the later ``now`` winning. A note without a topic is an upload.
    """
    made = notes.withColumn("id", F.sha2(F.col("note_key").cast("string"), 256))
    topic = F.upper(F.coalesce(F.nullif("topic", F.lit("")), F.lit("upload")))
    fixed = {"updated": F.lit(now), "source": F.lit("generated"), "progress": F.lit(0), "is_favorite": F.lit(False), "version": F.unix_micros(F.lit(now).cast("timestamp"))}
    store.put(made.select("id", F.col("document_title").alias("title"), topic.alias("topic"), *[c.alias(k) for k, c in fixed.items()]))
    return made.select("note_key", "id")


def save_attempts(attempts: DataFrame, path: str) -> None:
    """Appends attempts with what they lack filled in: topic, label, numbers and lists. Empty strings count as lacking."""
    given = lambda c, v: F.coalesce(F.nullif(c, F.lit("")), F.lit(v)).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    rows = attempts.select(
        "id", "note_id", given("topic", "all"), given("topic_label", "Quiz"), *map(number, ["score", "total", "correct"]),
        F.coalesce("weak_topics", F.array().cast("array<string>")).alias("weak_topics"), number("duration_seconds"),
    )
    append(rows, path)
