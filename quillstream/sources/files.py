"""Text of uploaded files: (filename, content) to (filename, text)."""

from __future__ import annotations

import io
import logging
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as fn

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def docx_text(content: bytes | None) -> str | None:
    """The paragraphs of a Word file, a line each; null if it is none, or damaged, or encrypted."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, zlib.error, KeyError, RuntimeError, NotImplementedError, EOFError, ElementTree.ParseError):
        return None  # a member may be damaged, encrypted or packed by a method that is not known
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))


def pdf_text(content: bytes | None, marks: bool) -> str | None:
    """The pages of a PDF file, each behind its mark or without marks; null where no PDF library is installed, and for a
    file that the library can't read, so that one damaged file does not end a job."""
    try:
        from PyPDF2 import PdfReader
    except ImportError:
        return None
    try:
        pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content or b"")).pages]
    except Exception:  # of whatever kind: damaged files raise all sorts
        logging.getLogger(__name__).warning("a PDF file of %d bytes can't be read", len(content or b""), exc_info=True)
        return None
    return "\n\n".join(f"[[PAGE_{i}]]\n{t}" for i, t in enumerate(pages, 1)) if marks else "".join(t + "\n" for t in pages if t)


@F.pandas_udf(StringType())
def _docx(content: pd.Series) -> pd.Series:
    return content.map(docx_text)


@F.pandas_udf(StringType())
def _pdf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: pdf_text(c, True))


@F.pandas_udf(StringType())
def _pdf_bare(content: pd.Series) -> pd.Series:
    return content.map(lambda c: pdf_text(c, False))


def _decoded(content: Column) -> Column:
    """UTF-8 text; bytes that aren't count as U+FFFD."""
    return F.make_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string"))


def _by_kind(files: DataFrame, kind: Column, plain: list[str], pdf, other: Column) -> DataFrame:
    """Only Word and PDF files go through Python."""
    files = files.withColumn("__kind", kind)
    rest = files.where(~F.col("__kind").isin("pdf", "docx")).withColumn("text", F.when(F.col("__kind").isin(plain), _decoded(F.col("content"))).otherwise(other))
    word = files.where("__kind = 'docx'").withColumn("text", F.coalesce(_docx("content"), other))
    paged = files.where("__kind = 'pdf'").withColumn("text", F.coalesce(pdf("content"), other))
    return rest.unionByName(word).unionByName(paged).select(*[c for c in files.columns if c not in ("content", "__kind")], "text")


def extract_text(files: DataFrame) -> DataFrame:
    """PDF pages behind page marks, Word paragraphs, txt and md as UTF-8; suffixes in any case. For all else, and where a
    file can't be read, a sentence says so."""
    placeholder = F.concat(F.lit("[Extracted text from "), "filename", F.lit(" - install PyPDF2/python-docx for real extraction]"))
    return _by_kind(files, fn.extension(F.col("filename")), ["txt", "md"], _pdf, placeholder)


def extract_text_strict(files: DataFrame) -> DataFrame:
    """PDF pages without marks, Word paragraphs and txt, by suffixes in lower case only; all else has a null text and
    ``status`` 400."""
    suffix = F.regexp_extract("filename", r"\.([^.]+)$", 1)
    found = _by_kind(files, suffix, ["txt"], _pdf_bare, F.lit(None).cast("string"))
    return found.withColumn("status", F.when(F.col("text").isNull(), 400).otherwise(200))
