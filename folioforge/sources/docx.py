"""Word packages as DataFrames: packages → parts → nodes and paragraphs, and back to bytes.

``read_packages`` uses Spark's binaryFile source.  Only zip archives are read and
written in Python, one package per row; what is inside is read by
``operators/nodes.py``.  A bad package or part becomes a violation row and never
stops a job.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes as N
from .scratch import written

# Names of the main part and of the other parts whose text is editable.
MAIN = "word/document.xml"
EDITABLE = re.compile(r"word/(header\d+|footer\d+|footnotes|endnotes|comments)\.xml")
#: A package part of more than this many bytes is refused before it is inflated.
MAX_PART = 1 << 28

PART = "doc_id string, part string, content binary, sha256 string, size long, is_editable boolean, violation string"
KEYS = N.KEYS


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of every package under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("doc_id"), "content")


def explode_parts(packages: DataFrame) -> DataFrame:
    """One row per package part, or one row with the violation for a package that can't be read."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, content in zip(pdf.doc_id, pdf.content):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        names = [i.filename for i in infos]
                        if MAIN not in names:
                            raise ValueError("not a valid DOCX")
                        if len(names) != len(set(names)):
                            raise ValueError("duplicate-entries")
                        if any(i.file_size > MAX_PART for i in infos):
                            raise ValueError("resource-limit-exceeded")
                        rows = []
                        for i in infos:
                            data = z.read(i)
                            rows.append((doc_id, i.filename, data, hashlib.sha256(data).hexdigest(), len(data), i.filename == MAIN or bool(EDITABLE.fullmatch(i.filename)), None))
                    out += rows
                except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, RuntimeError) as e:
                    code = str(e) if isinstance(e, ValueError) else "package-validity"
                    out.append((doc_id, None, None, None, None, None, code))
            yield pd.DataFrame(out, columns=["doc_id", "part", "content", "sha256", "size", "is_editable", "violation"])

    return packages.select("doc_id", "content").mapInPandas(run, PART)


def part_texts(parts: DataFrame) -> DataFrame:
    """(doc_id, part, xml) of the editable parts that are UTF-8."""
    return parts.where(F.col("is_editable") & F.is_valid_utf8("content")).select("doc_id", "part", F.col("content").cast("string").alias("xml"))


def part_tokens(parts: DataFrame) -> DataFrame:
    """Nested tokens of the editable parts."""
    return N.nest(N.tokens(part_texts(parts), KEYS, "xml"), KEYS)


def part_violations(parts: DataFrame, nested: DataFrame) -> DataFrame:
    """(doc_id, part, code, detail) of packages and parts that can't be read; detail is a byte offset."""
    packages = parts.where("violation IS NOT NULL").select("doc_id", "part", F.col("violation").alias("code"), F.lit(None).cast("long").alias("detail"))
    broken = parts.where(F.col("is_editable") & ~F.is_valid_utf8("content")).select("doc_id", "part", F.lit("invalid-encoding").alias("code"), F.lit(None).cast("long").alias("detail"))
    return packages.union(broken).union(N.nesting_violations(nested, KEYS).select("doc_id", "part", "code", F.col("start").alias("detail")))


def sound_tokens(parts: DataFrame) -> DataFrame:
    """Nested tokens of the editable parts without violations."""
    nested = part_tokens(parts)
    return N.sound(nested, N.nesting_violations(nested, KEYS), KEYS)


def parse_paragraphs(parts: DataFrame) -> DataFrame:
    """Addressed paragraphs of all editable parts with byte ranges, both views and the number of their revisions."""
    nested = written(sound_tokens(parts), "tokens")
    paragraphs = written(N.word_paragraphs(nested), "paragraphs")
    return N.word_views(paragraphs, N.word_nodes(nested, paragraphs))


def parse_nodes(parts: DataFrame) -> DataFrame:
    """Node rows of all editable parts."""
    nested = written(sound_tokens(parts), "tokens")
    return N.word_nodes(nested, written(N.word_paragraphs(nested), "paragraphs"))


def parse_revisions(parts: DataFrame) -> DataFrame:
    """Revision rows with the key ``part|kind|id|fingerprint``."""
    return N.word_revisions(parse_nodes(parts))


def mark_revisions(nested: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, part, paragraph_id, kind, w_id, author): insertions and deletions of paragraph marks."""
    entry = F.struct("seq", "name", "level")
    rows = N.with_chain(nested.where("kind IN ('open', 'close', 'alone')"), KEYS, ["p", "pPr"], entry)
    p = F.try_element_at(F.filter("chain", lambda x: x["name"] == "p"), F.lit(-1))
    inside = F.try_element_at(F.col("chain"), F.lit(-1))["name"] == "pPr"
    marks = rows.where((F.col("kind") == "alone") & F.col("name").isin("ins", "del") & (F.col("parent_name") == "rPr") & inside).withColumn("p", p["seq"])
    found = N.attributes(F.col("token"))
    rows = marks.join(paragraphs.select(*KEYS, F.col("seq").alias("p"), "paragraph_id"), [*KEYS, "p"])
    kind = F.when(F.col("name") == "ins", "insert").otherwise("delete")
    return rows.select(*KEYS, "paragraph_id", kind.alias("kind"), found["w:id"].alias("w_id"), found["w:author"].alias("author"))


def joined_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, part, content): tokens in order as the bytes of their part."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "token")))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(pieces, lambda x: x["token"]), "").cast("binary").alias("content"))


def settled_tokens(nested: DataFrame, accept: bool) -> DataFrame:
    """Tokens with every revision accepted or rejected.

    Tags of revisions go, and with them the content of those that lose; deleted
    text that stays becomes text; anchors in removed content stay where it was.
    """
    lost = [n for n, k in N.REVISIONS.items() if k in (("delete", "move_from") if accept else ("insert", "move_to"))]
    rows = N.with_chain(nested, KEYS, lost, F.struct("seq"))
    gone = (F.size("chain") > 0) & ~F.coalesce(F.col("name").isin(*N.ANCHORS), F.lit(False))
    kept = rows.where(~gone & ~F.col("name").isin(*N.REVISIONS))
    text = F.when(F.col("name") == "delText", F.regexp_replace("token", "delText", "t")).otherwise(F.col("token"))
    return kept.drop("chain") if accept else kept.withColumn("token", text).drop("chain")


def replaced_tokens(nested: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens and (doc_id, part, paragraph_id, code) of ``edits(doc_id, part, paragraph_id, old, new)``.

    A text that is found exactly once in one text node of its paragraph is
    replaced (code null).  Codes: text-ambiguous, cross-region-text (it is in the
    visible text, but not in one node), text-not-found, duplicate-edit (more than
    one edit of the paragraph; none of them is done).
    """
    by = [*KEYS, "paragraph_id"]
    nested = written(nested, "tokens")
    paragraphs = written(N.word_paragraphs(nested), "paragraphs")
    nodes = written(N.word_nodes(nested, paragraphs), "nodes")
    once = edits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edits"), F.first("old").alias("old"), F.first("new").alias("new"))
    hits = F.when(F.col("old") != "", (F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old")).otherwise(0).cast("int")
    found = nodes.where("cls = 'text'").join(once, by).withColumn("hits", hits).where("hits > 0")
    sums = found.groupBy(*by).agg(F.sum("hits").alias("hits"))
    views = N.word_views(paragraphs, nodes).select(*by, "final_text")
    code = (
        F.when(F.col("n_edits") > 1, "duplicate-edit").when(F.col("hits") > 1, "text-ambiguous").when(F.col("hits") == 1, F.lit(None))
        .when((F.col("old") != "") & F.contains("final_text", "old"), "cross-region-text").otherwise("text-not-found")
    )
    status = once.join(sums, by, "left").join(views, by, "left").select(*by, code.alias("code"))
    new = F.replace(F.replace(F.replace(F.replace("text", "old", "new"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    patches = found.join(status.where("code IS NULL"), by, "left_semi").select(*KEYS, "seq", new.alias("patch"))
    return nested.join(patches, [*KEYS, "seq"], "left").withColumn("token", F.coalesce("patch", "token")).drop("patch"), status


def rewrite(content: bytes, new: dict[str, bytes]) -> bytes:
    """The package with new parts; a package without changes is returned byte for byte."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [(i, z.read(i)) for i in z.infolist()]
    if all(new.get(i.filename, data) == data for i, data in parts):
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, data in parts:
            z.writestr(info, new.get(info.filename, data))
    return out.getvalue()


def write_parts(packages: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, content): packages with the contents of ``parts(doc_id, part, content)`` put in place."""
    per_package = parts.groupBy("doc_id").agg(F.collect_list("part").alias("names"), F.collect_list("content").alias("contents"))

    def run(batches):
        for pdf in batches:
            new = [dict(zip(n, c)) if n is not None else {} for n, c in zip(pdf.names, pdf.contents)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "content": [rewrite(c, x) if x else c for c, x in zip(pdf.content, new)]})

    rows = packages.select("doc_id", "content").join(per_package, "doc_id", "left")
    return rows.mapInPandas(run, "doc_id string, content binary")


def settle_packages(packages: DataFrame, accept: bool) -> DataFrame:
    """(doc_id, content) with every revision of every editable part settled; parts with violations stay as they are."""
    return write_parts(packages, joined_parts(settled_tokens(sound_tokens(explode_parts(packages)), accept)))


def replace_in_packages(packages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages with the edits done, status of every edited paragraph), see :func:`replaced_tokens`."""
    rows, status = replaced_tokens(sound_tokens(explode_parts(packages)), edits)
    return write_parts(packages, joined_parts(rows)), status


def package_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts that were added or removed, or that changed without being editable."""
    b = before.select("doc_id", "part", F.col("sha256").alias("b"), "is_editable")
    both = b.join(after.select("doc_id", "part", F.col("sha256").alias("a")), ["doc_id", "part"], "full")
    code = (
        F.when(F.col("a").isNull(), "part-removed").when(F.col("b").isNull(), "part-added")
        .when((F.col("a") != F.col("b")) & ~F.col("is_editable"), "protected-part-changed")
    )
    return both.select("doc_id", "part", code.alias("code")).where(F.col("code").isNotNull())
