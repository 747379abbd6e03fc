"""Audited character normalisation: catalogue, candidate scan, apply, audit."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: class → whether a candidate of it may be converted without review
APPROVED, AMBIGUOUS = "approved", "ambiguous"


def accent_catalog() -> list[tuple[str, str, str]]:
    """(source, target, class) of accented Latin-1 letters, derived from Unicode decompositions."""
    out = []
    for code in range(0xC0, 0x100):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            out.append((chr(code), base, APPROVED if base in "aeiouAEIOU" else AMBIGUOUS))
    return out


def vertical_catalog() -> list[tuple[str, str, str]]:
    """(source, target, class) of super- and subscript characters, derived from Unicode compatibility decompositions."""
    out = []
    for code in (*range(0x80, 0x300), *range(0x2070, 0x20A0)):
        kind, _, target = unicodedata.decomposition(chr(code)).partition("> ")
        if kind in ("<super", "<sub"):
            text = "".join(chr(int(c, 16)) for c in target.split())
            out.append((chr(code), text, APPROVED if text.isdigit() else AMBIGUOUS))
    return out


def candidate_scan(docs: DataFrame, catalog: list[tuple[str, str, str]], doc_id: str = "doc_id", text: str = "text", around: int = 12) -> DataFrame:
    """Every catalogued character: occurrence id, offset, target, class and context.

    One pass over the characters of a text gives its candidates with their short
    contexts, cut from the array of characters, so the time grows with the text.
    Only candidates move for their numbering, which goes on over repeated rows of a
    doc_id.
    """
    known = docs.sparkSession.createDataFrame(catalog, "source string, target string, class string")
    sources = [s for s, _, _ in catalog]
    # the characters are a column of their own: inside the lambda they would be made again for every candidate
    rows = docs.where(F.col(text).rlike("[" + "".join(sources) + "]")).select(F.col(doc_id).alias("doc_id"), F.split(F.col(text), "").alias("chars"))
    context = lambda i: F.array_join(F.slice("chars", F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), "")
    found = F.array_compact(F.transform("chars", lambda c, i: F.when(c.isin(sources), F.struct(i.alias("offset"), c.alias("source"), context(i).alias("context")))))
    rows = rows.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    hits = rows.join(F.broadcast(known), "source")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("offset")).cast("string")
    number = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0"))  # lpad alone would cut longer numbers
    return hits.select("doc_id", F.concat(F.lit("V"), number).alias("occurrence_id"), "offset", "source", "target", "class", "context")


def apply_catalog(docs: DataFrame, catalog: list[tuple[str, str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Text with the approved class converted, and how many characters changed; targets may have any length; no shuffle."""
    easy = {s: t for s, t, c in catalog if c == APPROVED}
    if all(len(t) == 1 for t in easy.values()):
        out = F.translate(F.col(text), "".join(easy), "".join(easy.values()))
    else:  # one pass over the characters, so that no target is converted again
        table = F.create_map(*[F.lit(x) for pair in easy.items() for x in pair])
        out = F.array_join(F.transform(F.split(F.col(text), ""), lambda c: F.coalesce(table[c], c)), "")
    count = F.regexp_count(F.col(text), F.lit("[" + "".join(easy) + "]"))
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), out.alias("normalized"), count.alias("n_converted"))


def audit(candidates: DataFrame) -> DataFrame:
    """One record per candidate: converted or preserved, with the reason."""
    ok = F.col("class") == APPROVED
    return candidates.select(
        "doc_id", "occurrence_id", F.when(ok, "convert").otherwise("preserve").alias("action"), F.when(ok, F.lit("")).otherwise(F.concat(F.lit("class:"), "class")).alias("reason")
    )
