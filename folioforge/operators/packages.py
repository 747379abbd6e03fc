"""Relationship graphs and statistics of packages, from rows of their parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nodes as N
from ..sources.scratch import written

MIB = 1 << 20
# Inclusive limits of the three size profiles.
PROFILES = {
    "S": {"package_bytes": 25 * MIB, "xml_bytes": 100 * MIB, "n_parts": 2_000, "n_leaves": 20_000, "n_revisions": 5_000, "n_cells": 100_000, "depth": 512},
    "L": {"package_bytes": 250 * MIB, "xml_bytes": 1_024 * MIB, "n_parts": 20_000, "n_leaves": 200_000, "n_revisions": 50_000, "n_cells": 1_000_000, "depth": 1_024},
    "X": {"package_bytes": 500 * MIB, "xml_bytes": 2_048 * MIB, "n_parts": 40_000, "n_leaves": 400_000, "n_revisions": 100_000, "n_cells": 2_000_000, "depth": 2_048},
}


def resolved_target(rels: Column, target: Column) -> Column:
    """The package member that a relationship names, from the folder of its source part; null for targets outside the package."""
    external = target.startswith("/") | target.contains("://") | target.startswith("mailto:")
    folders = F.split(rels, "/")
    own = F.when(F.element_at(folders, F.greatest(F.size(folders) - 1, F.lit(1))) == "_rels", F.size(folders) - 2).otherwise(F.size(folders) - 1)
    base = F.slice(folders, F.lit(1), own)
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    steps = F.aggregate(F.split(target, "/"), base, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.when(~external, F.ltrim(F.array_join(steps, "/"), F.lit("/")))


def source_part(rels: Column) -> Column:
    """The part whose relationships a member holds; '' for those of the package."""
    return F.regexp_replace(F.regexp_replace(rels, r"(^|/)_rels/", "$1"), r"\.rels$", "")


def relationships(rels: DataFrame) -> DataFrame:
    """(doc_id, part, source, rel_id, type, target, resolved) of relationship members (doc_id, part, xml)."""
    rows = N.tokens(rels, N.KEYS, "xml").where(N.element() & (F.col("name") == "Relationship"))
    rows = rows.withColumn("a", F.explode(F.array(N.attributes(F.col("token")))))  # exploded, they are read once
    rows = rows.where(F.col("a")["Target"].isNotNull())
    return rows.select("doc_id", "part", source_part(F.col("part")).alias("source"), F.col("a")["Id"].alias("rel_id"), F.col("a")["Type"].alias("type"), F.col("a")["Target"].alias("target"), resolved_target(F.col("part"), F.col("a")["Target"]).alias("resolved"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(doc_id) of graphs (doc_id, a, b) that have a cycle of any length.

    Rounds take away every edge into a node without a way out and every edge from a
    node without a way in; what is left is empty exactly where there is no cycle.
    Rounds grow with the longest chain; each is two semi-joins on (doc_id, node).
    """
    left = written(edges.select("doc_id", "a", "b").distinct(), "edges")
    count = left.count()
    while count:
        starts, ends = left.select("doc_id", F.col("a").alias("n")).distinct(), left.select("doc_id", F.col("b").alias("n")).distinct()
        kept = left.join(starts.withColumnRenamed("n", "b"), ["doc_id", "b"], "left_semi").join(ends.withColumnRenamed("n", "a"), ["doc_id", "a"], "left_semi")
        left = written(kept.select("doc_id", "a", "b"), "edges")
        before, count = count, left.count()
        if count == before:
            break
    return left.select("doc_id").distinct()


#: Edges of a document that a task holds at most; documents of more meet in joins.
EDGES_HELD = 200_000
MUTUAL, TRANSITIVE = "relationship-cycle", "relationship-cycle-transitive"


def _left_by_removal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (a, b) that are left where every edge into a node without a way out is taken away: none without a cycle."""
    left, n = np.arange(len(a)), int(max(a.max(), b.max())) + 1
    for _ in range(32):  # short chains, all at once
        kept = left[np.bincount(a[left], minlength=n)[b[left]] > 0]
        if len(kept) == len(left):
            return left
        left = kept
    order = left[np.argsort(b[left], kind="stable")]
    begins, ways = np.searchsorted(b[order], np.arange(n + 1)).tolist(), np.bincount(a[left], minlength=n).tolist()
    source, stack = a[order].tolist(), [k for k in range(n) if not ways[k]]
    while stack:  # long ones, an edge at a time
        k = stack.pop()
        for x in source[begins[k] : begins[k + 1]]:
            ways[x] -= 1
            if not ways[x]:
                stack.append(x)
    return left[np.array(ways)[b[left]] > 0]


def _found_in(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, a, b, code) of whole documents' distinct edges: mutual ones, and documents with a cycle."""
    doc = pd.factorize(rows.doc_id)[0]
    name = pd.factorize(np.concatenate([rows.a, rows.b]))[0].astype(np.int64)
    node = pd.factorize(np.concatenate([doc, doc]).astype(np.int64) * (name.max() + 1) + name)[0]
    a, b = node[: len(doc)], node[len(doc) :]
    n = int(node.max()) + 1
    mutual = rows[np.isin(a * n + b, b * n + a)].assign(code=MUTUAL)
    cyclic_ = rows.doc_id.iloc[_left_by_removal(a, b)].drop_duplicates()
    return pd.concat([mutual, pd.DataFrame({"doc_id": cyclic_, "a": None, "b": None, "code": TRANSITIVE})])


def _graph_batches(batches):
    """(doc_id, a, b, code) from edges sorted by doc_id; a document of more than EDGES_HELD edges is passed on with null codes."""
    told = lambda rows: pa.RecordBatch.from_pandas(rows, _FOUND, preserve_index=False)
    held, passing = None, None
    for batch in batches:
        rows = batch.to_pandas()
        if passing is not None:
            yield told(rows[rows.doc_id == passing].assign(code=None))
            rows = rows[rows.doc_id != passing]
        if not len(rows):
            continue
        passing = None
        held = rows if held is None else pd.concat([held, rows])
        last = held.doc_id == held.doc_id.iloc[-1]
        if not last.all():
            yield told(_found_in(held[~last]))
            held = held[last]
        if len(held) > EDGES_HELD:
            yield told(held.assign(code=None))
            held, passing = None, held.doc_id.iloc[-1]
    if held is not None:
        yield told(_found_in(held))


_FOUND = pa.schema([(c, pa.string()) for c in ("doc_id", "a", "b", "code")])


def relationship_violations(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, source, resolved, code): relationship-target-missing, relationship-cycle (two parts name each other, or one itself),
    relationship-cycle-transitive (a document with a cycle of any length; source and resolved are null).

    Graphs of up to EDGES_HELD edges are read whole, a document after the other; larger ones by joins.
    """
    inner = links.where("resolved IS NOT NULL")
    missing = inner.join(members.select("doc_id", F.col("part").alias("resolved")), ["doc_id", "resolved"], "left_anti")
    out = missing.select("doc_id", "source", "resolved", F.lit("relationship-target-missing").alias("code")).distinct()
    edges = inner.select("doc_id", F.col("source").alias("a"), F.col("resolved").alias("b")).repartition("doc_id").distinct()
    found = written(edges.sortWithinPartitions("doc_id").mapInArrow(_graph_batches, "doc_id string, a string, b string, code string"), "graphs")
    out = out.union(found.where("code IS NOT NULL"))
    large = found.where("code IS NULL").drop("code")
    if large.isEmpty():
        return out
    mutual = large.join(large.select("doc_id", F.col("a").alias("b"), F.col("b").alias("a")), ["doc_id", "a", "b"], "left_semi")
    none = F.lit(None).cast("string")
    out = out.union(mutual.select("doc_id", "a", "b", F.lit(MUTUAL)))
    return out.union(cyclic(large).select("doc_id", none, none, F.lit(TRANSITIVE)))


def package_stats(packages: DataFrame, parts: DataFrame, nested: DataFrame) -> DataFrame:
    """doc_id, package_bytes, n_parts, xml_bytes, largest_part, ratio, depth, longest_text, n_leaves, n_revisions, n_cells.

    ``packages``: doc_id, content; ``parts``: rows of ``explode_parts``; ``nested``:
    nested tokens of the editable parts.  Depth and texts are those of the main part.
    """
    size = packages.select("doc_id", F.octet_length("content").cast("long").alias("package_bytes"))
    xml = F.col("part").startswith("word/") & F.col("part").endswith(".xml")
    sums = parts.where("part IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.coalesce(F.sum(F.when(xml, F.col("size"))), F.lit(0)).alias("xml_bytes"), F.max("size").alias("largest_part"), F.sum("size").alias("all_bytes"))
    main = F.col("part") == "word/document.xml"
    revisions = N.element() & F.col("name").isin(*N.REVISIONS)
    counts = nested.groupBy("doc_id").agg(
        F.max(F.when(main & N.opens(), F.col("level"))).alias("depth"), F.count_if(F.col("kind").isin("text", "cdata") & F.col("parent_name").isin("t", "delText")).alias("n_leaves"),
        F.count_if(revisions).alias("n_revisions"), F.count_if(N.element() & (F.col("name") == "tc")).alias("n_cells"),
    )
    runs = nested.where(main & (F.col("kind") == "text") & (F.col("parent_name") == "t")).groupBy("doc_id", "parent").agg(F.sum(F.octet_length("token")).alias("n"))
    longest = runs.groupBy("doc_id").agg(F.max("n").alias("longest_text"))
    rows = size.join(sums, "doc_id", "left").join(counts, "doc_id", "left").join(longest, "doc_id", "left")
    return rows.withColumn("ratio", F.try_divide(F.col("all_bytes"), F.col("package_bytes"))).drop("all_bytes").fillna(0)
