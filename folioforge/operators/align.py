"""Alignment of drafts with their baseline, and who owns the style of what changed.

Opcodes are those of recursive longest matching blocks (the earliest of the
longest).  Only that recursion runs in Python, over integers: a pair's units are
numbered by Arrow, and the places where a block of some length ends are bit
sets, so that lengths double with one shift and one ``and`` per place; long pairs
go row by row instead.  Batches are bounded by bytes and one pair of a batch is
open at a time, so a task's memory is that of its longest pair.  A paragraph's
units are one row of arrays: values, and runs of units alike in style and place,
from which slices, contexts, codes and assigned styles are taken.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .units import LAST, clusters, in_pos

#: Bytes of one Arrow batch of pairs; a longer pair is a batch of its own.
BATCH_BYTES = 1 << 20
#: Bits of the sets of one level, above which blocks are looked for row by row.
MOST_BITS = 1 << 26


def longest_block(a: list[int], places: list[int], lo_b: int, hi_b: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the first longest common block; ``places``: bit set in b of every value of ``a``."""
    width = (1 << (hi_b - lo_b)) - 1
    ends = [(p >> lo_b) & width for p in places]
    if not any(ends):
        return 0, 0, 0
    levels, size = [ends], 1
    while True:  # where blocks of twice the length end
        last = levels[-1]
        more = [0] * size + [x & (y << size) for x, y in zip(last[size:], last)]
        if len(last) <= size or not any(more):
            break
        levels.append(more)
        size *= 2
    best, found = levels[-1], size
    for ends in reversed(levels[:-1]):
        size //= 2
        more = [0] * found + [x & (y << found) for x, y in zip(best[found:], ends)]
        if any(more[: len(best)]):
            best, found = more[: len(best)], found + size
    i = next(k for k, x in enumerate(best) if x)
    return i - found + 1, lo_b + (best[i] & -best[i]).bit_length() - found, found


def longest_block_by_rows(a: list[int], b: np.ndarray, lo_b: int) -> tuple[int, int, int]:
    """The same from the values themselves, in memory that grows with ``b`` alone."""
    best, runs = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a):
        runs[1:] = np.where(b == x, runs[:-1] + 1, 0)
        j = int(runs.argmax())
        n = int(runs[j])
        if n > best[2]:
            best = (i - n + 1, lo_b + j - n, n)
    return best


def opcodes(a: list[int], b: list[int]) -> list[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert steps that turn a into b."""
    long = len(a) * len(b) > MOST_BITS
    values, where, places = np.array(b), {}, []
    if not long:
        for j, x in enumerate(b):
            where[x] = where.get(x, 0) | 1 << j
        places = [where.get(x, 0) for x in a]
    todo, blocks = [(0, len(a), 0, len(b))], []
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        i, j, n = longest_block_by_rows(a[lo_a:hi_a], values[lo_b:hi_b], lo_b) if long else longest_block(a, places[lo_a:hi_a], lo_b, hi_b)
        if n:
            i += lo_a
            blocks.append((i, j, n))
            if lo_a < i and lo_b < j:
                todo.append((lo_a, i, lo_b, j))
            if i + n < hi_a and j + n < hi_b:
                todo.append((i + n, hi_a, j + n, hi_b))
    out, i, j = [], 0, 0
    for x, y, n in [*sorted(blocks), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            if out and out[-1][0] == "equal" and (out[-1][2], out[-1][4]) == (x, y):
                out[-1] = ("equal", out[-1][1], x + n, out[-1][3], y + n)
            else:
                out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def with_opcodes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, a, b: arrays of values, and other columns) with ``ops``; from_a … to_b are offsets in characters of the values."""
    names = ("operation", "i1", "i2", "j1", "j2", "from_a", "to_a", "from_b", "to_b")
    kinds = [pa.string(), *[pa.int32()] * 8]

    def run(batches):
        for batch in batches:
            columns, stops = [[] for _ in names], [0]
            for k in range(len(batch)):
                sides = [batch.column(c)[k].values for c in ("a", "b")]
                flat = pa.concat_arrays(sides)
                numbers, widths, n = flat.dictionary_encode().indices.to_pylist(), pc.utf8_length(flat).to_pylist(), len(sides[0])
                wide_a, wide_b = [0, *accumulate(widths[:n])], [0, *accumulate(widths[n:])]
                for op, i1, i2, j1, j2 in opcodes(numbers[:n], numbers[n:]):
                    for column, x in zip(columns, (op, i1, i2, j1, j2, wide_a[i1], wide_a[i2], wide_b[j1], wide_b[j2])):
                        column.append(x)
                stops.append(len(columns[0]))
            steps = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), steps)], [*batch.schema.names, "ops"])

    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{schema}, ops array<struct<operation:string," + ",".join(f"{n}:int" for n in names[1:]) + ">>")


def text_hunks(pairs: DataFrame) -> DataFrame:
    """(id, hunk, operation, i1, i2, j1, j2, removed, inserted) of (id, before, after) texts; offsets are code points.

    Equal and null pairs have no hunks and never reach Python.
    """
    changed = pairs.where("before IS NOT NULL AND after IS NOT NULL AND before <> after")
    sides = changed.select("id", "before", "after", clusters(F.col("before")).alias("a"), clusters(F.col("after")).alias("b"))
    rows = with_opcodes(sides, ["id"]).select("id", "before", "after", F.posexplode(F.filter("ops", lambda x: x["operation"] != "equal")).alias("hunk", "h"))
    part = lambda text, lo, hi: F.substring(text, F.col(lo) + 1, F.col(hi) - F.col(lo))
    spans = [F.col(f"h.{x}").alias(y) for x, y in zip(("from_a", "to_a", "from_b", "to_b"), ("i1", "i2", "j1", "j2"))]
    rows = rows.select("id", "hunk", "h.operation", *spans, "before", "after")
    return rows.withColumns({"removed": part("before", "i1", "i2"), "inserted": part("after", "j1", "j2")}).drop("before", "after")


def spliced(pairs: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, text): every ``before`` text with its hunks put in, all at once."""
    pieces = hunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i1", "hunk", "i2", "inserted"))).alias("h"))
    rows = pairs.where("before IS NOT NULL AND after IS NOT NULL").join(pieces, "id", "left").withColumn("h", F.coalesce("h", F.array()))
    stops = F.concat(F.array(F.lit(0)), F.transform("h", lambda x: x["i2"]))
    kept = F.transform("h", lambda x, k: F.concat(F.substring("before", stops[k] + 1, x["i1"] - stops[k]), x["inserted"]))
    tail = F.substring("before", F.try_element_at(stops, F.lit(-1)) + 1, F.length("before"))
    return rows.select("id", F.concat(F.array_join(kept, ""), tail).alias("text"))


def _listed(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """by, ``name`` (values in order, X before text and T before a token) and ``name``_runs of units.

    A run (lo, hi, token, style, wrappers, in_revision, chars) is a token, or text alike in all of these.
    """
    w = in_pos(by)
    like = lambda c: F.lag(c).over(w).eqNullSafe(F.col(c))
    same = ~F.col("is_token") & ~F.lag("is_token", 1, True).over(w) & like("style") & like("wrappers") & like("in_revision")
    value = F.concat(F.when(F.col("is_token"), "T").otherwise("X"), F.col("value"))
    rows = rows.select(*by, "pos", value.alias("v"), "is_token", "style", "wrappers", "in_revision", F.sum(F.when(same, 0).otherwise(1)).over(w).alias("run"))
    runs = rows.groupBy(*by, "run").agg(
        F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.first("is_token").alias("token"), F.first("style").alias("style"), F.first("wrappers").alias("wrappers"), F.first("in_revision").alias("in_revision"),
        F.sum(F.length("v") - 1).cast("int").alias("chars"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("held"),
    )
    facts = ("lo", "hi", "token", "style", "wrappers", "in_revision", "chars")
    every = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*facts, F.transform("held", lambda x: x["v"]).alias("values")))).alias("r"))
    return every.select(*by, F.flatten(F.transform("r", lambda x: x["values"])).alias(name), F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in facts])).alias(f"{name}_runs"))


def _hunk(o: Column) -> Column:
    """One of ``ops`` with what it replaces and puts in, and the styled units nearest to its start."""
    i1, i2, j1, j2 = (o[c] for c in ("i1", "i2", "j1", "j2"))
    none = F.array()
    met = lambda runs, lo, hi: F.filter(F.coalesce(runs, none), lambda x: (lo < hi) & (x["lo"] < hi) & (x["hi"] > lo))
    base, draft = met("a_runs", i1, i2), met("b_runs", j1, j2)
    text = lambda values, lo, hi: F.array_join(F.transform(F.filter(F.slice(values, lo + 1, hi - lo), lambda v: v.startswith("X")), lambda v: F.substring(v, 2, LAST)), "")
    styled = F.filter(F.coalesce("a_runs", none), lambda x: ~x["token"] & x["style"].isNotNull())
    one = lambda x, k: F.when(x.isNotNull(), F.struct(x["style"].alias("style"), F.substring(F.get("a", k), 2, LAST).alias("value")))
    left, right = F.try_element_at(F.filter(styled, lambda x: x["lo"] < i1), F.lit(-1)), F.get(F.filter(styled, lambda x: x["hi"] > i1), F.lit(0))
    # characters of text alone: offsets in ``a`` count those of tokens and a letter for each value
    tokens = F.aggregate(F.filter(F.coalesce("a_runs", none), lambda x: x["token"] & (x["lo"] < i1)), F.lit(0), lambda n, x: n + x["chars"])
    made = {
        "base_token": F.exists(base, lambda x: x["token"]), "base_revision": F.exists(base, lambda x: x["in_revision"]), "draft_token": F.exists(draft, lambda x: x["token"]), "draft_revision": F.exists(draft, lambda x: x["in_revision"]),
        "base_styles": F.array_sort(F.array_distinct(F.array_compact(F.transform(base, lambda x: F.when(~x["token"], x["style"]))))), "base_paths": F.size(F.array_distinct(F.transform(base, lambda x: x["wrappers"]))),
        "removed": text("a", i1, i2), "inserted": text("b", j1, j2), "left": one(left, F.least(left["hi"], i1) - 1), "right": one(right, F.greatest(right["lo"], i1)), "base_start": o["from_a"] - i1 - tokens,
    }
    return F.struct(*[o[c].alias(c) for c in ("operation", "i1", "i2", "j1", "j2")], *[x.alias(c) for c, x in made.items()])


def plan_hunks(base: DataFrame, drafts: DataFrame, paragraphs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hunks, draft units with their styles) of edited paragraphs.

    ``base`` and ``drafts``: units (see operators/units.py); ``paragraphs``: by,
    mode (direct, track or ambiguous), has_opaque, insertion_style.  Hunks carry the
    units and characters they replace, source_styles, assigned_style, reason and
    code.  A code rejects its whole paragraph; the first one in order counts:
    opaque-paragraph-mutated, protected-token-mutated, edit-mode-ambiguous,
    revision-text-mutated-in-direct-mode, protected-context-ambiguous,
    ambiguous-alignment, protected-boundary-crossing, unanchored-mixed-rewrite,
    mixed-replacement-requires-unchanged-text.

    A stretch between matching blocks has no unit in common on its two sides, so a
    replaced stretch has no unchanged unit inside, and its text takes the one style
    of what it replaces.
    """
    # the size of a unit table's files is a small part of what its rows take in memory: joins that hold units are never broadcast
    none = F.array().cast("array<string>")
    sides = paragraphs.join(_listed(base, "a", by).hint("merge"), by, "left").join(_listed(drafts, "b", by).hint("merge"), by, "left").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    ops = with_opcodes(sides.where("a <> b"), by)
    parts = F.transform(F.filter("ops", lambda o: o["operation"] != "equal"), _hunk)
    kept = F.transform(F.filter("ops", lambda o: o["operation"] == "equal"), lambda o: F.struct(o["i1"].alias("i1"), o["j1"].alias("j1"), o["j2"].alias("j2")))
    steps = written(ops.select(*by, "mode", "has_opaque", "insertion_style", F.size("a").alias("n_base"), parts.alias("hunks"), kept.alias("kept")), "steps")
    hunks = steps.select(*by, "mode", "has_opaque", "insertion_style", "n_base", F.posexplode("hunks").alias("hunk", "h")).select("*", "h.*").drop("h")
    pure, either = F.col("operation") == "insert", lambda c: F.col(f"base_{c}") | F.col(f"draft_{c}")
    direct, start = F.col("mode") == "direct", F.col("i1") == 0
    unlike = (F.col("left.value") == F.col("right.value")) & (F.col("left.style") != F.col("right.style"))
    replaced = (F.col("operation") == "replace")
    code = (
        F.when(F.col("has_opaque"), "opaque-paragraph-mutated").when(either("token"), "protected-token-mutated").when(F.col("mode") == "ambiguous", "edit-mode-ambiguous")
        .when(direct & either("revision"), "revision-text-mutated-in-direct-mode").when(pure & ~start & F.col("left").isNull() & F.col("right").isNull(), "protected-context-ambiguous")
        .when(pure & ~start & F.coalesce(unlike, F.lit(False)), "ambiguous-alignment").when(replaced & (F.col("base_paths") > 1), "protected-boundary-crossing")
        .when(replaced & (F.size("base_styles") > 1) & start & (F.col("i2") == F.col("n_base")), "unanchored-mixed-rewrite").when(replaced & (F.size("base_styles") > 1), "mixed-replacement-requires-unchanged-text")
    )
    style = (
        F.when(replaced, F.get("base_styles", F.lit(0))).when(pure & start, F.coalesce("right.style", "insertion_style")).when(pure, F.coalesce("left.style", "right.style"))
    )
    reason = (
        F.when(F.col("mode") == "track", "tracked-revision-mapping").when(F.col("operation") == "delete", "deletion-preserves-survivors").when(replaced, "single-region-inheritance")
        .when(start, F.when(F.col("right").isNotNull(), "paragraph-start-right-context").otherwise("insertion-style-fallback")).when(F.col("left").isNotNull(), "left-context").otherwise("right-context-fallback")
    )
    hunks = hunks.withColumns({"code": code, "assigned_style": F.when(code.isNull(), style), "reason": F.when(code.isNull(), reason), "source_styles": F.col("base_styles")})
    equal = steps.select(*by, F.inline("kept")).select(*by, F.posexplode(F.sequence(F.col("j1"), F.col("j2") - 1)).alias("k", "pos"), "i1").select(*by, "pos", (F.col("i1") + F.col("k")).alias("from_pos"))
    new = hunks.where("j2 > j1").select(*by, F.explode(F.sequence(F.col("j1"), F.col("j2") - 1)).alias("pos"), F.col("assigned_style").alias("new_style"))
    known = base.select(*by, F.col("pos").alias("from_pos"), F.col("style").alias("old_style"), F.col("node").alias("old_node"))
    units = drafts.join(equal.hint("merge"), [*by, "pos"], "left").join(known.hint("merge"), [*by, "from_pos"], "left").join(new.hint("merge"), [*by, "pos"], "left")
    units = units.select(*by, "pos", "value", "is_token", F.coalesce("old_style", "new_style").alias("style"), "wrappers", "in_revision", F.coalesce("old_node", "node").alias("node"), "role")
    shown = ["hunk", "mode", "operation", "i1", "i2", "j1", "j2", "base_start", "removed", "inserted", "source_styles", "assigned_style", "reason", "code"]
    return hunks.select(*by, *shown), units


def rejected(hunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, code): paragraphs with the code of their first failing hunk."""
    bad = hunks.where("code IS NOT NULL")
    return bad.groupBy(*by).agg(F.min_by("code", "hunk").alias("code"))


def synced_units(base: DataFrame, units: DataFrame, hunks: DataFrame, by: list[str]) -> DataFrame:
    """Units of all paragraphs after a direct synchronisation: drafts that changed and weren't rejected, otherwise the baseline."""
    changed = hunks.select(*by).distinct().join(rejected(hunks, by), by, "left_anti")
    return units.join(changed, by, "left_semi").unionByName(base.join(changed, by, "left_anti"))


def tracked(hunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hunks as tracked revisions (keys, hunk, part, kind, at, text): insert, delete, or a deletion followed by an insertion."""
    entry = lambda kind, text: F.when(F.col(text) != "", F.struct(F.lit(kind).alias("kind"), F.col(text).alias("text")))
    parts = F.array_compact(F.array(entry("delete", "removed"), entry("insert", "inserted")))
    at = "base_start" if "base_start" in hunk_rows.columns else "i1"
    return hunk_rows.select(*keys, "hunk", F.col(at).alias("at"), F.posexplode(parts).alias("part", "r")).select(*keys, "hunk", "part", "r.kind", "at", "r.text")
