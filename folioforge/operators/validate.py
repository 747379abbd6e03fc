"""Integrity gates as data (violation rows), anchors, limits, retention and id allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(base: Column, live: Column, seen: Column) -> Column:
    """clean / dirty / stale-clean / conflict from two hash equalities."""
    source_same, draft_same = base == live, base == seen
    return F.when(source_same & draft_same, "clean").when(source_same, "dirty").when(draft_same, "stale-clean").otherwise("conflict")


def tombstone_violations(baseline: DataFrame, live: DataFrame, deleted: DataFrame) -> DataFrame:
    """Ids neither live nor deleted, deletions of unknown ids, and ids both live and deleted."""
    missing = baseline.join(live, "id", "left_anti").join(deleted, "id", "left_anti").select("id", F.lit("missing-tombstone").alias("code"))
    unknown = deleted.join(baseline, "id", "left_anti").select("id", F.lit("unknown-delete").alias("code"))
    both = live.join(deleted, "id", "left_semi").select("id", F.lit("live-and-deleted").alias("code"))
    return missing.unionByName(unknown).unionByName(both)


def anchor_violations(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Anchors (id, at) without partner, twice, or ending before they start; one full outer join on the counts."""
    s = starts.groupBy("id").agg(F.count(F.lit(1)).alias("n_start"), F.min("at").alias("start"))
    e = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_end"), F.min("at").alias("end"))
    both = s.join(e, "id", "full")
    code = (
        F.when(F.col("n_end").isNull(), "anchor-not-closed").when(F.col("n_start").isNull(), "anchor-not-opened")
        .when((F.col("n_start") > 1) | (F.col("n_end") > 1), "anchor-duplicate").when(F.col("start") > F.col("end"), "anchor-reversed")
    )
    return both.select("id", code.alias("code")).where(F.col("code").isNotNull())


def limit_violations(measured: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """(key, dimension, actual, limit) for each measured column above its inclusive limit."""
    pairs = ", ".join(f"'{c}', cast({c} as bigint), cast({n} as bigint)" for c, n in limits.items())
    rows = measured.selectExpr(key, f"stack({len(limits)}, {pairs}) as (dimension, actual, max_allowed)")
    return rows.where("actual > max_allowed")


def retention(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keys, outcome) for signatures (keys, sig): kept, changed, added or removed."""
    both = before.select(*keys, F.col("sig").alias("b")).join(after.select(*keys, F.col("sig").alias("a")), list(keys), "full")
    outcome = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "kept").otherwise("changed")
    return both.select(*keys, outcome.alias("outcome"))


def lowest_free_ids(used: DataFrame, groups: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` lowest positive ids that each group (g) doesn't use; ``used`` has (g, id).

    Among the numbers 1 … n + wanted at least ``wanted`` are free, so the candidate range follows each group's own count.
    """
    n = used.groupBy("g").agg(F.countDistinct("id").alias("n"))
    room = groups.join(n, "g", "left").select("g", F.explode(F.sequence(F.lit(1), (F.coalesce("n", F.lit(0)) + wanted).cast("int"))).alias("id"))
    free = room.join(used.select("g", F.col("id").cast("int").alias("id")), ["g", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    return free.withColumn("rank", rank).where(F.col("rank") <= wanted)


def attach_preceding(events: DataFrame, group: str, order: list[str], is_holder: Column, value: Column) -> DataFrame:
    """As-of attach: the last holder's value at or before each row (null before the first)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("attached_to", F.last(F.when(is_holder, value), ignorenulls=True).over(w))


def containment(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges (g, start, stop, id) that hold each point (g, at): equi-join on the group, range test inside."""
    r = ranges.select(F.col("g").alias("rg"), "start", "stop", "id")
    return points.join(r, (F.col("g") == F.col("rg")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop"))).drop("rg")


def fnv1a_utf16(text: Column) -> Column:
    """FNV-1a over UTF-16 code units (little-endian bytes taken in pairs), as eight hex digits."""
    raw = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16LE")), F.lit("(..)(..)"), F.lit(0))
    units = F.transform(raw, lambda x: F.conv(F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)), 16, 10).cast("bigint"))
    step = lambda acc, u: F.pmod(acc.bitwiseXOR(u) * F.lit(16777619), F.lit(4294967296))
    return F.when(F.length(text) == 0, F.lit("811c9dc5")).otherwise(F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("bigint"), step))), 8, "0"))


def occurrences(docs: DataFrame, items: DataFrame, limit_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, n): how often each item's text occurs in each document that has it.

    One linear pass over the documents with an automaton over all item texts.  The automaton is
    broadcast, so items go in groups of about ``limit_bytes`` of text (64 bytes more per item); each further group is one more pass.
    """
    import pyarrow as pa

    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups, found = max(1, -(-size // limit_bytes)), None
    for k in range(groups):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k)
        texts: dict[str, list] = {}
        for r in some.where("text <> ''").collect():
            texts.setdefault(r.text, []).append(r.item_id)
        shared = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches, shared=shared):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, ids in shared.value.items():
                automaton.add_word(t, ids)
            automaton.make_automaton()
            for batch in batches:
                out: list = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts: dict = {}
                    for _, ids in automaton.iter(t) if shared.value else ():
                        for i in ids:
                            counts[i] = counts.get(i, 0) + 1
                    out += [(i, d, n) for i, n in counts.items()]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "n"])

        rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "item_id long, doc_id long, n long")
        found = rows if found is None else found.union(rows)
    return found


def text_match(items: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, n_docs, code): ok for exactly one holder, else text-not-found or text-ambiguous."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    got = items.select("item_id").join(n, "item_id", "left").withColumn("n_docs", F.coalesce("n", F.lit(0).cast("long")))
    code = F.when(F.col("n_docs") == 0, "text-not-found").when(F.col("n_docs") > 1, "text-ambiguous").otherwise("ok")
    return got.select("item_id", "n_docs", code.alias("code"))
