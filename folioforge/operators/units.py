"""Paragraphs as units: grapheme clusters and zero-width tokens, their edit projection, and back to nodes.

A unit has a value, a style (text only) and the wrappers it lies in.  Ranges and
insertions become a start and an end token around their content; deletions are
one gap token, their content is hidden; other nodes are tokens.  A token's value
is its placeholder, so a projection can be compared with what it was made from.
All of it is JVM expressions; order is that of path arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .nodes import unescaped, with_chain

# Approximate grapheme clusters.  CR LF, pairs of regional indicators, marks after
# anything, and whatever a zero-width joiner touches stay together.
_ONE = r"\r\n|[\x{1F1E6}-\x{1F1FF}]{2}|(?s:.)"
_JOINED = rf"\x{{200D}}+(?:{_ONE})?"
CLUSTER = rf"(?:{_JOINED}|{_ONE})(?:\p{{M}}+|{_JOINED})*"
# Placeholder brackets and their escapes in prose.
START, END = "⟦", "⟧"
LAST = 2**31 - 1


def clusters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0))


def _quoted(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (START, "&#x27E6;"), (END, "&#x27E7;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def placeholder(keyword: Column | str, pairs: Column) -> Column:
    """``⟦keyword key="value" …⟧`` of an array of (key, value); null values are left out."""
    said = F.transform(F.filter(pairs, lambda x: x["value"].isNotNull()), lambda x: F.concat(x["key"], F.lit('="'), _quoted(x["value"]), F.lit('"')))
    return F.concat(F.lit(START), keyword if isinstance(keyword, Column) else F.lit(keyword), F.lit(" "), F.array_join(said, " "), F.lit(END))


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _sorted_pairs(attrs: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(attrs)), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def hidden() -> Column:
    """Whether a node lies in a deletion."""
    return F.exists("rev_path", lambda x: x["kind"].isin("delete", "move_from"))


def units(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, value, is_token, style, wrappers, in_revision, node, role of the nodes of ``word_nodes``.

    role is text, token, gap, start or end; wrappers are the numbers of the
    enclosing ranges and insertions; node is the number of the node a unit is of.
    """
    number = F.concat(F.lit("N"), F.col("seq").cast("string"))
    none = F.create_map().cast("map<string,string>")
    own = F.when(F.col("cls") == "opaque", F.create_map(F.lit("tag"), F.col("tag"))).otherwise(F.coalesce("attrs", none))
    styled = F.when((F.col("cls") == "inline") & F.col("style").isNotNull(), F.map_concat(F.map_filter(own, lambda k, v: k != "style"), F.create_map(F.lit("style"), F.col("style")))).otherwise(own)
    rest = _sorted_pairs(F.map_filter(styled, lambda k, v: ~k.isin("id", "kind")))
    known = F.concat(F.array(_pair("id", number), _pair("kind", F.col("kind"))), rest)
    only_id, revision = F.array(_pair("id", number)), F.regexp_replace("kind", "_", "-")
    unit = lambda order, value, role: F.struct(order.alias("order"), value.alias("value"), F.lit(role).alias("role"))
    here, after = F.col("path").cast("array<long>"), F.concat(F.col("path").cast("array<long>"), F.array(F.lit(LAST).cast("long")))
    text = F.transform(clusters(F.coalesce("text", F.lit(""))), lambda c, i: unit(F.concat(here, F.array(i.cast("long"))), c, "text"))
    made = (
        F.when(F.col("cls") == "text", text)
        .when(F.col("cls") == "range", F.array(unit(here, placeholder("range-start", known), "start"), unit(after, placeholder("range-end", only_id), "end")))
        .when((F.col("cls") == "revision") & F.col("kind").isin("insert", "move_to"), F.array(unit(here, placeholder(revision, known), "start"), unit(after, placeholder(F.concat(F.lit("/"), revision), only_id), "end")))
        .when(F.col("cls") == "revision", F.array(unit(here, placeholder("revision-gap", F.array(_pair("id", number), _pair("kind", F.col("kind")))), "gap")))
        .otherwise(F.array(unit(here, placeholder("token", known), "token")))
    )
    wrappers = F.slice("path", 1, F.size("path") - 1)
    rows = nodes.where(~hidden()).select(*by, F.col("seq").alias("node"), wrappers.alias("wrappers"), (F.size("rev_path") > 0).alias("in_revision"), F.when(F.col("cls") == "text", F.col("style")).alias("style"), F.explode(made).alias("u"))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("u.order")) - 1
    return rows.select(*by, pos.alias("pos"), F.col("u.value").alias("value"), (F.col("u.role") != "text").alias("is_token"), "style", "wrappers", "in_revision", "node", F.col("u.role").alias("role"))


def in_pos(by: list[str]):
    return Window.partitionBy(*by).orderBy("pos")


def glued(value: Column, order: str = "pos") -> Column:
    """Values of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("v")))), lambda x: x["v"]), "")


def rebuilt(rows: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, order, cls, kind, text, style, wrappers, node: units as nodes again, adjacent text of one style merged.

    Content of deletions comes back from ``nodes`` behind its gap.
    """
    w = in_pos(by)
    same = ~F.col("is_token") & (F.lag("is_token").over(w) == F.lit(False)) & F.lag("style").over(w).eqNullSafe(F.col("style")) & F.lag("wrappers").over(w).eqNullSafe(F.col("wrappers"))
    rows = rows.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    texts = rows.where("NOT is_token").groupBy(*by, "island").agg(F.min("pos").alias("pos"), glued(F.col("value")).alias("text"), F.first("style").alias("style"), F.first("wrappers").alias("wrappers"))
    order = F.array(F.col("pos").cast("int"))
    out = texts.select(*by, order.alias("order"), F.lit("text").alias("cls"), F.lit("text").alias("kind"), "text", "style", "wrappers", F.lit(None).cast("int").alias("node"))
    tokens = rows.where("is_token AND role <> 'end'").select(*by, "pos", "node")
    whole = nodes.select(*by, F.col("seq").alias("node"), "cls", "kind", "text", "style", F.slice("path", 1, F.size("path") - 1).alias("wrappers"))
    out = out.unionByName(tokens.join(whole, [*by, "node"]).select(*by, order.alias("order"), "cls", "kind", "text", "style", "wrappers", "node"))
    gap = F.get(F.filter("rev_path", lambda x: x["kind"].isin("delete", "move_from")), F.lit(0))["seq"]
    kept = nodes.where(hidden()).select(*by, gap.alias("gap"), F.col("seq").alias("node"), "cls", "kind", "text", "style", F.slice("path", 1, F.size("path") - 1).alias("wrappers"))
    gaps = rows.where("role = 'gap'").select(*by, F.col("node").alias("gap"), "pos")
    return out.unionByName(kept.join(gaps, [*by, "gap"]).select(*by, F.array(F.col("pos").cast("int"), "node").alias("order"), "cls", "kind", "text", "style", "wrappers", "node"))


def _escaped(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), (START, "\\u27E6"), (END, "\\u27E7")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def edit_bodies(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, body): the editable text of every paragraph that has units, with placeholders for its tokens."""
    return rows.groupBy(*by).agg(glued(F.when(F.col("is_token"), F.col("value")).otherwise(_escaped(F.col("value")))).alias("body"))


_PROSE = r"(?:\\\\|\\[uU]27[eE][67]|[^\\⟦⟧])+"
_PIECE = rf"⟦[^⟦⟧]*⟧|{_PROSE}|(?s:.)"
_KEYWORD = r"^⟦(/?[a-z-]+)(?:\s|⟧)"
#: Attributes each placeholder must have; those in ``_CLOSED`` may have no others.
_NEEDED = {"token": ("id", "kind"), "range-start": ("id", "kind"), "insert": ("id", "kind"), "move-to": ("id", "kind"), "revision-gap": ("id", "kind"), "range-end": ("id",), "/insert": ("id",), "/move-to": ("id",)}
_CLOSED = ("revision-gap", "range-end", "/insert", "/move-to")
_OPENERS = {"range-start": "range-end", "insert": "/insert", "move-to": "/move-to"}


def read_bodies(bodies: DataFrame, by: list[str], depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(units without style, violations (by, code, detail)) of edited bodies (by, body).

    A body that breaks the grammar gives ``edit-grammar-invalid`` and no units:
    unknown or incomplete placeholders, brackets or backslashes that aren't
    escaped, starts and ends that don't match.
    """
    piece = F.col("piece")
    rows = bodies.select(*by, F.posexplode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(_PIECE), F.lit(0))).alias("seq", "piece"))
    held = piece.startswith(START) & piece.endswith(END)
    rows = rows.withColumn("keyword", F.when(held, F.regexp_extract(piece, _KEYWORD, 1)))
    found = F.regexp_extract_all(piece, F.lit(r'([^\s=⟦⟧"]+)="([^"]*)"'), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("key"), unescaped(F.regexp_extract(x, '="([^"]*)"$', 1)).alias("value")))
    rows = rows.withColumn("pairs", F.when(held, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    keys = F.transform("pairs", lambda x: x["key"])
    left = F.regexp_replace(F.regexp_replace(piece, r'[^\s=⟦⟧"]+="[^"]*"', ""), r"\s", "")
    rows = rows.withColumn("_id", F.get(F.filter("pairs", lambda x: x["key"] == "id"), F.lit(0))["value"]).withColumn("name", F.coalesce(F.create_map(*[F.lit(x) for a, b in _OPENERS.items() for x in (b, a)])[F.col("keyword")], "keyword", F.lit("")))
    opens, closes = F.col("keyword").isin(*_OPENERS), F.col("keyword").isin(*_OPENERS.values())
    rows = rows.withColumn("kind", F.when(opens, "open").when(closes, "close").otherwise("other"))
    # read three times below: parsed once, and each plan stays small
    rows = with_chain(written(rows, "body-pieces"), by, None, F.struct("seq", "name", F.col("_id").alias("id"), "keyword"), depth)
    # what a closing placeholder would close: the last one that was open before it
    before = F.lag("chain").over(Window.partitionBy(*by).orderBy("seq"))
    closed = F.try_element_at(F.coalesce(before, F.array()), F.lit(-1))
    rows = rows.withColumn("_closed", closed).withColumn("_open", F.last("chain").over(Window.partitionBy(*by)))
    needed = F.create_map(*[x for k, v in _NEEDED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("keyword")]
    empty = F.exists("pairs", lambda x: x["key"].isin("id", "kind") & (x["value"] == ""))
    kinds = F.get(F.filter("pairs", lambda x: x["key"] == "kind"), F.lit(0))["value"]
    wrong = (
        F.when(~held & ~piece.rlike(f"^{_PROSE}$"), "unescaped").when(held & needed.isNull(), "unknown-placeholder")
        .when(held & (F.size(F.array_except(needed, keys)) > 0) | held & empty, "incomplete-placeholder").when(held & F.col("keyword").isin(*_CLOSED) & (F.size(F.array_except(keys, needed)) > 0), "unknown-attribute")
        .when(held & (left != F.concat(F.lit(START), "keyword", F.lit(END))), "unknown-attribute").when((F.col("keyword") == "revision-gap") & ~kinds.isin("delete", "move_from"), "wrong-kind")
        .when(closes & ~(F.col("_closed.id").eqNullSafe(F.col("_id")) & F.col("_closed.name").eqNullSafe(F.col("name"))), "mismatched-placeholder").when(opens & F.exists("_open", lambda x: x["seq"] == F.col("seq")), "unclosed-placeholder")
    )
    rows = written(rows.withColumn("wrong", wrong).drop("left", "_closed", "_open", "name"), "read-pieces")
    bad = rows.where("wrong IS NOT NULL").select(*by, F.lit("edit-grammar-invalid").alias("code"), F.col("wrong").alias("detail"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, r"\\[uU]27[eE]6", START), r"\\[uU]27[eE]7", END), r"\\\\", r"\\")
    ordered = F.concat(F.filter("pairs", lambda x: x["key"] == "id"), F.filter("pairs", lambda x: x["key"] == "kind"), F.filter("pairs", lambda x: ~x["key"].isin("id", "kind")))
    unit = lambda value, role: F.struct(value.alias("value"), F.lit(role).alias("role"))
    said = placeholder(F.col("keyword"), ordered)
    made = F.when(opens, F.array(unit(said, "start"))).when(closes, F.array(unit(said, "end"))).when(F.col("keyword") == "revision-gap", F.array(unit(said, "gap"))).when(held, F.array(unit(said, "token"))).otherwise(F.transform(clusters(plain), lambda c: unit(c, "text")))
    around = F.when(opens, F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))).otherwise(F.col("chain"))
    good = rows.join(bad.select(*by).distinct(), by, "left_anti").withColumn("around", around)
    good = good.select(*by, "seq", F.transform("around", lambda x: F.substring(x["id"], 2, 12).try_cast("int")).alias("wrappers"), F.exists("around", lambda x: x["keyword"] != "range-start").alias("in_revision"), F.substring("_id", 2, 12).try_cast("int").alias("node"), F.posexplode(made).alias("k", "u"))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("seq", "k")) - 1
    return good.select(*by, pos.alias("pos"), F.col("u.value").alias("value"), (F.col("u.role") != "text").alias("is_token"), F.lit(None).cast("string").alias("style"), "wrappers", "in_revision", "node", F.col("u.role").alias("role")), bad
