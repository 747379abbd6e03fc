"""Typed documents: one text per document, written from node rows and read back as node rows.

A typed document is a header line, then blocks: a paragraph marker, a line for its
mark's revision if it has one, and one line of inline markup.  Part markers change
the part of what follows; delete markers name removed paragraphs.  Reading is
windows over lines and brackets over the tags of a line, both written as tables, writing two ordered
aggregations; all of it is JVM expressions.

What breaks the grammar becomes violation rows (keys, line, code), and nothing else
is read from such a document.  Codes: missing-header, incompatible-schema,
expected-paragraph-marker, marker-incomplete, unknown-kind, paragraph-not-one-line,
attribute-syntax, duplicate-attribute, unknown-entity, unclosed-tag, malformed-tag,
unknown-tag, token-incomplete, span-invalid, span-holds-structure,
structure-mismatch, unclosed-structure, duplicate-paragraph, duplicate-deletion,
live-and-deleted.

Defined results: null and empty texts have no header; quotes in attribute values are
written as ``&quot;`` and read again; text nodes without text are not read back;
structures nest as brackets, so a range in a revision keeps its content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .nodes import closes, opens, with_chain
from .units import LAST, glued

# The grammar's header fields with their defaults, node tags and kinds.
HEADER = {"schema": "1", "format": "format.json", "styles": "styles.json", "template": "_template.docx", "source": "source.docx"}
TAGS = {"range": "docx-range", "revision": "docx-revision", "anchor": "docx-anchor", "inline": "docx-inline", "opaque": "docx-opaque"}
KINDS, MARK_KINDS = ("insert", "delete", "move_from", "move_to"), ("insert", "delete")
WRAPS = ("range", "revision")

_BREAK = "\\r\\n|[\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
_ATTRIBUTE = r'[A-Za-z_:][A-Za-z0-9_.:-]*="[^"\\]*(?:\\.[^"\\]*)*"'
_TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9_.:-]*)"
_NODE = ["paragraph_id", "path", "cls", "kind", "token_id", "style", "text", "attrs"]


def _escaped(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _plain(x: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _said(key: Column | str, value: Column) -> Column:
    return F.concat(F.lit(key) if isinstance(key, str) else key, F.lit('="'), F.replace(_escaped(value), F.lit('"'), F.lit("&quot;")), F.lit('"'))


def _attributes(first: list[tuple[str, Column]], rest: Column) -> Column:
    """``key="value"`` of the named ones that aren't null, then of a map in the order of its keys."""
    names = [n for n, _ in first]
    more = F.transform(F.array_sort(F.map_entries(F.map_filter(F.coalesce(rest, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names)))), lambda x: _said(x["key"], x["value"]))
    return F.array_join(F.concat(F.array_compact(F.array(*[_said(n, v) for n, v in first])), more), " ")


def merged(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with adjacent texts of one style and one parent as one."""
    w = Window.partitionBy(*by).orderBy("path")
    parent = F.slice("path", 1, F.size("path") - 1)
    rows = nodes.withColumn("_parent", parent)
    text = F.col("cls") == "text"
    same = text & (F.lag("cls").over(w) == "text") & F.lag("style").over(w).eqNullSafe(F.col("style")) & (F.lag("_parent").over(w) == F.col("_parent"))
    rows = rows.withColumn("_island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    # a node that isn't text is an island of its own
    is_text, one = F.first("cls") == "text", lambda c: F.first(c).alias(c)
    glue = F.when(is_text, glued(F.coalesce("text", F.lit("")), "path")).otherwise(F.first("text"))
    own = [F.when(~is_text, F.first(c)).alias(c) for c in ("token_id", "attrs")]
    out = rows.groupBy(*by, "_island").agg(F.min("path").alias("path"), one("cls"), F.when(is_text, "text").otherwise(F.first("kind")).alias("kind"), one("style"), glue.alias("text"), *own)
    return out.select(*by, *_NODE[1:])


def bodies(paragraphs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, paragraph_id, body): inline markup of every paragraph that has nodes; texts of the base style stand without a span."""
    by = [*keys, "paragraph_id"]
    rows = merged(nodes, by).join(paragraphs.select(*by, F.coalesce("base", F.lit("")).alias("base")), by)
    tag = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])[F.col("cls")]
    style = F.when((F.col("cls") == "inline") & (F.col("style") != ""), F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "style"), F.create_map(F.lit("style"), F.col("style")))).otherwise(F.col("attrs"))
    begin = F.concat(F.lit("<"), tag, F.lit(" "), _attributes([("id", F.col("token_id")), ("kind", F.col("kind"))], style))
    text = _escaped(F.coalesce("text", F.lit("")))
    unit = lambda order, value: F.struct(order.alias("order"), value.alias("value"))
    here, after = F.col("path").cast("array<int>"), F.concat(F.col("path").cast("array<int>"), F.array(F.lit(LAST)))
    made = (
        F.when((F.col("cls") == "text") & F.coalesce("style", F.lit("")).eqNullSafe(F.col("base")), F.array(unit(here, text)))
        .when(F.col("cls") == "text", F.array(unit(here, F.concat(F.lit("<span "), _said("data-s", F.coalesce("style", F.lit(""))), F.lit(">"), text, F.lit("</span>")))))
        .when(F.col("cls").isin(*WRAPS), F.array(unit(here, F.concat(begin, F.lit(">"))), unit(after, F.concat(F.lit("</"), tag, F.lit(">")))))
        .otherwise(F.array(unit(here, F.concat(begin, F.lit("/>")))))
    )
    return rows.select(*by, F.explode(made).alias("u")).select(*by, "u.*").groupBy(*by).agg(glued(F.col("value"), "order").alias("body"))


def write_typed(documents: DataFrame, paragraphs: DataFrame, nodes: DataFrame, deletions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, typed) of documents (keys, meta).

    ``paragraphs``: keys, ord, part_key, paragraph_id, base, inherit, mark_kind,
    mark_id, mark_attrs (null where there is none).  ``nodes``: keys, paragraph_id,
    path (numbers of the enclosing wrappers and of the node), cls, kind, token_id,
    style, text, attrs.  ``deletions``: keys, ord, paragraph_id.
    """
    keys = keys or ["doc_id"]
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = paragraphs.join(bodies(paragraphs, nodes, keys), [*keys, "paragraph_id"], "left")
    part = F.coalesce("part_key", F.lit(""))
    moved = part != F.lag(part, 1, "").over(w)
    heirs = F.coalesce("inherit", F.lit("")) != ""
    none = F.lit(None).cast("map<string,string>")
    marker = _attributes([("id", F.col("paragraph_id")), ("base", F.when(~heirs, F.coalesce("base", F.lit("")))), ("inherit", F.when(heirs, F.col("inherit")))], none)
    mark = F.concat(F.lit("\n<!--@mark "), _attributes([("kind", F.col("mark_kind")), ("id", F.col("mark_id"))], F.col("mark_attrs")), F.lit("-->"))
    block = F.concat(
        F.when(moved, F.concat(F.lit("<!--@part "), _said("key", part), F.lit("-->\n\n"))).otherwise(""), F.lit("<!--@p "), marker, F.lit("-->"), F.when(F.col("mark_kind").isNotNull(), mark).otherwise(""),
        F.when(F.coalesce("body", F.lit("")) != "", F.concat(F.lit("\n"), "body")).otherwise(""),
    )
    gone = deletions.select(*keys, F.struct(F.lit(1).alias("last"), F.col("ord").cast("long").alias("ord")).alias("at"), F.concat(F.lit("<!--@delete "), _said("id", F.col("paragraph_id")), F.lit("-->")).alias("block"))
    blocks = rows.select(*keys, F.struct(F.lit(0).alias("last"), F.col("ord").cast("long").alias("ord")).alias("at"), block.alias("block")).unionByName(gone)
    whole = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("b"))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    head = F.concat(F.lit("<!--@typed "), _attributes([(k, F.coalesce(F.element_at(meta, F.lit(k)), F.lit(v))) for k, v in HEADER.items()], F.map_filter(meta, lambda k, v: k != "source_path")), F.lit("-->"))
    lines = F.concat(F.array(head), F.coalesce(F.transform("b", lambda x: x["block"]), F.array().cast("array<string>")))
    return documents.join(whole, keys, "left").select(*keys, F.concat(F.array_join(lines, "\n\n"), F.lit("\n")).alias("typed"))


def _pairs(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit(_ATTRIBUTE), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("key"), F.regexp_extract(x, '="(.*)"$', 1).alias("value")))


def _attribute_code(raw: Column, pairs: Column) -> Column:
    names = F.transform(pairs, lambda x: x["key"])
    return (
        F.when(F.regexp_replace(raw, _ATTRIBUTE, "").rlike(r"\S"), "attribute-syntax").when(F.size(F.array_distinct(names)) < F.size(names), "duplicate-attribute")
        .when(F.exists(pairs, lambda x: x["value"].rlike("&(?!amp;|lt;|gt;|quot;)")), "unknown-entity")
    )


def _read(pairs: Column, *without: str) -> Column:
    """Attributes as a map; of repeated names (a violation) the first."""
    rest = F.filter(pairs, lambda x: ~x["key"].isin(*without)) if without else pairs
    return F.aggregate(rest, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["key"]), m).otherwise(F.map_concat(m, F.create_map(x["key"], _plain(x["value"])))))


def _value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda x: x["key"] == key), F.lit(0))["value"]


def _lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line, said, what, at (line of the marker it belongs to), pairs, code: every line that isn't blank, and one row of blank documents."""
    w, all_ = Window.partitionBy(*keys).orderBy("line"), Window.partitionBy(*keys)
    rows = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), _BREAK, -1)).alias("line", "said"))
    said, full = F.col("said"), F.col("said").rlike(r"(?U)\S")
    rows = rows.withColumn("n", F.count_if(full).over(w)).withColumn("total", F.count_if(full).over(all_))
    what = F.when(~full, "blank").when(F.col("n") == 1, "header").when(said.startswith("<!--@part"), "part").when(said.startswith("<!--@delete"), "delete").when(said.startswith("<!--@p"), "p").otherwise("other")
    rows = rows.withColumn("what", what)
    rows = rows.withColumn("up", F.last(F.when(F.col("what") != "other", F.struct("line", "what")), ignorenulls=True).over(w))
    mine = (F.col("what") == "other") & (F.col("up.what") == "p")
    what = F.when(mine & said.startswith("<!--@mark") & (F.col("line") == F.col("up.line") + 1), "mark").when(mine, "body").otherwise(F.col("what"))
    rows = rows.withColumn("what", what).withColumn("at", F.col("up.line"))
    nth = F.count_if(F.col("what") == "body").over(Window.partitionBy(*keys, "at").orderBy("line"))
    raw = F.when(F.col("what").isin("header", "part", "delete", "p", "mark"), F.regexp_extract("said", "^<!--@(?:typed|part|delete|mark|p)(.*)-->$", 1)).otherwise("")
    rows = rows.withColumn("nth", nth).withColumn("raw", raw).withColumn("pairs", _pairs(F.col("raw")))
    pairs, ends = F.col("pairs"), said.endswith("-->")
    keys_ = F.transform(pairs, lambda x: x["key"])
    has = lambda k: F.array_contains(keys_, k)
    only = lambda k: (F.size(pairs) == 1) & has(k)
    some = lambda k: F.coalesce(_value(pairs, k), F.lit("")) != ""
    code = (
        F.when((F.col("total") == 0) & (F.col("line") == 0), "missing-header").when(F.col("what") == "blank", None)
        .when((F.col("what") == "header") & ~(said.startswith("<!--@typed") & ends), "missing-header").when((F.col("what") == "other") | (F.col("what").isin("part", "delete", "p") & ~ends), "expected-paragraph-marker")
        .when((F.col("what") == "body") & (F.col("nth") > 1), "paragraph-not-one-line").when((F.col("what") == "mark") & ~ends, "marker-incomplete")
        .when(_attribute_code(F.col("raw"), pairs).isNotNull(), _attribute_code(F.col("raw"), pairs)).when((F.col("what") == "header") & ~_value(pairs, "schema").eqNullSafe(F.lit("1")), "incompatible-schema")
        .when((F.col("what") == "part") & ~only("key") | (F.col("what") == "delete") & ~(only("id") & some("id")) | (F.col("what") == "p") & (~some("id") | (has("base") == has("inherit"))) | (F.col("what") == "mark") & ~(has("kind") & has("id")), "marker-incomplete")
        .when((F.col("what") == "mark") & ~_value(pairs, "kind").isin(*MARK_KINDS), "unknown-kind")
    )
    return rows.withColumn("code", code).where((F.col("what") != "blank") | F.col("code").isNotNull()).select(*keys, "line", "said", "what", "at", "pairs", "nth", "code")


def _tags(rows: DataFrame, by: list[str], depth: int | None) -> DataFrame:
    """Pieces of inline markup with chain, above (wrappers and spans they lie in), pairs and code."""
    rows = rows.select(*by, "line", F.posexplode(F.regexp_extract_all("said", F.lit("<[^>]*>|[^<]+|<"), F.lit(0))).alias("seq", "piece"))
    piece = F.col("piece")
    tag = piece.startswith("<") & piece.endswith(">")
    rows = rows.withColumn("name", F.when(tag, F.regexp_extract(piece, _TAG_NAME, 1)).otherwise("")).withColumn("tag", tag)
    name, inner = F.col("name"), F.trim(F.regexp_extract(piece, r"^</?[A-Za-z][A-Za-z0-9_.:-]*(.*)>$", 1))
    closing = piece.startswith("</")
    rows = rows.withColumn("self", F.col("tag") & ~closing & inner.endswith("/"))
    rows = rows.withColumn("raw", F.when(F.col("self"), F.regexp_replace(inner, "/$", "")).otherwise(inner)).withColumn("pairs", _pairs(F.col("raw")))
    held = name.isin("span", *(TAGS[c] for c in WRAPS))
    kind = F.when(~F.col("tag"), "text").when(closing & held, "close").when(held & ~F.col("self"), "open").otherwise("alone")
    rows = with_chain(rows.withColumn("kind", kind), by, None, F.struct("seq", "name", _value(F.col("pairs"), "data-s").alias("style")), depth)
    w = Window.partitionBy(*by).orderBy("seq")
    none = F.array().cast(rows.schema["chain"].dataType)
    rows = rows.withColumn("_before", F.coalesce(F.lag("chain").over(w), none)).withColumn("_end", F.last("chain").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs, in_span = F.col("pairs"), F.exists("_before", lambda x: x["name"] == "span")
    some = lambda k: F.coalesce(_value(pairs, k), F.lit("")) != ""
    revision, known = name == TAGS["revision"], name.isin("span", *TAGS.values())
    wrong_attributes = _attribute_code(F.col("raw"), pairs)
    code = (
        F.when(~F.col("tag") & piece.startswith("<"), "unclosed-tag").when(~F.col("tag"), F.when(piece.rlike("&(?!amp;|lt;|gt;)"), "unknown-entity")).when(name == "", "malformed-tag").when(wrong_attributes.isNotNull(), wrong_attributes)
        .when(~known, "unknown-tag").when(closes(), F.when(~F.try_element_at("_before", F.lit(-1))["name"].eqNullSafe(name), "structure-mismatch").when((name != "span") & (F.size(pairs) > 0), "attribute-syntax"))
        .when((name == "span") & (F.col("self") | in_span | (F.size(pairs) != 1) | ~some("data-s")), "span-invalid")
        .when((name != "span") & (closing | (F.col("self") == held) | ~some("kind") | ~F.when(revision, _value(pairs, "id").isNotNull()).otherwise(some("id"))), "token-incomplete")
        .when(revision & ~_value(pairs, "kind").isin(*KINDS), "unknown-kind").when(opens() & (name != "span") & in_span, "span-holds-structure")
        .when(opens() & F.exists("_end", lambda x: x["seq"] == F.col("seq")), "unclosed-structure")
    )
    return rows.withColumn("code", code)


def read_typed(docs: DataFrame, keys: list[str] | None = None, text: str = "typed", depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, paragraphs, nodes, deletions, violations), the first four as :func:`write_typed` takes them.

    ``depth``: the deepest nesting of inline markup; counted if not given.
    """
    keys = keys or ["doc_id"]
    lines = written(_lines(docs, keys, text), "typed-lines")
    body = lines.where("what = 'body' AND nth = 1").select(*keys, F.col("at").alias("ord"), "line", "said")
    tags = _tags(body, [*keys, "ord"], depth).select(*keys, "ord", "line", "seq", "piece", "name", "kind", "pairs", "_before", "code")
    tags = written(tags, "typed-tags")
    wrong = lines.select(*keys, "line", "code").unionByName(tags.select(*keys, "line", "code")).where("code IS NOT NULL")
    ids = lines.where("what IN ('p', 'delete')").select(*keys, "line", "what", _plain(_value(F.col("pairs"), "id")).alias("id")).where("id <> ''")
    one = Window.partitionBy(*keys, "id").orderBy("line")
    live = F.count_if(F.col("what") == "p").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nth = F.row_number().over(Window.partitionBy(*keys, "id", "what").orderBy("line"))
    code = F.when((F.col("what") == "p") & (nth > 1), "duplicate-paragraph").when((F.col("what") == "delete") & (nth > 1), "duplicate-deletion").when((F.col("what") == "delete") & (live > 0), "live-and-deleted")
    wrong = wrong.unionByName(ids.withColumn("code", code).where("code IS NOT NULL").select(*keys, "line", "code"))
    bad = wrong.select(*keys).distinct()
    good = lines.join(bad, keys, "left_anti")
    pairs = F.col("pairs")
    documents = good.where("what = 'header'").select(*keys, _read(pairs).alias("meta"))
    w = Window.partitionBy(*keys).orderBy("line")
    part = F.coalesce(F.last(F.when(F.col("what") == "part", _plain(_value(pairs, "key"))), ignorenulls=True).over(w), F.lit(""))
    marked = good.withColumn("part_key", part).where("what IN ('p', 'mark')").groupBy(*keys, F.col("at").alias("ord"))
    rows = marked.agg(F.min(F.when(F.col("what") == "p", F.col("part_key"))).alias("part_key"), F.max(F.when(F.col("what") == "p", pairs)).alias("p"), F.max(F.when(F.col("what") == "mark", pairs)).alias("m"))
    value = lambda c, k: _plain(_value(F.col(c), k)).alias(k if c == "p" else f"mark_{k}")
    paragraphs = rows.select(*keys, "ord", "part_key", _plain(_value(F.col("p"), "id")).alias("paragraph_id"), value("p", "base"), value("p", "inherit"), value("m", "kind"), value("m", "id"), F.when(F.col("m").isNotNull(), _read(F.col("m"), "id", "kind")).alias("mark_attrs"))
    deletions = good.where("what = 'delete'").select(*keys, F.col("line").alias("ord"), _plain(_value(pairs, "id")).alias("paragraph_id"))
    found = tags.where("NOT (kind = 'close' OR name = 'span')").join(bad, keys, "left_anti").join(paragraphs.select(*keys, "ord", "paragraph_id", F.coalesce("base", F.lit("")).alias("base")), [*keys, "ord"])
    around = F.transform(F.filter("_before", lambda x: x["name"] != "span"), lambda x: x["seq"])
    span = F.get(F.filter("_before", lambda x: x["name"] == "span"), F.lit(0))["style"]
    cls = F.create_map(*[F.lit(x) for c, t in TAGS.items() for x in (t, c)])[F.col("name")]
    is_text = F.col("kind") == "text"
    style = F.when(is_text, F.coalesce(_plain(span), "base")).when(F.col("name") == TAGS["inline"], F.coalesce(_plain(_value(pairs, "style")), F.lit("")))
    rest = F.when(F.col("name") == TAGS["inline"], _read(pairs, "id", "kind", "style")).otherwise(_read(pairs, "id", "kind"))
    nodes = found.select(
        *keys, "paragraph_id", F.concat(around, F.array("seq")).alias("path"), F.when(is_text, "text").otherwise(cls).alias("cls"), F.when(is_text, "text").otherwise(_plain(_value(pairs, "kind"))).alias("kind"),
        F.when(~is_text, _plain(_value(pairs, "id"))).alias("token_id"), style.alias("style"), F.when(is_text, _plain(F.col("piece"))).alias("text"), F.when(~is_text, rest).alias("attrs"),
    )
    return documents, paragraphs, merged(nodes, [*keys, "paragraph_id"]), deletions, wrong


def of_word_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of ``word_nodes`` as :func:`write_typed` takes them; their numbers name the tokens."""
    none = F.create_map().cast("map<string,string>")
    own = F.when(F.col("cls") == "opaque", F.map_concat(F.map_filter(F.coalesce("attrs", none), lambda k, v: k != "tag"), F.create_map(F.lit("tag"), F.col("tag")))).otherwise(F.col("attrs"))
    return nodes.select(*keys, "paragraph_id", "path", "cls", "kind", F.when(F.col("cls") != "text", F.concat(F.lit("N"), F.col("seq").cast("string"))).alias("token_id"), F.when(F.col("cls").isin("text", "inline"), F.coalesce("style", F.lit(""))).alias("style"), "text", own.alias("attrs"))
