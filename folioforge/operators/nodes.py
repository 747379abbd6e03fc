"""Markup as rows: tokens, nesting as intervals, container addresses and nodes, all in JVM expressions.

A part (one text) becomes its tokens with byte offsets.  The level of a tag is a
running sum; the element it lies in is the last opening tag one level up.  The
open elements of a set of names are an array per row (``chain``): its k-th entry
is the last opening tag of the set whose level within the set is k, so one window
pass gives them all.  Its length is the deepest nesting found, not the size of
the data.

Markup that isn't nested properly never stops a job: it becomes violation rows
(keys, seq, start, code), and what is read from such a part is left out by
``sound``.

Defined results: null and empty texts have no tokens; parts are told apart by
their keys; a text of any length is one window partition, as a part is the unit
that has an order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns stay in the common subset of the Java and RE2 dialects.
_SKIPPED = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^<>]*>"
_TAG = r"</?[A-Za-z_][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>"
XML_TOKEN = rf"(?s){_SKIPPED}|{_TAG}|[^<]+|<"
#: Scripts and styles are one token.
HTML_TOKEN = rf"(?is)<script[^<>]*>.*?</script>|<style[^<>]*>.*?</style>|{_SKIPPED}|{_TAG}|[^<]+|<"
LOCAL_NAME = r"^</?(?:[A-Za-z_][\w.\-]*:)?([A-Za-z_][\w.\-]*)"
VOID = ("br", "hr", "img", "input", "meta", "link")



def opens() -> Column:
    return F.col("kind") == "open"


def closes() -> Column:
    return F.col("kind") == "close"


def alone() -> Column:
    return F.col("kind") == "alone"


def element() -> Column:
    return F.col("kind").isin("open", "alone")


def tokens(parts: DataFrame, keys: list[str], text: str, pattern: str = XML_TOKEN, void: tuple[str, ...] = (), lower: bool = False) -> DataFrame:
    """keys, seq, token, kind, name, start, stop: everything of a text in order, with byte offsets.

    kind is open, close, alone, text, cdata, skip, or stray for a "<" that starts nothing.
    """
    rows = parts.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("seq", "token"))
    t = F.col("token")
    name = F.when(t.startswith("<"), F.regexp_extract(t, LOCAL_NAME, 1)).otherwise("")
    name = F.lower(name) if lower else name
    kind = (
        F.when(t.startswith("<![CDATA["), "cdata").when(t.startswith("<!") | t.startswith("<?"), "skip").when(~t.startswith("<"), "text").when(t == "<", "stray")
        .when(t.startswith("</"), "close").when(t.endswith("/>") | F.col("name").isin(*void) | t.endswith("</script>") | t.endswith("</style>"), "alone").otherwise("open")
    )
    stop = F.sum(F.octet_length("token").cast("long")).over(in_order(keys))
    return rows.withColumn("name", name).withColumn("kind", kind).withColumn("stop", stop).withColumn("start", F.col("stop") - F.octet_length("token"))


def in_order(keys: list[str], *more: str):
    return Window.partitionBy(*keys, *more).orderBy("seq")


def answered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of lenient markup: an opening tag that no closing tag of its name answers stands alone, an unanswered closing tag has the kind ``skip``.

    Tags of one name answer each other like brackets.
    """
    step = F.when(opens(), 1).when(closes(), -1).otherwise(0)
    w = in_order(keys, "name")
    rows = rows.withColumn("_sum", F.sum(step).over(w))
    level = F.col("_sum") + F.greatest(F.lit(0), -F.min("_sum").over(w))
    rows = rows.withColumn("_level", F.when(opens(), level).when(closes(), level + 1).otherwise(-1 - F.col("seq")))
    pairs = in_order(keys, "name", "_level")
    kind = F.when(opens() & ~F.lead("kind", 1, "").over(pairs).eqNullSafe(F.lit("close")), "alone").when(closes() & ~F.lag("kind", 1, "").over(pairs).eqNullSafe(F.lit("open")), "skip").otherwise(F.col("kind"))
    return rows.withColumn("_kind", kind).drop("kind", "_sum", "_level").withColumnRenamed("_kind", "kind")


def nest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with level (of the element or text; the root has 1), parent, parent_name, and element_stop of opening tags.

    ``opener`` and ``opener_name`` of a closing tag are those of the element it would close.
    """
    total = F.sum(F.when(opens(), 1).when(closes(), -1).otherwise(0)).over(in_order(keys))
    rows = rows.withColumn("level", F.when(opens(), total).otherwise(total + 1).cast("int"))
    level = F.col("level")
    # an opening tag comes twice: as an element that others lie in, at its level, and as one that lies in another
    met = F.when(opens(), F.array(level, level - 1)).when(closes(), F.array(level)).otherwise(F.array(level - 1))
    both = rows.withColumn("_at", F.explode(met)).withColumn("_holds", opens() & (F.col("_at") == level))
    found = F.last(F.when(F.col("_holds"), F.struct("seq", "name")), ignorenulls=True).over(in_order(keys, "_at"))
    both = both.withColumn("_up", found).where(~F.col("_holds")).drop("_at", "_holds")
    both = both.withColumns({
        "parent": F.when(~closes(), F.col("_up.seq")), "parent_name": F.when(~closes(), F.col("_up.name")),
        "opener": F.when(closes(), F.col("_up.seq")), "opener_name": F.when(closes(), F.col("_up.name")),
        "_element": F.when(opens(), F.col("seq")).when(closes(), F.col("_up.seq")).otherwise(-1 - F.col("seq")),
    })
    end = F.max(F.when(closes(), F.col("stop"))).over(Window.partitionBy(*keys, "_element"))
    return both.withColumn("element_stop", F.when(opens(), end).when(alone(), F.col("stop"))).drop("_up", "_element")


def nesting_code() -> Column:
    """Why a nested token isn't nested properly or can't be read; null for others."""
    return (
        F.when(closes() & ~F.col("opener_name").eqNullSafe(F.col("name")), "malformed-nesting").when(opens() & F.col("element_stop").isNull(), "unclosed-element")
        .when(F.col("kind") == "stray", "stray-markup").when((F.col("kind") == "text") & bad_reference(F.col("token")), "character-reference")
    )


def nesting_violations(nested: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, start, code of everything that isn't nested properly or can't be read."""
    return nested.withColumn("code", nesting_code()).where(F.col("code").isNotNull()).select(*keys, "seq", "start", "code")


def sound(rows: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of parts without a violation."""
    return rows.join(violations.select(*keys).distinct(), keys, "left_anti")


# The predefined entities of the markup.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_PIECE = r"&#[0-9]+;|&#[xX][0-9A-Fa-f]+;|&[A-Za-z]+;|[^&]+|&"


def _code_point(piece: Column) -> Column:
    """Code point of a character reference; null for other pieces and for numbers that are no character."""
    digits = F.regexp_replace(F.regexp_extract(piece, r"^&#[xX]?([0-9A-Fa-f]+);$", 1), "^0+", "")
    base_16 = piece.startswith("&#x") | piece.startswith("&#X")
    value = F.when(base_16, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    fits = (F.length(digits) > 0) & (F.length(digits) <= 7) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(piece.startswith("&#") & fits, value)


def bad_reference(text: Column) -> Column:
    """Whether a text holds a character reference to no character."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return text.contains("&#") & F.exists(pieces, lambda p: p.startswith("&#") & (F.length(p) > 2) & _code_point(p).isNull())


def unescaped(text: Column) -> Column:
    """Character data as text; numbers that are no character become U+FFFD, unknown entities stay."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))

    def one(p: Column) -> Column:
        plain = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])[p]
        char = F.decode(F.unhex(F.lpad(F.hex(_code_point(p)), 8, "0")), "UTF-32")
        return F.when(p.startswith("&#") & (F.length(p) > 2), F.coalesce(char, F.lit("�"))).otherwise(F.coalesce(plain, p))

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def elements(nested: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, name, level, parent, ordinal among the siblings of its name, start, stop of every element."""
    order = Window.partitionBy(*keys, "parent", "name").orderBy("seq")
    rows = nested.where(element()).withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select(*keys, "seq", "name", "level", "parent", "ordinal", "start", F.col("element_stop").alias("stop"))


def _open_elements(keys: list[str], mine: Column) -> Column:
    return F.sum(F.when(opens() & mine, 1).when(closes() & mine, -1).otherwise(0)).over(in_order(keys)).cast("int")


def deepest(rows: DataFrame, keys: list[str], names: list[str] | None) -> int:
    """The deepest nesting of the elements among ``names`` (or all); only tags of these move."""
    mine = F.lit(True) if names is None else F.col("name").isin(*names)
    tags = rows.where((opens() | closes()) & mine).select(*keys, "seq", "kind", "name")
    return tags.withColumn("_depth", _open_elements(keys, mine)).agg(F.coalesce(F.max("_depth"), F.lit(0))).first()[0]


def with_chain(rows: DataFrame, keys: list[str], names: list[str] | None, entry: Column, depth: int | None = None) -> DataFrame:
    """``chain``: for every row the open elements among ``names`` (or all), outermost first, as ``entry``; an opening tag is in its own.

    ``depth``: the deepest nesting of these elements; counted if not given.
    """
    mine = F.lit(True) if names is None else F.col("name").isin(*names)
    depth = deepest(rows, keys, names) if depth is None else depth
    rows = rows.withColumn("_depth", _open_elements(keys, mine))
    kept = [F.last(F.when(opens() & mine & (F.col("_depth") == k), entry), ignorenulls=True).over(in_order(keys)) for k in range(1, max(depth, 1) + 1)]
    return rows.withColumn("chain", F.slice(F.array(*kept), 1, F.greatest(F.col("_depth"), F.lit(0)))).drop("_depth")


@dataclass(frozen=True)
class Grammar:
    """Names that number paragraphs: letters of labelled containers, those numbered through a part, names without a label, and those of them whose content is numbered through the part."""

    letters: dict[str, str]
    throughout: tuple[str, ...] = ()
    silent: tuple[str, ...] = ()
    entries: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.letters, *self.silent]


# Containers of word processing parts and their address letters.
WORD = Grammar({"tbl": "T", "tr": "R", "tc": "C", "txbxContent": "B", "sdtContent": "S", "p": "P"}, ("tbl", "txbxContent", "sdtContent"), ("body", "hdr", "ftr", "footnotes", "endnotes", "comments", "footnote", "endnote", "comment", "sdt"), ("footnote", "endnote", "comment"))
HTML = Grammar({"nav": "N", "article": "A", "div": "D", "footer": "F", "ul": "U", "li": "L", "h1": "H", "p": "P"})


def labelled(nested: DataFrame, keys: list[str], grammar: Grammar, depth: int | None = None, numbered: Column | None = None) -> DataFrame:
    """Elements of the grammar with their chain of ancestors and ``label``: letters with ordinals along the containers, as in T0.R1.C0.P2.

    An ordinal counts elements of one letter in their nearest container of the
    grammar, or through the whole part for ``throughout`` names, where a label
    starts anew.  ``numbered``: condition on ``near`` (the nearest container) and
    ``above`` (all of them); elements that don't meet it are not counted, and neither they nor what lies in them has a label.
    """
    marks = nested.where(F.col("kind").isin("open", "close", "alone") & F.col("name").isin(*grammar.names))
    depth = deepest(marks, keys, grammar.names) if depth is None else depth
    marks = with_chain(marks, keys, grammar.names, F.struct("seq", "name", "level"), depth)
    above = F.when(opens(), F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))).otherwise(F.col("chain"))
    marks = marks.withColumn("above", above).withColumn("near", F.try_element_at("above", F.lit(-1)))
    counted = element() & (F.lit(True) if numbered is None else numbered)
    letter = F.create_map(*[F.lit(x) for pair in grammar.letters.items() for x in pair])[F.col("name")]
    scope = F.when(F.col("name").isin(*grammar.throughout) | F.coalesce(F.col("near.name").isin(*grammar.entries), F.lit(False)), F.lit(-1)).otherwise(F.coalesce("near.seq", F.lit(-2)))
    marks = marks.withColumns({"_counted": F.coalesce(counted & letter.isNotNull(), F.lit(False)), "_letter": F.coalesce(letter, F.lit("")), "_scope": scope})
    order = Window.partitionBy(*keys, "_scope", "_letter", "_counted").orderBy("seq")
    marks = marks.withColumn("ordinal", F.when(F.col("_counted"), F.row_number().over(order) - 1))
    step = F.concat("_letter", F.col("ordinal").cast("string"))
    lost = F.col("ordinal").isNull() & letter.isNotNull()
    entry = F.struct("seq", "name", "level", step.alias("step"), F.col("name").isin(*grammar.throughout).alias("anew"), lost.alias("lost"), "token")
    marks = with_chain(marks.drop("chain"), keys, grammar.names, entry, depth)
    own = F.when(opens(), F.col("chain")).otherwise(F.concat("chain", F.array(entry)))
    rows = marks.where(element()).withColumn("chain", own)
    steps = F.aggregate("chain", F.array().cast("array<string>"), lambda a, x: F.when(x["anew"], F.array(x["step"])).when(x["step"].isNull(), a).otherwise(F.concat(a, F.array(x["step"]))))
    label = F.when(~F.exists("chain", lambda x: x["lost"]) & letter.isNotNull(), F.array_join(steps, "."))
    return rows.withColumn("label", label).drop("_counted", "_letter", "_scope")


# Names of word processing markup, by what they become.
REVISIONS = {"ins": "insert", "del": "delete", "moveTo": "move_to", "moveFrom": "move_from"}
ANCHORS = {"bookmarkStart": "bookmark-start", "bookmarkEnd": "bookmark-end", "commentRangeStart": "comment-start", "commentRangeEnd": "comment-end"}
INLINE = (
    "tab", "br", "cr", "noBreakHyphen", "softHyphen", "sym", "commentReference", "footnoteRef", "endnoteRef", "annotationRef",
    "separator", "continuationSeparator", "lastRenderedPageBreak",
)
BOOLEAN = ("b", "i", "strike", "outline", "shadow", "smallCaps", "caps", "vanish", "webHidden")
_ATTRIBUTE = r"([^\s=<>\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
KEYS = ["doc_id", "part"]


def attributes(token: Column) -> Column:
    """Names as written and values of a tag."""
    group = lambda k: F.regexp_extract_all(token, F.lit(_ATTRIBUTE), F.lit(k))
    values = F.zip_with(group(2), group(3), lambda x, y: F.concat(x, y))  # one of the two is empty
    return F.map_from_arrays(group(1), F.transform(values, unescaped))


def _word_numbered() -> Column:
    """Which containers and paragraphs have an address: those that lie directly in the container that may hold them."""
    name, near, above = F.col("name"), F.col("near.name"), F.col("above")
    direct = F.col("level") == F.col("near.level") + 1
    body = F.try_element_at(F.filter("above", lambda x: x["name"] == "body"), F.lit(1))["level"]
    return (
        F.when(name == "tbl", direct & near.isin("body", "tc", "hdr", "ftr")).when(name == "tr", direct & (near == "tbl")).when(name == "tc", direct & (near == "tr"))
        .when(name == "txbxContent", F.exists(above, lambda x: (x["name"] == "p") & (x["level"] == body + 1)))
        .when(name == "sdtContent", direct & (near == "sdt") & (F.size(above) == 2) & (F.try_element_at(above, F.lit(1))["name"] == "body") & (F.col("near.level") == body + 1))
        .when(name == "p", direct & near.isin("body", "tc", "txbxContent", "sdtContent", "hdr", "ftr", "footnote", "endnote", "comment"))
    )


def word_paragraphs(nested: DataFrame, keys: list[str] = KEYS, depth: int | None = None) -> DataFrame:
    """keys, paragraph_id, entry_id, container, ordinal, seq, level, start, stop of every addressed paragraph; their order is that of ``stop``.

    Body paragraphs are P0, P1, …; cells T0.R0.C0.P0 with tables, nested ones too,
    numbered through the part; text boxes B0.P0; content controls S0.P0; other
    parts put their name before, and paragraphs of notes and comments carry the id
    of their entry.
    """
    rows = labelled(nested, keys, WORD, depth, _word_numbered()).where((F.col("name") == "p") & F.col("label").isNotNull())
    stem = F.regexp_extract("part", r"([^/]+)\.xml$", 1)
    prefix = F.when(stem == "document", "").otherwise(F.concat(stem, F.lit(".")))
    entry = F.try_element_at(F.filter("chain", lambda x: x["name"].isin(*WORD.entries)), F.lit(-1))["token"]
    entry_id = F.regexp_extract(entry, "\\sw:id\\s*=\\s*[\"']([^\"']*)", 1)
    return rows.select(
        *keys, F.concat(prefix, "label").alias("paragraph_id"), entry_id.alias("entry_id"), F.coalesce("near.name", F.lit("")).alias("container"), "ordinal", "seq", "level", "start", F.col("element_stop").alias("stop")
    )


def run_styles(nested: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, run, style_id, canonical: the canonical properties of every run that has some.

    Revision save ids and switched-off switches go, true values of switches too;
    attributes and properties are sorted; format history is no property.
    """
    inner = nested.where(element() & F.col("name").isin("rPr") & (F.col("parent_name") == "r")).select(*keys, F.col("seq").alias("parent"), F.col("parent").alias("run"))
    held = nested.where(element() & (F.col("parent_name") == "rPr") & (F.col("name") != "rPrChange"))
    props = inner.join(held.select(*keys, "parent", "name", "token"), [*keys, "parent"], "left")
    kept = F.map_filter(attributes(F.col("token")), lambda k, v: ~F.regexp_extract(k, "([^:]*)$", 1).startswith("rsid"))
    switch = F.col("name").isin(*BOOLEAN)
    value = F.lower(F.element_at(F.map_filter("kept", lambda k, v: F.regexp_extract(k, "([^:]*)$", 1) == "val"), F.lit("w:val")))
    off, on = switch & value.isin("false", "0", "off", "none"), switch & value.isin("true", "1", "on")
    props = props.withColumn("kept", kept).withColumn("off", F.coalesce(off, F.lit(False)))
    props = props.withColumn("kept", F.when(on, F.map_filter("kept", lambda k, v: ~k.endswith(":val"))).otherwise(F.col("kept")))
    pairs = F.array_sort(F.map_entries("kept"))
    named = F.regexp_extract("token", r"^<([^\s/>]+)", 1)
    said = F.concat(F.lit('["'), named, F.lit('",'), F.to_json(F.transform(pairs, lambda x: F.array(x["key"], x["value"]))), F.lit(',"",[]]'))
    shown = F.transform(pairs, lambda x: F.concat(F.lit("('"), x["key"], F.lit("', '"), x["value"], F.lit("')")))
    order = F.concat(F.lit("('"), named, F.lit("', ("), F.array_join(shown, ", "), F.when(F.size(pairs) == 1, ",").otherwise(""), F.lit("), '', ())"))
    props = props.select(*keys, "run", F.when(F.col("name").isNotNull() & ~F.col("off"), F.struct(order.alias("order"), said.alias("said"))).alias("p"))
    every = props.groupBy(*keys, "run").agg(F.array_sort(F.collect_list("p")).alias("p"))
    canonical = F.concat(F.lit('["w:rPr",[],"",['), F.array_join(F.transform("p", lambda x: x["said"]), ","), F.lit("]]"))
    return every.select(*keys, "run", style_id(canonical).alias("style_id"), canonical.alias("canonical"))


def style_id(canonical: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(canonical, 256), 1, 16))


PLAIN = '["w:rPr",[],"",[]]'  # fixed value: canonical form of a run without properties


def word_nodes(nested: DataFrame, paragraphs: DataFrame, keys: list[str] = KEYS, depth: int | None = None) -> DataFrame:
    """keys, paragraph_id, path, cls, kind, rev_path, range_path, style, text, attrs, seq, start: the nodes of addressed paragraphs, in order of ``seq``.

    cls is text, inline, anchor, opaque, range or revision (the last two: rows of
    the wrappers themselves).  path: seq of the enclosing wrappers and of the node,
    so arrays sort in document order.  rev_path and range_path: enclosing revisions
    (seq, kind, w_id) and ranges, outermost first.  A run with content that isn't
    known is one opaque node; a container that isn't known is opaque with all in it;
    a run without content is an inline node of kind empty-run.
    """
    wraps, names = [*REVISIONS, "hyperlink"], ["p", "r", *REVISIONS, "hyperlink"]
    entry = F.struct("seq", "name", "level", "token")
    rows = with_chain(nested.where(~F.col("kind").isin("skip", "close") | (closes() & F.col("name").isin(*names))), keys, names, entry, depth).where(~closes())
    above = F.when(opens() & F.col("name").isin(*names), F.slice("chain", 1, F.size("chain") - 1)).otherwise(F.col("chain"))
    rows = rows.withColumn("above", above).withColumn("p", F.try_element_at(F.filter("above", lambda x: x["name"] == "p"), F.lit(-1)))
    rows = rows.where("p IS NOT NULL").withColumn("inner", F.filter("above", lambda x: x["seq"] > F.col("p.seq")))
    run = F.try_element_at(F.filter("inner", lambda x: x["name"] == "r"), F.lit(-1))
    rows = rows.withColumn("wrappers", F.filter("inner", lambda x: x["name"].isin(*wraps))).withColumn("run", run)
    # how many elements lie between the paragraph and this one, and whether all of them are wrappers
    between = F.col("level") - F.col("p.level") - 1
    content = (between == F.size("wrappers")) & F.col("run").isNull() & element()
    in_run = F.col("run").isNotNull() & (F.col("run.level") == F.col("p.level") + 1 + F.size("wrappers"))
    child = in_run & element() & (F.col("level") == F.col("run.level") + 1)
    known = F.col("name").isin("rPr", "t", "delText", *INLINE)
    words = in_run & F.col("kind").isin("text", "cdata") & (F.col("level") == F.col("run.level") + 2) & F.col("parent_name").isin("t", "delText")
    changed = in_run & element() & (F.col("name") == "rPrChange") & (F.col("level") == F.col("run.level") + 2) & (F.col("parent_name") == "rPr")
    group = Window.partitionBy(*keys, "_run")
    own_run = content & (F.col("name") == "r")
    rows = rows.withColumn("_run", F.when(own_run, F.col("seq")).when(in_run, F.col("run.seq")).otherwise(-1 - F.col("seq")))
    strange = F.min(F.when(child & ~known, F.struct("seq", "token"))).over(group)
    filled = F.max(F.when(child & F.col("name").isin("t", "delText", *INLINE) | changed, 1)).over(group).isNotNull()
    rows = rows.withColumn("_strange", strange).withColumn("_filled", filled)
    usual, wrapper = F.col("_strange").isNull(), F.col("name").isin(*wraps)
    lookup = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("name")]
    cls = (
        F.when(own_run & ~usual, "opaque").when(own_run & ~F.col("_filled"), "inline").when(content & F.col("name").isin(*ANCHORS), "anchor").when(content & (F.col("name") == "hyperlink"), "range")
        .when(content & wrapper, "revision").when(content & ~F.col("name").isin("r", "pPr"), "opaque").when(words & usual, "text").when((child & F.col("name").isin(*INLINE) | changed) & usual, "inline")
    )
    kind = (
        F.when(own_run, F.when(usual, "empty-run").otherwise("unsupported-run")).when(F.col("cls") == "text", "text").when(F.col("cls") == "opaque", "opaque")
        .when(F.col("name") == "rPrChange", "rpr-change").otherwise(F.coalesce(lookup(ANCHORS), lookup(REVISIONS), F.col("name")))
    )
    text = F.when(F.col("kind") == "cdata", F.regexp_extract("token", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).otherwise(unescaped(F.col("token")))
    tag = F.when(own_run, F.coalesce("_strange.token", "token")).otherwise(F.col("token"))
    rows = rows.withColumn("cls", cls).where("cls IS NOT NULL").withColumn("_kind", kind)
    revision = F.transform(F.filter("wrappers", lambda x: x["name"] != "hyperlink"), lambda x: F.struct(
        x["seq"].alias("seq"), F.create_map(*[F.lit(y) for pair in REVISIONS.items() for y in pair])[x["name"]].alias("kind"), F.regexp_extract(x["token"], "\\s(?:\\w+:)?id\\s*=\\s*[\"']([^\"']*)", 1).alias("w_id")
    ))
    ranges = F.transform(F.filter("wrappers", lambda x: x["name"] == "hyperlink"), lambda x: x["seq"])
    plain = rows.select(
        *keys, F.col("p.seq").alias("_p"), F.concat(F.transform("wrappers", lambda x: x["seq"]), F.array("seq")).alias("path"), "cls", F.col("_kind").alias("kind"), revision.alias("rev_path"), ranges.alias("range_path"),
        F.when(F.col("cls") == "text", text).alias("text"), F.when(F.col("cls") != "text", attributes(tag)).alias("attrs"), F.when(F.col("cls") == "opaque", F.regexp_extract(tag, r"^<([^\s/>]+)", 1)).alias("tag"), "seq", "start",
        F.when(F.col("_run") >= 0, F.col("_run")).alias("run"),
    )
    styles = run_styles(nested, keys).select(*keys, "run", F.col("style_id").alias("style"))
    style = F.when(F.col("run").isNotNull(), F.coalesce("style", style_id(F.lit(PLAIN))))
    every = plain.join(styles, [*keys, "run"], "left").withColumn("style", style).select(*plain.columns, "style").drop("run")
    return every.join(paragraphs.select(*keys, F.col("seq").alias("_p"), "paragraph_id"), [*keys, "_p"]).drop("_p")


def shown(nodes: DataFrame, hidden: tuple[str, ...]) -> Column:
    return ~F.exists("rev_path", lambda x: x["kind"].isin(*hidden))


def word_views(paragraphs: DataFrame, nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, paragraph_id, final_text, original_text, n_revisions, has_opaque of every addressed paragraph."""
    by = [*keys, "paragraph_id"]
    piece = F.when(F.col("cls") == "text", F.col("text")).when(F.col("kind") == "tab", "\t").when(F.col("kind").isin("br", "cr"), "\n")
    final = F.when(shown(nodes, ("delete", "move_from")), F.coalesce(F.when(F.col("cls") == "opaque", F.concat(F.lit("[opaque:"), "kind", F.lit("]"))), piece))
    original = F.when(shown(nodes, ("insert", "move_to")), piece)
    glue = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("seq", x.alias("piece"))))), lambda y: y["piece"]), "")
    sums = nodes.groupBy(*by).agg(glue(final).alias("final_text"), glue(original).alias("original_text"), F.count_if(F.col("cls") == "revision").alias("n_revisions"), F.bool_or(F.col("cls") == "opaque").alias("has_opaque"))
    none = {"final_text": "", "original_text": "", "n_revisions": 0, "has_opaque": False}
    return paragraphs.select(*by, "entry_id", "start", "stop").join(sums, by, "left").fillna(none)


def word_revisions(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, paragraph_id, kind, w_id, author, date, text, revision_key of every revision; its text is all that lies in it."""
    wraps = nodes.where(F.col("cls") == "revision")
    held = nodes.where(F.col("cls") == "text").select(*keys, F.explode("rev_path").alias("r"), "seq", "text")
    glue = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda y: y["text"]), "")
    texts = held.groupBy(*keys, F.col("r.seq").alias("seq")).agg(glue.alias("text"))
    value = lambda n: F.coalesce(F.element_at(F.map_from_entries(F.transform(F.map_entries("attrs"), lambda x: F.struct(F.regexp_extract(x["key"], "([^:]*)$", 1).alias("key"), x["value"].alias("value")))), F.lit(n)), F.lit(""))
    rows = wraps.drop("text").join(texts, [*keys, "seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    key = F.concat_ws("|", "part", "kind", value("id"), F.substring(F.sha2("text", 256), 1, 12))
    return rows.select(*keys, "paragraph_id", "seq", "kind", value("id").alias("w_id"), value("author").alias("author"), value("date").alias("date"), "text", key.alias("revision_key"))
