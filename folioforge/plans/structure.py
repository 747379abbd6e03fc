"""Queries over markup structure and over word packages derived from the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, signatures, units
from ..operators import nodes as N
from ..sources import docx
from ..sources.scratch import written
from ..sources.tables import conversation_parts, table
from ..sources.tasks import dealt

QUERIES: dict = {}
PAGE = ["page_id"]
#: Bytes of markup and tokens that one task holds; a page, whatever its length, is in one task.
BYTES_A_TASK, TOKENS_A_TASK = 4 << 20, 100_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(*PAGE, "html")
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    return N.tokens(dealt(pages, PAGE, size, BYTES_A_TASK), PAGE, "html", N.HTML_TOKEN, N.VOID, lower=True)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tokens of all pages that are nested properly once unanswered tags stand alone."""
    nested = written(N.nest(N.answered(_page_tokens(spark, sf_dir), PAGE), PAGE), "page-tokens")
    return N.sound(dealt(nested, PAGE, nested.count(), TOKENS_A_TASK), N.nesting_violations(nested, PAGE), PAGE)


@query
def markup_elements(spark, sf_dir):
    """Every element with its level, parent, ordinal among its siblings and byte range."""
    return N.elements(_pages(spark, sf_dir), PAGE)


@query
def markup_violations(spark, sf_dir):
    """Unanswered tags, and what isn't nested properly even without them."""
    rows = _page_tokens(spark, sf_dir).withColumn("was", F.col("kind"))
    nested = N.nest(N.answered(rows, PAGE), PAGE)
    unanswered = F.when(F.col("was") != F.col("kind"), F.concat(F.lit("unanswered-"), "was"))
    return nested.select(*PAGE, "seq", "start", F.explode(F.array_compact(F.array(unanswered, N.nesting_code()))).alias("code"))


@query
def markup_addresses(spark, sf_dir):
    """Addresses of blocks along navigation, articles, lists and paragraphs."""
    rows = N.labelled(_pages(spark, sf_dir), PAGE, N.HTML)
    return rows.select("page_id", "seq", "name", "label")


@query
def markup_text_nodes(spark, sf_dir):
    """Text that isn't white space, with the path of elements around it and its nearest container."""
    rows = N.with_chain(_pages(spark, sf_dir), PAGE, None, F.struct("seq", "name"))
    texts = rows.where((F.col("kind") == "text") & F.col("token").rlike(r"[^ \t\n\r]"))
    path = F.array_join(F.transform("chain", lambda x: x["name"]), "/")
    return texts.select("page_id", "seq", "start", path.alias("path"), "parent", N.unescaped(F.col("token")).alias("text"))


def _conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nest(N.tokens(conversation_parts(spark, sf_dir), N.KEYS, "xml"), N.KEYS)


def conversation_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, nodes) of the parts made of conversations."""
    nested = written(_conversation_tokens(spark, sf_dir), "part-tokens")
    found = written(N.word_paragraphs(nested), "part-paragraphs")
    return found, N.word_nodes(nested, found)


@query
def package_paragraphs(spark, sf_dir):
    """Paragraphs of word parts made of conversations: addresses, text boxes and both views."""
    return N.word_views(*conversation_nodes(spark, sf_dir)).select("doc_id", "paragraph_id", "final_text", "original_text", "n_revisions", "has_opaque")


@query
def package_revisions(spark, sf_dir):
    """Revision inventory of the same parts."""
    rows = N.word_revisions(written(conversation_nodes(spark, sf_dir)[1], "part-nodes"))
    return rows.select("doc_id", "paragraph_id", "kind", "w_id", "author", F.length("text").alias("n_chars"), "revision_key")


@query
def package_settled(spark, sf_dir):
    """The same parts with all revisions rejected, as their bytes' hash."""
    return docx.joined_parts(docx.settled_tokens(_conversation_tokens(spark, sf_dir), False)).select("doc_id", F.sha2("content", 256).alias("sha256"))


@query
def semantic_signature(spark, sf_dir):
    """Order-free digests of what the same parts say."""
    nested = written(_conversation_tokens(spark, sf_dir), "part-tokens")
    return signatures.signature_digests(signatures.signature_items(nested, nested.select("doc_id", "part").distinct()))


@query
def retention_rules(spark, sf_dir):
    """What a word processor's rules find lost after all revisions were accepted."""
    nested = written(_conversation_tokens(spark, sf_dir), "part-tokens")
    members = nested.select("doc_id", "part").distinct()
    accepted = docx.joined_parts(docx.settled_tokens(nested, True)).select("doc_id", "part", F.col("content").cast("string").alias("xml"))
    after = written(N.nest(N.tokens(accepted, N.KEYS, "xml"), N.KEYS), "settled-tokens")
    before, later = (written(signatures.signature_items(x, members), "items") for x in (nested, after))
    return signatures.retention_violations(before, later, "word-windows-m365")


BY = ["doc_id", "part", "paragraph_id"]


def _conversation_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, units) of the parts made of conversations."""
    found = written(conversation_nodes(spark, sf_dir)[1], "part-nodes")
    return found, written(units.units(found, BY), "part-units")


@query
def edit_projection(spark, sf_dir):
    """Editable body of every paragraph, with placeholders."""
    return units.edit_bodies(_conversation_units(spark, sf_dir)[1], BY).select("doc_id", "paragraph_id", "body")


@query
def units_round_trip(spark, sf_dir):
    """Nodes to units, to the edit projection, back to units and to nodes; of each node its place, kind and text."""
    nodes, base = _conversation_units(spark, sf_dir)
    read, _ = units.read_bodies(written(units.edit_bodies(base, BY), "bodies"), BY)
    styled = read.drop("style", "node").join(base.select(*BY, "pos", "style", "node").hint("merge"), [*BY, "pos"])  # units aren't broadcast
    rows = units.rebuilt(written(styled, "styled-units"), nodes, BY)
    place = F.row_number().over(Window.partitionBy("doc_id", "paragraph_id").orderBy("order")) - 1
    return rows.select("doc_id", "paragraph_id", place.alias("place"), "cls", "kind", F.coalesce("text", F.lit("")).alias("text"))


@query
def sync_plan(spark, sf_dir):
    """Every paragraph's draft says its role in capitals: hunks of the plan, direct or, in every second conversation, tracked."""
    nodes, base = _conversation_units(spark, sf_dir)
    bodies = units.edit_bodies(base, BY)
    role = F.regexp_extract("body", "^(user|assistant)", 1)
    drafts = bodies.withColumn("body", F.when(role != "", F.concat(F.upper(role), F.expr("substring(body, length(regexp_extract(body, '^(user|assistant)', 1)) + 1)"))).otherwise(F.col("body")))
    mode = F.when(F.col("doc_id").cast("long") % 2 == 0, "direct").otherwise("track")
    opaque = nodes.groupBy(*BY).agg(F.bool_or(F.col("cls") == "opaque").alias("has_opaque"))
    paragraphs = opaque.select(*BY, mode.alias("mode"), "has_opaque", F.lit("s_none").alias("insertion_style"))
    read = written(units.read_bodies(written(drafts, "drafts"), BY)[0], "draft-units")
    hunks, _ = align.plan_hunks(base, read, paragraphs, BY)
    return hunks.select("doc_id", "paragraph_id", "hunk", "mode", "operation", "i1", "i2", "removed", "inserted", "assigned_style", "reason", "code")


_TOKEN = N.HTML_TOKEN.replace("'", "''")
TOKENS = rf"""t0 AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TOKEN}')) AS token, CAST(unnest(range(len(regexp_extract_all(html, '{_TOKEN}')))) AS INTEGER) AS seq FROM pages WHERE html <> ''),
t1 AS (SELECT *, CAST(sum(strlen(token)) OVER (PARTITION BY page_id ORDER BY seq) AS BIGINT) AS stop, CASE WHEN starts_with(token, '<') THEN lower(regexp_extract(token, '^</?(?:[A-Za-z_][\w.\-]*:)?([A-Za-z_][\w.\-]*)', 1)) ELSE '' END AS name FROM t0),
tok AS (SELECT page_id, seq, token, name, stop, stop - strlen(token) AS start,
  CASE WHEN starts_with(token, '<!') OR starts_with(token, '<?') THEN 'skip' WHEN NOT starts_with(token, '<') THEN 'text' WHEN token = '<' THEN 'stray' WHEN starts_with(token, '</') THEN 'close'
       WHEN ends_with(token, '/>') OR ends_with(token, '</script>') OR ends_with(token, '</style>') OR name IN ('br', 'hr', 'img', 'input', 'meta', 'link') THEN 'alone' ELSE 'open' END AS kind FROM t1),
-- an opening tag is answered by the first closing tag of its name after which as many are open as before it
run AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, name ORDER BY seq) AS s FROM tok WHERE kind IN ('open', 'close')),
pairs AS (SELECT o.page_id, o.seq, min(c.seq) AS answer FROM run o JOIN run c ON o.page_id = c.page_id AND o.name = c.name AND o.kind = 'open' AND c.kind = 'close' AND c.seq > o.seq AND c.s = o.s - 1 GROUP BY ALL),
el AS (SELECT t.page_id, t.seq, t.name, t.start, coalesce(c.stop, t.stop) AS stop, c.seq AS answer FROM tok t LEFT JOIN pairs p USING (page_id, seq) LEFT JOIN tok c ON c.page_id = t.page_id AND c.seq = p.answer WHERE t.kind IN ('open', 'alone')),
crossed AS (SELECT DISTINCT a.page_id FROM el a JOIN el b ON a.page_id = b.page_id AND a.start < b.start AND b.start < a.stop AND a.stop < b.stop),
good AS (SELECT page_id FROM tok GROUP BY page_id HAVING count(*) FILTER (kind = 'stray') = 0 AND page_id NOT IN (FROM crossed)),
inside AS (SELECT b.page_id, b.seq, max(a.seq) AS parent, count(*) AS above FROM el a JOIN el b ON a.page_id = b.page_id AND a.seq < b.seq AND a.answer > b.seq GROUP BY ALL)"""

_LETTERS = ", ".join(f"('{n}', '{c}')" for n, c in N.HTML.letters.items())
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
# the parts once more: paragraph k of a conversation is its k-th turn, and other roles' texts lie in text boxes
_TURNS = """t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k,
  count(*) FILTER (role NOT IN ('user', 'assistant')) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS b FROM conversations)"""
_PART = "word/document.xml"

ORACLES = {
    "markup_elements": f"""WITH {TOKENS} SELECT e.page_id, e.seq, name, CAST(coalesce(above, 0) + 1 AS INTEGER) AS level, parent, CAST(row_number() OVER (PARTITION BY e.page_id, parent, name ORDER BY e.seq) - 1 AS INTEGER) AS ordinal, start, stop
        FROM el e LEFT JOIN inside USING (page_id, seq) WHERE e.page_id IN (FROM good)""",
    "markup_violations": f"""WITH {TOKENS} SELECT page_id, seq, start, 'unanswered-' || kind AS code FROM tok t WHERE (kind = 'open' AND (page_id, seq) NOT IN (SELECT (page_id, seq) FROM pairs)) OR (kind = 'close' AND (page_id, seq) NOT IN (SELECT (page_id, answer) FROM pairs))
        UNION ALL SELECT page_id, seq, start, 'stray-markup' FROM tok WHERE kind = 'stray'""",
    "markup_addresses": f"""WITH RECURSIVE {TOKENS}, g AS (SELECT e.*, letter FROM el e JOIN (VALUES {_LETTERS}) AS k(name, letter) USING (name) WHERE page_id IN (FROM good)),
        n AS (SELECT b.page_id, b.seq, b.name, b.letter, max(a.seq) AS near FROM g b LEFT JOIN g a ON a.page_id = b.page_id AND a.seq < b.seq AND a.answer > b.seq GROUP BY ALL),
        o AS (SELECT *, letter || (row_number() OVER (PARTITION BY page_id, near, letter ORDER BY seq) - 1) AS step FROM n),
        l AS (SELECT page_id, seq, name, step AS label FROM o WHERE near IS NULL UNION ALL SELECT o.page_id, o.seq, o.name, l.label || '.' || o.step FROM o JOIN l ON o.page_id = l.page_id AND o.near = l.seq)
        SELECT page_id, seq, name, label FROM l""",
    "markup_text_nodes": f"""WITH {TOKENS} SELECT t.page_id, t.seq, t.start, coalesce(string_agg(a.name, '/' ORDER BY a.seq), '') AS path, max(a.seq) AS parent,
        replace(replace(replace(replace(replace(t.token, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS text
        FROM tok t LEFT JOIN el a ON a.page_id = t.page_id AND a.seq < t.seq AND a.answer > t.seq WHERE t.kind = 'text' AND regexp_matches(t.token, '[^ \t\n\r]') AND t.page_id IN (FROM good) GROUP BY t.page_id, t.seq, t.start, t.token""",
    "package_paragraphs": f"""WITH {_TURNS} SELECT doc_id, 'P' || k AS paragraph_id, role || CASE role WHEN 'user' THEN text WHEN 'assistant' THEN '' ELSE '[opaque:unsupported-run]' END AS final_text,
        role || CASE role WHEN 'assistant' THEN text ELSE '' END AS original_text, CAST(role IN ('user', 'assistant') AS BIGINT) AS n_revisions, role NOT IN ('user', 'assistant') AS has_opaque FROM t
        UNION ALL SELECT doc_id, 'B' || b || '.P0', text, text, 0, false FROM t WHERE role NOT IN ('user', 'assistant')""",
    "package_revisions": f"""WITH {_TURNS} SELECT doc_id, 'P' || k AS paragraph_id, CASE role WHEN 'user' THEN 'insert' ELSE 'delete' END AS kind, CAST(turn AS VARCHAR) AS w_id, role AS author, CAST(length(text) AS INTEGER) AS n_chars,
        '{_PART}|' || CASE role WHEN 'user' THEN 'insert' ELSE 'delete' END || '|' || turn || '|' || substr(sha256(text), 1, 12) AS revision_key FROM t WHERE role IN ('user', 'assistant')""",
    "package_settled": f"""WITH {_TURNS}, p AS (SELECT doc_id, turn, '<w:r><w:t>' || {_ESCAPED.format('text')} || '</w:t></w:r>' AS r, '<w:r><w:t>' || role || '</w:t></w:r>' AS head, role FROM t)
        SELECT doc_id, sha256('<w:document><w:body>' || string_agg('<w:p>' || head || CASE role WHEN 'user' THEN '' WHEN 'assistant' THEN r ELSE '<w:r><w:pict><w:txbxContent><w:p>' || r || '</w:p></w:txbxContent></w:pict></w:r>' END || '</w:p>', '' ORDER BY turn) || '</w:body></w:document>') AS sha256 FROM p GROUP BY doc_id""",
    "edit_projection": f"""WITH {_TURNS}, n AS (SELECT *, sum(CASE role WHEN 'user' THEN 14 WHEN 'assistant' THEN 14 ELSE 20 END + CASE WHEN text = '' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn) AS upto FROM t)
        SELECT doc_id, 'P' || k AS paragraph_id, role || CASE role WHEN 'user' THEN '⟦insert id="N' || w || '" kind="insert" w:author="user" w:id="' || turn || '"⟧' || text || '⟦/insert id="N' || w || '"⟧'
        WHEN 'assistant' THEN '⟦revision-gap id="N' || w || '" kind="delete"⟧' ELSE '⟦token id="N' || w || '" kind="unsupported-run" tag="w:pict"⟧' END AS body
        FROM (SELECT *, 2 + upto - CASE role WHEN 'user' THEN 14 WHEN 'assistant' THEN 14 ELSE 20 END - CASE WHEN text = '' THEN -1 ELSE 0 END + 6 AS w FROM n) UNION ALL SELECT doc_id, 'B' || b || '.P0', text FROM t WHERE role NOT IN ('user', 'assistant') AND text <> ''""",
    "units_round_trip": f"""WITH {_TURNS} SELECT doc_id, 'P' || k AS paragraph_id, p AS place, CASE p WHEN 0 THEN 'text' WHEN 2 THEN 'text' ELSE CASE WHEN role IN ('user', 'assistant') THEN 'revision' ELSE 'opaque' END END AS cls,
        CASE WHEN p IN (0, 2) THEN 'text' WHEN role = 'user' THEN 'insert' WHEN role = 'assistant' THEN 'delete' ELSE 'unsupported-run' END AS kind, CASE p WHEN 0 THEN role WHEN 2 THEN text ELSE '' END AS text
        FROM t, (VALUES (0), (1), (2)) AS x(p) WHERE p < 2 OR (role IN ('user', 'assistant') AND text <> '') UNION ALL SELECT doc_id, 'B' || b || '.P0', 0, 'text', 'text', text FROM t WHERE role NOT IN ('user', 'assistant') AND text <> ''""",
    # "user" and "USER" have no letter in common, nor have "assistant" and "ASSISTANT"
    "sync_plan": f"""WITH {_TURNS} SELECT doc_id, 'P' || k AS paragraph_id, 0 AS hunk, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'direct' ELSE 'track' END AS mode, 'replace' AS operation, 0 AS i1, CAST(length(role) AS INTEGER) AS i2, role AS removed, upper(role) AS inserted,
        's_' || substr(sha256('{N.PLAIN}'), 1, 16) AS assigned_style, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'single-region-inheritance' ELSE 'tracked-revision-mapping' END AS reason, CAST(NULL AS VARCHAR) AS code FROM t WHERE role IN ('user', 'assistant')""",
    "semantic_signature": f"""WITH {_TURNS}, e AS (SELECT *, {_ESCAPED.format('text')} AS x FROM t), i AS (
        SELECT doc_id, 'visible_text' AS dimension, '1*' || sha256(string_agg(role || CASE role WHEN 'assistant' THEN '' ELSE x END, '' ORDER BY turn)) AS item FROM e GROUP BY doc_id
        UNION ALL SELECT doc_id, 'deleted_text', '1*' || sha256(string_agg(x, '' ORDER BY turn)) FROM e WHERE role = 'assistant' AND text <> '' GROUP BY doc_id
        UNION ALL SELECT doc_id, 'revision_marks', count(*) || '*' || CASE role WHEN 'user' THEN 'insert' ELSE 'delete' END || ':' || role || ':' FROM e WHERE role IN ('user', 'assistant') GROUP BY doc_id, role)
        SELECT doc_id, dimension, sha256(string_agg(item, chr(10) ORDER BY item)) AS digest FROM i GROUP BY ALL""",
    "retention_rules": f"""WITH {_TURNS} SELECT doc_id, 'deleted_text' AS dimension, 'changed' AS code, CAST(1 AS BIGINT) AS n_items FROM t WHERE role = 'assistant' AND text <> '' GROUP BY doc_id
        UNION ALL SELECT doc_id, 'revision_marks', 'changed', count(DISTINCT role) FROM t WHERE role IN ('user', 'assistant') GROUP BY doc_id""",
}
