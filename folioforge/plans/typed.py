"""Queries over typed documents and comments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import comments, typed
from ..operators import nodes as N
from ..sources import docx
from ..sources.scratch import written
from ..sources.tables import commented_parts, table
from .structure import _ESCAPED, _TURNS, conversation_nodes

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _typed(spark: SparkSession, sf_dir: str, one_line: bool) -> DataFrame:
    """Conversations as typed documents; ``one_line``: line breaks of texts are blanks, without it such documents break the grammar."""
    paragraphs, nodes = conversation_nodes(spark, sf_dir)
    none = F.lit(None)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("stop"))
    rows = paragraphs.select("doc_id", at.alias("ord"), F.lit("").alias("part_key"), "paragraph_id", none.cast("string").alias("inherit"), N.style_id(F.lit(N.PLAIN)).alias("base"), *[none.cast("string").alias(c) for c in ("mark_kind", "mark_id")], none.cast("map<string,string>").alias("mark_attrs"))
    found = typed.of_word_nodes(nodes, ["doc_id"])
    if one_line:
        found = found.withColumn("text", F.regexp_replace("text", r"\R", " "))
    documents = paragraphs.select("doc_id").distinct().withColumn("meta", F.create_map(F.lit("source"), F.concat("doc_id", F.lit(".docx"))))
    return typed.write_typed(documents, rows, found, rows.where("false"))


@query
def typed_markup(spark, sf_dir):
    """Every conversation as a typed document."""
    return _typed(spark, sf_dir, True)


@query
def typed_round_trip(spark, sf_dir):
    """The same documents read again: of each node its place, kind, token and text."""
    _, _, nodes, _, _ = typed.read_typed(written(_typed(spark, sf_dir, True), "typed"))
    place = F.row_number().over(Window.partitionBy("doc_id", "paragraph_id").orderBy("path")) - 1
    return nodes.select("doc_id", "paragraph_id", place.alias("place"), "cls", "kind", F.coalesce("text", F.lit("")).alias("text"))


@query
def typed_violations(spark, sf_dir):
    """What breaks the grammar in documents whose texts have line breaks."""
    wrong = typed.read_typed(written(_typed(spark, sf_dir, False), "typed"))[4]
    return wrong.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


def _commented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nested tokens, paragraphs, nodes) of conversations with comments."""
    nested = written(N.nest(N.tokens(commented_parts(spark, sf_dir), N.KEYS, "xml"), N.KEYS), "comment-tokens")
    paragraphs = written(N.word_paragraphs(nested), "comment-paragraphs")
    return nested, paragraphs, written(N.word_nodes(nested, paragraphs), "comment-nodes")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of every third turn are to go, and one per conversation that isn't there."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("t"))
    return rows.where("t % 3 = 0").select("doc_id", F.col("t").cast("string").alias("comment_id")).union(rows.select("doc_id", F.lit("none")).distinct())


@query
def comment_listing(spark, sf_dir):
    """Comments with their metadata and the paragraphs they are anchored in."""
    rows = comments.listing(*_commented(spark, sf_dir))
    return rows.withColumn("anchor_paragraphs", F.array_join("anchor_paragraphs", ","))


@query
def comment_violations(spark, sf_dir):
    """Comments without markers and markers without comment."""
    nested, _, nodes = _commented(spark, sf_dir)
    return comments.violations(nested, nodes)


@query
def comment_deletion(spark, sf_dir):
    """What became of every comment that was to be deleted."""
    _, paragraphs, nodes = _commented(spark, sf_dir)
    status = comments.deleted(paragraphs, nodes, _wanted(spark, sf_dir))[2]
    return status.withColumn("anchor_paragraphs", F.array_join("anchor_paragraphs", ","))


@query
def comments_left(spark, sf_dir):
    """Nodes left in every paragraph after the deletion."""
    _, paragraphs, nodes = _commented(spark, sf_dir)
    left = comments.deleted(paragraphs, nodes, _wanted(spark, sf_dir))[0]
    return left.groupBy("doc_id", "paragraph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind").isin(*comments.MARKERS)).alias("n_markers"))


@query
def comments_cleared(spark, sf_dir):
    """Parts without comments, as their bytes' hash."""
    nested = N.nest(N.tokens(commented_parts(spark, sf_dir), N.KEYS, "xml"), N.KEYS)
    return docx.joined_parts(comments.cleared(nested)).select("doc_id", "part", F.sha2("content", 256).alias("sha256"))


_STYLE = f"'s_' || substr(sha256('{N.PLAIN}'), 1, 16)"
# the number of the node behind a paragraph's role, as in edit_projection: 14 tokens a spoken turn, 20 another, one less without text
_STEP = "CASE WHEN role IN ('user', 'assistant') THEN 14 ELSE 20 END - CASE WHEN text = '' THEN 1 ELSE 0 END"
_NUMBERED = f"{_TURNS}, w AS (SELECT *, {_ESCAPED.format("replace(text, chr(10), ' ')")} AS x, 8 + sum({_STEP}) OVER (PARTITION BY doc_id ORDER BY turn) - ({_STEP}) AS w FROM t)"
_MARK = "CASE role WHEN 'user' THEN 'insert' ELSE 'delete' END"
_COMMENTS = f"{_TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS j FROM t WHERE role <> 'user')"

ORACLES = {
    "typed_markup": f"""WITH {_NUMBERED}, b AS (SELECT doc_id, turn, CASE WHEN role IN ('user', 'assistant') THEN '' ELSE '<!--@p id="B' || b || '.P0" base="' || {_STYLE} || '"-->' || CASE WHEN x = '' THEN '' ELSE chr(10) || x END || chr(10) || chr(10) END
        || '<!--@p id="P' || k || '" base="' || {_STYLE} || '"-->' || chr(10) || role || CASE WHEN role IN ('user', 'assistant') THEN '<docx-revision id="N' || w || '" kind="' || {_MARK} || '" w:author="' || role || '" w:id="' || turn || '">' || x || '</docx-revision>' ELSE '<docx-opaque id="N' || w || '" kind="unsupported-run" tag="w:pict"/>' END AS block FROM w)
        SELECT doc_id, '<!--@typed schema="1" format="format.json" styles="styles.json" template="_template.docx" source="' || doc_id || '.docx"-->' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) || chr(10) AS typed FROM b GROUP BY doc_id""",
    "typed_round_trip": f"""WITH {_TURNS}, r AS (SELECT * REPLACE (replace(text, chr(10), ' ') AS text) FROM t) SELECT doc_id, 'P' || k AS paragraph_id, CAST(p AS INTEGER) AS place, CASE WHEN p <> 1 THEN 'text' WHEN role IN ('user', 'assistant') THEN 'revision' ELSE 'opaque' END AS cls,
        CASE WHEN p <> 1 THEN 'text' WHEN role IN ('user', 'assistant') THEN {_MARK} ELSE 'unsupported-run' END AS kind, CASE p WHEN 0 THEN role WHEN 2 THEN text ELSE '' END AS text
        FROM r, (VALUES (0), (1), (2)) AS x(p) WHERE p < 2 OR (role IN ('user', 'assistant') AND text <> '') UNION ALL SELECT doc_id, 'B' || b || '.P0', 0, 'text', 'text', text FROM r WHERE role NOT IN ('user', 'assistant') AND text <> ''""",
    "typed_violations": f"""WITH {_TURNS}, o AS (SELECT doc_id, 'P' || k AS p, role IN ('user', 'assistant') AS held, role || CASE WHEN role IN ('user', 'assistant') THEN '<r>' || text || '</r>' ELSE '<o/>' END AS body FROM t UNION ALL SELECT doc_id, 'B' || b, false, text FROM t WHERE role NOT IN ('user', 'assistant')),
        l AS (SELECT doc_id, p, held, unnest(string_split(body, chr(10))) AS said, generate_subscripts(string_split(body, chr(10)), 1) AS i, len(string_split(body, chr(10))) AS n FROM o),
        m AS (SELECT *, trim(said) = '' AS blank, bool_or(trim(said) = '') OVER (PARTITION BY doc_id, p ORDER BY i) AS after FROM l),
        v AS (SELECT doc_id, CASE WHEN after THEN 'expected-paragraph-marker' WHEN i > 1 THEN 'paragraph-not-one-line' WHEN held AND n > 1 THEN 'unclosed-structure' END AS code FROM m WHERE NOT blank)
        SELECT doc_id, code, count(*) AS n FROM v WHERE code IS NOT NULL GROUP BY ALL""",
    "comment_listing": f"""WITH {_COMMENTS} SELECT doc_id, CAST(turn AS VARCHAR) AS comment_id, 'comments.P' || j AS paragraph_id, role AS author, '2024-01-01T00:00:00Z' AS date, text, CASE role WHEN 'assistant' THEN 'P' || k ELSE '' END AS anchor_paragraphs FROM c""",
    "comment_violations": f"""WITH {_COMMENTS} SELECT doc_id, CAST(turn AS VARCHAR) AS comment_id, CASE role WHEN 'user' THEN 'comment-not-found' ELSE 'comment-without-anchor' END AS code FROM t WHERE role <> 'assistant'""",
    "comment_deletion": f"""WITH {_COMMENTS} SELECT doc_id, CAST(turn AS VARCHAR) AS comment_id, CASE role WHEN 'user' THEN 'comment-not-found' END AS code, CAST(role <> 'user' AS BIGINT) AS n_paragraphs, CASE role WHEN 'assistant' THEN 'P' || k ELSE '' END AS anchor_paragraphs FROM t WHERE turn % 3 = 0
        UNION ALL SELECT DISTINCT doc_id, 'none', 'comment-not-found', 0, '' FROM t""",
    "comments_left": f"""WITH {_COMMENTS}, n AS (SELECT doc_id, 'P' || k AS paragraph_id, CASE WHEN role = 'user' OR (role = 'assistant' AND turn % 3 <> 0) THEN 3 ELSE 0 END AS n_markers FROM t)
        SELECT doc_id, paragraph_id, CAST(n_markers + 1 AS BIGINT) AS n_nodes, CAST(n_markers AS BIGINT) AS n_markers FROM n UNION ALL SELECT doc_id, 'comments.P' || j, 1, 0 FROM c WHERE turn % 3 <> 0""",
    "comments_cleared": f"""WITH {_TURNS} SELECT doc_id, 'word/document.xml' AS part, sha256('<w:document><w:body>' || string_agg('<w:p><w:r><w:t>' || role || '</w:t></w:r>' || CASE WHEN role IN ('user', 'assistant') THEN '<w:r></w:r>' ELSE '' END || '</w:p>', '' ORDER BY turn) || '</w:body></w:document>') AS sha256 FROM t GROUP BY doc_id
        UNION ALL SELECT DISTINCT doc_id, 'word/comments.xml', sha256('<w:comments></w:comments>') FROM t""",
}
