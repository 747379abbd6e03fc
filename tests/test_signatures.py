"""Signatures, consumer rules and verification of written packages."""

from pyspark.sql import functions as F

from folioforge.operators import nodes as N
from folioforge.operators import signatures as S
from folioforge.sources import docx
from folioforge.sources.scratch import written
from tests.test_docx import MORE, NS, package, run

COMMENTS = f'<w:comments {NS}><w:comment w:id="1" w:author="A"><w:p>{run("why")}{run(" so")}</w:p></w:comment><w:comment w:id="2" w:author="B"><w:p/></w:comment></w:comments>'
BODY = f'<w:p>{run("a")}<w:bookmarkStart w:id="0" w:name="m"/><w:ins w:id="5" w:author="A" w:date="d">{run("b")}</w:ins></w:p>'
RENUMBERED = f'<w:p>{run("ab")[:-6]}</w:r><w:bookmarkStart w:id="8" w:name="_GoBack"/><w:bookmarkStart w:id="9" w:name="m"/><w:ins w:id="77" w:author="A" w:date="d"/></w:p>'


def items(spark, rows, links=()):
    parts = spark.createDataFrame(rows, "doc_id string, part string, xml string")
    nested = written(N.nest(N.tokens(parts, N.KEYS, "xml"), N.KEYS), "tokens")
    table = spark.createDataFrame(links, "doc_id string, rel_id string, type string, target string") if links else None
    return written(S.signature_items(nested, parts.select("doc_id", "part"), table), "items")


def doc(body):
    return f"<w:document {NS}><w:body>{body}</w:body></w:document>"


def test_signatures_and_rules(spark):
    comments = ("d", "word/comments.xml", COMMENTS)
    before = items(spark, [("d", docx.MAIN, doc(BODY)), comments], [("d", "r1", "x/hyperlink", "http://a:1/b")])
    got = {(r.dimension, r.item): r.n for r in before.collect()}
    assert got["comments", "1:A:why so"] == 1 and got["comments", "2:B:"] == 1 and got["revision_marks", "insert:A:d"] == 1 and got["comment_parts", "word/comments.xml"] == 1 and got["bookmarks", "m"] == 1
    same = items(spark, [comments, ("d", docx.MAIN, doc(RENUMBERED))], [("d", "r1", "x/hyperlink", "http://a:1/b")])
    digests = [{(r.dimension): r.digest for r in S.signature_digests(x).collect()} for x in (before, same)]
    assert digests[0]["comments"] == digests[1]["comments"] and digests[0]["bookmarks"] != digests[1]["bookmarks"]
    loose = {(r.dimension, r.code) for r in S.retention_violations(before, same, "word-windows-m365").collect()}
    assert loose == set()  # other ids, other runs and one more bookmark
    assert {(r.dimension, r.code) for r in S.retention_violations(before, same).collect()} == {("bookmarks", "changed")}
    bare = items(spark, [("d", docx.MAIN, doc(f"<w:p>{run('x')}</w:p>"))])
    lost = {(r.dimension, r.code) for r in S.retention_violations(before, bare, "word-windows-m365").collect()}
    assert lost == {("visible_text", "changed"), ("revision_marks", "changed"), ("comments", "changed"), ("relationships", "changed"), ("bookmarks", "lost"), ("comment_parts", "lost")}


def test_written_output_is_verified(spark):
    packages = spark.createDataFrame([("a", package()), ("b", package(MORE))], "doc_id string, content binary")
    views = written(docx.parse_paragraphs(docx.explode_parts(packages)), "views")
    assert S.output_violations(views, views).count() == 0
    settled = written(docx.parse_paragraphs(docx.explode_parts(docx.settle_packages(packages, True))), "settled")
    wanted = written(views.withColumns({"original_text": F.regexp_replace("final_text", r"\[opaque:[^\]]*\]", ""), "n_revisions": F.lit(0)}), "wanted")
    assert S.output_violations(wanted, settled).count() == 0
    other = wanted.where("paragraph_id <> 'P3'").withColumn("final_text", F.when(F.col("paragraph_id") == "P0", "x").otherwise(F.col("final_text"))).withColumn("n_revisions", F.when(F.col("paragraph_id") == "P1", 9).otherwise(F.col("n_revisions")))
    got = {(r.doc_id, r.paragraph_id, r.code) for r in S.output_violations(other, settled).where("doc_id = 'a'").collect()}
    assert got == {("a", "P0", "final-text-differs"), ("a", "P1", "revisions-differ"), ("a", "P3", "paragraph-added")}
    assert {r.code for r in S.output_violations(settled, other).where("paragraph_id = 'P3'").collect()} == {"paragraph-missing"}
