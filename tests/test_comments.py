"""Comments of packages with repeated ids, bookmarks of the same number, nested markers and empty parts."""

from folioforge.operators import comments as C
from folioforge.operators import nodes as N
from folioforge.sources import docx

MAIN = (
    '<w:document><w:body><w:p><w:bookmarkStart w:id="1"/><w:commentRangeStart w:id="1"/><w:r><w:t>a</w:t></w:r><w:ins w:id="9"><w:r><w:t>b</w:t></w:r><w:commentRangeEnd w:id="1"/></w:ins>'
    '<w:r><w:commentReference w:id="1"/></w:r></w:p><w:p><w:commentRangeStart w:id="1"/><w:commentRangeStart w:id="7"/><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>'
)
NOTES = (
    '<w:comments><w:comment w:id="1" w:author="A &amp; B" w:date="d"><w:p><w:r><w:t>x</w:t></w:r><w:del w:id="3"><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:comment>'
    '<w:comment w:id="1" w:author="second"/><w:comment w:id="2"><w:p/></w:comment></w:comments>'
)


def test_comments(spark):
    rows = [("d", "word/document.xml", MAIN), ("d", C.COMMENTS, NOTES), ("none", "word/document.xml", "<w:document><w:body><w:p/></w:body></w:document>"), ("none", C.COMMENTS, "<w:comments/>")]
    nested = N.nest(N.tokens(spark.createDataFrame(rows, "doc_id string, part string, xml string"), N.KEYS, "xml"), N.KEYS).cache()
    paragraphs = N.word_paragraphs(nested).cache()
    nodes = N.word_nodes(nested, paragraphs).cache()
    got = {tuple(r) for r in C.listing(nested, paragraphs, nodes).withColumn("anchor_paragraphs", C.F.array_join("anchor_paragraphs", ",")).collect()}
    assert got == {("d", "1", "comments.P0", "A & B", "d", "xy", "P0,P1"), ("d", "1", "comments.P1", "A & B", "d", "xy", "P0,P1"), ("d", "2", "comments.P2", "", "", "", "")}
    assert {tuple(r) for r in C.violations(nested, nodes).collect()} == {("d", "2", "comment-without-anchor"), ("d", "7", "comment-not-found")}
    wanted = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "7"), ("none", "1")], "doc_id string, comment_id string")
    left, tombs, status = C.deleted(paragraphs, nodes, wanted)
    assert {(r.doc_id, r.comment_id, r.code, r.n_paragraphs, *r.anchor_paragraphs) for r in status.collect()} == {("d", "1", None, 2, "P0", "P1"), ("d", "7", "comment-not-found", 0), ("none", "1", "comment-not-found", 0)}
    assert {r.paragraph_id for r in tombs.collect()} == {"comments.P0", "comments.P1"}
    kept = [(r.paragraph_id, r.kind) for r in left.orderBy("part", "seq").collect()]
    assert ("P0", "bookmark-start") in kept and ("P1", "comment-start") in kept and len([k for k in kept if k[1].startswith("comment")]) == 1
    texts = {(r.doc_id, r.part): r.content.decode() if isinstance(r.content, (bytes, bytearray)) else r.content for r in docx.joined_parts(C.cleared(nested)).collect()}
    assert texts["d", C.COMMENTS] == "<w:comments></w:comments>" and texts["none", C.COMMENTS] == "<w:comments/>"
    assert "comment" not in texts["d", "word/document.xml"] and '<w:bookmarkStart w:id="1"/>' in texts["d", "word/document.xml"]
