"""Real package semantics on packages built from XML strings."""

import hashlib
import io
import zipfile

import pytest

from folioforge.operators import nodes as N
from folioforge.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


BODY = (
    f"<w:p>{run('Take 20 mg daily.')}</w:p>"
    f"<w:p>{run('Keep ')}<w:ins w:id=\"1\" w:author=\"A\" w:date=\"2024-01-01T00:00:00Z\">{run('new ')}</w:ins>"
    "<w:del w:id=\"2\" w:author=\"B\"><w:r><w:delText>old </w:delText></w:r></w:del>"
    f"{run('text &amp; more')}</w:p>"
    "<!-- <w:p>not a paragraph</w:p> -->"
    f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p>{run('nested')}</w:p></w:tc></w:tr></w:tbl><w:p>{run('b')}</w:p></w:tc></w:tr></w:tbl>"
    f"<w:p/><w:p>{run('end')}</w:p>"
)


def package(body=BODY, main=docx.MAIN, notes=None):
    out, stamp = io.BytesIO(), lambda name: zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(stamp(main), body if isinstance(body, bytes) else f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        if notes:
            z.writestr(stamp("word/footnotes.xml"), notes)
        z.writestr(stamp("word/header1.xml"), f"<w:hdr {NS}><w:p>{run('head')}</w:p></w:hdr>")
        z.writestr(stamp("word/styles.xml"), "<w:styles/>")
    return out.getvalue()


BOX = f"<w:r><w:pict><v:shape><v:textbox><w:txbxContent><w:p>{run('in box')}</w:p><w:p/></w:txbxContent></v:textbox></v:shape></w:pict></w:r>"
MORE = (
    f"<w:p>{run('host')}{BOX}</w:p><w:p>{run('after')}</w:p><w:sdt><w:sdtPr/><w:sdtContent><w:p>{run('control')}</w:p></w:sdtContent></w:sdt>"
    f"<w:tbl><w:tr><w:tc><w:p>{run('cell')}{BOX}</w:p></w:tc></w:tr></w:tbl><w:sdt><w:sdtContent><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:sdtContent></w:sdt>"
    '<w:p><w:pPr><w:rPr><w:ins w:id="20" w:author="M"/><w:b/></w:rPr></w:pPr><w:r><w:rPr><w:b w:val="1"/><w:sz w:val="24"/><w:i w:val="0"/><w:rPrChange w:id="9"><w:rPr/></w:rPrChange></w:rPr>'
    '<w:t xml:space="preserve">bold &#x4e2d;&amp; </w:t><w:tab/><w:t><![CDATA[<x>]]></w:t></w:r>'
    '<w:hyperlink r:id="r1"><w:ins w:id="7" w:author="Z"><w:r><w:t>linked</w:t></w:r><w:del w:id="8"><w:r><w:delText>gone</w:delText></w:r></w:del><w:bookmarkStart w:id="0"/></w:ins></w:hyperlink>'
    "<w:fldSimple w:instr=' a > b '><w:r><w:t>1</w:t></w:r></w:fldSimple><w:r/><w:r><w:t>a</w:t><w:drawing/></w:r></w:p>"
)
NOTES = f'<w:footnotes {NS}><w:footnote w:id="3"><w:p>{run("n1")}</w:p><w:p>{run("n2")}</w:p></w:footnote><w:footnote w:id="4"><w:p>{run("n3")}</w:p></w:footnote></w:footnotes>'


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("good", package()), ("broken", b"not a zip"), ("empty", package(main="word/other.xml")), ("more", package(MORE, notes=NOTES))]
    rows += [("crossed", package("<w:p><w:r><w:t>x</w:r></w:t></w:p>")), ("open", package("<w:p>")), ("letters", package(f"<w:p>{run('&#9999999; &#xFFFFFF; &#xD800;')}</w:p>")), ("latin", package(b"\xff\xfe"))]
    return docx.explode_parts(spark.createDataFrame(rows, "doc_id string, content binary")).cache()


@pytest.fixture(scope="module")
def paragraphs(parts):
    return {(r.doc_id, r.paragraph_id): r for r in docx.parse_paragraphs(parts).collect()}


@pytest.fixture(scope="module")
def nodes(parts):
    return docx.parse_nodes(parts).cache()


def test_bad_packages_and_parts_become_violations(parts):
    got = {(r.doc_id, r.part, r.code) for r in docx.part_violations(parts, docx.part_tokens(parts)).collect()}
    main = docx.MAIN
    assert got == {
        ("broken", None, "package-validity"), ("empty", None, "not a valid DOCX"), ("crossed", main, "malformed-nesting"), ("latin", main, "invalid-encoding"),
        ("open", main, "malformed-nesting"), ("open", main, "unclosed-element"), ("letters", main, "character-reference"),
    }


def test_addresses_and_views(paragraphs):
    got = {i: (r.final_text, r.original_text, r.n_revisions) for (d, i), r in paragraphs.items() if d == "good"}
    assert got["P0"] == ("Take 20 mg daily.",) * 2 + (0,)
    assert got["P1"] == ("Keep new text & more", "Keep old text & more", 2)
    assert got["T0.R0.C0.P0"][0] == "a" and got["T1.R0.C0.P0"][0] == "nested" and got["T0.R0.C1.P0"][0] == "b"
    assert got["P2"] == ("", "", 0) and got["P3"][0] == "end" and got["header1.P0"][0] == "head"
    assert {d for d, _ in paragraphs} == {"good", "more", "crossed", "open", "letters", "latin"}  # of the last four only the header


def test_boxes_controls_notes_and_nested_tables(paragraphs):
    rows = sorted((r for (d, _), r in paragraphs.items() if d == "more"), key=lambda r: (r.part, r.stop))
    # a box in a cell and a table in a control have no addresses; a box paragraph closes before its host
    assert [r.paragraph_id for r in rows if r.part == docx.MAIN] == ["B0.P0", "B0.P1", "P0", "P1", "S0.P0", "T0.R0.C0.P0", "P2"]
    assert [(r.paragraph_id, r.entry_id) for r in rows if "foot" in r.part] == [("footnotes.P0", "3"), ("footnotes.P1", "3"), ("footnotes.P2", "4")]
    assert [r.final_text for r in rows if r.part == docx.MAIN][:3] == ["in box", "", "host[opaque:unsupported-run]"]


def test_nodes(nodes):
    got = [tuple(r) for r in nodes.where("doc_id = 'more' AND paragraph_id = 'P2'").orderBy("path").select("cls", "kind", "text", "rev_path.kind", "style").collect()]
    bold = "s_" + hashlib.sha256(b'["w:rPr",[],"",[["w:b",[],"",[]],["w:sz",[["w:val","24"]],"",[]]]]').hexdigest()[:16]
    plain = "s_" + hashlib.sha256(b'["w:rPr",[],"",[]]').hexdigest()[:16]
    assert got == [
        ("inline", "rpr-change", None, [], bold), ("text", "text", "bold 中& ", [], bold), ("inline", "tab", None, [], bold), ("text", "text", "<x>", [], bold), ("range", "hyperlink", None, [], None),
        ("revision", "insert", None, [], None), ("text", "text", "linked", ["insert"], plain), ("revision", "delete", None, ["insert"], None), ("text", "text", "gone", ["insert", "delete"], plain),
        ("anchor", "bookmark-start", None, ["insert"], None), ("opaque", "opaque", None, [], None), ("inline", "empty-run", None, [], plain), ("opaque", "unsupported-run", None, [], plain),
    ]


def test_revision_keys_and_marks(parts):
    got = sorted(r.revision_key for r in docx.parse_revisions(parts).collect())
    assert [k.rsplit("|", 1)[0] for k in got] == [f"word/document.xml|{x}" for x in ("delete|2", "delete|8", "insert|1", "insert|7")]
    assert got[3].endswith(hashlib.sha256(b"linkedgone").hexdigest()[:12])
    nested = docx.sound_tokens(parts)
    marks = docx.mark_revisions(nested, N.word_paragraphs(nested)).collect()
    assert [(r.doc_id, r.paragraph_id, r.kind, r.w_id, r.author) for r in marks] == [("more", "P2", "insert", "20", "M")]


@pytest.mark.parametrize("accept,texts", [(True, ["Keep new text & more", "linked"]), (False, ["Keep old text & more", ""])])
def test_settlement(spark, accept, texts):
    before = spark.createDataFrame([("d", package()), ("m", package(MORE)), ("x", package("<w:p>"))], "doc_id string, content binary")
    after_rows = docx.settle_packages(before, accept).cache()
    after = docx.explode_parts(after_rows)
    rows = {(r.doc_id, r.paragraph_id): r for r in docx.parse_paragraphs(after).collect()}
    assert rows["d", "P1"].final_text == rows["d", "P1"].original_text == texts[0] and rows["d", "P1"].n_revisions == 0
    assert rows["m", "P2"].final_text == f"bold 中& \t<x>{texts[1]}[opaque:opaque][opaque:unsupported-run]"
    kinds = [r.kind for r in docx.parse_nodes(after).where("doc_id = 'm' AND cls = 'anchor'").collect()]
    assert kinds == ["bookmark-start"]  # kept either way
    assert docx.package_guard(docx.explode_parts(before), after).count() == 0
    assert {r.doc_id: bytes(r.content) for r in after_rows.collect()}["x"] == package("<w:p>")


def test_no_change_is_byte_identical(spark):
    packages = spark.createDataFrame([("a", package(MORE)), ("b", package())], "doc_id string, content binary")
    tokens = docx.sound_tokens(docx.explode_parts(packages))
    assert {r.doc_id: bytes(r.content) for r in docx.write_parts(packages, docx.joined_parts(tokens)).collect()} == {"a": package(MORE), "b": package()}


def test_replace_in_packages(spark):
    packages = spark.createDataFrame([("d", package())], "doc_id string, content binary")
    edits = [("P0", "20 mg", "30 mg & <b>"), ("P1", "Keep new", "b"), ("P3", "zzz", "b"), ("T0.R0.C0.P0", "a", "c"), ("T0.R0.C0.P0", "a", "d"), ("P9", "x", "y"), ("T1.R0.C0.P0", "e", "b")]
    table = spark.createDataFrame([("d", docx.MAIN, *e) for e in edits], "doc_id string, part string, paragraph_id string, old string, new string")
    after, status = docx.replace_in_packages(packages, table)
    assert {r.paragraph_id: r.code for r in status.collect()} == {
        "P0": None, "P1": "cross-region-text", "P3": "text-not-found", "T0.R0.C0.P0": "duplicate-edit", "P9": "text-not-found", "T1.R0.C0.P0": "text-ambiguous",
    }
    got = {r.paragraph_id: r.final_text for r in docx.parse_paragraphs(docx.explode_parts(after)).collect()}
    assert got["P0"] == "Take 30 mg & <b> daily." and got["T0.R0.C0.P0"] == "a" and got["P1"] == "Keep new text & more"


def test_every_byte_of_a_text_is_in_one_token(spark):
    texts = ["", "a<b", "<a b='>' c=\"<\"/>é<!-- <p> --><?x ?><![CDATA[<p>]]></a>", "<", "<<a>>", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, xml string")
    got = N.tokens(df, ["doc_id"], "xml").orderBy("doc_id", "seq").collect()
    for i, t in enumerate(texts):
        mine = [r for r in got if r.doc_id == i]
        assert "".join(r.token for r in mine) == (t or "") and [r.start for r in mine] == [0, *(r.stop for r in mine)][: len(mine)]
    assert [r.kind for r in got if r.doc_id == 2] == ["alone", "text", "skip", "skip", "cdata", "close"]
