"""Typed documents: write(read(x)) = x, every violation code, odd inputs."""

import random

import pytest

from folioforge.operators import typed as T

HEAD = '<!--@typed schema="1" format="format.json" styles="styles.json" template="_template.docx" source="source.docx"'


def document(rng: random.Random, n: int) -> str:
    """A canonical typed document: what the writer itself would write."""
    text = lambda: "".join(rng.choice(["a", "é", "&amp;", "&lt;", "&gt;", '"', " ", "中", "\\", "x"]) for _ in range(rng.randint(1, 5)))
    ids = iter(range(10**6))

    def token(name, kind, more="", end="/>"):
        return f'<docx-{name} id="t{next(ids)}" kind="{kind}"{more}{end}'

    def nodes(level, last=""):
        out = []
        for _ in range(rng.randint(0, 4)):
            what = rng.choice(["text", "span", "anchor", "inline", "opaque", "range", "revision"])
            if what in ("text", "span") and last == what:
                continue
            if what == "text":
                out.append(text())
            elif what == "span":
                out.append(f'<span data-s="s_2">{text()}</span>')
            elif what == "anchor":
                out.append(token("anchor", "bookmark-start", ' w:id="1" w:name="a &quot;b&quot; &amp; \\c"'))
            elif what == "inline":
                out.append(token("inline", "tab", rng.choice(["", ' style="s_9"', ' n="1" style="s_9" z=""'])))
            elif what == "opaque":
                out.append(token("opaque", "field"))
            elif level < 3:
                out.append(token(what, "hyperlink" if what == "range" else rng.choice(T.KINDS), end=">") + nodes(level + 1) + f"</docx-{what}>")
            last = what
        return "".join(out)

    blocks, part = [HEAD + rng.choice(["", ' author="Z &lt;z&gt;"']) + "-->"], ""
    for k in range(n):
        new = rng.choice([part, part, "comments", "header1", ""])
        if new != part:
            blocks.append(f'<!--@part key="{new}"-->')
            part = new
        body = nodes(0)
        mark = rng.choice(["", "", '\n<!--@mark kind="insert" id="m1" w:author="Q"-->'])
        blocks.append(f'<!--@p id="p{k}" {rng.choice(["base", "inherit"])}="s_1"-->{mark}' + (f"\n{body}" if body.strip() else ""))
    blocks += [f'<!--@delete id="gone{k}"-->' for k in range(rng.randint(0, 2))]
    return "\n\n".join(blocks) + "\n"


def base_of(text):
    return text.replace('inherit="s_1"', 'base="s_1"')


def test_read_and_written_again(spark):
    texts = [base_of(document(random.Random(k), k % 7)) for k in range(60)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, typed string").repartition(3)
    *parts, wrong = T.read_typed(docs)
    assert wrong.collect() == []
    again = {r.doc_id: r.typed for r in T.write_typed(*parts).collect()}
    assert again == {str(k): t for k, t in enumerate(texts)}


def test_inherited_style_is_written_without_base(spark):
    text = f'{HEAD}-->\n\n<!--@p id="a" inherit="b"-->\n<span data-s="s_1">x</span>\n'
    *parts, wrong = T.read_typed(spark.createDataFrame([("d", text)], "doc_id string, typed string"))
    assert wrong.isEmpty() and T.write_typed(*parts).first().typed == text


def test_lenient_forms_read_alike(spark):
    text = f'\n  \n{HEAD}-->\r\n<!--@p base="s"   id="a"-->\na<span data-s="s">b</span><span data-s="t">c</span><span data-s="t">d<docx-anchor kind="k" id="1"  /></span>\n<!--@p id="b" base="s"-->\n'
    _, paragraphs, nodes, _, wrong = T.read_typed(spark.createDataFrame([("d", text)], "doc_id string, typed string"))
    assert wrong.isEmpty() and {r.paragraph_id for r in paragraphs.collect()} == {"a", "b"}
    got = [(r.cls, r.style, r.text) for r in sorted(nodes.collect(), key=lambda r: r.path)]
    assert got == [("text", "s", "ab"), ("text", "t", "cd"), ("anchor", None, None)]


P = '<!--@p id="a" base="s"-->\n'
BROKEN = {
    "missing-header": ["", None, " \n ", P, "<!--@typed schema"], "incompatible-schema": ['<!--@typed schema="2"-->', "<!--@typed -->"], "expected-paragraph-marker": ["loose", '<!--@part key="a"', P + "x\n\ny", '<!--@mark kind="insert" id="1"-->'],
    "marker-incomplete": ["<!--@part-->", '<!--@delete id=""-->', '<!--@p id="a"-->', '<!--@p id="a" base="s" inherit="t"-->', '<!--@p id="" base="s"-->', P + '<!--@mark id="1"-->'], "unknown-kind": [P + '<!--@mark kind="move_to" id="1"-->', P + '<docx-revision id="1" kind="odd"></docx-revision>'],
    "paragraph-not-one-line": [P + "x\ny", P + "x y"], "attribute-syntax": ["<!--@p id=a-->", P + '<docx-anchor id="1" kind/>', P + '<docx-range id="1" kind="k"></docx-range id="1">', P + "a</span/>"], "duplicate-attribute": [P + '<docx-anchor id="1" kind="k" id="2"/>'],
    "unknown-entity": [P + "a & b", P + "&quot;", P + '<docx-anchor id="&nbsp;" kind="k"/>'], "unclosed-tag": [P + "a < b"], "malformed-tag": [P + "<>", P + "< b>"], "unknown-tag": [P + "<b/>", P + "</b>"],
    "token-incomplete": [P + "<docx-anchor/>", P + '<docx-anchor id="1" kind="k">', P + '<docx-range id="1" kind="k"/>', P + '<docx-opaque id="" kind="k"/>'], "span-invalid": [P + "<span></span>", P + '<span data-s="a"><span data-s="b">x</span></span>', P + '<span data-s="a"/>'],
    "span-holds-structure": [P + '<span data-s="a"><docx-range id="1" kind="k"></docx-range></span>'], "structure-mismatch": [P + "</span>", P + '<docx-range id="1" kind="k"><docx-revision id="2" kind="insert"></docx-range></docx-revision>'],
    "unclosed-structure": [P + '<docx-range id="1" kind="k">x', P + '<span data-s="a">x'], "duplicate-paragraph": [P + "\n" + P], "duplicate-deletion": ['<!--@delete id="z"-->\n<!--@delete id="z"-->'], "live-and-deleted": [P + '\n<!--@delete id="a"-->'],
}


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(f"{code}/{k}", t if code in ("missing-header", "incompatible-schema") else f"{HEAD}-->\n{t}") for code, texts in BROKEN.items() for k, t in enumerate(texts)]
    *parts, wrong = T.read_typed(spark.createDataFrame([*rows, ("fine", HEAD + "-->")], "doc_id string, typed string"))
    return parts, wrong.collect()


def test_every_code(broken):
    _, wrong = broken
    got = {}
    for r in wrong:
        got.setdefault(r.doc_id, set()).add(r.code)
    for code, texts in BROKEN.items():
        for k in range(len(texts)):
            assert code in got.get(f"{code}/{k}", ()), (code, k, got.get(f"{code}/{k}"))


def test_nothing_is_read_from_broken_documents(broken):
    (documents, paragraphs, nodes, deletions), _ = broken
    assert [r.doc_id for r in documents.collect()] == ["fine"]
    assert paragraphs.isEmpty() and nodes.isEmpty() and deletions.isEmpty()


def test_nodes_are_made_in_one_pass(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(T, "written", lambda df, name, write=T.written: tables.append(name) or write(df, name), raising=False)
    doc = HEAD + '-->\n\n<!--@p id="P0" base="s_1"-->\na<span data-s="s_1">b</span><docx-inline id="t1" kind="tab" n="1"/>c<docx-revision id="t2" kind="insert">d</docx-revision>\n'
    _, _, nodes, _, wrong = T.read_typed(spark.createDataFrame([("d", doc)], "doc_id string, typed string"))
    assert tables == ["typed-lines", "typed-tags"] and wrong.count() == 0
    assert "Union" not in nodes._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[0]
    got = [(r.cls, r.kind, r.token_id, r.text, r.attrs) for r in nodes.orderBy("path").collect()]
    assert got == [("text", "text", None, "ab", None), ("inline", "tab", "t1", None, {"n": "1"}), ("text", "text", None, "c", None), ("revision", "insert", "t2", None, {}), ("text", "text", None, "d", None)]
