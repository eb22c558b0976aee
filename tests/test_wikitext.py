from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import wikitext as W
from refloom.operators import extraction as X
from refloom.operators import rewriting as R
from refloom.operators.citations import extract_citations


def texts(spans):
    return [s.text for s in spans]


def test_templates_outer_before_nested(one):
    got = one(B.template_spans("t"), [
        "* {{Cite web | url=https://a.org | author=Ms.Y}}",
        "* {{Cite web | author=Ms.Y | ref={{sfnref|Hill|1990}}}}",
        "<ref>{{ cite journal | author=Ms.Y}}</ref>",
        "<ref>{{Cite web | ref={{sfnref|Hill|1990}} }}</ref>",
        "no template",
    ])
    assert [texts(g) for g in got] == [
        ["{{Cite web | url=https://a.org | author=Ms.Y}}"],
        ["{{Cite web | author=Ms.Y | ref={{sfnref|Hill|1990}}}}", "{{sfnref|Hill|1990}}"],
        ["{{ cite journal | author=Ms.Y}}"],
        ["{{Cite web | ref={{sfnref|Hill|1990}} }}", "{{sfnref|Hill|1990}}"],
        [],
    ]


def test_odd_braces(one):
    got = one(B.brace_spans("t"), [
        "a {{x|{{y|{{z}}}}|q}} {{open {{in}} tail",
        "{{a|{{{b|c}}}}}",
        "{{{{{n}}}|x}}",
        "{{{{x}}|y}} }}",
        "<!-- {{no}} --><nowiki>{{no}}</nowiki>{{yes}}",
    ])
    assert [[(s.kind, s.text) for s in g] for g in got] == [
        [("template", "{{x|{{y|{{z}}}}|q}}"), ("template", "{{y|{{z}}}}"), ("template", "{{z}}"), ("template", "{{in}}")],
        [("template", "{{a|{{{b|c}}}}}"), ("argument", "{{{b|c}}}")],
        [("template", "{{{{{n}}}|x}}"), ("argument", "{{{n}}}")],
        [("template", "{{{{x}}|y}}"), ("template", "{{x}}")],
        [("template", "{{yes}}")],
    ]


def test_span_positions_and_long_pages(one):
    page = " ".join(f"é{{{{cite web|title=t{i}|ref={{{{r{i}}}}}}}}} text" for i in range(400))
    (spans,) = one(B.template_spans("t"), [page])
    assert len(spans) == 800
    assert all(page[s.start : s.end] == s.text for s in spans)
    (outer,) = one(B.outermost(B.template_spans("t")), [page])
    assert len(outer) == 400
    (deep,) = one(B.with_ancestors(B.template_spans("t")), [page])
    assert {s.depth for s in deep} == {1, 2} and all(len(s.ancestors) == s.depth - 1 for s in deep)


def test_balance(one):
    assert one(B.balanced("t"), ["{{}}", "{{{}}}}", "a{b}c", "}{", ""]) == [True, False, True, False, True]
    assert one(B.repair_unbalanced("t"), ["{{a", "{{a}}"]) == ["{{a}}", "{{a}}"]


def test_params(one):
    got = one(W.template_params("t"), [
        "{{cite web|title=a|url=http://x.y/?a=b|last = Foo |pos|{{x|y=z}}|[[a|b]]|ref={{s|a|{{b|c}}}}}}",
        "{{a}}", "{{a|}}", "{{a|b=[[c|d}}", "{{x|t=<nowiki>|</nowiki>|u=1}}", "{{a|x=1|x=2|p|3=q}}",
    ])
    assert [[(p.name, p.value) for p in g] for g in got] == [
        [("title", "a"), ("url", "http://x.y/?a=b"), ("last", "Foo"), ("1", "pos"), ("2", "{{x|y=z}}"),
         ("3", "[[a|b]]"), ("ref", "{{s|a|{{b|c}}}}")],
        [], [("1", "")], [("b", "[[c"), ("1", "d")], [("t", "<nowiki>|</nowiki>"), ("u", "1")],
        [("x", "1"), ("x", "2"), ("1", "p"), ("3", "q")],
    ]
    (m,) = one(W.params_to_map(W.template_params("t")), ["{{a|x=1|x=2|y=}}"])
    assert m == {"x": "2", "y": ""}


def test_param_access(over):
    maps = [{"a": "1", "b": " "}]
    assert over(W.has_param("m", "b"), maps) == [True]
    assert over(W.has_param("m", "b", ignore_empty=True), maps) == [False]
    assert over(W.get_param("m", "z", "none"), maps) == ["none"]


def test_plain_text(one):
    got = one(W.strip_code("t"), [
        "'''A''' {{x|{{y}}}}[[P|q]] [[r]] [http://x.y z w][http://k.l] <ref>abc</ref><br/>&amp;&eacute;&#233;&#x41;&nope;",
        "{{{arg|def}}} {{{n}}}", "== H ==\n\n\n\n* item", "<nowiki>{{x}}</nowiki> <math>a</math>", "a || b",
    ])
    assert got == ["A q r z w abc&ééA&nope;", "def ", " H \n\n item", "{{x}} ", "a || b"]


def test_links_headings_tags(one):
    (links,) = one(W.wikilinks("t"), ["[[A|b]] [[C]] [[File:x.png|thumb|d]]"])
    assert [(x.title, x.text) for x in links] == [("A", "b"), ("C", None), ("File:x.png", "thumb|d")]
    (urls,) = one(W.external_links("t"), ["see [https://a.b/c d e], https://x.y/z. and mailto:a@b [//p.q r]"])
    assert [(u.url, u.title) for u in urls] == [
        ("https://a.b/c", "d e"), ("https://x.y/z", None), ("mailto:a@b", None), ("//p.q", "r")]
    (heads,) = one(W.headings("t"), ["lead\n== A ==\ntext\n===B===\nx = y =\n==C=="])
    assert [(h.level, h.title.strip()) for h in heads] == [(2, "A"), (3, "B"), (2, "C")]
    (refs,) = one(W.tags("t", "ref"), ['<ref name="a">x</ref> <ref name=b /> <REF>y</REF>'])
    assert [(r.contents, r.self_closing) for r in refs] == [("x", False), (None, True), ("y", False)]
    assert one(W.get_attribute("t", "name"), ['group=x name="a b"']) == ["a b"]
    assert one(W.has_attribute("t", "zz"), ['group=x name="a b"']) == [False]
    assert one(W.title_matches("t", F.lit("foo bar")), ["Foo_bar", "[[foo bar]]", "Foo Bar"]) == [True, True, False]


def test_sections(spark):
    pages = spark.createDataFrame([(1, "lead\n== A ==\na\n=== B ===\nb\n== C ==\nc")], "page_id int, content string")
    flat = X.sections(pages, flat=True).select("level", "title", "text").collect()
    assert [(r.level, r.title) for r in flat] == [(0, None), (2, "A"), (3, "B"), (2, "C")]
    assert flat[1].text == "== A ==\na\n"
    nested = X.sections(pages, levels=[2], matching="a", include_headings=False).collect()
    assert [r.text for r in nested] == ["\na\n=== B ===\nb\n"]


def test_repeated_text_gets_both_sections(spark):
    page = "{{c|1}}\n== A ==\n{{c|1}}\n==B==\n{{c|2}}"
    pages = spark.createDataFrame([(1, page)], "page_id int, content string")
    rows = extract_citations(pages).orderBy("pos").collect()
    assert [(r.section, list(r.sections_all)) for r in rows] == [
        ("Initial Section", ["Initial Section", "A"]), ("A", ["Initial Section", "A"]), ("B", ["B"])]
    strict = extract_citations(pages, strict=True).orderBy("pos").collect()
    assert [r.section for r in strict] == ["Initial Section", "A", "A"]


def test_edits(spark):
    pages = spark.createDataFrame([(1, "x {{Cite web|a=1|b=2}} y {{cite web|a=1}} {{other|a=1}}")], "page_id int, content string")
    done = R.rewrite_page_templates(pages, "cite web", "a", None).first().content
    assert done == "x {{Cite web|b=2}} y {{cite web}} {{other|a=1}}"
    one_param = spark.createDataFrame([("{{t|p|a=1|a=2}}",)], "text string")
    assert R.rewrite_param(one_param, "a", F.lit("9")).first().text == "{{t|p|a=1|a=9}}"
    assert R.rewrite_param(one_param, "z", F.lit("9")).first().text == "{{t|p|a=1|a=2|z=9}}"


def test_nodes_by_kind_and_pattern(spark):
    pages = spark.createDataFrame([(1, "{{a}} [[Link]] <!-- c --> == no")], "page_id int, content string")
    nodes = X.all_nodes(pages)
    assert {r.kind for r in nodes.collect()} == {"template", "wikilink", "comment"}
    assert X.filter_nodes(nodes, pattern="LINK").count() == 1
