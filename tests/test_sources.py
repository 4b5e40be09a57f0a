"""Readers over small files."""

from __future__ import annotations

import json

from lexiscope.sources import corpora as S
from lexiscope.sources import pages as P


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2}\n')
    got = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string", numbered=True).orderBy("line_no").collect()
    assert [(r["line_no"], r["id"], r["_corrupt"]) for r in got] == [(1, 1, None), (3, None, "not json"), (4, 2, None)]
    plain = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()
    assert sorted(r["_corrupt"] or "" for r in plain) == ["", "", "not json"]


def test_genre_corpus(spark, tmp_path):
    (tmp_path / "essay.jsonl").write_text('{"index": 1, "text": "a", "label": 1, "written_by": "x"}\n{"index": 2, "text": "", "label": 7}\n')
    got = {r["index"]: (r["genre"], r["label"], r["errors"]) for r in S.read_genre_corpus(spark, str(tmp_path)).collect()}
    assert got == {"1": ("essay", 1, []), "2": ("essay", 7, ["label", "text"])}


def test_prose_tree_and_languages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.md", "a.ko.md", "sub/b.mdx", "c.py"):
        (tmp_path / name).write_text(name)
    df = S.read_prose_tree(spark, str(tmp_path))
    assert sorted(r["text"] for r in df.collect()) == ["a.ko.md", "a.md", "sub/b.mdx"]
    assert [r["text"] for r in S.select_lang_files(df, "ko").collect()] == ["a.ko.md"]


def test_front_matter(spark):
    text = "---\nid: x\nlist:\n  - a\n  - 'b'\nnest:\n  en:\n    18: suppress  # why\n---\n\nBody\n"
    r = S.parse_front_matter(spark.createDataFrame([(text,), ("plain",)], "text string")).collect()
    assert r[0]["meta"] == {"id": "x", "list/0": "a", "list/1": "b", "nest/en/18": "suppress"} and r[0]["body"] == "Body"
    assert r[1]["meta"] == {} and r[1]["body"] == "plain"


def test_lexicons(spark, tmp_path):
    for d, words in (("base", "- one\n- two"), ("own", "- mine")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "ai-en.md").write_text(f"# x\n- not this\n## Strict matches\n{words}\n## Multi-word phrases\n- a ~ b\n## Notes\n- nor this\n")
    a, b = (S.read_lexicon(spark, str(tmp_path / d), p) for d, p in (("base", 0), ("own", 1)))
    assert sorted((r["kind"], r["entry"]) for r in a.collect()) == [("phrase", "a ~ b"), ("strict", "one"), ("strict", "two")]
    assert sorted(r["entry"] for r in S.shadow(a, b).collect()) == ["a ~ b", "mine"]


def test_patterns(spark, tmp_path):
    (tmp_path / "en-style.md").write_text("---\npack: en-style\nlanguage: en\ndedupe-with:\n  - source: en-style:3\n    target: en-x:4\n---\n# T\n\n### 3. First One\n\n**Watch words:** alpha, \"beta\", alpha\n\nmore\n\n### 12. Second\n\nno list\n")
    pats, terms, edges = S.read_patterns(spark, str(tmp_path))
    assert sorted((r["pattern_id"], r["category"], r["number"], r["title"]) for r in pats.collect()) == [("en-style:12", "style", 12, "Second"), ("en-style:3", "style", 3, "First One")]
    assert sorted(r["term"] for r in terms.collect()) == ["alpha", "beta"]
    assert [tuple(r) for r in edges.collect()] == [("en-style:3", "en-x:4", "en-style:3", "")]


def test_policies(spark, tmp_path):
    good = "---\ndocument-type: blog\nname: n\nversion: 1\nscope: s\npurpose: p\n" + "".join(f"{k}:\n  - v\n" for k in S.POLICY_LISTS) + "pattern-overrides:\n  en:\n    3: suppress\n---\nB"
    (tmp_path / "blog.md").write_text(good)
    (tmp_path / "news.md").write_text("---\ndocument-type: other\nmps: 1\npattern-overrides:\n  fr:\n    x: drop\n---\nB")
    errors, rows = S.read_policies(spark, str(tmp_path))
    got = {r["document_type"]: r["errors"] for r in errors.collect()}
    assert got["blog"] == [] and {"document-type", "name", "foreign: mps", "override language", "override action"} <= set(got["news"])
    assert [tuple(r) for r in rows.collect()] == [("blog", "en", 3, "suppress")]


def test_personas(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\nid: p1\nlang: en\nblocks:\n  preferred_words:\n    allow:\n      - so\n      - maybe\n    avoid: [unlock, elevate]\ntarget_features:\n  mattr:\n    target: 0.8\n    tolerance: 0.1\n    weight: 2\n---\nB")
    people, targets = S.read_personas(spark, str(tmp_path))
    r = people.first()
    assert (r["persona_id"], r["allow"], r["avoid"], r["errors"]) == ("p1", ["so", "maybe"], ["unlock", "elevate"], [])
    assert [tuple(r) for r in targets.collect()] == [("p1", "en", "mattr", 0.8, 0.1, 2.0, None)]


def test_segments(spark, tmp_path):
    (tmp_path / "a.xliff").write_text('<xliff><file><body><trans-unit id="1" resname="r" translate="no"><source>S</source><target state="final">T</target></trans-unit><trans-unit id="2"><source>U</source></trans-unit></body></file></xliff>')
    got = [tuple(r) for r in S.read_segments(spark, str(tmp_path / "a.xliff")).orderBy("id").collect()]
    assert got == [("1", "r", "no", None, None, "S", "T", "final"), ("2", None, None, None, None, "U", None, None)]


def test_detector_labels(spark, tmp_path):
    rows = [{"fixture_id": "a", "detector": "d", "label": "AI", "score": 0.9}, {"fixture_id": "b", "detector": "d", "predicted_hot": False}, {"fixture_id": "c", "detector": "d", "label": "maybe"}]
    (tmp_path / "d.json").write_text(json.dumps({"results": rows}, indent=1))
    assert {r["fixture_id"]: r["predicted"] for r in S.read_detector_labels(spark, str(tmp_path / "d.json")).collect()} == {"a": True, "b": False, "c": None}


PAGE = '<html><head><title>No</title></head><body><nav><p>Menu entry of the page</p></nav><!-- x --><script>var t="</p>";</script><h1>A heading that is long enough</h1><p>First paragraph with <b>bold</b> text &amp; more.</p><p>first paragraph WITH bold text &amp; more.</p><ul><li>Short</li></ul><img src="/a.png" alt="A long description" width="640"><img src="data:xx"><img src="/logo.png"></body></html>'


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    lines = P.html_to_paragraphs(pages, None).filter("page_id = 1").orderBy("idx")
    assert "First paragraph with bold text & more." in [r["text"] for r in lines.collect()] and lines.count() == len({r["text"].lower() for r in lines.collect()})
    blocks = [(r["tag"], r["text"]) for r in P.html_prose_blocks(pages).orderBy("idx").collect()]
    assert blocks == [("h1", "A heading that is long enough"), ("p", "First paragraph with bold text & more."), ("p", "first paragraph WITH bold text & more.")]
    images = P.page_images(pages).collect()
    assert [(r["src"], r["priority"]) for r in images] == [("/a.png", 4)]
