"""Readers of archives and gold sets, and Markdown, on small written files."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest

from quillgraph.functions import markup
from quillgraph.sources import archives as R


def test_bundle(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "title": "T"}\n\n')
    edge = {"src": "x", "dst": "y", "relation": "supports", "agreement": {"tier": "strong"}, "trust": 0.5}
    (tmp_path / "c.json").write_text(json.dumps({"contributions": [{"id": "x", "paper_id": "a"}], "edges": [edge, {"src": "y", "dst": "x", "relation": "refines"}]}))
    got = R.bundle(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "c.json"))
    assert [r.id for r in got["papers"].collect()] == ["a"] and [r.paper_id for r in got["contributions"].collect()] == ["a"]
    assert sorted((r.src, r.rel, r.tier, r.trust, r.directed) for r in got["edges"].collect()) == [("x", "supports", "strong", 0.5, False), ("y", "refines", "", None, False)]


def test_gold_by_suffix(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{k1, title={A {Big}\n Title}, year={2020}, doi={https://doi.org/10.1000/X.}}\n@misc{k2, year=1999}\n@misc{k3, title="Two", eprint={2401.00001v2}, year={n.d.}}')
    (tmp_path / "b.jsonl").write_text('{"title": "Three"}\n\n{"title": " "}\n{"id": 7, "title": "Four", "year": 2001}\n')
    (tmp_path / "c.csv").write_text('title,year\n"Five, six",1990\n')
    read = lambda n: sorted(tuple(r) for r in R.gold(spark, str(tmp_path / n)).collect())
    assert read("a.bib") == [("k1", "A Big Title", "10.1000/x", "", 2020), ("k3", "Two", "", "2401.00001", None)]
    assert read("b.jsonl") == [("7", "Four", "", "", 2001), ("gold:00000", "Three", "", "", None)]
    assert read("c.csv") == [("gold:00000", "Five, six", "", "", 1990)]
    with pytest.raises(ValueError):
        list(R.gold_rows("x.txt", ""))


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("all.jsonl", '{"pmid": 1, "t": "a"}\n{"pmid": 2, "t": "b"}\n{"pmid": 1, "t": "c"}\n')
        z.writestr("__MACOSX/all.jsonl", "x")
    wanted = spark.createDataFrame([("1",), ("9",), (None,)], "pmid string")
    assert [tuple(r) for r in R.zipped_lines(spark, str(tmp_path / "a.zip"), "pmid string, t string", wanted, "pmid").collect()] == [("1", "a")]


def test_source_files(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name in ("m/a.tex", "b.BBL", "c.png"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "1").write_bytes(raw.getvalue())
    (tmp_path / "2").write_bytes(gzip.compress(b"only"))
    (tmp_path / "3").write_bytes(b"%PDF")
    got = sorted((r.path[-1], r.name, r.text) for r in R.source_files(spark, str(tmp_path)).collect())
    assert got == [("1", "b.BBL", "abc"), ("1", "m/a.tex", "abc"), ("2", "main.tex", "only")]


def test_claims_and_texts(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"doc_id": 5, "title": "T", "abstract": ["a", "b"]}\n{"doc_id": 6}\n')
    claims = [{"id": 1, "claim": "c", "evidence": {"5": [{"sentences": [0], "label": "contradict"}]}, "cited_doc_ids": [5]}, {"id": 2, "claim": "d", "evidence": {}}, {"id": 3, "claim": "e"}]
    (tmp_path / "claims.jsonl").write_text("\n".join(map(json.dumps, claims)))
    docs, found = R.claim_corpus(spark, str(tmp_path / "corpus.jsonl"), str(tmp_path / "claims.jsonl"))
    assert sorted(tuple(r) for r in docs.collect()) == [("5", "T", ["a", "b"]), ("6", "", [])]
    assert sorted(tuple(r) for r in found.collect()) == [("1", "c", "CONTRADICT", ["5"], ["5"]), ("2", "d", "NOINFO", [], []), ("3", "e", "NOINFO", [], [])]
    (tmp_path / "arxiv_2401.00001.txt").write_text("one\ntwo")
    assert [tuple(r) for r in R.full_texts(spark, str(tmp_path)).collect()] == [("arxiv_2401.00001", "one\ntwo")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("<script>x</script>", ""), ("plain  &amp; text", "plain & text\n"),
        ("<h2> A <em>b</em></h2><p>One\n two<br>three</p><p>four", "## A *b*\n\nOne two\nthree\n\nfour\n"),
        ("<ul><li>a<ol><li>x</li><li>y</li></ol></li><li> b</li></ul>", "- a\n  1. x\n  2. y\n\n- b\n"),
        ("<table><tr><th>h</th><th>k</th></tr><tr><td>1|2</td></tr></table>", "| h | k |\n| --- | --- |\n| 1\\|2 | |\n"),
        ("<p>so <math alttext='a^2'><mi>a</mi></math>.</p><math display='block' alttext='b'></math>", "so $a^2$ .\n\n$$\nb\n$$\n"),
        ("<table class='ltx_eqn_table'><tr><td>pad</td><td><math alttext='c=d'></math></td><td class='ltx_eqn_eqno'>(4)</td></tr></table>", "$$\nc=d \\tag{4}\n$$\n"),
        ("<figure><img src='f.png' alt='F'><img src='data:x'><figcaption>Cap</figcaption></figure>", "![F](f.png)\n\nCap\n"),
        ("<nav><p>menu</p></nav><b>x</b></i> y", "**x** y\n"),
    ],
)
def test_markdown(html, want):
    assert markup.to_markdown(html) == want


def test_markdown_of_deep_pages(spark):
    deep = "<div>" * 5000 + "x"
    assert [r.markdown for r in markup.markdown(spark.createDataFrame([(1, deep)], "page_id int, html string"), "page_id", "html").collect()] == ["x\n"]
