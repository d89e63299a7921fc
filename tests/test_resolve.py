from quillgraph.functions import bibliography as B
from quillgraph.operators import resolve as R

SCHEMA = "pos long, id string, source string, title string, authors array<string>, year int, url string, doi string"


def test_dedup_across_sources(spark):
    rows = [
        (0, "s2:1", "semanticscholar", "A Study of Graph Neural Networks in Practice", ["Ann Lee"], 2020, None, None), (1, "openalex:W1", "openalex", "A study of graph neural networks, in practice!", ["Ann Lee"], 2021, None, None),
        (2, "arxiv:2401.00001", "arxiv", "Another Title Entirely Here", ["Bo Chen"], 2024, None, None), (3, "x", "crossref", "Renamed", ["Bo Chen"], 2024, "http://arxiv.org/abs/2401.00001v2", None),
        (4, "y1", "crossref", "Same Name Of Work", [], None, None, "10.1000/a1"), (5, "y2", "crossref", "Same Name Of Work", [], None, None, "10.1000/a2"), (6, "z", "other", "Short", None, None, None, None), (7, "w", "other", None, None, None, None, None),
        (8, "v", "arxiv", "A Study of Graph Neural Networks in Practice Today", ["Zed Lee"], 2022, None, None), (9, "u", "arxiv", "A Study of Graph Neural Networks in Practice Today", ["Kim Wu"], 2030, None, None),
    ]
    got = {r.id: [v.id for v in r.versions] for r in R.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 8 matches 0 (contained title, same surname); 9 has 8's title key but 8 is no leader, and matches no leader itself.
    assert got == {"openalex:W1": ["s2:1", "openalex:W1", "v"], "arxiv:2401.00001": ["arxiv:2401.00001", "x"], "y1": ["y1"], "y2": ["y2"], "z": ["z"], "w": ["w"], "u": ["u"]}


def test_leaders_depend_on_order(spark):
    pos = spark.createDataFrame([(i,) for i in range(6)], "pos long")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {(r.pos, r.leader) for r in R.leaders(pos, chain).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)}


def test_entries():
    numbered = "Body 2001.\n\nReferences\n[1] A. Lee. First work on graphs. 2019.\n[2] B. Chen. Second work, see [1]. 2020.\n[3] C. Wu. Third work with no date at all.\nAppendix A\n[4] no"
    assert [(e[0], e[1]) for e in B.entries(B.block(numbered))] == [("1", "numeric"), ("2", "numeric"), ("3", "numeric")]
    named = "References\nLee et al. (2019). First work on graphs.\nChen (2020). Second work\n on networks.\n"
    assert B.entries(B.block(named)) == [("Lee et al.|2019", "author_year", "Lee et al. (2019). First work on graphs."), ("Chen|2020", "author_year", "Chen (2020). Second work on networks.")]
    # Initials between name and year are no marker, and without blank lines nothing else parts the entries.
    initials = "References\nLee, A. (2019). First work on graphs.\nChen, B. (2020). Second work\n on networks.\n"
    assert B.entries(B.block(initials)) == [(None, "unmarked", "Lee, A. (2019). First work on graphs. Chen, B. (2020). Second work on networks.")]
    blank = "bibliography\n\nfirst work on graphs by lee, 2019\n\nno year in this entry at all\n\nsecond work on graphs, 2020"
    assert len(B.entries(B.block(blank))) == 2
    many = "References\n" + "".join(f"[{i}] Author {i}. A title number {i}. 2020.\n" for i in range(1, 700))
    assert len(B.entries(B.block(many))) == 500
    assert (B.status(None), B.status("text"), B.status("text " * 3000), B.status("text " * 3000 + "\nReferences\nnone"), B.status(numbered)) == ("text_unavailable", "short_or_stub", "heading_absent", "reference_block_unsegmented", "parsed")


def test_references(spark):
    df = spark.createDataFrame([(1, "References\nLee (2019). First work on graphs.\nChen et al. (2020). Second work on nets."), (2, None)], "id long, text string")
    assert [(r.id, r.pos, r.style) for r in B.references(df, "id", "text").orderBy("pos").collect()] == [(1, 0, "author_year"), (1, 1, "author_year")]
