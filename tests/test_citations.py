import pytest
from pyspark.sql import functions as F

from quillgraph.functions import bibliography as B
from quillgraph.functions import citations as C


def listed(entries):
    return [raw for _, _, raw in entries]


def test_numbered_lists():
    text = "Body [1].\nReferences\n[1] Smith J. A first title here. 2019.\n[2] Jones K. A second title here.\n[3] Lee M. A third title. 2021.\nAppendix A\n[4] Not a reference at all. 2020."
    assert [(label, style) for label, style, _ in B.of_text(text)] == [("1", "numeric"), ("2", "numeric"), ("3", "numeric")]
    # A list may begin after 1, and one number may fall.
    assert len(B.of_text("x\nReferences\n[4] Smith J. A first title here.\n[5] Jones K. Second title here.\n[2] Lee M. A third title here.\n[6] Kim N. A fourth title here.")) == 4
    # Flat text without line ends.
    flat = "word " * 50 + "References [1] Smith J. A first title here. 2019. [2] Jones K. A second title, 2020. [3] Lee M. Third title: more. 2021."
    assert len(B.of_text(flat)) == 3


def test_names_with_years_and_unmarked():
    names = "x\nReferences\nSmith et al. (2019) A long title about things. Jones [2020b] Another long title about things."
    assert [(label, style) for label, style, _ in B.of_text(names)] == [("Smith et al.|2019", "author_year"), ("Jones|2020b", "author_year")]
    plain = "x\nBibliography\nSmith J. A first title. 2019.\n\nJones K. Second title without year.\n\nLee M. A third title. 2021."
    assert B.of_text(plain) == [(None, "unmarked", "Smith J. A first title. 2019."), (None, "unmarked", "Lee M. A third title. 2021.")]
    lines = "x\nReferences\n1. Smith J. A first title. 2019.\n2. Jones K. A second title. 2020.\n"
    assert listed(B.of_text(lines)) == ["Smith J. A first title. 2019.", "Jones K. A second title. 2020."]


def test_the_last_heading_with_entries_counts():
    text = "a\nReferences\n[1] Smith J. A first title here. 2019.\n[2] Jones K. A second title here.\n" + "\nReferences\nprompt text without any entry\n"
    assert listed(B.of_text(text)) == ["Smith J. A first title here. 2019.", "Jones K. A second title here. References prompt text without any entry"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "text_unavailable"), ("", "text_unavailable"), ("short", "short_or_stub"), ("long " * 3000, "heading_absent"), ("references " + "long " * 3000, "heading_without_reference_block"),
        ("long " * 3000 + "\nReferences\nnothing like an entry", "reference_block_unsegmented"), ("x\nReferences\n[1] Smith J. A first title. 2019.\n[2] Jones K. A second title. 2020.", "parsed"),
    ],
)
def test_statuses(text, want):
    assert B.status(text) == want


def test_blobs():
    blob = "".join(f"@article{{k{i}, title={{Long title number {i}}}, year={{2019}}}}" for i in range(120))
    assert len(blob) > B.MOST_LENGTH and len(B.references_for([blob, "Smith J. A short one. 2019.", " Smith J. A short one. 2019. "], None)) == 121
    items = "\\bibitem{a} Smith J. A first title. 2019. \\bibitem{b} Jones K. A second title. 2020."
    assert B.split_blob(items) == ["{a} Smith J. A first title. 2019.", "{b} Jones K. A second title. 2020."]
    assert B.references_for([], "x\nReferences\n[1] Smith J. A first title. 2019.\n[2] Jones K. A second title. 2020.") == ["Smith J. A first title. 2019.", "Jones K. A second title. 2020."]


def test_markers():
    body = "As in [3–7] and [1, 4]; also (5) and [4]."
    assert [body[a:b] for a, b in C.markers(body, "4", "numeric")] == ["[3–7]", "[1, 4]", "[4]"]
    assert [body[a:b] for a, b in C.markers(body, "5", "numeric")] == ["[3–7]", "(5)"]
    text = "Smith et al. (2019) say so; Smith, in 2020, not. (smith 2019)"
    assert [text[a:b] for a, b in C.markers(text, "Smith et al.|2019", "author_year")] == ["Smith et al. (2019", "smith 2019"]


def test_latex():
    tex = r"First \citep[p.~3]{a, b} then \emph{more} \cite{b} and \citet*{b}."
    got = C.cite_contexts(tex)
    assert [(k, n) for k, n, _ in got] == [("a", 0), ("b", 0), ("b", 1)]
    assert got[0][2] == "First [CITED:TARGET] then more [CITED] and [CITED]." and got[2][2] == "First [CITED] then more [CITED:TARGET] and [CITED]."
    assert C.bbl_entries(r"\bibitem[x]{k} Body one. \bibitem{l} Two. \end{thebibliography} \bibitem{m} no") == [("k", "Body one."), ("l", "Two.")]
    assert [k for k, _ in C.bibtex_entries("@a{k, t={x {y} z}} @b{l, t={open")] == ["k"]


def test_agreed(spark):
    rows = [(1, "k", "x", 1), (1, "k", "y", 2), (1, "l", "x", 2), (1, "l", "z", 2), (1, "m", "x", 1), (1, "m", "x", 1), (2, "k", "q", 2)]
    got = C.agreed(spark.createDataFrame(rows, "id int, key string, body string, tier int"), "id").collect()
    assert sorted(map(tuple, got)) == [(1, "k", "x", 1), (1, "m", "x", 1), (2, "k", "q", 2)]


def test_stated_ids_and_fields(spark):
    rows = [("see arXiv: 2401.01234v2 and 10.1000/x",), ("doi:10.1000/ab_c(1)",), ("none",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "raw string").select(C.stated_id(F.col("raw")).alias("s")).collect()]
    assert got == ["arxiv:2401.01234", "doi:10.1000/ab_c(1)", None, None]
    made = [("title={T}, author={A}, booktitle={B}, year={1999}, eprint={2401.01234}",), ("author={A}",), ("TITLE={}",)]
    got = [r.s for r in spark.createDataFrame(made, "raw string").select(C.of_fields(F.col("raw")).alias("s")).collect()]
    assert got == ["A. T. B. 1999. arXiv:2401.01234", "", ""]


def test_references_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert B.references(df, "id", "text").count() == 0 and B.references(df.limit(0), "id", "text").count() == 0
    assert {r.status for r in B.statuses(df, "id", "text").collect()} == {"text_unavailable"}
