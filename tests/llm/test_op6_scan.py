import random

import pytest

from quillgraph.llm import op6_html_extraction as op


def best_by_brute_force(parts, word, tags):
    """The highest sum over all contiguous ranges, of pages without content elements."""
    gain = []
    for tag, text, off in parts:
        name = tag.lstrip("/")
        gain.append(tags.get(op.named(name), op.DEFAULT_TAG) if tag and not off and name not in op.INLINE else 0.0 if off or tag else word * len(text.split()))
    return max((sum(gain[i:j]) for i in range(len(gain) + 1) for j in range(i, len(gain) + 1)), default=0.0), gain


def test_scan_finds_the_best_region():
    r = random.Random(3)
    for _ in range(300):
        page = "".join(r.choice(["<p>", "</p>", "<div>", "<li>", "<b>", "one two three ", "x ", "<h2>t</h2>", "<nav>n n n</nav>", "<x-y>"]) for _ in range(r.randint(1, 25)))
        tags = {n: -r.choice([0.0, 0.5, 1.5, 4.0]) for n in ("p", "div", "li", "h2", op.OTHER)}
        parts = op.tokens(page)
        best, gain = best_by_brute_force(parts, 0.7, tags)
        (first, last), = op.region(parts, 0.7, tags)
        assert sum(gain[first:last]) == pytest.approx(best)


def test_weights_decide():
    page = "<div>menu of links</div><li>a</li><li>b</li><p>" + "text " * 12 + "</p><li>c</li><p>" + "more " * 12 + "</p>"
    mild, strict = {"li": -0.1, "p": 0.0, "div": 0.0}, {"li": -9.0, "p": 0.0, "div": -9.0}
    assert op.extract(page, 1.0, mild).startswith("menu of links a b text")
    assert op.extract(page, 1.0, strict) == ("text " * 12).strip()


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ("<section id='related-work'>r</section>", True), ("<p class='share-price'>r</p>", True), ("<figure><figcaption>r</figcaption></figure>", True), ("<math><mi>r</mi></math>", True), ("<div class='header-image-credit'>r</div>", True),
        ("<div class='related-posts'>r</div>", False), ("<div class='comment-list'>r</div>", False), ("<div id='ad-1'>r</div>", False), ("<div class='x cookie_notice'>r</div>", False), ("<ul class='share-buttons'><li>r</ul>", False), ("<div role='navigation'>r</div>", False),
    ],
)
def test_compound_names(inside, kept):
    assert op.extract(f"<article><h1>T</h1>{inside}<p>e</p></article>") == ("T r e" if kept else "T e")


def test_pages_without_content_elements(spark):
    """The labelled pages' weights find the same text where the article tags are taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    word, tags = op.learn(pages, "html")
    same = total = 0
    for r in pages.select("html").collect():
        plain = r.html.replace("<article>", "").replace("</article>", "")
        total += plain != r.html
        same += plain != r.html and op.extract(plain, word, tags) == op.extract(r.html, word, tags)
    assert total > 100 and same >= 0.95 * total
