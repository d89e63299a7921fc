import pytest


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>menu</p><main><h1>Title</h1><article><p>a b</p></article><p>more</p></main><p>foot", "Title a b more"),
        ("<article>one two</article><p>x</p><article>three</article>", "one two three"),
        ("<main><article>a b c</article><article>d</main><p>x", "a b c d"),
        ("<main>a<article>b</article>c<aside><article>no</article>no<article>no</article></aside>d</main>", "a b c d"),
        ("<article>a</article></article><p>x", "a"),
        ("<main>a<article>b</body><p>x", "a b"),
        ("<article>a</article><p>" + "long " * 9 + "</p>", "long " * 8 + "long"),
    ],
)
def test_op6_whole_content(page, want):
    from quillgraph.llm.op6_html_extraction import extract

    assert extract(page) == want
