import pytest

from cellweave.llm import html_extract as op

ARTICLE = "<h1>Title</h1><p>First paragraph, with some words. And more of them, here.</p><p>Second paragraph, as long as the first one is.</p>"
TEXT = "Title\nFirst paragraph, with some words. And more of them, here.\nSecond paragraph, as long as the first one is."
AROUND = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy now, please. It is cheap!</div>%s<footer>&copy; somebody</footer></body></html>'

#: page, its text.
CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain text, no tags.", "plain text, no tags."),
    (AROUND % f"<article>{ARTICLE}</article>", TEXT),
    (AROUND % f"<div id='main'>{ARTICLE}</div>", TEXT),
    (AROUND % f"<article>{ARTICLE}<div class='comments'><p>I think so too, really. Good.</p></div></article>", TEXT),
    (AROUND % f"<article>{ARTICLE}<aside>Related: this.</aside><form><p>Your mail, please.</p></form></article>", TEXT),
    (AROUND % "<article><p>a &amp; b &lt;c&gt; &#65;&#x42; &eacute;</p></article>", "a & b <c> AB é"),
    (AROUND % "<article><p>one\n  two\t<b>three</b> <i>fo</i>ur<br>five</p></article>", "one two three four five"),
    (AROUND % "<article><p>never closed<p>next one<ul><li>a<li>b</ul></article>", "never closed\nnext one\na\nb"),
    (AROUND % "<article><!-- hidden <p>x</p> --><p>seen</p><p hidden>not seen</p><p style='display:none'>nor this</p></article>", "seen"),
    (AROUND % "<article><table><tr><td>c1</td><td>c2</td></tr></table></article>", "c1\nc2"),
    ("<article><p>cut off in the tex", "cut off in the tex"), ("<article><p>cut in a tag</p><di", "cut in a tag"),
    ("<article><p>x < y and y > z</p></article>", "x < y and y > z"), ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_page(i):
    page, text = CASES[i]
    assert op.main_text(page) == text


def test_extract_keeps_every_row(spark):
    rows = [(k, f"http://x/{k}", h) for k, (h, _) in enumerate(CASES)] + [(None, None, None), (1, "http://x/1", "")]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, op.extract(df).collect()), key=str)
    want = sorted([(k, f"http://x/{k}", t, len(t)) for k, (_, t) in enumerate(CASES)] + [(None, None, "", 0), (1, "http://x/1", "", 0)], key=str)
    assert got == want
    assert op.extract(df.limit(0)).count() == 0


def test_table_has_articles_without_what_stands_around_them(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html
    import re

    for r in op.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|h2|li|div|ul|td|tr)[^>]*>|<br>", " ", inner))).split())
        assert " ".join(r["text"].split()) == want


def test_scores_decide_inside_articles():
    links = "<div class='x'><a href='/1'>Mail this</a> <a href='/2'>Print this</a></div>"
    assert op.main_text(AROUND % f"<article>{ARTICLE}{links}</article>") == TEXT
    low = "<ul>" + "<li>x</li>" * 9 + "</ul>"
    long = "<p>" + "A sentence of some length, with a comma in it. " * 20 + "</p>"
    assert op.main_text(f"<article>{long}{low}{long}</article>").count("x\n") == 2  # all but those beside the paragraphs


def test_every_sibling_article_stays():
    pages = AROUND % f"<article>{ARTICLE}</article><div><p>Teaser of some page.</p></div><article>{ARTICLE}</article><article class='comment'><p>I think so too, really. Good.</p></article>"
    assert op.main_text(pages) == f"{TEXT}\n{TEXT}"


def test_a_stub_article_does_not_hide_the_text_outside():
    assert op.main_text(f"<article><p>Stub.</p></article><div id='main'>{ARTICLE * 3}</div>").endswith("\n".join([TEXT] * 3))


def test_scores_decide_without_article_elements_and_class_names(spark, sf_dir):
    """Pages of the table without articles, then without any class or id too: the text must be that of the whole page."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for bare in (lambda x: x, lambda x: re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", x)):
        same = sum(op.main_text(bare(re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", x))) == op.main_text(x) for x in pages)
        assert same >= 0.8 * len(pages), (same, len(pages))


def test_many_unclosed_tags_take_time_in_proportion():
    import time

    began = time.monotonic()
    for tag in ("div", "b", "p", "li", "span", "a", "ul"):
        assert op.main_text(f"<{tag}>word, and more. " * 60_000 + "</p></li></div>")
    assert time.monotonic() - began < 60
