from __future__ import annotations

import time

import pytest
from fixtures import FOLDER

from featloom.llm.html import Weights, best_region, extract_text, learn_weights, main_text, tokens

STORY = "<p>One two three four five.</p><p>Six seven eight nine ten.</p>"
TEXT = "One two three four five.\nSix seven eight nine ten."
AROUND = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site name and claim</h1></header>"
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us and more</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies on this site, and you will like it a lot.</div>{}"
    "<aside>Read also this other story of ours</aside><div id=comments><p>First reader comment, with many words in it.</p></div>"
    "<form><label>Mail</label><input name=x></form><footer>&copy; the site</footer></body></html>"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (AROUND.format(f"<article>{STORY}</article>"), TEXT),
        (AROUND.format(f"<main>{STORY}</main>"), TEXT),
        (AROUND.format(f"<div>{STORY}</div>"), TEXT),
        (AROUND.format(f"<article><header><h1>Title</h1></header>{STORY}</article>"), "Title\n" + TEXT),
        (f"<article>{STORY}<div class=ad>Buy this now, it is cheap.</div><p>Last words.</article>", TEXT + "\nLast words."),
        (f"<article>{STORY}<script>if (a<b) {{ x = '</p><p>no text' }}</script></article><p>x", TEXT),
        ("<article><p>A&amp;B &lt;tag&gt; &#233;&eacute; &quot;q&quot; &am &unknown; x</article>", 'A&B <tag> éé "q" &am &unknown; x'),
        ("<article><p> a \n\t b<b>c</b> <i>d</i>e<br>f <!-- no > text --> g</p></article>", "a bc de f g"),
        ("<article><ul><li>one item here<li>two items here</ul><table><tr><td>cell<td>other</table>", "one item here\ntwo items here\ncell\nother"),
        (f"<main><p>An intro of the page.<article>{STORY}<article class=comment><p>So wise!</article><p>End.</article></main>", TEXT + "\nEnd."),
        (f"<article>{STORY}<p><a href=x>More words in a link</a></article>", TEXT + "\nMore words in a link"),
        (f"<article>{STORY}</article><p>x<article><p>More of it, told in other words.</article>", TEXT + "\nMore of it, told in other words."),
        (f"<article>{STORY}</article><article><a href=x>Only some links</a> <a href=y>that lead on</a></article>", TEXT),
        (f"<main><article>{STORY}</article><nav>menu</nav><article>{STORY}</article></main>", TEXT + "\n" + TEXT),
        ("plain words without any markup at all", "plain words without any markup at all"),
        ("1 < 2 and 3 > 2, is it not <b>so</b>?", "1 < 2 and 3 > 2, is it not so?"),
        ("<article><p>Words before a tag that is cut <a href='x", "Words before a tag that is cut"),
        ("<nav><a href=x>only</a> a menu</nav>", ""),
        ("<p>broken <b>bold<br><p>next</p></i></article>", "broken bold\nnext"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, text):
    assert main_text(page, Weights()) == text


def test_region_is_the_best_of_all():
    weights = Weights(plain=1.0, tag=-2.0)
    page = "<p>a b c<p>d<p><p><p>e f g h<p>i j k l<p><p><p><p><p>m"
    found = [t for t in tokens(page)]
    scores = [len(v.split()) * 1.0 if k == "text" else -2.0 for k, v, *_ in found]
    spans = [(sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(spans, key=lambda s: s[0])
    region = best_region(page, weights)
    assert sum(len(v.split()) if k == "text" else -2.0 for k, v, *_ in region) == best[0] == 6


def test_learned_weights(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = learn_weights(pages)
    assert weights.plain > 0.5 > 0 > weights.boilerplate
    assert all(w < 0 for w in weights.tags.values()) and weights.tags["p"] > weights.tags["nav"]
    assert learn_weights(pages.where("html NOT LIKE '%<article%'")) == Weights()


def test_odd_tables(spark):
    rows = [(1, "u", None, "x"), (None, None, AROUND.format(f"<article>{STORY}</article>"), "y"), (1, "u", "", "z"), (1, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract_text(pages, learn_weights(pages)).collect())
    assert got == [("1", "", 0)] * 3 + [("None", TEXT, len(TEXT))]
    assert extract_text(pages.limit(0), learn_weights(pages.limit(0))).count() == 0


@pytest.mark.parametrize("page", ["<" * 50_000, "<a href='" * 5_000, "<p>" * 30_000 + "x", "<!--" * 50_000, "<div>" * 20_000 + "</b>" * 2000])
def test_long_broken_pages_take_little_time(page):
    start = time.time()
    main_text(page, Weights())
    assert time.time() - start < 5
