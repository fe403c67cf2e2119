import html
import random
import re

import numpy as np
import pytest

from specloom.llm import html_text as ht

ARTICLE = ["The council voted on Monday to repair the old bridge over the river, after years of delay.", "Work is to start in spring & should take two years. The cost, some say, is too high.", "Residents welcomed the plan. \"We have waited long enough,\" one of them said, near the market."]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return ht.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def plain(source):
    """What the tables' pages hold between <article> and </article>."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
    return "\n\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)) if b)


def test_query_against_plain_text_of_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = ht.op13_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    assert all(r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)


LAYOUTS = [
    '<body><div id="topmenu" class="menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="wrap"><div class="post-content"><h2>Bridge</h2>{}</div><div class="sidebar"><h3>Popular</h3><ul><li><a href=x>One more story</a></li><li><a href=y>Another</a></li></ul></div></div><div id="footer">All rights reserved</div>',
    '<header><h1>The Daily</h1><nav><ul><li><a href=1>World</a><li><a href=2>Sport</a></ul></nav></header><main>{}<section id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this at all, nobody asked us.</p></div><div class="comment"><p>Nice.</p></div></section></main><aside><p>Buy now</p></aside>',
    '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>OK</button></div><article>{}<div class="advert"><p>Cheap flights to anywhere, book today.</p></div><form action=s><label>Mail</label><input name=m><select><option>A</select></form></article><footer><p>&copy; 2020</p></footer>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_layouts(model, layout):
    source = layout.format("".join(f"<p>{html.escape(t)}</p>" for t in ARTICLE))
    assert [b for b in ht.main_texts([source], model)[0].split("\n\n") if b != "Bridge"] == ARTICLE


def test_held_out_layouts(model, spark, sf_dir):
    rng = random.Random(42)
    blocks = [plain(r.html).split("\n\n") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    short, long, right = [x[:50] for b in blocks for x in b], [x for b in blocks for x in b], []
    for b in blocks:
        page = ht.Page(ht._laid_out(rng, [("h1" if i == 0 else "p", x) for i, x in enumerate(b)], short, long))
        truth = ht._truth(page)
        right.append(ht.render(page, ht.decode(page, ht.odds(ht.features([page]), model))) == ht.render(page, (truth > 0).tolist()))
    assert np.mean(right) > 0.9


def every_labelling(page, score, enter, leave):
    """Sums of all labellings in which no way down leaves the order outside, inside, cut."""
    best, n = None, len(page.name)

    def go(i, states, total):
        nonlocal best
        if i == n:
            best = total if best is None or total > best else best
            return
        above = states[page.parent[i]] if i else 0
        for s in range(above, 3) if above else ((0, 1) if i else (0, 1)):
            if above == 1 and s == 0:
                continue
            go(i + 1, [*states, s], total + (score[i] if s == 1 else -score[i]) - enter * (s == 1 and above == 0) - leave[i] * (s == 2 and above == 1))

    go(0, [], 0.0)
    return best


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for _ in range(40):
        page = ht.Page("".join(rng.choice(["<div>", "</div>", "<section>", "</section>", "<p>a</p>"]) for _ in range(9)))
        score = rng.normal(0, 2, len(page.name))
        kept, leave = ht.decode(page, score), ht.leaving(page)
        cut = [False] * len(kept)
        total = 0.0
        for i, (k, p) in enumerate(zip(kept, page.parent, strict=True)):
            above = kept[p] if i else False
            cut[i] = bool(i and not k and (above or cut[p]))
            assert not (k and i and cut[p])  # nothing inside below what was cut out
            total += (score[i] if k else -score[i]) - 3.0 * (k and not above) - leave[i] * (cut[i] and above)
        assert total == pytest.approx(every_labelling(page, score, 3.0, leave))


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = ht.fit(x[:3000], y[:3000], np.ones(3000), trees=40)
    assert np.mean((ht.odds(x[3000:], model) > 0) == y[3000:]) > 0.95


def text_of(source):
    page = ht.Page(source)
    return ht.render(page, [name not in ht.NEVER for name in page.name])


def test_reading_of_markup():
    assert text_of("<p>a&amp;b &copy &#233; &am; x</p>") == "a&b © é &am; x"
    assert text_of("<p>one<br>two <b>th</b>ree\n\t four<p>five<li>six<li>seven") == "one two three four\n\nfive\n\nsix\n\nseven"
    assert text_of("a<script>if (a<b) '</p>'</script>b<style>x{}</style><!-- c > d --> e<textarea><p>t</textarea>") == "ab e"
    assert text_of('<div title="a > b">x</div><p>1 < 2 and <3</p><a href=x>y') == "x\n\n1 < 2 and <3\n\ny"
    assert text_of("<p>cut <b") == "cut" and text_of("") == "" and text_of("<!-- open") == "" and text_of("<script>open") == ""
    assert text_of("</div></p>x<table><tr><td>1<td>2<tr><td>3</table>") == "x\n\n1\n\n2\n\n3"


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "plain words only"), (None, "v", "<article><p>" + "word, and more of it. " * 30_000), (3, "w", "<div>" * 3000 + "x"), (3, "w", "<nav><a href=x>menu</a></nav>"), (4, "z", "<p>" + "<" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = ht.extract(pages, model).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(a), str(b)) for a, b, _ in rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 1} == {""} and next(len(r.text.split()) for r in got if r.page_id is None) == 150_000
    assert not ht.extract(pages.limit(0), model).count() and ht.learn(pages.limit(0)) is None
    assert [r.text for r in ht.extract(spark.createDataFrame([(1, "u", "<nav>no</nav><p>yes</p>")], "page_id long, url string, html string"), None).collect()] == ["yes"]
