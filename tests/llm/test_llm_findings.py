"""Cases in which an operator did less than the whole job, by hand."""

import random

import pytest

from docloom.llm import html_consensus, toxicity, url_graph

LEAD = "The lead says in a few words what the page is about and why. " * 3
BODY = "The body goes on about the same matter at some length. " * 18


def lines(html, path=None):
    return [" ".join(x.split()) for x in html_consensus.extract(html, path).split("\n")]


@pytest.mark.parametrize("name", ["has-sidebar", "content-sidebar-wrap", "no-header", "page with-nav", "sidebar-layout", "site-header-main", "search"])
def test_wrappers_named_after_noise_keep_their_page(name):
    html = f'<body><div class="{name}"><article><div class="post-header"><h1>Head</h1></div><p>{BODY}</p></article><div class="sidebar"><p>Side</p></div></div></body>'
    assert lines(html) == ["Head", BODY.strip()]
    plain = html.replace("<article>", "<div>").replace("</article>", "</div>").replace("post-header", "top")
    assert BODY.strip() in lines(plain) and "Side" not in lines(plain)


def test_noise_by_name_still_goes():
    talk = f'<section id="comments"><article class="comment-body"><p>{BODY}{BODY}</p></article></section>'
    assert lines(f'<div><p>{BODY}</p></div>{talk}<div class="related-posts"><p>More</p></div>') == [BODY.strip()]
    assert lines(f'<article><p>One <span class="share">Share</span> two.</p><p>{BODY}</p></article>{talk}') == ["One two.", BODY.strip()]


H, P, Q = "Head", LEAD.strip(), BODY.strip()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<article class="a"><h1>{H}</h1><p>{P}</p><div class="body"><p>{Q}</p></div></article>', [H, P, Q]),
        (f'<div class="a"><h1>{H}</h1><p>{P}</p><div class="body"><p>{Q}</p></div></div>', [H, P, Q]),
        (f'<main><section class="one"><p>{Q}</p></section><section class="two"><p>{P}</p></section></main>', [Q, P]),
        (f'<div><section class="one"><p>{Q}</p></section><section class="two"><p>{P}</p></section></div>', [Q, P]),
        (f'<article><p>{P}</p><blockquote><p>{Q}</p></blockquote><p>End.</p></article>', [P, Q, "End."]),
        (f'<div><p>{P}</p><blockquote><p>{Q}</p></blockquote><p>End.</p></div>', [P, Q, "End."]),
        (f'<div class="l"><article class="x"><p>{Q}</p></article><article class="y"><p>{P}</p></article></div>', [Q, P]),
        (f'<div><table><tr><td class="s"><p>{P}</p></td><td class="t"><p>{Q}</p></td></tr></table></div>', [P, Q]),
    ],
)
def test_main_text_is_the_whole_region(html, want):
    page = f'<html><body><nav><a href="/">Home</a></nav>{html}<footer>Foot</footer></body></html>'
    assert lines(page) == want
    path, share = html_consensus.best_path(page)
    assert lines(page, path) == want and share > 0.9
    # a vote for an inner container takes nothing away
    assert lines(page, "/html/body/article.a/div.body") == want


def test_a_host_vote_takes_no_text_away(spark):
    flat, split = f'<article><div class="body"><p>{Q}</p></div></article>', f'<article><h1>{H}</h1><p>{P}</p><div class="body"><p>{Q}</p></div></article>'
    rows = [(i, f"http://h.org/{i}", split if i == 3 else flat) for i in range(5)]
    got = {r.page_id: r.text.split("\n") for r in html_consensus.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: [H, P, Q] if i == 3 else [Q] for i in range(5)}


def test_all_who_link_to_a_blocked_host_are_blocked(spark):
    farms = [f"farm{i}.net" for i in range(7)]
    pages = [(f"http://{h}/", '<a href="http://bad.com/">x</a>') for h in farms] + [("http://bad.com/de/1", ""), ("http://wide.net/", '<a href="http://bad.com/">x</a>' + "".join(f'<a href="http://h{i}.net/">x</a>' for i in range(9)))]
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in url_graph.judge(rows).collect()}
    assert verdicts == {h: "block" for h in [*farms, "bad.com"]} | {"wide.net": "allow"}


def test_repeated_rows_do_not_weigh_in_the_toxicity_sample(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["vexor"] * (i % 5 == 0))) for i in range(200)]
    labels = toxicity.targets(spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int"))
    once, often = (toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels, toxicity.CATEGORIES) for r in (rows, rows + [rows[1]] * 300))
    assert once.words == often.words and once.cut == often.cut
    assert all((a == b).all() for a, b in zip(once.weights, often.weights, strict=True))
