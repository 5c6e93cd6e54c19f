"""Comments, adverts and hidden elements by the names they go by, inside an article and beside it."""

import pytest

from docloom.llm import html_consensus

NOISE = """reader-comments user-comments comments-wrapper commentaires kommentare comentarios responses discussion ad-wrapper ad-container ads-container advert-wrap google-ad gpt-ad dfp-ad adsbygoogle ad-300x250
 cookie-wrapper newsletter-container taboola outbrain paywall notification Werbung publicidad publicite userComments""".split()
TEXT = ["<p>" + "The first paragraph of the story says what has happened in the town. " * 3 + "</p>", "<p>" + "The second one tells who was there and what they saw of it. " * 3 + "</p>"]
MAIN = "\n".join(" ".join(p[3:-4].split()) for p in TEXT)


@pytest.mark.parametrize("name", NOISE)
def test_noise_goes_wherever_it_stands(name):
    extra = f'<div class="{name}"><p>Buy this now or tell us what you think.</p></div>'
    for page in (f"<article>{TEXT[0]}{extra}{TEXT[1]}</article>", f"<div class=content>{TEXT[0]}{TEXT[1]}{extra}</div>", f"<div>{TEXT[0]}{TEXT[1]}</div>{extra}", f"<article>{TEXT[0]}{TEXT[1]}</article><div id={name}><p>Say no.</p></div>"):
        assert html_consensus.extract(f"<html><body>{page}</body></html>", None) == MAIN, page


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"', "style='visibility:hidden'"])
def test_hidden_elements_go(attribute):
    assert html_consensus.extract(f"<article>{TEXT[0]}<div {attribute}><p>Not to be seen.</p></div>{TEXT[1]}</article>", None) == MAIN


@pytest.mark.parametrize("attribute", ['title="the hidden gem"', 'class="x" data-note="display:none"', 'aria-hidden="false"', 'class="related-work"', 'class="comment-free"', 'class="discussion-of-results"', 'class="sidebar-layout"', 'class="page-wrapper"', 'class="adverse"', 'class="x-ray"', "title='a hidden=b'"])
def test_what_only_looks_like_noise_stays(attribute):
    assert html_consensus.extract(f"<article>{TEXT[0]}<div {attribute}>{TEXT[1]}</div></article>", None) == MAIN


def test_a_section_of_a_paper_and_a_named_main_stay():
    assert html_consensus.extract(f"<article>{TEXT[0]}<section class=discussion>{TEXT[1]}</section></article>", None) == MAIN
    assert html_consensus.extract(f'<div class="ad-container">{TEXT[0]}{TEXT[1]}</div>', None) == MAIN  # it holds the page
    assert html_consensus.extract(f'<body hidden><article aria-hidden="true">{TEXT[0]}{TEXT[1]}</article></body>', None) == MAIN
