import itertools
import random

import pytest

from triagelake.llm import html_text
from triagelake.llm.html_text import Graph, extract, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site name</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies to improve your experience on this site. Please accept them all.</p></div>
<div id="content" class="post"><h1>The title of it</h1><p>First   paragraph of the story, which has a good number of words in it, &amp; ends here.<p>Short one.
<div class="ad">Buy now cheap things from us today and tomorrow, great offers.</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
<ul><li>Point one of the list here.<li>Point two.</ul><p>Last <b>paragraph</b> that is long enough to be kept by the classifier alone.</div>
<aside>Related: <a href=1>one</a></aside><div class="comments"><h3>3 comments</h3><p>Great article, I really liked reading this, thank you so much for writing it!</p><form><textarea>x</textarea><button>Send</button></form></div>
<footer>Copyright 2020</footer></body></html>"""


def test_keeps_the_article_only():
    assert main_text(PAGE).split("\n") == [
        "The title of it", "First paragraph of the story, which has a good number of words in it, & ends here.", "Short one.", "Point one of the list here.", "Point two.",
        "Last paragraph that is long enough to be kept by the classifier alone.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a href='x>text", "&#xFFFFFFF;&nbsp;", "<p>" * 3000])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


STORY = "<article><p>The story itself stands here, with enough words in it to be kept by the classifier.</p></article>"


@pytest.mark.parametrize("before", ["<svg-icon></svg-icon>", "<video-player src=x></video-player>", "<template-x>", "<svg/>", '<svg class="a>b" />', "<math />", "<svg:rect>"])
def test_elements_before_the_article(before):
    assert main_text(f"<body>{before}{STORY}</body>") == main_text(STORY) != ""


@pytest.mark.parametrize("before", ["<svg><path d='M0'/>no</svg>", "<svg a=/>no</svg >", "<script/>no</script>", "<title>no</title>"])
def test_raw_elements_end_at_their_end_tag(before):
    assert main_text(f"<body>{before}{STORY}</body>") == main_text(STORY) != ""


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("length", [10, 5000, 300_000])
def test_quoted_values_of_any_length(quote, length):
    other = "'" if quote == '"' else '"'
    value = (f"<nav class={other}ad{other}>no</nav></article><p hidden>" * (1 + length // 40))[:length] + ">"
    page = f"<body>{STORY.replace('<article', f'<article data-x={quote}{value}{quote}')}</body>"
    assert main_text(page) == main_text(page.replace(" data-x=", " data-x  =\n")) == main_text(STORY) != ""


def test_quotes_elsewhere_open_nothing():
    for tag in ("<p title='it's'>", "<p \">", "<p a=b\"c>", "<p title=\"open>"):
        assert main_text(f"<article>{tag}The story's text, with enough words in it to be kept, isn't lost.</p></article>") == "The story's text, with enough words in it to be kept, isn't lost."


def test_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 9)
        graph, scores, edges = Graph(), [rng.choice([-3, -1, -0.5, 0.25, 1, 2, 4]) for _ in range(n)], {}
        for s in scores:
            graph.node(s)
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[a, b] = rng.choice([0.25, 0.5, 1.5])
                graph.edge(a, b, edges[a, b])
        cost = lambda label: sum(abs(s) for s, x in zip(scores, label) if (s > 0) != x and s) + sum(w for (a, b), w in edges.items() if label[a] != label[b])  # noqa: B023
        assert cost(graph.cut()) == pytest.approx(min(cost(x) for x in itertools.product((False, True), repeat=n)))


def test_table(spark):
    rows = [(1, "u", PAGE, "old"), (1, None, None, "old"), (None, "u", "", None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [len(r["text"]) > 0 for r in found] == [True, False, False]
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


MIXED = """<body><div class="nav"><a href=x>Home</a></div><div><p>The storm reached the coast late on Monday and left three towns without power, officials said.</p><div>Photos</div>
<p>Crews from two counties worked through the night to clear the roads, and schools stayed closed on Tuesday.</p></div>
<div><a href=1>More from the coast</a><p>Weather</p><div>All the day's news in one mail.</div><p>Sport</p><div><a href=3>Contact us</a></div></div></body>"""


def test_the_cut_overrules_scores_both_ways():
    found = html_text.blocks(MIXED)
    label = {b.text: (b.score() > 0, kept) for b, kept in zip(found, html_text.labels(found), strict=True)}
    assert label["Photos"] == (False, True) and label["All the day's news in one mail."] == (True, False)
    assert main_text(MIXED).split("\n")[1] == "Photos" and main_text(MIXED).count("\n") == 2


@pytest.mark.parametrize("name", ["share", "side-by-side", "related", "privacy", "reply"])
def test_doubtful_names_are_outvoted_by_long_paragraphs(name):
    inner = "This paragraph belongs to the story and is long enough to be seen as such by anyone who reads it."
    page = f"<body>{STORY.replace('</article>', f'<div class={name}><p>{inner}</p></div></article>')}</body>"
    assert main_text(page).split("\n")[1] == inner
    links = f"<body>{STORY.replace('</article>', f'<div class={name}><a href=1>One</a> <a href=2>Two</a></div></article>')}</body>"
    assert main_text(links) == main_text(STORY)


def test_pages_by_all_labellings():
    rng = random.Random(8)
    bits = ["<p>Short.</p>", "<p>A paragraph of some ten words stands here, no more.</p>", "<div>Word</div>", "<a href=1>Link</a>", "<div><div>Two words</div></div>", "<ul><li>Item one<li><a href=2>Two</a></ul>", "<h2>Head</h2>"]
    for _ in range(60):
        page = "".join(f"<{e}>{''.join(rng.choices(bits, k=rng.randint(1, 3)))}</{e}>" for e in rng.choices(["div", "article", "nav", "div class=related", "section"], k=2))
        page = page.replace("</div class=related>", "</div>")
        found = html_text.blocks(page)[:11]
        edges = [(i - 1, i, html_text.NEXT if found[i - 1].element.parent == found[i].element.parent else html_text.NEXT_ELSEWHERE) for i in range(1, len(found))]
        groups = {}
        for i, b in enumerate(found):
            groups.setdefault(b.element.parent, []).append(i)

        def cost(label):
            hubs = sum(html_text.PARENT * min(sum(label[i] for i in g), sum(not label[i] for i in g)) for g in groups.values())  # noqa: B023
            return hubs + sum(abs(b.score()) for b, x in zip(found, label) if (b.score() > 0) != x) + sum(w for i, j, w in edges if label[i] != label[j])  # noqa: B023

        assert cost(html_text.labels(found)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=len(found)))))


def test_long_page(spark):
    page = f"<body><article>{'<p>A paragraph of the long story, one of very many that it has.</p>' * 20_000}</article><footer>no</footer></body>"
    found = extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["text"]
    assert found.count("\n") == 19_999


LONG = "This paragraph has more than enough words to be taken for a part of the story by anyone who doesn't look at the names around it, and it ends here."


@pytest.mark.parametrize("name", ["discussion", "replies", "notice", "notice info", "notification", "related", "nav", "promo", "widget", "recommended"])
@pytest.mark.parametrize("where", ["before", "after"])
def test_notices_comments_and_teasers_outside_of_the_article(name, where):
    other = f'<div class="{name}"><p>{LONG}</p><p>{LONG}</p></div>'
    assert main_text(f"<body>{other + STORY if where == 'before' else STORY + other}</body>") == main_text(STORY)


@pytest.mark.parametrize("name", ["discussion", "replies", "notice", "notifications"])
def test_notices_and_comments_inside_of_the_article(name):
    assert main_text(STORY.replace("</article>", f'<div class="{name}"><p>{LONG}</p></div></article>')) == main_text(STORY)


@pytest.mark.parametrize("name", ["navy-history", "navigator", "promontory", "noticeable"])
def test_names_that_only_begin_like_those(name):
    assert main_text(STORY.replace("</article>", f'<div class="{name}"><p>{LONG}</p></div></article>')).split("\n")[1] == LONG


@pytest.mark.parametrize("name", ["noscript", "svg", "object", "video", "template"])
def test_elements_that_never_close_hide_nothing(name):
    assert main_text(f"<body><{name}>{STORY}</body>") == main_text(STORY)
    assert main_text(f"<body><{name}>no</{name}><{name} class=x>{STORY}</body>") == main_text(STORY)


def test_raw_text_that_never_closes_takes_the_rest():
    assert main_text(f"<body>{STORY}<script>var x = '<p>no</p>'; {STORY}") == main_text(STORY)
    assert html_text.blocks("<noscript>" * 200_000 + "x")[0].text == "x"
