"""Tree scoring against a plain scorer over random trees, and pages where scores decide."""

import random
import time

import pytest

from fotolith.llm import html_text as h

BLOCKS = ["div", "section", "article", "main", "blockquote", "ul"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ","]) for _ in range(n))


def random_tree(rng, depth=0):
    """``(tag, children)``; children are trees or strings."""
    if depth and (depth > 3 or rng.random() < 0.5):
        inner = [words(rng, rng.randint(0, 60))]
        if rng.random() < 0.4:
            inner.insert(rng.randint(0, 1), ("a", [words(rng, rng.randint(1, 30))]))
        return rng.choice(["p", "p", "h2", "pre"]), inner
    return rng.choice(BLOCKS), [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 5))]


def markup(tree):
    if isinstance(tree, str):
        return tree
    return f"<{tree[0]}>{''.join(map(markup, tree[1]))}</{tree[0]}>"


def brute_text(tree):
    """The main text by the module's rules, one node and one definition at a time."""
    root = ("html", [tree])
    parents, nodes = {}, []

    def visit(node, parent):
        nodes.append(node)
        parents[id(node)] = parent
        for c in node[1]:
            if not isinstance(c, str):
                visit(c, node)

    visit(root, None)
    is_block = lambda x: not isinstance(x, str) and x[0] in h.BLOCK
    size = lambda x: len(x.strip()) if isinstance(x, str) else sum(map(size, x[1]))
    links = lambda x: 0 if isinstance(x, str) else size(x) if x[0] == "a" else sum(map(links, x[1]))
    commas = lambda x: x.count(",") if isinstance(x, str) else sum(map(commas, x[1]))

    heads = lambda x: 0 if isinstance(x, str) else size(x) if x[0] in h.HEADINGS else sum(map(heads, x[1]))

    def points(node):
        own = [c for c in node[1] if not is_block(c)]
        n = sum(map(size, own))
        return 1 + sum(map(commas, own)) + min(n / h.CHARS_A_POINT, h.MOST_LENGTH_POINTS) if node[0] in h.PARAGRAPH and n else 0

    def up(node):
        while node is not None:
            yield node
            node = parents[id(node)]

    def score(node):
        if not size(node):
            return 0
        found = sum(points(x) / k for x in nodes for k, a in enumerate(list(up(x))[:4]) if k and a is node)
        return (found + h.BONUS.get(node[0], 0)) * (1 - links(node) / size(node))

    holders = [x for x in nodes if is_block(x) and x[0] not in {"p", *h.HEADINGS} and size(x)]
    if not holders:
        chosen = [root]
    else:
        best = max(holders, key=score)
        most = score(best)
        while parents[id(best)] is not None and score(parents[id(best)]) >= h.PARENT_SHARE * most > 0:
            best = parents[id(best)]
        above = parents[id(best)]
        stays = lambda x: x is best or 0 < heads(x) == size(x) or score(x) >= max(h.LEAST_SIBLING, h.SIBLING_SHARE * most) or x[0] in ("p", "pre", "blockquote") and size(x) > 0 and links(x) / size(x) <= h.MAX_LINK_DENSITY
        chosen = [best] if above is None else [x for x in above[1] if stays(x)]

    def lines(node):
        if any(map(is_block, node[1])):
            return [line for c in node[1] for line in lines(c)]
        flat = lambda x: x if isinstance(x, str) else "".join(map(flat, x[1]))
        return [" ".join(flat(node).split())]

    return "\n".join(line for x in chosen for line in lines(x) if line)


def test_main_text_follows_the_scores_of_random_trees():
    rng = random.Random(1)
    kept = 0
    for _ in range(400):
        tree = random_tree(rng)
        page = markup(tree)
        assert h.main_text(page) == brute_text(tree), page
        kept += len(h.main_text(page)) < sum(len(x) for x in h.blocks([h.parse(page)]))
    assert kept > 100  # scores leave something out on many of them


PROSE = "A sentence of some length, with a comma, that tells the story of the page and goes on for a while."


def page(*parts):
    return "<body>" + "".join(parts) + "</body>"


def test_a_story_in_several_articles_is_whole():
    part = lambda k: f"<article><h2>Part {k}</h2><p>{PROSE} {k}</p><p>{PROSE} again {k}</p></article>"
    got = h.main_text(page("<main>", part(1), part(2), part(3), "</main>", "<div><a href=x>Other pages</a></div>"))
    assert got.count("again") == 3 and "Other pages" not in got


def test_an_article_in_sections_is_whole():
    part = lambda k: f"<section><h3>Head {k}</h3><p>{PROSE} {k}</p><p>{PROSE}</p></section>"
    got = h.main_text(page(f"<article><h1>Title</h1><p>Lead.</p>{part(1)}{part(2)}<p>End.</p></article>"))
    assert got.startswith("Title\nLead.\nHead 1\n") and got.endswith("\nEnd.")


def test_the_best_container_wins_over_a_main_of_links():
    links = "".join(f"<li><a href=x>Link number {k}, with words</a></li>" for k in range(40))
    story = "".join(f"<p>{PROSE} {k}</p>" for k in range(4))
    got = h.main_text(page(f"<main><ul>{links}</ul></main>", f"<div>{story}</div>"))
    assert got.count(PROSE) == 4 and "Link number" not in got


def test_of_several_articles_teasers_stay_out():
    story = "".join(f"<p>{PROSE} {k}</p>" for k in range(6))
    teasers = "".join(f"<article><a href=x>Teaser {k}</a></article>" for k in range(5))
    got = h.main_text(page(f"<div><article>{story}</article>{teasers}</div>"))
    assert got.count(PROSE) == 6 and "Teaser" not in got


@pytest.mark.parametrize(
    "reference, text",
    [("&#" + "9" * 5000 + ";", "�"), ("&#x" + "F" * 6000, "�"), ("&#" + "0" * 5000 + "65;", "A"), ("&#X" + "0" * 5000 + "41;", "A"), ("&#65", "A"), ("&#1114112;", "�"), ("&#12345678;", "�"), ("&amp;#65;", "&#65;"), ("&#0;", "�"), ("&#;", "&#;")],
)
def test_references_of_any_length(reference, text):
    assert h.main_text(f"<p>x{reference} y</p>") == f"x{text} y"


#: Elements whose class or id holds a word of boilerplate but names something of the article.
@pytest.mark.parametrize(
    "tag, name",
    [
        ("h2", 'id="related-work"'), ("h2", 'id="login"'), ("section", 'id="notice-period"'), ("section", 'id="sharing-data"'), ("div", 'id="social-security"'), ("div", 'class="share-price"'),
        ("p", 'class="alert"'), ("section", 'id="cookies"'), ("div", 'class="entry-header"'), ("div", 'class="header"'), ("section", 'id="ad-hoc-queries"'), ("div", 'class="has-sidebar"'), ("div", 'class="menu-of-the-day"'),
        ("header", ""), ("h3", 'class="comments"'), ("div", 'class="reply_to_critics"'),
    ],
)
def test_an_article_keeps_what_its_names_only_resemble_boilerplate(tag, name):
    inner = f"<{tag} {name}>Something that is said here.</{tag}>"
    assert h.main_text(page(f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>")) == f"{PROSE}\nSomething that is said here.\n{PROSE}"


@pytest.mark.parametrize(
    "tag, name",
    [
        ("div", 'class="ad"'), ("div", 'class="share-buttons"'), ("div", 'id="comments"'), ("section", 'id="comments"'), ("section", 'class="comment-list"'), ("div", 'class="comment comment-12"'),
        ("div", 'class="cookie-notice"'), ("div", 'class="newsletter_signup"'), ("ul", 'class="breadcrumbs"'), ("div", 'class="ad-slot-3"'), ("div", 'id="side-bar"'), ("div", 'class="related-posts"'), ("div", 'class="social-share-bar"'),
        ("aside", ""), ("nav", ""), ("footer", ""), ("form", ""), ("div", 'role="alert"'), ("div", "hidden"), ("div", 'class="skip-link"'), ("div", 'class="sponsored-links"'), ("div", 'class="site-footer"'),
    ],
)
def test_boilerplate_goes_wherever_it_stands(tag, name):
    inner = f"<{tag} {name}><p>{PROSE} This is not of the article.</p></{tag}>"
    whole = f"<article><p>{PROSE}</p>{{}}<p>{PROSE}</p></article>{{}}"
    assert h.main_text(page(whole.format(inner, inner))) == f"{PROSE}\n{PROSE}"


def test_headers_of_the_page_go_and_those_of_the_article_stay():
    got = h.main_text(page(f"<header><h1>Site</h1><p>{PROSE}</p></header>", f"<article><header><h1>Title</h1><p>Lead.</p><nav>Contents</nav></header><p>{PROSE}</p></article>"))
    assert got == f"Title\nLead.\n{PROSE}"


@pytest.mark.parametrize(
    "text",
    ["<b>" * 350_000, "<b>" * 100_000 + "<li>x</li>" * 60_000, "<li><ul>" + "<b>" * 100_000 + "<li>x</li>" * 60_000, "<p>" + "<b>" * 100_000 + "<div>x</div>" * 60_000,
     "<table><tr>" + "<i>" * 100_000 + "<td>x" * 100_000, "<select>" + "<option>x" * 100_000, "<div>" * 200_000, "<div><p>" * 120_000, "<a '>" * 200_000 + "'", '<a "' * 200_000, "<!--" * 200_000],
    ids=range(11),
)
def test_a_page_of_a_megabyte_left_open_takes_linear_time(text):
    began = time.process_time()
    h.main_text(text)
    assert time.process_time() - began < 8 * len(text) / 1e6  # a shared machine; the walk of old took minutes
