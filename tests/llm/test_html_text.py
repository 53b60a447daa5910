"""Main text of pages: the ratios against all pairs of paths, wrappers whose
names sound like boilerplate, and deep nesting."""

import math
import random
import time

import pytest

from tablegov.llm import html_text

TEXT = "A sentence, with marks; and some more of it. It goes on. Another one, as long as the first; it ends here."
ARTICLE = ("<article><p>A sentence, with marks; and some more of it. It goes on.</p>"
           "<p>Another one, as long as the first; it ends here.</p></article>")


def inside(extra):
    return ARTICLE.replace("</article>", extra + "</article>")


@pytest.mark.parametrize("page, text", [
    (f"<form id='f'>{ARTICLE}</form>", TEXT),
    (f"<div class='content with-sidebar'>{ARTICLE}</div>", TEXT),
    (f"<div id='page' class='has-header'><header>Site</header>{ARTICLE}<footer>&copy; me</footer></div>", TEXT),
    (f"<nav>Menu one</nav><form>{ARTICLE}<label>Mail, please.</label></form><footer>All rights, reserved.</footer>", TEXT),
    (f"<div class='sidebar'><article><p>A teaser, short.</p></article></div>{ARTICLE}", TEXT),
    (f"<aside><main><p>A teaser, short.</p></main></aside>{ARTICLE}", TEXT),
    (inside("<div class='comments'><article class='comment'><p>I agree, fully; it is well said, all of it. Yes!</p></article></div>"),
     TEXT),
    (inside("<div class='share-buttons'><a href=x>Tell, others</a></div><div class='ad'>Buy now, cheap, today.</div>"), TEXT),
    (inside("<div class='market share'><p>Shares rose, and fell; then rose again.</p></div>"),
     TEXT + " Shares rose, and fell; then rose again."),
    (inside("<ul><li><a href=x>A linked list</a></li><li><a href=y>is text</a></li></ul>"), TEXT + " A linked list is text"),
    ("<div class='sidebar'><p>All there is, on this page.</p></div>", "All there is, on this page."),
    (f"{ARTICLE}<p hidden>not seen</p><p style='display: none'>nor this</p>", TEXT),
])
def test_parts_of_pages(page, text):
    assert html_text.main_text(page) == text
    assert html_text.main_text(f"<html><body class='with-menu'>{page}</body></html>") == text


def all_paths(root):
    found = [root]
    for path in found:
        found.extend(path.children.values())
    return found


def brute_paths(root, threshold):
    """Every path looks at every other along the tree, one at a time."""
    paths = all_paths(root)
    value = {}
    for p in paths:
        if p.text:
            links = p.linked / p.text * (1 if p.kind == "plain" else 0.5)
            value[p] = math.log(1 + p.text / p.blocks) * (1 + math.log(1 + p.marks / p.blocks)) * (1 - links)
    value = {p: v for p, v in value.items() if v > 0}
    kinds = {p.kind for p in value}
    best = "inside" if "inside" in kinds else "again" if "again" in kinds else "plain"
    fused = {}
    for p in value:
        steps, seen, total, top = {p: 0}, [p], 0.0, 0.0
        for q in seen:
            for r in [*q.children.values(), q.parent]:
                if r is not None and r not in steps and (r.kind, r.down) == (p.kind, p.down):
                    steps[r] = steps[q] + 1
                    seen.append(r)
        for q in seen:
            if q in value:
                near = q.text * math.exp(-steps[q])
                total, top = total + near, top + near * value[q]
        weight = 1.0 if best == "plain" else 3.0 if p.kind == best else 0.25
        fused[p] = weight * 0.02 ** p.down * top / total
    return {p: v for p, v in fused.items()}, threshold * max(fused.values(), default=0.0)


@pytest.mark.parametrize("seed", range(40))
def test_ratios_against_all_pairs(seed):
    rng = random.Random(seed)
    tags = ["div", "p", "ul", "li", "article", "section", "nav", "form", "a", "b", "main", "div class='market share'",
            "div class=ad", "div id=comments", "h1"]
    page, opened = [], []
    for _ in range(rng.randrange(5, 120)):
        act = rng.random()
        if act < 0.45:
            opened.append(rng.choice(tags))
            page.append(f"<{opened[-1]}>")
        elif act < 0.7 and opened:
            page.append(f"</{opened.pop().split()[0]}>")
        else:
            page.append(" ".join(rng.choices(["one", "two,", "three.", "four!"], k=rng.randrange(1, 40))))
    reader = html_text.read_page("".join(page))
    for threshold in (0.05, 0.15, 0.6):
        values, limit = brute_paths(reader.root, threshold)
        kept = html_text.content_paths(reader.root, threshold)
        assert kept <= set(values)
        for p, v in values.items():
            assert (p in kept) == (v >= limit) or v == pytest.approx(limit, rel=1e-9)


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + "deep text", "<div>x " * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000 + "y", "<b>x" * 50_000 + "</i>" * 50_000,
    "<p><b>x" * 50_000, "<article><div class=ad>x" * 25_000])
def test_deep_pages_take_linear_time(page):
    start = time.time()
    assert html_text.main_text(page)
    assert time.time() - start < 20
