"""Main text of pages whose elements end late, never, or at once."""

import random
import re

import numpy as np
import pytest

from trackweave.llm import extract

TEXT = "The first paragraph is long enough, and has words. It goes on for a while."
ARTICLE = f"<article><h1>A title</h1><p>{TEXT}</p></article>"
BEFORE = [
    '<svg class="icon"/>', '<svg><path d="M0"/><title/></svg>', "<math/>", "<div><button>Menu</div>", "<div><object data='x'></div>", "<button>Menu",
    "<object data='x'>", "<select><option>One<option>Two</select>", "<noscript><p>No script.</p></noscript>", "<script>var a = '<p>';</script>", "<div><iframe src='x'></div>",
]


@pytest.mark.parametrize("before", BEFORE)
def test_article_after_embedded_element(before):
    for end in ("", "<div><svg></svg><button>Go</button></div>"):
        if end and before in ("<button>Menu",):
            continue  # there the button does end, behind the article
        assert extract.main_text(f"<html><body>{before}{ARTICLE}{end}</body></html>", extract.fit([], [])) == f"A title\n{TEXT}"


@pytest.mark.parametrize("page", [
    '<body class="single has-sidebar">{}</body>', '<body class="home widget">{}</body>', '<div class="content with-sidebar">{}</div>', '<div id="page" class="widget">{}</div>',
])
def test_names_around_the_article(page):
    assert extract.main_text(page.format(ARTICLE), extract.fit([], [])) == f"A title\n{TEXT}"


@pytest.mark.parametrize("name", ["post comments-open", "post related", "share"])
def test_names_on_the_article(name):
    page = ARTICLE.replace("<article>", f'<article class="{name}">')
    assert extract.main_text(page, extract.fit([], [])) == f"A title\n{TEXT}"


def test_name_is_outweighed_by_the_text_only():
    long = " ".join([TEXT] * 6)
    page = f'<div class="widget"><p>{long}</p><p>{long}</p></div><div class="share">Share this</div><aside><p>{long}</p></aside>'
    assert extract.main_text(page, extract.fit([], [])) == f"{long}\n{long}"


def test_the_cut_decides_where_no_name_tells_a_role(spark, sf_dir):
    """Given pages without names of roles and kinds of elements, and with blocks that look like the other label: the cut mends more labels than it spoils."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").select("html").collect() if r.html]
    rng = random.Random(3)

    def noisy(page):
        cut = page.find("<article")
        head, body = page[:cut], page[cut:]
        body = re.sub("</p>", lambda m: "</p>" + (f"<p>{rng.choice(['Yes', 'See below', 'Note 3', '1999'])}</p>" if rng.random() < 0.5 else ""), body)
        long = lambda m: "<li>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)) + ". More of it. And more.</li>" if rng.random() < 0.15 else m.group()
        return re.sub(r'<li><a href="[^"]*">[^<]*</a></li>', long, head) + body

    def bare(page):
        return re.sub(r'<div class="ad">', "<div>", re.sub(r"<(/?)(article|nav|footer|p|li|ul|h1)\b", r"<\1div", page))

    both = [(extract.blocks_of(p), extract.blocks_of(bare(p))) for p in map(noisy, pages)]
    both = [(named, blocks) for named, blocks in both if len(named) == len(blocks)]
    half = len(both) // 2
    truth = [[b.hint > 0 for b in named] for named, _ in both]
    weights = extract.fit(np.concatenate([extract.features(b) for _, b in both[:half]]), np.array(sum(truth[:half], []), float))
    alone = [(extract.features(b) @ weights > 0).tolist() for _, b in both[half:]]
    cut = [extract.label(b, weights) for _, b in both[half:]]
    want = sum(truth[half:], [])
    share = lambda labels: np.mean([a == b for a, b in zip(sum(labels, []), want)])
    assert share(cut) > share(alone) + 0.01 and share(cut) > 0.9
    assert sum(a != b for a, b in zip(sum(alone, []), sum(cut, []))) > 20
