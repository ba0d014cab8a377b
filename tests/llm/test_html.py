"""The wrapper of a host decides what its pages' text is."""

import random

from netvigil.llm import html

SCHEMA = "page_id long, url string, html string"


def _texts(spark, pages):
    rows = [(k, "http://a.example/%d" % k, page) for k, page in enumerate(pages)]
    return [r.text for r in sorted(html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)]


def _story(k):
    return [f"Head of page {k}", f"The first part of story {k} tells what came about.", f"Part two of story {k} is as long as the first one was.", f"A last word on {k}."]


def test_names_that_tell_nothing(spark):
    """Two sibling sections both stay; constants and links go, a constant heading amid the text stays."""
    pages, want = [], []
    for k in range(6):
        head, one, two, last = _story(k)
        links = "".join(f"<li><a href=x>Link {k} {j} to another page</a></li>" for j in range(5))
        extra = f"<div class=q><p>{last}</p></div>" if k % 2 else ""
        pages.append(
            f"<html><body><div class=z1><p>We use small files on your machine to count visits to this site, and more of that.</p></div><div class=z2><ul>{links}</ul></div>"
            f"<div class=z3><h1>{head}</h1><div class=z4><p>{one}</p></div><div class=z4b><h2>Background</h2><p>{two}</p></div></div>{extra}<div class=z5>All rights kept by the owner.</div></body></html>"
        )
        want.append("\n".join([head, one, "Background", two] + [last] * (k % 2)))
    got = _texts(spark, pages)
    assert got == want
    alone = html.read_page(pages[0])
    by_page = html.marks_alone(alone)
    kept = "\n".join(t for s, t, _ in alone.blocks if by_page[s] == "1")
    assert "small files" in kept and "small files" not in got[0]  # a page by itself can't know


def test_box_inside_an_article(spark):
    """A box with the same texts on page after page is a notice; a copied article and a constant paragraph beside others stay."""
    pages = [f"<article><h1>{h}</h1><p>{a}</p><div class=k7><p>Join our circle of readers.</p></div><p>{b}</p></article>" for h, a, b, _ in map(_story, range(6))]
    want = ["\n".join(_story(k)[:3]) for k in range(6)]
    assert _texts(spark, pages) == want
    assert "Join our circle" in _texts(spark, pages[:1])[0]  # one page knows no constants
    copies = [pages[0].replace("k7", "k8")] * 5
    assert all("Join our circle" in t for t in _texts(spark, copies))
    near = [f"<article><h1>Issue {k}</h1><div class=body><p>{_story(0)[1]}</p><p>{_story(0)[2]}</p></div></article>" for k in range(6)]
    assert _texts(spark, near) == [f"Issue {k}\n{_story(0)[1]}\n{_story(0)[2]}" for k in range(6)]


def test_pages_of_another_kind(spark):
    """A page without a main container keeps its text on a host that has them elsewhere."""
    pages = [f"<body><main><h1>{h}</h1><p>{a}</p></main></body>" for h, a, _, _ in map(_story, range(4))]
    pages += [f"<body><div class=u1><dl><dd>{b}</dd></dl></div></body>" for _, _, b, _ in map(_story, range(4, 7))]
    got = _texts(spark, pages)
    assert got[:4] == ["\n".join(_story(k)[:2]) for k in range(4)]
    assert got[4:] == [_story(k)[2] for k in range(4, 7)]


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_wrapper_covers_its_pages():
    """By plain quadratic alignment, every stream lies within the wrapper of its host."""
    rng = random.Random(3)
    for _ in range(40):
        parts = [f"<{t}.c{k} #{s} /{t}".split() for k, (t, s) in enumerate(zip(rng.choices(["div", "section"], k=6), rng.choices("ph", k=6), strict=True))]
        shapes = [["<body", *[x for p in parts if rng.random() < 0.7 for x in p], "/body"] for _ in range(8)]
        wrapper = shapes[0]
        for shape in shapes[1:]:
            wrapper = html.align(wrapper, shape)
        for shape in shapes:
            bare = html._bare(wrapper)
            assert _longest_common(bare, shape) == len(shape)
            at = html.places_in(wrapper, shape)
            found = [p for p in at if p >= 0]
            assert found == sorted(set(found)) and len(at) == sum(t[0] == "#" for t in shape)


def test_odd_pages(spark):
    rows = [(1, None, None, 9), (1, None, None, 9), (2, "http://b.example/1", "", 9), (3, "http://b.example/2", "<p>" + "word " * 200_000, 9), (None, "http://b.example/3", "<main><p>x &amp; y</p></main>", 9)]
    got = html.extract_text(spark.createDataFrame(rows, SCHEMA + ", text int")).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 5), (1, 0), (1, 0), (2, 0), (3, 999_999)]
    assert html.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


HARD = {
    '<div class="layout with-sidebar"><article><p>Whole article text.</p></article></div>': "Whole article text.",
    '<div id="page" class="has-banner"><main><p>Main text.</p></main></div>': "Main text.",
    '<div id="page" class="overlay search"><main><p>Main text.</p></main></div>': "Main text.",
    '<form id="all"><main><p>A page in a form.</p></main></form>': "A page in a form.",
    '<article><section class="login-tutorial"><p>a</p></section><div class="menu-planning"><p>b</p></div><div class="ad-hoc-networks">c</div><div class="comment-on-policy">d</div><div id="social-history">e</div></article>': "a\nb\nc\nd\ne",
    '<main><p>The story.</p></main><article class="comment"><p>A reader.</p></article>': "The story.",
    '<main><p>A long story.</p></main><div class="related"><article><p>Card.</p></article></div>': "A long story.",
    '<article><p>Text.</p><div class="ad-slot-3">Buy.</div><div class="share-buttons">Share.</div><section class="comments"><article><p>A reader.</p></article></section></article>': "Text.",
    '<article><p>So <math><mi>y</mi><mo>=</mo><mn>2</mn></math></p><menu><li>An item.</li></menu><button>Press</button></article>': "So y=2\nAn item.",
    "<article><p class=a\">One.</p><img alt=it's src=x><p title='a>b' id=\"c>d\">Two &gt; 1 < 3</p></article>": "One.\nTwo > 1 < 3",
    '<div class="has-banner"><p>A page without a main container.</p></div>': "A page without a main container.",
}


def test_names_that_only_sound_like_boxes(spark):
    """Each page is a host of its own, so its names and links alone decide."""
    rows = [(k, f"http://h{k}.example/", page) for k, page in enumerate(HARD)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(len(HARD))] == list(HARD.values())


def test_random_pages_by_a_plain_extractor(spark):
    """Pages of known blocks: article parts under misleading names stay, boxes go, whatever stands around the article."""
    rng = random.Random(12)
    layouts = ["with-sidebar", "has-banner", "no-header page", "x1", "search-results-page wide", "overlay"]
    inner = ["ad-hoc-notes", "menu-history", "comment-on-law", "login-guide", "social-life", "q7", "banner-year"]
    boxes = ["ad", "share-bar", "related-posts", "newsletter", "comments", "cookie-notice", "widget"]
    rows, want = [], {}
    for k in range(60):
        parts, own = [], []
        for j in range(rng.randint(2, 6)):
            text = f"Part {j} of story {k} says {rng.random()}."
            if rng.random() < 0.3:
                parts.append(f'<div class="{rng.choice(boxes)}"><p>Box {text}</p></div>')
            else:
                own.append(text)
                quote = rng.choice(["", ' class=a"', " title=it's", " data-x='<b>'"])
                parts.append(f'<section class="{rng.choice(inner)}"><p{quote}>{text}</p></section>' if rng.random() < 0.5 else f"<p{quote}>{text}</p>")
        around = [f'<div class="{rng.choice(layouts)}">', f'<div id="{rng.choice(layouts)}" class="c">']
        page = f"<html><body><nav><a href=x>Home</a></nav>{''.join(around)}<{(tag := rng.choice(['article', 'main']))}>{''.join(parts)}</{tag}></div></div><footer>End</footer></body></html>"
        rows.append((k, f"http://r{k % 7}.example/{k}", page))
        want[k] = "\n".join(own)
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in want if got[k] != want[k]] == []


def test_query_counts_code_points(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example/", "<main><p>日本 &amp; é</p></main>"), (2, None, None)], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in html.op3_extract(spark, str(tmp_path)).collect()) == [(1, "http://a.example/", "日本 & é", 6), (2, None, "", 0)]
