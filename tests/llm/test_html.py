"""Main text of pages whose parts are known."""

import random

from tidewatch.llm import html_text

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]


def sentence(n=12):
    return " ".join(RNG.choices(WORDS, k=n))


def page(host, i, kind):
    title, parts = f"Title {i} &amp; more", [f"{sentence()} &lt;{i}&gt;" for _ in range(RNG.randint(1, 4))]
    wanted = " ".join([f"Title {i} & more", *(p.replace("&lt;", "<").replace("&gt;", ">") for p in parts)])
    promo = f"<p>All articles of {host} are free to read.</p>"
    around = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>"
        f"<header><h1>{host}</h1></header><nav><ul><li><a href=x>{sentence(1)}<li>{sentence(2)}</ul></nav><!-- x <p>no</p> -->"
        f"<div class='cookie-notice'>{sentence()}</div><div id=ad>{sentence()}</div>"
    )
    after = (
        f"<aside>{sentence()}</aside><form>{sentence()}<input><button>go</button></form><section class=comments><p>{sentence(60)}</p></section>"
        f"<footer>&copy; {host}</footer></body></html>"
    )
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p[: len(p) // 2]}<b>{p[len(p) // 2 :]}</b>\n" for p in parts)
    if kind == "article":
        return around + f"<article>{body}<div class=share>{sentence()}</div><p hidden>no</article>" + after, wanted
    return around + f"<div class=story>{body}</p>{promo}</div>" + after, wanted


def test_pages(spark):
    rows, wanted = [], []
    for host, kind, n in (("a.example", "article", 150), ("b.example", "div", 90)):
        for i in range(n):
            source, text = page(host, i, kind)
            rows.append((len(rows), f"https://user@{host}:80/p/{i}", source))
            wanted.append((rows[-1][0], text))
    odd = [
        (900, None, None, ""), (901, "", "", ""), (902, "//x", "just \n text &eacute;", "just text é"),
        (903, "no url", "<div><p>one<p>two <br>three<", "one two three<"), (None, "http://c/", "<article><p>x</p></article>", "x"),
        (904, "http://d/", "<div>" * 3000 + "deep" + "</div>" * 10, "deep"), (904, "http://d/", "<p " + "a" * 50, ""),
    ]
    rows += [r[:3] for r in odd]
    wanted += [(r[0], r[3]) for r in odd]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    out = html_text.main_texts(pages).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.page_id, r.text) for r in out], key=key) == sorted(wanted, key=key)
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template():
    source = page("a", 1, "div")[0]
    trees = [html_text.parse(source) for _ in range(6)]
    template, slots = html_text.template_of(trees)
    assert not any(template)
    assert "Title 1" in html_text.article_text(trees[0], template[0], slots[0])


def test_matching_keeps_order():
    a = html_text.parse("<ul><li>1<li>2<li>3</ul><p>x")
    b = html_text.parse("<p>y</p><ul><li>2<li>3</ul><p>z")
    size, pairs = html_text.match_trees(a, b)
    assert size == 5
    assert [(x.tag, x.text, y.text) for x, y in pairs if x.tag == "p"] == [("p", "x", "z")]


def test_long_pages_with_a_constant_block_at_the_end():
    """Stories of very different lengths, aligned with the longest; the promo paragraph after them is template on all."""
    promo = "<p>All articles of this host are free to read.</p>"
    stories = [[sentence() for _ in range(n)] for n in (300, 60, 61, 75, 120, 299, 12, 40)]
    made = [f"<title>{i}</title><div class=story>" + "".join(f"<p>{p}{'<ul><li>x</ul>' * (k % 7 == i)}" for k, p in enumerate(s)) + f"{promo}</div>" for i, s in enumerate(stories)]
    trees = [html_text.parse(m) for m in made]
    template, slots = html_text.template_of(trees)
    for tree, fixed, slot, story in zip(trees, template, slots, stories, strict=True):
        text = html_text.article_text(tree, fixed, slot)
        assert story[0] in text and story[-1] in text
        assert "free to read" not in text


def test_large_lists_match_as_small_ones_do(monkeypatch):
    rng = random.Random(2)
    kinds = ["<p>x</p>", "<p><b>x</b></p>", "<ul><li>x</ul>", "<ul><li>x<li>y</ul>", "<h2>x</h2>", "<div><p>x</p><h2>x</h2></div>"]
    for _ in range(20):
        a, b = (html_text.parse("".join(rng.choices(kinds, k=rng.randint(1, 40)))) for _ in range(2))
        found = []
        for many in (10**9, 1):
            monkeypatch.setattr(html_text, "MANY_PAIRS", many)
            size, pairs = html_text.match_trees(a, b)
            assert size == len(pairs)
            found.append([(id(x), id(y)) for x, y in pairs])
        assert found[0] == found[1]


def test_names_do_not_drop_stories():
    story = "".join(f"<p>{sentence()}</p>" for _ in range(6))
    kept = {
        "compound": f"<div class='entry-content has-share-buttons'>{story}</div>",
        "page": f"<div id=main-menu-page>{story}</div>",
        "layout": f"<div class=sidebar>{story}</div>",
        "paragraph": f"<div><p class='notice-of-motion'>The motion passed.</p>{story}</div>",
    }
    dropped = "<div class='cookie-notice'>We use cookies.</div><div class='site-footer'>About</div><ul class=menu><li><a href=x>All of it</a></ul>"
    for name, source in kept.items():
        page = html_text.parse(f"<body>{dropped}{source}<div class=comments><p>{sentence(40)}</p></div></body>")
        text = html_text.article_text(page, set(), None)
        wanted = html_text.parse(source).text
        assert text == wanted, name


def test_deep_pages_are_matched_at_every_level():
    """A constant promo paragraph is template however deep the story lies; pages of very different depth match too."""
    for depth in (10, 58, 62, 70, 900):
        made = [
            f"<title>{i}</title>" + "<div>" * depth + f"<p>{sentence()}</p>{'<ul><li>x</ul>' * (i % 3)}<p>All articles are free.</p>" + "</div>" * depth for i in range(8)
        ]
        trees = [html_text.parse(m) for m in made]
        template, slots = html_text.template_of(trees)
        for tree, fixed, slot in zip(trees, template, slots, strict=True):
            assert "free" not in html_text.article_text(tree, fixed, slot), depth
    a, b = (html_text.parse("<div>" * n + "<p>x</p>" + "<i>y</i>" * k) for n, k in ((20000, 1), (15000, 2)))
    assert html_text.match_trees(a, b)[0] == 15001
