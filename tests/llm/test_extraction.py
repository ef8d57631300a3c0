import html.parser
import random
import time

from memlake.llm import extraction as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site"><p>Header words</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">Buy this now, it is very good and very long to read indeed.</div>
<div class="cookie-notice">We use cookies on this page and want your consent to do so.</div>
<article class="post-17"><h1>Title &amp; more</h1><p><b>First   one.<br><p>Second&nbsp;one, a &lt; b.</p><ul><li>item one<li>item two</ul>
<form><p>Sign up here</p></form><aside>Side words</aside></article>
<div id="comments"><p>A reader says a long thing about the article, far too long to be of use.</p></div>
<footer>&copy; words</footer></body></html>"""


def test_one_page():
    assert X.main_text(PAGE, []) == "Title & more\n\nFirst one.\n\nSecond one, a < b.\n\nitem one\n\nitem two"


def test_paths_are_generalised():
    assert X.best(X.blocks(PAGE))[0] == "body>article.post-#"
    page = X.Page(PAGE)
    assert page.number("body>article.post-#") == page.article()[0] and page.number("body>div.none") is None


def test_odd_markup():
    assert X.main_text("", []) == ""
    assert X.main_text("plain words only", []) == "plain words only"
    assert X.main_text("<div><p>a<p>b <!-- x > y -->c</div>tail", []) == "a\n\nb c" or X.main_text("<div><p>a<p>b <!-- x > y -->c</div>tail", []).startswith("a\n\nb c")
    assert X.main_text("<article><p title='a > b'>kept</p><script>never ends", []) == "kept"
    assert X.main_text("<article><p>5 < 6 and 7 > 3</p></article>", []) == "5 < 6 and 7 > 3"
    assert X.main_text("<article><p>" + "long words " * 50000 + "</p></article>", []) == ("long words " * 50000).strip()


LEAD, BODY, SHORT = "lead words " * 30, "body words " * 70, "a short paragraph beside a long quote, and some more of it here. "


def texts_of(*parts):
    return "\n\n".join(" ".join(p.split()) for p in parts)


def nested(inner):
    return f'<body><nav><a href="/">home</a></nav><div class="top">Site name</div>{inner}<div class="more"><a href="/b">another page of ours</a> <a href="/c">a third page of ours</a></div><footer>end</footer></body>'


NESTED = [
    (f"<article><h1>T</h1><div class=intro>{LEAD}</div><div class=body>{BODY}</div></article>", texts_of("T", LEAD, BODY)),
    (f"<div class=post><h1>T</h1><div class=lead><p>{LEAD}</p></div><div class=text><div class=in><p>{BODY}</p></div></div></div>", texts_of("T", LEAD, BODY)),
    (f"<article><h1>T</h1><p>{SHORT}</p><blockquote>{BODY}</blockquote><p>{SHORT}</p></article>", texts_of("T", SHORT, BODY, SHORT)),
    (f"<div class=post><p>{SHORT}</p><figure><p>{BODY}</p></figure><p>{SHORT}</p></div>", texts_of(SHORT, BODY, SHORT)),
    (f"<article><p>{SHORT}</p><table><tr><td>{BODY}<td>{LEAD}</table><p>{SHORT}</p></article>", texts_of(SHORT, BODY, LEAD, SHORT)),
    (f"<div class=a><p>{BODY}</p></div>", texts_of(BODY)),
]


def test_articles_keep_their_parts(spark):
    for inner, want in NESTED:
        assert X.main_text(nested(inner), []) == want, inner
    rows = [(10 * k + i, f"https://h{k}.example.org/{i}", nested(inner)) for k, (inner, _) in enumerate(NESTED) for i in range(4)]
    got = X.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == NESTED[r.page_id // 10][1] for r in got) and len(got) == len(rows)
    inner, want = NESTED[0]
    assert X.main_text(nested(inner), ["body>article>div.body"]) == want


ARTICLE = f"<h1>Title</h1><p>{BODY}</p><p>{LEAD}</p>"
WANT = texts_of("Title", BODY, LEAD)
COMMENTS = f'<div id="comments"><h3>Replies</h3><article class="comment"><p>{"a reader says much " * 80}</p></article></div>'


def test_marked_wrappers_keep_their_article():
    for wrapped in (
        f'<div class="layout has-sidebar"><article>{ARTICLE}</article><div class="sidebar"><p>{SHORT}</p></div></div>',
        f'<div class="layout has-sidebar"><article>{ARTICLE}</article></div>{COMMENTS}',
        f'<div id="search-results-page"><div class="text">{ARTICLE}</div></div>',
        f'<form id="aspnetForm"><div class="text">{ARTICLE}</div></form>',
        f'<form id="aspnetForm"><div class="has-footer"><div class="text">{ARTICLE}</div><div class="footer"><p>{SHORT}</p></div></div></form>',
        f'<div class="page with-comments"><main>{ARTICLE}</main>{COMMENTS}</div>',
        f"<article><header><p>by a writer</p><h1>Title</h1></header><p>{BODY}</p><p>{LEAD}</p></article>",
        f'<article><h1 class="entry-header">Title</h1><p>{BODY}</p><p>{LEAD}</p></article>',
        f'<article><div class="entry-header"><span>by a writer</span><h1>Title</h1></div><p>{BODY}</p><p>{LEAD}</p></article>',
    ):
        assert X.main_text(nested(wrapped), []) == WANT, wrapped[:80]


def test_marked_parts_go():
    for part in (COMMENTS, f'<p class="comment">{SHORT}</p>', f'<div class="ad-slot"><p>{SHORT * 3}</p></div>', f'<div class="newsletter-box">{SHORT}</div>', f"<form><p>{SHORT}</p></form>", f'<section class="related-posts"><p>{SHORT}</p></section>'):
        assert X.main_text(nested(f"<article>{ARTICLE}{part}</article>"), []) == WANT, part[:60]


def test_compound_names_are_hints_only():
    """Sections on a topic whose name has a mark in it stay; what steers or sells goes, whatever stands around it."""
    prose = "This section has something to say about its topic, and says it at some length. "
    for name in ('section id="search-algorithms"', 'section id="form-factor"', 'section class="related-work"', 'div id="menu-planning"', 'div class="notice-periods"', 'section id="share-prices"', 'section id="cookie-recipes"', 'div class="header-files"'):
        tag = name.split()[0]
        for head in ("", "<h2>A topic</h2>"):
            part = f"<{name}>{head}<p>{prose * 2}</p><p>{prose * 3}</p></{tag}>"
            want = texts_of("Title", BODY, LEAD, *(["A topic"] if head else []), prose * 2, prose * 3)
            assert X.main_text(nested(f"<article>{ARTICLE}{part}</article>"), []) == want, part[:60]
            assert X.main_text(nested(f"<main>{ARTICLE}{part}</main>"), []) == want, part[:60]
    links = '<a href="/x">another page that is named at some length and is long enough to be a block of prose</a>'
    for part in (
        f'<div class="search-results">{links}{links}</div>', f'<section id="menu-links"><ul><li>{links}</ul></section>', '<div class="share-buttons"><p>Tell others</p></div>',
        f'<div class="comment-list"><h3>Replies</h3><p>{prose * 9}</p></div>', f'<section id="reader-comments"><p>{prose * 9}</p></section>', f'<div class="cookie-notice"><p>{prose}</p></div>',
        f'<div class="ad"><p>{prose * 9}</p></div>', f'<form class="search-form"><p>{prose}</p></form>', f'<section class="related-posts"><h2>More</h2><p>{prose}</p></section>',
    ):
        assert X.main_text(nested(f"<article>{ARTICLE}{part}</article>"), []) == WANT, part[:60]


def test_deep_and_odd_pages_take_linear_time():
    began = time.process_time()
    deep = "<div>" * 20_000 + f"<p>{BODY}</p>" + "</div>" * 20_000
    assert X.main_text(deep, []) == texts_of(BODY)
    assert X.main_text("<div>x" * 20_000, []).startswith("x")
    assert X.main_text("<a " * 200_000, []) == ("<a " * 200_000).strip()
    assert X.main_text('<div class="sidebar">' * 20_000 + "words", []) in ("", "words")
    assert X.main_text("<p>a<table><tr><td>" * 5000, []) is not None
    assert time.process_time() - began < 20


class Plain(html.parser.HTMLParser):
    """A slow reader of tidy pages: each piece of text with the open elements around it."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            while "p" in self.open:
                self.open.pop()
        if tag == "br":
            self.found.append(([*self.open], " "))
        if tag not in ("br", "meta", "img", "link", "hr"):
            self.open.append(tag)
            self.found.append(([*self.open], None))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.found.append(([*self.open], None))

    def handle_data(self, text):
        self.found.append(([*self.open], text))


def test_bundled_pages_beside_a_plain_reader(spark):
    """Every page of the bundled table against a reader that knows its articles' element and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {}
    for r in pages.collect():
        blocks, now = [], ""
        for around, text in Plain(r.html).found:
            if text is None and around[-1:] and around[-1] in ("b", "i", "a", "span", "em"):
                continue
            if text is None:
                blocks.append(now)
                now = ""
            elif "article" in around and not {"nav", "aside", "footer", "form", "script", "style"} & set(around):
                now += text
        wanted[r.page_id] = "\n\n".join(" ".join(b.split()) for b in [*blocks, now] if b.strip())
    got = {r.page_id: r.text for r in X.extract_text(pages).collect()}
    assert got.keys() == wanted.keys()
    differ = [k for k in got if got[k] != wanted[k]]
    assert not differ, (len(differ), got[differ[0]][:300], wanted[differ[0]][:300])


def page(i, rng, kind):
    body = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 8))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    main = {"article": f'<article class="n{i}">{paragraphs}</article>', "div": f'<div class="wrap"><div class="content"><div class="text{i}">{paragraphs}</div></div></div>', "table": f"<table><tr><td class=main>{paragraphs}</td></tr></table>"}[kind]
    return f'<body><nav><a href="/">home</a></nav>{main}<div class="side-bar promo"><p>{"buy " * 60}</p></div><footer>end</footer></body>', "\n\n".join(body)


def test_hosts_with_templates(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(90):
        kind = ("article", "div", "table")[i % 3]
        html, want[i] = page(i, rng, kind)
        rows.append((i, f"https://{kind}.example.org/{i}", html, "clash"))
    rows += [(900, None, None, ""), (901, "not a url", "", ""), (None, "https://article.example.org/x", rows[0][2], ""), (0, rows[0][1], rows[0][2], "")]
    got = X.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 900} == want
    assert {r.text for r in got if r.page_id in (900, 901)} == {""}


def test_salted_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "https://a.example.org/", page(i, rng, "div")[0]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    small = sorted(map(tuple, X.extract_text(df).collect()))
    monkeypatch.setattr("memlake.llm.common.BROADCAST_BYTES", -1)
    assert sorted(map(tuple, X.extract_text(df).collect())) == small


def test_empty_table(spark):
    assert X.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
