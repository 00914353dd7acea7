from pagemill.functions import content, fields
from pagemill.functions.tree import parse, select

PAGE = """<html><head><title>News - Acme Co., Ltd.</title><meta charset="gbk"></head><body>
<nav class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/about/">About</a><ul><li><a href="/about/team">Team</a></li></ul></li></ul></nav>
<div class="breadcrumb"><a href="/">首页</a> > <a href="/news">News</a> > <span>Today</span></div>
<div class="article-content"><h1>A headline</h1><span class="pubtime">2024年3月5日 10:20</span><p>First <b>bold</b> paragraph that says something of some length, enough to be the content of this page.</p>
<p>Second paragraph with more words, so that the text is over one hundred characters for sure.</p><img data-src="pic.jpg" src="blank.gif" alt="Pic"><script>var a = "</p>";</script></div>
<div class="footer">Copyright 2024 电话：0451-12345678 ICP备123号</div></body></html>"""
URL = "https://www.acme.example/news/1.html"


def test_lenient_tree():
    root = parse('<p>a<p>b<b>c</i>d</p>e<br>f<script>x="</p>"</script><!-- n -->')
    assert root.text() == "a b c d e f"
    assert parse(None).text() == "" and parse("<").text() in ("", "<")
    assert parse("<div><img src='a&amp;b'>x &lt; y</div>").html() == '<div><img src="a&amp;b">x &lt; y</div>'


def test_deep_nesting_is_no_recursion():
    assert parse("<div>" * 5000 + "x").text() == "x"
    assert parse("<div>" * 5000 + "x").html().endswith("</div>")


def test_selectors():
    root = parse(PAGE)
    assert [e.text() for e in select(root, ".breadcrumb a")] == ["首页", "News"]
    assert select(root, "div.article-content > h1")[0].text() == "A headline"
    assert len(select(root, "img[data-src$=jpg], [class*=foot]")) == 2
    assert select(root, "p:nth-child(2)") == []


def test_fields():
    root = parse(PAGE)
    assert fields.heading(root) == fields.page_title(root) == "A headline"
    assert fields.charset(root) == "gbk"
    assert fields.publish_text(root) == "2024年3月5日 10:20"
    assert fields.crumbs(root) == ["News", "Today"]
    assert fields.crumb_levels(root) == ["News", "Today"]
    assert fields.menu_prefixes(root, URL) == [("About", "/about")]
    assert [m[3] for m in fields.menu_links(root, URL)] == [1, 1]
    assert (["About", "Team"], 2) in [(m[2], m[3]) for m in fields.menu_links(root, URL, nested=True)]
    assert fields.company(root, "www.acme.example") == "News"
    assert ("https://www.acme.example/about/team", "Team") in fields.links(root, URL)


def test_paging():
    html = '<input totalpage="3"><a tagname="/a/b-2.html">2</a><div class="page"><a onclick="go(\'x.html\')">x</a></div>'
    assert [u for u, _ in fields.paging(parse(html), URL)] == [f"https://www.acme.example/a/b-{i}.html" for i in (1, 2, 3)]
    assert fields.paging(parse(html.replace("totalpage", "t")), URL) == [("https://www.acme.example/news/x.html", "x")]


def test_images():
    root = parse(PAGE + "<div style=\"background:url('bg.png')\"></div>")
    count = content.rescue_images(root, URL)
    assert count["lazy_fixed"] == 1 and count["css_extracted"] == 1
    assert [i for i, _ in content.collect_images(root, URL)] == ["https://www.acme.example/news/pic.jpg", "https://www.acme.example/news/bg.png"]


def test_content_and_cleaning():
    main = content.main_content(parse(PAGE))
    assert "First" in main.text() and "Copyright" not in main.text()
    body = content.structured_body(PAGE, URL)
    assert "paragraph" in body and "ICP" not in body and "<a" not in body
    assert "breadcrumb" not in content.strip_navigation(PAGE, URL) and "headline" in content.strip_navigation(PAGE, URL)
    assert "Second paragraph" in content.clean_page(PAGE, URL)["text"]
    assert content.clean_page("", URL)["text"] == ""
    blocks = content.blocks(parse(PAGE))
    assert all(b["pre"] <= b["post"] for b in blocks)


def test_rules():
    assert content.rule_faults([("div.article-content", "content"), ("h1", "title")]) == []
    assert content.rule_faults([]) and content.rule_faults([("body", "remove")]) and content.rule_faults([("a{}", "content")]) and content.rule_faults([("a", "x")])
    got = content.extract_by_rules(PAGE, URL, [("div.article-content", "content"), ("h1", "title"), (".pubtime", "remove")])
    assert got["title"] == "A headline" and got["images"] == 1 and "2024" not in got["html"]


def test_main_content_by_measures():
    words = "some plain words of a story " * 12
    two = parse(f"<body><div id=head>x</div><div id=a class=news><p>{words}</p></div><div id=b><p>{words}</p><p>{words}</p></div><div id=c>short</div></body>")
    got = content.by_score(two)
    assert got.tag == "div" and [e.get("id") for e in got.elements() if e.get("id")] == ["b", "a"]
    nested = parse(f"<body><div id=o><div id=i class=content><p>{words}</p><p>{words}</p></div></div><p>end</p></body>")
    assert content.by_score(nested).get("id") == "o"
    article = parse(f"<body><article id=s><p>{words}</p></article>" + "<div><img src=a></div>" * 6 + "</body>")
    assert content.by_score(article).tag == "body"
    dense = parse("<body><div id=d><span>just some forty five characters of text, no more</span></div><div id=e>thirty one characters are here!</div>" + "<p>word</p>" * 40 + "</body>")
    assert content.by_score(dense).get("id") == "d"
    pictures = parse("<body>" + "<div class=g>" + "<img src=a>" * 2 + "</div>" * 1 + "<p>t</p>" * 30 + "</body>")
    assert content.by_score(pictures) is not None
    assert content.by_score(parse("<body><p>only</p></body>")).tag == "body"


def test_references_without_a_semicolon():
    page = '<title>a &amp; b&amp</title><a href="/x?a=1&amp;b=2&copy=3">&notin; &notit; &#65; &#65 ﷐</a><script>if (a &amp b) {}</script><!-- &amp -->'
    assert parse(page).text() == "a & b& ∉ ¬it; A A ﷐"
    root = parse(page, ended=True)
    assert root.text() == "a & b&amp ∉ &notit; A &#65 ﷐"
    assert root.first("a").get("href") == "/x?a=1&b=2&copy=3"
    assert root.first("script").children == ["if (a &amp b) {}"] and root.first("#comment").children == [" &amp "]
    assert parse(None, ended=True).text() == ""
