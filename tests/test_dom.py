import random

import pytest

from pagelake.functions.url_join import host, normalise, parse_url, resolve
from pagelake.operators import selectors as sel
from pagelake.operators.css import SelectorError, compile_css, compile_xpath
from pagelake.operators.dom import Document, Node, outer_html


def html(text):
    return outer_html(Document(text).root)


def test_implied_and_void_elements():
    assert html("<title>A &amp; B</title>x<br>y") == "<html><head><title>A &amp; B</title></head><body>x<br>y</body></html>"
    assert html("") == html("<html>") == html("<body>")


def test_automatic_closing():
    assert "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>" in html("<ul><li>a<li>b<ul><li>c</ul></ul>")
    assert "<tbody><tr><td>1</td><td>2</td></tr><tr><th>x</th></tr></tbody>" in html("<table><tr><td>1<td>2<tr><th>x</table>")
    assert "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>" in html("<dl><dt>a<dd>b<dt>c</dl>")
    assert "<select><option>1</option><option>2</option></select>" in html("<select><option>1<option>2</select>")
    assert "<p>a</p><div>b</div>" in html("<p>a<div>b</div>")
    assert "<h1>a</h1><h2>b</h2>" in html("<h1>a<h2>b</h2>")


def test_formatting_reopens_in_the_next_paragraph():
    assert "<p><b>x<br></b></p><p><b>y</b></p>" in html("<p><b>x<br><p>y")


def test_raw_text_and_entities_once():
    assert '<script>var t="</p>";</script><p>z</p>' in html('<body><script>var t="</p>";</script><p>z')
    assert Document("<p>&amp;amp; &copy &notit;").first("p").joined() == "&amp; © ¬it;"
    assert Document('<a href="?a=1&copy=2&lt;">').first("a").attrs["href"] == "?a=1&copy=2<"
    assert Document("<noscript><iframe src=x></iframe></noscript>").select("iframe") == []


def test_stray_ends_and_comments():
    d = Document("<!-- a --><p>x</i></p></div><!-- b -->")
    assert d.comments == 2 and d.first("p").joined() == "x"


@pytest.mark.parametrize("seed", range(40))
def test_serialised_trees_parse_to_themselves(seed):
    rng = random.Random(seed)

    def tree(depth):
        n = Node(rng.choice(["div", "section", "span", "em"]) if depth else "div", {"id": str(rng.randrange(9))} if rng.random() < 0.4 else {})
        for _ in range(rng.randint(0, 3) if depth < 5 else 0):
            if rng.random() < 0.4 and (not n.children or n.children[-1].tag is not None):
                n.add(Node(None, text=rng.choice(["a<b", "x & y", 'q"', "é"])))
            elif n.tag in ("div", "section"):
                n.add(tree(depth + 1))
            elif rng.random() < 0.5:
                n.add(Node("br", {}))
        return n

    text = outer_html(tree(0))
    d = Document(text)
    assert "".join(outer_html(c) for c in d.body.children) == text
    assert all(n.id < c.id <= n.end for n in d.all for c in n.children)


def test_css():
    d = Document("<div class='x y' id=q data-a='one two'><p>1<p class=z>2</div><ul><li>a<li>b<li>c</ul><a href='/x.rss'>l</a>")
    texts = lambda css: [n.joined() for n in d.select(css)]
    assert texts("div.x > p.z") == ["2"] and texts("#q p") == ["1", "2"] and texts("li:first-child, li:last-child") == ["a", "c"]
    assert texts("[data-a~=two] p") == ["1", "2"] and texts("a[href$='.rss']") == ["l"] and texts("a[href^=\"/x\"], p[class]") == ["2", "l"]
    assert texts("*[data-a*='ne t'] .z") == ["2"] and texts("div.nope, ul > li") == ["a", "b", "c"]
    for bad in ("", "a[", "..x", "p:hover"):
        with pytest.raises(SelectorError):
            compile_css(bad)
        assert sel.try_compile(bad) is None
    assert sel.child("ul", "li") == "ul > li" and sel.meta_property("og:title") == 'meta[property="og:title"]'
    assert sel.multi(sel.class_("a"), sel.id_("b"), sel.attr("c"), sel.attr_contains("d", "e")) == '.a, #b, [c], [d*="e"]'
    assert sel.headings().count(",") == 5 and sel.descendant("a", "b") == "a b" and sel.link_rel("x") == 'link[rel="x"]'
    assert sel.attr_starts_with("a", "b") == '[a^="b"]' and sel.meta_name("n") == 'meta[name="n"]'


def test_xpath():
    d = Document("<div class=c><a href=/1>x</a><p><a href=/2 rel=n>y</a></p></div><a>z</a>")
    assert [v for _, _, v in d.xpath("//a/@href")] == ["/1", "/2"]
    assert [n.joined() for n in d.xpath("//div[@class='c']/a")] == ["x"]
    assert [n.joined() for n in d.xpath("//a[@rel]")] == ["y"] and d.xpath("//p/a/text()") == ["y"]
    assert [n.joined() for n in d.xpath("/html/body/a")] == ["z"]
    with pytest.raises(SelectorError):
        compile_xpath("count(//a)")


BASE = parse_url("HTTP://Www.Ex.com:80/a/b/c?q#f")


@pytest.mark.parametrize(
    "href,want",
    [
        ("/für,", "http://www.ex.com/f%C3%BCr,"), ("../x y", "http://www.ex.com/a/x%20y"), ("?z", "http://www.ex.com/a/b/c?z"),
        ("#k", "http://www.ex.com/a/b/c?q#k"), ("//h.com/p", "http://h.com/p"), ("mailto:x", "mailto:x"), ("d/./e/..", "http://www.ex.com/a/b/d/"),
        ("\\foo", "http://www.ex.com/foo"), ("", None), ("https://É.com", "https://xn--9ca.com/"), ("http://h:443/%7e", "http://h:443/%7e"),
        ("HTTPS://H.com:443", "https://h.com/"), ("../../../..", "http://www.ex.com/"),
    ],
)
def test_resolve(href, want):
    assert resolve(href, BASE) == want


def test_resolve_choices():
    assert resolve("http://A.com", None, verbatim_absolute=True) == "http://A.com" and resolve("http://A.com", None) == "http://a.com/"
    assert resolve("x", None) is None and resolve("x", None, without_base="verbatim") == "x"
    assert resolve("//h/p", BASE, slashes="https") == "https://h/p" and resolve("data:x", BASE, keep_data=True) == "data:x"
    assert resolve("tel:1", BASE, http_only=True) is None and resolve("#x", BASE, skip=("#",)) is None
    assert normalise("HTTP://h:80/a#f") == "http://h/a" and normalise("mailto:x") == "mailto:x" and normalise("no") is None
    assert host("https://u:p@H.com:8/x") == "h.com" and parse_url("http://") is None and parse_url("http://h:99999") is None


HOSTILE = {
    "attributes of an unclosed tag": "<p>a</p><a " + " ".join(f'x{k}="{k}"' for k in range(10_000)), "unclosed tags": "<p>a</p>" + "<a " * 100_000,
    "formatting": "<p>a</p>" + "<p><b>" * 10_000, "declarations": "<p>a</p>" + "<!x" * 100_000, "open quotes": "<p>a</p>" + '<a x="' * 50_001, "equals": "<p>a</p><a " + "=" * 100_000,
    "raw ends": "<p>a</p><script>" + "</script " * 50_000, "many attributes": "<p>a</p><a " + " ".join(f'x{k}="{k}"' for k in range(10_000)) + ">z</a>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    import time

    began = time.process_time()
    d = Document(HOSTILE[name])
    assert time.process_time() - began < 1 and d.first("p").joined() == "a"


def test_depth_is_bounded():
    d = Document("<div>" * 5_000 + "x")
    assert len(d.by_tag["div"]) == 5_000 and len(outer_html(d.root)) > 5_000
    assert max(sum(1 for _ in n.ancestors()) for n in d.all) <= 512


def test_at_most_three_equal_formatting_elements_reopen():
    body = html("<p><b><b><b><b><b>x<p>y")
    assert "<p><b><b><b>y</b></b></b></p>" in body
    assert "<p><b id=\"1\"><b id=\"2\"><b id=\"3\"><b id=\"4\">y" in html("".join(["<p>", *(f"<b id={k}>" for k in range(1, 5)), "x<p>y"]))


def test_quoted_ends_and_unfinished_tags():
    assert Document('<a title="x > y" href=/z>t</a>').first("a").attrs == {"title": "x > y", "href": "/z"}
    assert Document('<a "odd>t</a>').first("a").joined() == "t"
    assert html("<p>a<a href=") == html("<p>a") == html('<p>a<b title="never ends>x</b>')
    assert html("a</>b</ x>c<!never") == "<html><head></head><body>abc<!--never--></body></html>"
