from pagelake.functions.url_join import parse_url
from pagelake.operators import contacts, content, feeds, fingerprint, forms, links, media, metadata, pagination, readability
from pagelake.operators.dom import Document

BASE = parse_url("https://site.example/blog/post?pages=7")


def test_title_falls_back():
    assert metadata.title(Document("<meta property=og:title content=' A '><title>B</title>")) == "A"
    assert metadata.title(Document("<meta name=twitter:title content=T><title>B</title>")) == "T"
    assert metadata.title(Document("<title> </title><h1>H</h1>")) == "H" and metadata.title(Document("x")) is None


def test_metadata_record():
    m = metadata.metadata(
        Document(
            "<html lang=de><meta http-equiv='Content-Type' content='text/html; Charset=utf-8'><base href=/b><meta name=keywords content='a, ,b'>"
            "<link rel='shortcut icon' href=i.ico><link rel=icon sizes='16x16 32x32' href=i32.png><link rel=apple-touch-icon href=t.png>"
            "<meta name=robots content='NOINDEX, max-image-preview:none, max-video-preview:x'><meta property=article:published_time content=2024>"
            "<meta name=x-custom content=1><meta property=og:locale:alternate content=fr>"
        ),
        BASE,
    )
    assert (m["language"], m["charset"], m["base_url"], m["keywords"]) == ("de", "utf-8", "/b", ["a", "b"])
    assert m["favicon"].endswith("/blog/i32.png") and m["apple_touch_icon"].endswith("/blog/t.png") and m["published_date"] == "2024"
    assert m["robots"]["index"] is False and m["robots"]["follow"] and m["robots"]["max_image_preview"] == "none" and m["robots"]["max_video_preview"] == -1
    assert m["custom"] == {"x-custom": "1"} and m["opengraph"]["extra"] == {"og:locale:alternate": "fr"}


def test_structured_data():
    d = Document(
        "<script type='application/ld+json'>{\"@type\": \"A\", \"type\": \"B\", \"n\": {\"k\": 1}}</script><script type='application/ld+json'>broken</script>"
        "<div itemscope itemtype='http://schema.org/Thing'><img itemprop=i src=' s '><span itemprop=p>t</span></div><div itemscope></div>"
    )
    a, b, c = metadata.structured_data(d)
    assert a["schema_type"] == "B" and a["properties"]["n"] == '{"k":1}' and b["schema_type"] is None and b["raw"] == "broken"
    assert c["schema_type"] == "Thing" and c["properties"] == {"i": '"s"', "p": '"t"'}


def test_links():
    d = Document(
        "<a href=' /a '>x</a><a href=/a>again</a><a href='//cdn.example/z'></a><a href='https://sub.site.example/#f' rel='NOFOLLOW ugc zz'>s</a>"
        "<a href='#x'>n</a><a href='javascript:1'>n</a><a href='https://example/'>p</a>"
    )
    got = links.links(d, BASE)
    assert [x["url"] for x in got] == ["https://site.example/a", "https://cdn.example/z", "https://sub.site.example/", "https://example/"]
    assert [x["link_type"] for x in got] == ["internal", "external", "internal", "external"]
    assert got[1]["text"] == "//cdn.example/z" and got[2]["rel"] == ["no_follow", "ugc", "other"] and got[2]["is_nofollow"]
    assert links.links(Document("<a href=x>y</a>"))[0]["link_type"] == "unknown"


def test_dom_path():
    d = Document("<nav class='b a'><ul><li><a href=/x>t</a></li></ul></nav>")
    assert links.dom_path(d.first("a")) == "nav.a.b>ul>li"


def test_text_flow():
    d = Document("<article><h1>T</h1><p>one <b>two</b>,three</p><nav>menu</nav><div>four<br>five</div><script>x</script></article>")
    assert content.main_text(d) == "T\nonetwo ,three\nfour\nfive"  # inline elements join without a space
    assert content.flow(Document("<div>a<div><div>b</div></div></div>").body) == "a\nb"
    assert content.main_text(Document("<article>short</article><header>h</header><p>body text that is long enough</p>")).startswith("short")
    assert content.flow(d.root, content.SKIPPED, 1) == ""


def test_headings_and_outline():
    d = Document("<h2 id=i class='c d'>b</h2><h1>a</h1><h3>c</h3><h1> </h1>")
    assert [(h["level"], h["text"]) for h in content.headings(d)] == [(1, "a"), (2, "b"), (3, "c")]
    assert [(o["parent_idx"], o["depth"]) for o in content.outline(d)] == [(None, 0), (0, 1), (1, 2)]
    assert content.main_heading(Document("<h1> </h1><h2>x</h2>"))["level"] == 2 and content.main_heading(Document("")) is None


def test_lists_nested_and_definitions():
    d = Document("<ul><li>a <b>b</b><ol><li>n</ol></li><li><ul><li>lost</ul></li></ul><dl><dt>t<dd>1<dd>2</dl>")
    got = [(x["list_type"], x["path"], x["text"]) for x in content.lists(d)]
    assert got == [("unordered", [0], "a b"), ("unordered", [0, 0], "n"), ("definition", [0], "t: 1"), ("definition", [1], "t: 2")]


def test_tables_code_quotes_images():
    t = content.tables(Document("<table><caption>c</caption><thead><tr><th>h</thead><tr><td colspan=2>a<td rowspan=x>b</table><table></table>"))
    assert len(t) == 1 and t[0]["caption"] == "c" and t[0]["column_count"] == 2 and t[0]["rows"][0]["cells"][0]["colspan"] == 2
    c = content.code_blocks(Document("<pre><code class='lang-Rust'>a\nb\n</code></pre><p><code data-lang=sql>x</code><pre>no</pre>"))
    assert [(x["language"], x["is_inline"], x["line_count"]) for x in c] == [("Rust", False, 2), ("sql", True, 1)]
    q = content.quotes(Document("<blockquote cite=u>long enough <cite>w</cite></blockquote><blockquote>short</blockquote>"))
    assert q == [{"text": "long enough w", "cite": "u", "cite_url": "w"}]
    i = content.images(Document("<img src=' a.png ' width=10px height=5 loading=lazy><img src='data:x'><img>"), BASE)
    assert len(i) == 1 and i[0]["width"] is None and i[0]["height"] == 5 and i[0]["is_decorative"] and i[0]["url"].endswith("/blog/a.png")


def form(html):
    return forms.forms(Document(f"<form {html}</form>"))[0]


def test_form_types():
    kinds = {
        "><input type=password><input name=login>": "login", "action=/register><input type=password>": "registration",
        "><input type=password><input type=email name=e><input name=stay_in>": "login", "action=/forgot-password><input type=password>": "password_reset",
        "><input type=password>": "login", "><input name=q>": "search", "><input type=file name=x>": "upload", "><input name=profile>": "upload",
        "><input name=feedback>": "contact", "action=/subscribe>": "newsletter", "><input name=billing>": "checkout", "><textarea name=reply></textarea>": "comment",
        "action=/signup>": "registration", "><input name=zz>": "unknown",
    }
    assert {k: form(k)["form_type"] for k in kinds} == kinds


def test_form_fields_and_labels():
    f = forms.forms(Document(
        "<label for=a>First</label><label for=a>Second</label><form method=Dialog><input id=a type=TEL maxlength=9 minlength=x><label>In <input id=b name=n></label>"
        "<select name=s id=c><option value=1>One<option value=2 selected></select><textarea name=t> hi </textarea><input type=hidden name=XSRF-x>"
        "<input id=turnstile-1><button type=submit></button><input type=submit value=Go></form>"
    ))[0]
    a, b, c, t = f["fields"][:4]
    assert (a["label"], a["field_type"], a["max_length"], a["min_length"]) == ("First", "tel", 9, None)
    assert b["label"] == "In" and [o["label"] for o in c["options"]] == ["One", "2"] and t["value"] == "hi"
    assert f["has_csrf"] and f["has_captcha"] and f["method"] == "dialog" and f["submit_text"] == "Go"
    assert forms.field_type("Nope") == "unknown" and forms.field_type(None) == "text"


def test_page_numbers():
    cases = {"http://x/?page=3": 3, "http://x/page/4/": 4, "http://x/shop/12": 12, "http://x/a/5": 5, "http://x/?page=99999999999": None, "http://x/": None}
    assert {u: pagination.page_number(u) for u in cases} == cases
    assert pagination.page_info("see Page 2 of 9") == (2, 9, None) and pagination.page_info("pg 3 ... total 40 items") == (3, None, 40)


def test_pagination_kinds():
    kind = lambda h: pagination.pagination(Document(h), BASE)["pagination_type"]
    assert kind("<div class=infinite-scroll>") == "infinite_scroll" and kind("<script>endlessScroll</script>") == "infinite_scroll"
    assert kind("<a class=load-more>Load more</a>") == "load_more" and kind("<div class=pager><a href='?cursor=x'>n</a></div>") == "cursor"
    assert kind("<div class=pager><a href='?offset=20'>n</a></div>") == "offset" and kind("<a>Prev</a><span> › </span>") == "next_prev"
    assert kind("<ul class=pagination><a href=/page/1>1</a><a href=/page/2>2</a></ul>") == "numbered" and kind("x") == "none"
    p = pagination.pagination(Document("<link rel=Next href='?page=4'><p>no page"), BASE)
    assert p["next_url"].endswith("?page=4") and p["current_page"] == 3 and p["total_pages"] == 7
    assert pagination.prev_page(Document("<div class=pager><a class=active href=?page=3>3</a><a href=?page=2>2</a></div>"), BASE).endswith("?page=2")
    assert pagination.has_pagination(Document("<p>Page 1 of 3")) and not pagination.has_pagination(Document("<p>next week"))


def test_contacts():
    d = Document(
        "<title>Acme | Home</title><body><a href='mailto:joe@acme.co.uk'>Joe</a> x sue@acme.io info@acme.io call 800-555-1234 or +1 (212) 555-1234"
        "<a href='tel:0301234567'>o</a><address>1 Main Street 12345 city: Bonn</address><a href='https://x.com/@acme?'>t</a><a href='https://netflix.com/title'>n</a>"
        "<a href=/about-us>About</a>"
    )
    c = contacts.contacts(d)
    assert [(e["address"], e["source"]) for e in c["emails"]] == [("joe@acme.co.uk", "mailto_link"), ("sue@acme.io", "page_text")]
    assert ("8005551234", "toll_free") in [(p["normalized"], p["phone_type"]) for p in c["phones"]]
    assert c["phones"][0]["phone_type"] == "landline" and c["addresses"][0]["postal_code"] == "12345" and c["addresses"][0]["city"] == "Bonn"
    assert [s["platform"] for s in c["social_links"]] == ["twitter", "twitter"] and c["business_name"] == "Acme"
    assert contacts.contact_page(d) == "/about-us" and contacts.email_label(d, "joe@acme.co.uk") == "Joe" and contacts.phone_label(d, "0301234567") == "o"
    assert contacts.username("https://www.linkedin.com/in/bob/", "linkedin") == "bob" and contacts.username("https://t.me/s", "telegram") is None


def test_structured_address():
    a = contacts.addresses(Document(
        "<div itemscope itemtype=http://schema.org/PostalAddress><b itemprop=streetAddress>S 1</b><b itemprop=addressCountry content=DE>Germany</b>"
        "<i itemscope itemtype=http://schema.org/GeoCoordinates><meta itemprop=latitude content=1.5><b itemprop=longitude>2</b></i></div>"
    ))
    assert a[0]["street"] == "S 1" and a[0]["country"] == "DE" and a[0]["coordinates"] == {"latitude": 1.5, "longitude": 2.0} and len(a) == 1


def test_feeds_and_sitemaps():
    d = Document("<link rel=alternate type=application/atom+xml href=/a><link rel=alternate href=x.json><link type=application/xml href=/sitemap-news.xml><a href=/no>n</a>")
    assert [(f["feed_type"], f["url"]) for f in feeds.feeds(d, BASE)] == [("atom", "https://site.example/a"), ("json", "https://site.example/blog/x.json")]
    assert feeds.sitemaps(d, BASE)[0]["sitemap_type"] == "news"


def test_siphash_reference_vector():
    # empty input under a zero key, one and three rounds: the hash of the empty string is that of its end mark
    assert fingerprint.siphash13(b"") == 15130871412783076140
    assert fingerprint.hash_text("") == fingerprint.siphash13(b"\xff")


def test_fingerprint_amp_cache():
    a, b = (fingerprint.fingerprint(Document(f"<body><p>hello{x}</p>")) for x in ("", " world"))
    assert a["structure_hash"] == b["structure_hash"] and a["text_hash"] != b["text_hash"] and a["element_count"] == 4
    assert fingerprint.structure(Document("<body id=q><a href=http://x>1</a><a>2</a><img>")) == "<html:0<head:1<body#q:1<a[ext]:2<a[no]:2<img[img]:2"
    amp = fingerprint.amp(Document("<html ⚡><script src=https://cdn.ampproject.org/v0-1.2/v0.js></script><script custom-template=m></script>"))
    assert amp["is_amp"] and amp["has_amp_runtime"] and amp["amp_components"] == ["m"] and amp["amp_version"] == "1.2"
    h = fingerprint.cache_hints(Document("<meta http-equiv=Cache-Control content='max-age=60, stale-while-revalidate=5'><meta http-equiv=ETag content=x>"))
    assert (h["max_age"], h["stale_while_revalidate"], h["etag"], h["should_cache"]) == (60, 5, "x", True)
    assert fingerprint.cache_hints(Document("<meta http-equiv=Pragma content=No-Cache>"))["max_age"] is None


def test_media():
    d = Document(
        "<img src=a.JPG?x width=10px srcset='s.jpg 1x, b.jpg 2x'><img data-src=l.png><img src='data:image/png;base64,x'><picture><img src=a.JPG?x></picture>"
        "<video><source src=v.webm></video><iframe src=https://player.vimeo.com/video/12></iframe><a href=s.mp3>song</a><a href=f.pdf title=T>f</a><a download href=z>z</a>"
        "<iframe src=about:blank></iframe><object data=https://codepen.io/x width='50%'></object>"
    )
    m = media.media(d, BASE)
    assert [i["format"] for i in m["images"]] == ["jpeg", "png"] and media.best_image(m["images"][0]).endswith("b.jpg")
    assert [(v["platform"], v["video_id"]) for v in m["videos"]] == [("html5", None), ("vimeo", "12")]
    assert m["audio"][0]["mime_type"] == "audio/mpeg" and [x["doc_type"] for x in m["documents"]] == ["pdf", "other"]
    assert [(e["platform"], e["width"]) for e in m["embeds"]] == [("other", None), ("codepen", 50)]
    assert media.has_media(d)["image"] and not media.has_media(Document("x"))["video"]
    assert media.is_placeholder("/lazy.png") and media.is_placeholder("x", 5, 5) and not media.is_placeholder("x", 5, None)


def test_readability():
    body = "".join(f"<p>This is sentence number {k}, which has commas, words and enough length to count.</p>" for k in range(6))
    d = Document(f"<title>T</title><div class=sidebar><p>{'noise ' * 30}</p></div><div class=content><h2>Head</h2>{body}<ul><li>item</li></ul></div>")
    a = readability.article(d)
    assert a["title"] == "T" and "## Head" in a["content"] and "- item" in a["content"] and "noise" not in a["content"]
    assert "<h2>Head</h2>" in a["html"] and readability.readable_or_selected(d, "title").startswith("<div")
    assert readability.readable_or_selected(Document("<b>x</b><i>y</i>"), "b") == "x" and readability.article(Document(""))["content"] == ""
