"""Images, videos, audio, documents and embeds of a parsed page."""

from __future__ import annotations

import re

from ..functions.url_join import resolve
from .content import unsigned
from .dom import Document

_LAZY = tuple("data-" + n for n in "src lazy-src original srcset lazy-srcset bg background image url".split())
_PLACEHOLDER = re.compile("1x1|blank|lazy|loading|pixel|placeholder|spacer", re.I)
_PLACEHOLDER_HOSTS = ("picsum.photos", "placehold.it", "placekitten.com", "placeholder.com")
_EXT = re.compile(r"[^\W_]{1,5}\Z")
FORMATS = {
    "jpeg": ("jpg jpeg", "image/jpeg"), "png": ("png", "image/png"), "gif": ("gif", "image/gif"), "webp": ("webp", "image/webp"),
    "svg": ("svg", "image/svg+xml"), "avif": ("avif", "image/avif"), "heic": ("heic heif", "image/heic"),
    "ico": ("ico", "image/x-icon"), "bmp": ("bmp", "image/bmp"), "tiff": ("tiff tif", "image/tiff"),
}
_FORMAT_OF = {e: f for f, (exts, _) in FORMATS.items() for e in exts.split()}
VIDEO_PLATFORMS = (
    ("youtube", ("youtu.be", "youtube.com")), ("vimeo", ("vimeo.com",)), ("dailymotion", ("dai.ly", "dailymotion.com")),
    ("twitch", ("twitch.tv",)), ("facebook", ("facebook.com", "fb.watch")), ("twitter", ("twitter.com", "x.com")),
    ("tiktok", ("tiktok.com",)), ("wistia", ("wistia.com", "wistia.net")), ("brightcove", ("brightcove",)),
    ("jwplayer", ("jwplatform", "jwplayer")),
)
AUDIO_PLATFORMS = (
    ("spotify", ("open.spotify", "spotify.com")), ("soundcloud", ("soundcloud.com",)),
    ("applepodcasts", ("podcasts.apple.com",)), ("anchor", ("anchor.fm",)), ("podbean", ("podbean.com",)),
    ("buzzsprout", ("buzzsprout.com",)),
)
EMBED_PLATFORMS = (
    ("googlemaps", ("google.com/maps", "maps.google.")), ("twitter", ("platform.twitter", "twitter.com", "x.com")),
    ("instagram", ("instagram.com",)), ("facebook", ("facebook.com", "fb.com")), ("linkedin", ("linkedin.com",)),
    ("pinterest", ("pinterest.com",)), ("tiktok", ("tiktok.com",)), ("reddit", ("redd.it", "reddit.com")),
    ("codepen", ("codepen.io",)), ("jsfiddle", ("jsfiddle.net",)), ("codesandbox", ("codesandbox.io",)),
    ("giphy", ("giphy.com",)), ("slideshare", ("slideshare.net",)), ("typeform", ("typeform.com",)),
    ("calendly", ("calendly.com",)), ("stripe", ("stripe.com",)), ("paypal", ("paypal.com",)),
)
_VIDEO_EMBEDS = (
    "brightcove dai.ly dailymotion.com facebook.com/plugins/video jwplatform jwplayer tiktok.com twitch.tv vimeo.com "
    "wistia.com wistia.net youtu.be youtube-nocookie.com youtube.com"
).split()
_VIDEO_EXT = ".avi .m4v .mkv .mov .mp4 .ogg .ogv .webm".split()
_VIDEO_MIME = (("mp4", ".mp4"), ("webm", ".webm"), ("ogg", ".og[gv]"), ("quicktime", ".mov"), ("x-msvideo", ".avi"))
_AUDIO_HOSTS = (
    "anchor.fm buzzsprout.com castbox.fm open.spotify.com podbean.com podcasts.apple.com soundcloud.com spreaker.com"
).split()
_AUDIO_EXT = tuple(".aac .flac .m4a .mp3 .oga .ogg .opus .wav .wma".split())
_AUDIO_MIME = (("mpeg", ".mp3"), ("wav", ".wav"), ("ogg", ".og[ga]"), ("flac", ".flac"), ("aac", ".aac"), ("mp4", ".m4a"), ("opus", ".opus"))
_IDS = {
    "youtube": re.compile(r"(?:youtu\.be/|youtube\.com/(?:embed/|v/|watch\?v=))([\w-]{11})", re.A),
    "vimeo": re.compile(r"vimeo\.com(?:/video)?/([0-9]+)"),
    "dailymotion": re.compile(r"dailymotion\.com/(?:embed/)?video/([A-Za-z0-9]+)"),
    "twitch": re.compile(r"twitch\.tv/(?:videos/(?=[0-9]))?(\w+)", re.A),
    "tiktok": re.compile(r"tiktok\.com/@[^/]{1,}/video/([0-9]+)"),
}
#: in the order in which they are looked for
DOCUMENTS = (
    ("pdf", "pdf"), ("doc", "word"), ("docx", "word"), ("odt", "word"), ("rtf", "word"), ("xls", "excel"), ("xlsx", "excel"),
    ("ods", "excel"), ("csv", "csv"), ("ppt", "powerpoint"), ("pptx", "powerpoint"), ("odp", "powerpoint"), ("txt", "text"),
    ("epub", "epub"),
)
_OFFICE = "application/vnd.openxmlformats-officedocument."
DOCUMENT_MIME = {
    "pdf": "application/pdf", "word": _OFFICE + "wordprocessingml.document", "excel": _OFFICE + "spreadsheetml.sheet",
    "powerpoint": _OFFICE + "presentationml.presentation", "text": "text/plain", "csv": "text/csv", "epub": "application/epub+zip",
}
IMAGES = (
    "array<struct<src:string,absolute_url:string,alt:string,title:string,width:int,height:int,format:string,"
    "mime_type:string,loading:string,is_decorative:boolean,srcset:array<struct<url:string,width:int,density:float>>,"
    "sizes:string,data_src:string,is_placeholder:boolean,size_bytes:bigint,content_hash:string,classes:array<string>,id:string>>"
)
VIDEOS = (
    "array<struct<src:string,absolute_url:string,platform:string,video_id:string,poster:string,width:int,height:int,"
    "duration:double,mime_type:string,title:string,sources:array<struct<src:string,mime_type:string,quality:string>>,"
    "tracks:array<struct<src:string,kind:string,label:string,srclang:string,is_default:boolean>>,autoplay:boolean,"
    "loop_video:boolean,muted:boolean,controls:boolean,playsinline:boolean,embed_url:string,size_bytes:bigint>>"
)
AUDIO = (
    "array<struct<src:string,absolute_url:string,platform:string,title:string,artist:string,album:string,duration:double,"
    "mime_type:string,sources:array<struct<src:string,mime_type:string>>,autoplay:boolean,loop_audio:boolean,muted:boolean,"
    "controls:boolean,embed_url:string,size_bytes:bigint>>"
)
DOCS = (
    "array<struct<url:string,absolute_url:string,doc_type:string,filename:string,title:string,mime_type:string,"
    "size_bytes:bigint,page_count:int>>"
)
EMBEDS = (
    "array<struct<url:string,absolute_url:string,platform:string,title:string,width:int,height:int,allow:string,"
    "sandbox:string,loading:string,frameborder:string>>"
)
LINKS = (
    "array<struct<href:string,absolute_url:string,text:string,title:string,rel:array<string>,link_type:string,"
    "is_nofollow:boolean,is_sponsored:boolean,is_ugc:boolean,target:string,download:string,hreflang:string,media_type:string>>"
)
SCHEMA = f"struct<images:{IMAGES},videos:{VIDEOS},audio:{AUDIO},documents:{DOCS},embeds:{EMBEDS},links:{LINKS}>"


def link(href, base, data=False):
    return resolve(href, base, verbatim_absolute=True, slashes="https", trim=False, keep_data=data)


def by_words(url: str, table) -> str:
    low = url.lower()
    return next((k for k, words in table if any(w in low for w in words)), "other")


def _px(value):
    if value is None:
        return None
    while value.endswith("px"):
        value = value[:-2]
    return unsigned(value)


def _dimension(value):
    value = _strip(value.strip(), "px") if value is not None else None
    return unsigned(value.rstrip("%")) if value is not None else None


def _strip(value, end):
    while value.endswith(end):
        value = value[: -len(end)]
    return value


def extension(url: str) -> str | None:
    name = url.split("?")[0].split("#")[0].rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    return ext.lower() if _EXT.match(ext) and len(ext.encode()) <= 5 else None


def is_placeholder(src, width=None, height=None) -> bool:
    small = width is not None and height is not None and width <= 10 and height <= 10
    return bool(small or _PLACEHOLDER.search(src) or any(h in src for h in _PLACEHOLDER_HOSTS))


def srcset(text, base=None) -> list[dict]:
    out = []
    for part in text.split(","):
        words = part.split()
        if not words:
            continue
        width = density = None
        if len(words) > 1 and words[1].endswith("w"):
            width = unsigned(words[1].rstrip("w"))
        elif len(words) > 1 and words[1].endswith("x"):
            try:
                density = float(words[1].rstrip("x"))
            except ValueError:
                density = None
        out.append({"url": link(words[0], base, True) or words[0], "width": width, "density": density})
    return out


def best_image(image: dict) -> str:
    """Widest source, else densest (the last of equals for width and density), else the image itself."""
    for key in ("width", "density"):
        best = None
        for e in image["srcset"]:
            if e[key] is not None and (best is None or e[key] >= best[key]):
                best = e
        if best is not None:
            return best["url"]
    return image["absolute_url"] if image["absolute_url"] is not None else image["src"]


def _once(items, seen):
    for x in items:
        if x is not None:
            key = x["absolute_url"] if x["absolute_url"] is not None else x["src" if "src" in x else "url"]
            if key not in seen:
                seen.add(key)
                yield x


def _image(el, base):
    a = el.attrs.get
    src = a("src")
    if not src or (src.startswith("data:image/svg+xml") and len(src.encode()) <= 100):
        src = next((el.attrs[k] for k in _LAZY if k in el.attrs), None)
    if src is None or src.startswith("data:image/"):
        return None
    url = link(src, base, True)
    ext = (extension(url) if url is not None else None) or extension(src)
    form = _FORMAT_OF.get(ext, "unknown")
    width, height = _px(a("width")), _px(a("height"))
    return {
        "src": src, "absolute_url": url, "alt": a("alt"), "title": a("title"), "width": width, "height": height, "format": form,
        "mime_type": FORMATS[form][1] if form in FORMATS else "application/octet-stream",
        "loading": "lazy" if a("loading") == "lazy" else "eager", "is_decorative": a("alt") == "",
        "srcset": srcset(a("srcset"), base) if a("srcset") is not None else [], "sizes": a("sizes"),
        "data_src": next((el.attrs[k] for k in _LAZY if k in el.attrs), None),
        "is_placeholder": is_placeholder(src, width, height), "size_bytes": None, "content_hash": None,
        "classes": el.classes, "id": a("id"),
    }


def images(doc: Document, base=None) -> list[dict]:
    return list(_once((_image(el, base) for el in doc.by_tag.get("img", ())), set()))


def video_id(url, kind):
    m = _IDS[kind].search(url) if kind in _IDS else None
    return m[1] if m else None


def thumbnail(kind, ident):
    if ident is None:
        return None
    return {
        "youtube": f"https://img.youtube.com/vi/{ident}/maxresdefault.jpg",
        "dailymotion": "https://www.dailymotion.com" + f"/thumbnail/video/{ident}",
    }.get(kind)


def _mime(url, table, kind):
    low = url.lower()
    return next((f"{kind}/{m}" for m, p in table if re.search(re.escape(p).replace(r"\[", "[").replace(r"\]", "]"), low)), None)


def is_video_embed(url):
    low = url.lower()
    return any(h in low for h in _VIDEO_EMBEDS)


def _video(**known):
    return dict(src="", absolute_url=None, platform="html5", video_id=None, poster=None, width=None, height=None, duration=None,
                mime_type=None, title=None, sources=[], tracks=[], autoplay=False, loop_video=False, muted=False, controls=True,
                playsinline=False, embed_url=None, size_bytes=None) | known


def _source(doc, el):
    if "src" in el.attrs:
        return el.attrs["src"]
    first = doc.first("source", el)
    return first.attrs.get("src") if first is not None else None


def _video_element(doc, el, base):
    a, src = el.attrs.get, _source(doc, el)
    if src is None:
        return None
    sources = [
        {"src": link(s.attrs["src"], base) or s.attrs["src"], "mime_type": s.attrs.get("type"),
         "quality": s.attrs.get("data-quality", s.attrs.get("label"))}
        for s in doc.select("source[src]", el)
    ]
    kinds = ("captions", "chapters", "descriptions", "metadata")
    tracks = [
        {"src": link(t.attrs["src"], base) or t.attrs["src"], "kind": k if (k := t.attrs.get("kind")) in kinds else "subtitles",
         "label": t.attrs.get("label"), "srclang": t.attrs.get("srclang"), "is_default": "default" in t.attrs}
        for t in doc.select("track[src]", el)
    ]
    flags = {("loop_video" if k == "loop" else k): k in el.attrs for k in ("autoplay", "loop", "muted", "controls", "playsinline")}
    return _video(
        src=src, absolute_url=link(src, base), poster=link(a("poster"), base), width=_px(a("width")), height=_px(a("height")),
        mime_type=a("type") or _mime(src, _VIDEO_MIME, "video"), title=a("title", a("aria-label")), sources=sources, tracks=tracks,
        **flags,
    )


def videos(doc: Document, base=None) -> list[dict]:
    def found():
        for el in doc.by_tag.get("video", ()):
            yield _video_element(doc, el, base)
        for el in doc.select("iframe[src]"):
            src = el.attrs["src"]
            if is_video_embed(src):
                kind = by_words(src, VIDEO_PLATFORMS)
                ident = video_id(src, kind)
                yield _video(
                    src=src, absolute_url=link(src, base), platform=kind, embed_url=src, video_id=ident, title=el.attrs.get("title"),
                    width=_px(el.attrs.get("width")), height=_px(el.attrs.get("height")), poster=thumbnail(kind, ident),
                )
        for el in doc.select("object[data], embed[src]"):
            src = el.attrs.get("data", el.attrs.get("src"))
            if is_video_embed(src) or any(e in src.lower() for e in _VIDEO_EXT):
                kind = by_words(src, VIDEO_PLATFORMS) if is_video_embed(src) else "html5"
                yield _video(
                    src=src, absolute_url=link(src, base), platform=kind, video_id=video_id(src, kind),
                    width=unsigned(el.attrs.get("width")), height=unsigned(el.attrs.get("height")),
                )

    return list(_once(found(), set()))


def _sound(**known):
    return dict(src="", absolute_url=None, platform="html5", title=None, artist=None, album=None, duration=None, mime_type=None,
                sources=[], autoplay=False, loop_audio=False, muted=False, controls=True, embed_url=None, size_bytes=None) | known


def audio(doc: Document, base=None) -> list[dict]:
    def found():
        for el in doc.by_tag.get("audio", ()):
            if (src := _source(doc, el)) is not None:
                a = el.attrs.get
                sources = [
                    {"src": link(s.attrs["src"], base) or s.attrs["src"], "mime_type": s.attrs.get("type")}
                    for s in doc.select("source[src]", el)
                ]
                flags = {("loop_audio" if k == "loop" else k): k in el.attrs for k in ("autoplay", "loop", "muted", "controls")}
                yield _sound(
                    src=src, absolute_url=link(src, base), mime_type=a("type") or _mime(src, _AUDIO_MIME, "audio"),
                    title=a("title", a("aria-label")), sources=sources, **flags,
                )
        for el in doc.select("iframe[src]"):
            src = el.attrs["src"]
            if any(h in src.lower() for h in _AUDIO_HOSTS):
                yield _sound(
                    src=src, absolute_url=link(src, base), platform=by_words(src, AUDIO_PLATFORMS), embed_url=src,
                    title=el.attrs.get("title"),
                )
        for el in doc.select("a[href]"):
            href = el.attrs["href"]
            if href.lower().endswith(_AUDIO_EXT):
                yield _sound(src=href, absolute_url=link(href, base), title=el.joined(), mime_type=_mime(href, _AUDIO_MIME, "audio"))

    return list(_once(found(), set()))


def is_document(url: str) -> bool:
    low = url.lower()
    return any(low.endswith("." + e) or f".{e}?" in low or f".{e}&" in low for e, _ in DOCUMENTS)


def document_type(url: str) -> str:
    low = url.lower()
    return next((k for e, k in DOCUMENTS if "." + e in low), "other")


def documents(doc: Document, base=None) -> list[dict]:
    def linked(el):
        href = el.attrs["href"]
        kind, name = document_type(href), href.split("?")[0].rsplit("/", 1)[-1]
        name = name if "." in name else None
        title = el.attrs.get("title")
        return {
            "url": href, "absolute_url": link(href, base), "doc_type": kind, "filename": name,
            "title": title if title is not None else el.joined() or name, "mime_type": DOCUMENT_MIME.get(kind),
            "size_bytes": None, "page_count": None,
        }

    seen: set = set()
    out = list(_once((linked(el) for el in doc.select("a[href]") if is_document(el.attrs["href"])), seen))
    out += _once((linked(el) for el in doc.select("a[download][href]")), seen)
    for css in ("embed[src*='.pdf'], object[data*='.pdf']", "iframe[src*='.pdf']"):
        for el in doc.select(css):
            src = el.attrs.get("data", el.attrs.get("src")) if el.tag != "iframe" else el.attrs["src"]
            if src not in seen:  # embedded files are told apart by their raw address
                seen.add(src)
                out.append(
                    {
                        "url": src, "absolute_url": link(src, base), "doc_type": "pdf", "filename": None,
                        "title": el.attrs.get("title") if el.tag == "iframe" else None, "mime_type": "application/pdf",
                        "size_bytes": None, "page_count": None,
                    }
                )
    return out


def _embed(url, absolute, kind, el=None, names=()):
    out = dict(url=url, absolute_url=absolute, platform=kind, title=None, width=None, height=None, allow=None, sandbox=None,
               loading=None, frameborder=None)
    if el is not None:
        out |= {k: el.attrs.get(k) for k in names}
        out |= {k: _dimension(el.attrs.get(k)) for k in ("width", "height")}
    return out


def embeds(doc: Document, base=None) -> list[dict]:
    seen: set = set()

    def framed():
        for css, attr in (("iframe[src]", "src"), ("object[data]", "data"), ("embed[src]", "src")):
            for el in doc.select(css):
                url = el.attrs[attr]
                if any(a.tag == "noscript" for a in el.ancestors()):
                    continue
                if el.tag == "iframe":
                    if not url or url.startswith(("about:", "javascript:")):
                        continue
                    names = ("title", "allow", "sandbox", "loading", "frameborder")
                elif ".pdf" in url.lower():
                    continue
                else:
                    names = ("title",) if el.tag == "object" else ()
                yield _embed(url, link(url, base), embed_platform(url), el, names)

    out = list(_once(framed(), seen))

    def add(url, kind):
        if url is None or url in seen:
            return False
        seen.add(url)
        out.append(_embed(url, url, kind))
        return True

    for el in doc.select("blockquote.twitter-tweet"):
        any(add(a.attrs.get("href"), "twitter") for a in doc.select("a", el))
    for el in doc.select("blockquote.instagram-media"):
        add(el.attrs.get("data-instgrm-permalink"), "instagram")
    for el in doc.select("div.fb-post, div.fb-video"):
        add(el.attrs.get("data-href"), "facebook")
    for el in doc.select("blockquote.reddit-embed-bq"):
        any("reddit.com" in a.attrs.get("href", "").lower() and add(a.attrs["href"], "reddit") for a in doc.select("a", el))
    return out


def embed_platform(url: str) -> str:
    return next((k for k, words in EMBED_PLATFORMS if any(w in url for w in words)), "other")


def media(doc: Document, base=None, config=None) -> dict:
    from ..plans.config import MediaConfig

    c = config or MediaConfig()
    found = images(doc, base) if c.extract_images else []
    if c.filter_placeholders:
        found = [i for i in found if not i["is_placeholder"]]
    for key, least in (("width", c.min_image_width), ("height", c.min_image_height)):
        if least is not None:
            found = [i for i in found if i[key] is None or i[key] >= least]
    return {
        "images": found, "videos": videos(doc, base) if c.extract_videos else [],
        "audio": audio(doc, base) if c.extract_audio else [], "documents": documents(doc, base) if c.extract_documents else [],
        "embeds": embeds(doc, base) if c.extract_embeds else [], "links": [],
    }


def has_media(doc: Document, base=None) -> dict:
    """Which kinds the raw page holds, placeholders included."""
    return {
        "image": bool(doc.select("img, picture")),
        "video": bool(doc.select("iframe[src*=vimeo], iframe[src*=youtube], video")),
        "audio": bool(doc.select("iframe[src*=soundcloud], iframe[src*=spotify], audio")),
        "document": any(is_document(a.attrs["href"]) for a in doc.select("a[href]")),
        "embedded": any(
            all(a.tag != "noscript" for a in e.ancestors()) for e in doc.select("embed[src], iframe[src], object[data]")
        ),
    }


HAS = "struct<" + ",".join(f"{k}:boolean" for k in ("image", "video", "audio", "document", "embedded")) + ">"
