"""Lookups by URL, extension, MIME type and address as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import contacts as _contacts
from ..operators import media as _media

MEDIA_EXTENSIONS = {
    "image": "avif bmp gif heic heif ico jpeg jpg png svg tif tiff webp", "video": "3gp avi flv m4v mkv mov mp4 ogg ogv webm wmv",
    "audio": "aac aiff flac m4a mp3 oga opus wav wma", "document": "csv doc docx epub odp ods odt pdf ppt pptx rtf txt xls xlsx",
}
#: first table entry of which a word occurs
FEED_PATHS = tuple(
    """/articles/atom.xml /articles/feed/ /articles/rss.xml /atom /atom.xml /blog/atom /blog/atom.xml /blog/feed /blog/feed/
    /blog/rss /blog/rss.xml /feed /feed.xml /feed/ /feeds/ /feeds/atom.xml /feeds/posts/default /feeds/rss.xml /index.xml
    /news/atom.xml /news/feed/ /news/rss.xml /rss /rss.xml /rss/ /rss/category/feed.xml /rss/feed.xml""".split()
)
SITEMAP_PATHS = tuple(
    """/images/sitemap.xml /media/sitemap.xml /news/sitemap.xml /robots.txt /sitemap-image.xml /sitemap-index.xml
    /sitemap-mobile.xml /sitemap-news.xml /sitemap-news.xml.gz /sitemap-video.xml /sitemap.txt /sitemap.xml /sitemap.xml.gz
    /sitemap/ /sitemap/sitemap.xml /sitemap1.xml /sitemap2.xml /sitemap_index.xml /sitemap_index.xml.gz /sitemapindex.xml
    /sitemapindex.xml.gz /sitemaps/ /sitemaps/sitemap.xml /video/sitemap.xml""".split()
)


def by_words(text: Column, table, otherwise: str = "other") -> Column:
    out = None
    for name, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def video_platform(url: Column) -> Column:
    return by_words(F.lower(url), _media.VIDEO_PLATFORMS)


def audio_platform(url: Column) -> Column:
    return by_words(F.lower(url), _media.AUDIO_PLATFORMS)


def embed_platform(url: Column) -> Column:
    return by_words(url, _media.EMBED_PLATFORMS)


def social_platform(url: Column) -> Column:
    names = _contacts.PLATFORM_NAMES
    return by_words(F.lower(url), [(names.get(k, k), words) for k, words in _contacts.PLATFORMS])


def extension(url: Column) -> Column:
    """Extension of the last path segment, lower-cased; at most five letters or digits."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[^?#]*?\.([\p{IsAlphabetic}\p{N}]{1,5})(?:[?#]|$)", 1), F.lit("")))


def media_type_of_extension(ext: Column) -> Column:
    low, out = F.lower(ext), None
    for kind, exts in MEDIA_EXTENSIONS.items():
        hit = low.isin(*exts.split())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def media_type_of_mime(mime: Column) -> Column:
    m = F.lower(mime)
    return (
        F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio")
        .when(m.startswith("application/pdf") | m.rlike("document|presentation|spreadsheet"), "document").otherwise("other")
    )


def media_type(mime: Column, url: Column) -> Column:
    """By content type, else by how the URL ends."""
    u = F.lower(url)
    typed = (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
        .when(mime.rlike("document|pdf|presentation|spreadsheet"), "document")
    )
    ends = (
        F.when(u.rlike(r"\.(?:avif|bmp|gif|ico|jpe?g|png|svg|webp)$"), "image").when(u.rlike(r"\.(?:avi|mkv|mov|mp4|ogg|webm)$"), "video")
        .when(u.rlike(r"\.(?:aac|flac|m4a|mp3|wav)$"), "audio").when(u.rlike(r"\.(?:csv|docx?|epub|pdf|pptx?|txt|xlsx?)$"), "document")
        .otherwise("other")
    )
    return F.coalesce(typed, ends)


def image_format(ext: Column) -> Column:
    low, out = F.lower(ext), None
    for name, (exts, _) in _media.FORMATS.items():
        hit = low.isin(*exts.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def image_mime(form: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, (_, m) in _media.FORMATS.items() for x in (k, m)))
    return F.coalesce(F.try_element_at(table, form), F.lit("application/octet-stream"))


def document_type(url: Column) -> Column:
    low, out = F.lower(url), None
    for ext, kind in _media.DOCUMENTS:
        out = F.when(low.contains("." + ext), kind) if out is None else out.when(low.contains("." + ext), kind)
    return out.otherwise("other")


def is_document_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(?:csv|docx?|epub|od[pst]|pdf|pptx?|rtf|txt|xlsx?)(?:$|[?&])")


def is_audio_file(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(?:aac|flac|m4a|mp3|og[ag]|opus|wav|wma)$")


def is_placeholder(src: Column, width: Column, height: Column) -> Column:
    named = src.rlike("(?i)1x1|blank|lazy|loading|pixel|placeholder|spacer") | src.rlike(r"picsum\.photos|placehold\.it|placekitten\.com")
    return F.coalesce(named, F.lit(False)) | F.coalesce((width <= 10) & (height <= 10), F.lit(False))


def video_id(url: Column) -> Column:
    get = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    kind = video_platform(url)
    return (
        F.when(kind == "youtube", get(r"(?:youtu\.be/|youtube\.com/(?:embed/|v/|watch\?v=))([A-Za-z0-9_-]{11})"))
        .when(kind == "vimeo", get(r"vimeo\.com(?:/video)?/([0-9]+)"))
        .when(kind == "dailymotion", get(r"dailymotion\.com/(?:embed/)?video/([A-Za-z0-9]+)"))
        .when(kind == "twitch", get(r"twitch\.tv/(?:videos/(?=[0-9]))?([A-Za-z0-9_]+)"))
        .when(kind == "tiktok", get(r"tiktok\.com/@[^/]{1,}/video/([0-9]+)"))
    )


def thumbnail(url: Column) -> Column:
    kind, ident = video_platform(url), video_id(url)
    return F.when(kind == "youtube", F.concat(F.lit("https://img.youtube.com/vi/"), ident, F.lit("/maxresdefault.jpg"))).when(
        kind == "dailymotion", F.concat(F.lit("https://www.dailymotion.com"), F.lit("/thumbnail/video/"), ident)
    )


def youtube_embed_url(ident: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/embed/"), ident)


def vimeo_embed_url(ident: Column) -> Column:
    return F.concat(F.lit("https://player.vimeo.com/video/"), ident)


def spotify_embed_url(ident: Column) -> Column:
    return F.concat(F.lit("https://open.spotify.com"), F.lit("/embed/track/"), ident)


def feed_type(content: Column) -> Column:
    """rss, rss2, atom, json or unknown, by the first two hundred characters."""
    head = F.substring(content, 1, 200)
    after = F.substring_index(head, "<rss", -1)
    return (
        F.when(head.contains("<rss"), F.when(after.contains("2.0"), "rss2").otherwise("rss")).when(head.contains("<feed"), "atom")
        .when(head.contains('"version":"https://jsonfeed.org/'), "json").otherwise("unknown")
    )


def feed_type_of_url(url: Column) -> Column:
    u = F.lower(url)
    atom = u.contains("/atom") | u.endswith(".atom") | u.endswith("atom.xml")
    return F.when(atom, "atom").when(u.endswith(".json") | u.contains("jsonfeed"), "json").otherwise("rss2")


def sitemap_type(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(u.endswith(".txt"), "text").when(u.rlike(r"\.gz(?:ip)?$"), "gzip").when(u.contains("news"), "news")
        .when(u.contains("image"), "image").when(u.contains("video"), "video").when(u.contains("index"), "index").otherwise("xml")
    )


def well_known(pages, url: str = "url", paths=FEED_PATHS, name: str = "candidate"):
    """Each distinct URL with every well-known path after it: a fixed list, so rows grow by a constant."""
    base = F.regexp_replace(F.col(url), "/+$", "")
    return pages.select(F.col(url), F.explode(F.transform(F.array(*map(F.lit, paths)), lambda p: F.concat(base, p))).alias(name)).distinct()


def valid_email(email: Column) -> Column:
    e = F.trim(email)
    low = F.lower(e)
    parts = F.split(low, "@")
    domain = F.try_element_at(parts, F.lit(2))
    labels = F.split(domain, r"\.")
    listed = low.rlike("^(?:admin|donotreply|example|info|no-?reply|test)@")
    bad = domain.isin("domain.com", "domain.org", "example.com", "example.net", "example.org", "local", "localhost", "test.com")
    shape = bad | (F.size(labels) > 3) | (F.octet_length(F.element_at(labels, -1)) > 8)
    return e.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") & ~listed & ~((F.size(parts) == 2) & F.coalesce(shape, F.lit(False)))


def phone_digits(number: Column) -> Column:
    return F.regexp_replace(number, "[^0-9]", "")


def phone_type(number: Column) -> Column:
    d = phone_digits(number)
    n = F.length(d)
    area = F.when(d.startswith("1") & (n >= 11), F.substring(d, 2, 3)).otherwise(F.substring(d, 1, 3))
    free = n.between(10, 12) & area.isin("800", "833", "844", "855", "866", "877", "888")
    return (
        F.when(free, "toll_free").when(d.rlike("^1[3-9][0-9]{9}$"), "mobile")
        .when(d.startswith("0") & n.between(10, 12), "landline").otherwise("unknown")
    )


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


USER_AGENTS = tuple(
    f"Mozilla/5.0 ({system}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{version}.0.0.0 Safari/537.36"
    for system in ("Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7", "X11; Linux x86_64")
    for version in (128, 129, 130, 131)
)


def user_agent(url: Column, fixed: str | None = None) -> Column:
    """The given agent, else one of the list by a hash of the URL: the same at every run."""
    if fixed is not None:
        return F.lit(fixed)
    return F.element_at(F.array(*map(F.lit, USER_AGENTS)), (F.pmod(F.xxhash64(url), F.lit(len(USER_AGENTS))) + 1).cast("int"))


def fingerprint_change(old: Column, new: Column) -> Column:
    """Struct changed, minor, structural, similarity of two fingerprints."""
    text, shape = old["text_hash"] != new["text_hash"], old["structure_hash"] != new["structure_hash"]

    def part(hash_, size, weight):
        low, high = F.least(old[size], new[size]).cast("double"), F.greatest(old[size], new[size])
        return F.when(old[hash_] == new[hash_], F.lit(weight)).when(high > 0, F.lit(weight) * (low / high)).otherwise(0.0)

    total = part("text_hash", "text_length", 40.0) + part("structure_hash", "element_count", 40.0)
    total = total + part("main_content_hash", "main_content_length", 20.0)
    return F.struct(
        (text | shape).alias("changed"), (text & ~shape).alias("minor"), shape.alias("structural"), (total / 100.0).alias("similarity")
    )
