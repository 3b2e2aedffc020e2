"""Contact data of a parsed page."""

from __future__ import annotations

import re

from .dom import Document

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_EMAIL_AT = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_GAP = r"[\s.-]?"
_PHONE = re.compile(
    rf"(?:\+?\d{{1,3}}{_GAP})?" + rf"\(?\d{{2,4}}\)?{_GAP}" + rf"\d{{3,4}}{_GAP}" + r"\d{3,4}" + r"(?:\s*(?:#|ext|x|分机)\s*\d+)?\b"
)
_TOLLFREE = re.compile(r"(?:\+?1[\s.-]?)?8(?:00|33|44|55|66|77|88)[\s.-]?\d{3}[\s.-]?\d{4}")
_FREE = frozenset("800 833 844 855 866 877 888".split())
_POSTAL = re.compile(r"\b\d{5}\b(?:-\d{4}\b)?")
_POSTAL6 = re.compile(r"\b\d{6}\b")
_CONTACT = re.compile(r"(?:about|contact|support|客服|关于我们|联系)", re.I)
_STREET = "avenue boulevard drive lane road street zip 路 街 大道 巷 弄 邮编".split()
_BAD_LOCAL = tuple(n + "@" for n in "admin donotreply example info no-reply noreply test".split())
_BAD_DOMAIN = frozenset("domain.com domain.org example.com example.net example.org local localhost test.com".split())
#: first platform of which a word stands in the URL
PLATFORMS = (
    ("facebook", ("fb.com", "facebook")), ("twitter", ("x.com", "twitter")), ("linkedin", ("linkedin",)),
    ("instagram", ("instagram",)), ("youtube", ("youtu.be", "youtube")), ("github", ("github",)), ("tiktok", ("tiktok",)),
    ("pinterest", ("pinterest",)), ("snapchat", ("snapchat",)), ("reddit", ("reddit",)), ("telegram", ("telegram", "t.me")),
    ("whatsapp", ("whatsapp", "wa.me")), ("wechat", ("wechat", "weixin")), ("weibo", ("weibo",)),
)
#: as enums are written
PLATFORM_NAMES = {"linkedin": "linked_in", "youtube": "you_tube", "github": "git_hub", "tiktok": "tik_tok",
                  "whatsapp": "whats_app", "wechat": "we_chat"}
SCHEMA = (
    "struct<emails:array<struct<address:string,label:string,source:string>>,"
    "phones:array<struct<number:string,normalized:string,label:string,phone_type:string>>,"
    "addresses:array<struct<raw:string,street:string,city:string,state:string,postal_code:string,country:string,"
    "coordinates:struct<latitude:double,longitude:double>>>,"
    "social_links:array<struct<url:string,platform:string,username:string,label:string>>,business_name:string>"
)


def _body(doc):
    return "".join(doc.body.texts()) if doc.body is not None else ""


def _cut(text, prefix):
    while text.startswith(prefix):
        text = text[len(prefix) :]
    return text.strip()


def valid_email(email: str) -> bool:
    email = email.strip()
    if not _EMAIL.search(email) or email.lower().startswith(_BAD_LOCAL):
        return False
    parts = email.lower().split("@")
    if len(parts) == 2:
        labels = parts[1].split(".")
        return parts[1] not in _BAD_DOMAIN and len(labels) <= 3 and len(labels[-1].encode()) <= 8
    return True


def _mentions(text):
    """Addresses in a text, found from their @ sign, so in linear time."""
    out, done, at = [], 0, text.find("@")
    local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        if start < at and (m := _EMAIL_AT.match(text, at + 1)):
            out.append(text[start : m.end()])
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def emails(doc: Document) -> list[dict]:
    out, seen = [], set()

    def add(address, label, source):
        if valid_email(address) and address not in seen:
            seen.add(address)
            out.append({"address": address, "label": label, "source": source})

    for a in doc.select('a[href^="mailto:"]'):
        address = _cut(a.attrs["href"], "mailto:")
        label = a.joined()
        add(address, label if label and label != address else None, "mailto_link")
    for m in doc.select("meta[property=email], meta[name=email]"):
        if "content" in m.attrs:
            add(m.attrs["content"].strip(), None, "meta_tag")
    for address in _mentions(_body(doc)):
        add(address, None, "page_text")
    return out


def email_label(doc: Document, address: str) -> str | None:
    """Text of a link to the address, or of the nearest ancestor that says more than the address."""
    for a in doc.by_tag.get("a", ()):
        if a.attrs.get("href") == f"mailto:{address}":
            text = a.joined()
            if text and text != address:
                return text
            for up in a.ancestors():
                said = "".join(up.texts())
                if (bare := "".join(said.split())) and bare != address:
                    return said.strip()
    return None


def phone_label(doc: Document, number: str) -> str | None:
    for a in doc.by_tag.get("a", ()):
        if a.attrs.get("href") == f"tel:{number}" and (text := a.joined()) and text != number:
            return text
    return None


def digits(number: str) -> str:
    return "".join(c for c in number if "0" <= c <= "9")


def phone_type(number: str) -> str:
    d = digits(number)
    if 10 <= len(d) <= 12 and (d[1:4] if d[0] == "1" and len(d) >= 11 else d[:3]) in _FREE:
        return "toll_free"
    if len(d) == 11 and d[0] == "1" and d[1] in "3456789":
        return "mobile"
    return "landline" if d.startswith("0") and 10 <= len(d) <= 12 else "unknown"


def phones(doc: Document) -> list[dict]:
    out, seen = [], set()

    def add(number, label, kind):
        if (d := digits(number)) not in seen:
            seen.add(d)
            out.append({"number": number, "normalized": d, "label": label, "phone_type": kind})

    for a in doc.select('a[href^="tel:"]'):
        if number := _cut(a.attrs["href"], "tel:"):
            label = a.joined()
            add(number, label if label and label != number else None, phone_type(number))
    text = _body(doc)
    for m in _TOLLFREE.finditer(text):
        add(m[0], None, "toll_free")
    for m in _PHONE.finditer(text):
        add(m[0], None, phone_type(m[0]))
    return out


def _labelled(text, labels):
    low = text.lower()
    for label in labels:
        at = low.find(label)
        if at >= 0:
            rest = text[at + len(label) :].strip()
            colon = rest.find(":")
            if colon >= 0 and (value := rest[colon + 1 :].strip()):
                value = value.splitlines()[0].strip()
                if value and len(value.encode()) < 100:
                    return value
    return None


def address_parts(raw: str) -> dict:
    text = raw.strip()
    code = _POSTAL.search(text) or _POSTAL6.search(text)
    return {
        "raw": text, "street": text if len(text.encode()) < 200 else None,
        "city": _labelled(text, "city 城市 市 city/state".split()), "state": _labelled(text, ("state", "province", "省", "州")),
        "postal_code": code[0] if code else None, "country": _labelled(text, ("country", "国家", "country/region")),
        "coordinates": None,
    }


def _number(el):
    try:
        return float(el.attrs["content"] if "content" in el.attrs else el.joined())
    except ValueError:
        return None


def structured_addresses(doc: Document) -> list[dict]:
    out = []
    for el in doc.select('[itemscope][itemtype*="PostalAddress"]'):
        raw = el.joined()
        if not raw:
            continue

        def prop(name, el=el):
            for p in doc.select(f'[itemprop="{name}"]', el):
                if text := p.joined():
                    return p.attrs.get("content") or text
            return None

        spot = None
        if (geo := doc.first('[itemscope][itemtype*="GeoCoordinates"]', el)) is not None:
            lat, lng = (doc.first(f'[itemprop="{k}"]', geo) for k in ("latitude", "longitude"))
            if lat is not None and lng is not None and None not in (pair := (_number(lat), _number(lng))):
                spot = dict(zip(("latitude", "longitude"), pair))
        out.append(
            {
                "raw": raw, "street": prop("streetAddress"), "city": prop("addressLocality"), "state": prop("addressRegion"),
                "postal_code": prop("postalCode"), "country": prop("addressCountry"), "coordinates": spot,
            }
        )
    return out


def addresses(doc: Document) -> list[dict]:
    out = structured_addresses(doc)

    def add(raw):
        if raw and all(a["raw"] != raw for a in out):
            out.append(address_parts(raw) | {"raw": raw})

    for el in doc.select(".adr, .location, address, .contact-address, .address, [itemtype*=PostalAddress]"):
        add(el.joined())
    if not out:
        text = _body(doc)

        def placed(s):
            return _POSTAL.search(s) or _POSTAL6.search(s)

        def named(s):
            low = s.lower()
            return any(w in low for w in _STREET) or "postal code" in low

        if named(text) and placed(text):
            for line in text.splitlines():
                if named(line) or placed(line):
                    add(line.strip())
    return out


def platform(url: str) -> str:
    low = url.lower()
    return next((p for p, words in PLATFORMS if any(w in low for w in words)), "other")


def username(url: str, kind: str) -> str | None:
    parts = url.rstrip("/").split("/")
    if kind in ("facebook", "instagram", "pinterest", "snapchat", "tiktok", "twitter"):
        last = next((p for p in reversed(parts) if p and p != "www" and "." not in p), None)
        last = last.lstrip("@") if last is not None else ""
        return last if last and "#" not in last and "?" not in last else None
    if kind == "linkedin":
        at = next((k for k, p in enumerate(parts) if p in ("company", "in")), None)
        return parts[at + 1] if at is not None and at + 1 < len(parts) else None
    if kind == "github":
        return (parts[3] or None) if len(parts) > 3 else None
    if kind == "telegram":
        return parts[-1] if parts[-1] not in ("", "s") else None
    return None


def social_links(doc: Document) -> list[dict]:
    out, seen = [], set()

    def add(url, label):
        kind = platform(url)
        if kind != "other" and url not in seen:
            seen.add(url)
            out.append({"url": url, "platform": PLATFORM_NAMES.get(kind, kind), "username": username(url, kind), "label": label})

    for a in doc.select("a[href]"):
        href = a.attrs["href"].strip()
        if href and not href.startswith(("#", "javascript:")):
            add(href, a.joined() or None)
    for rel in ("me", "url", "social"):
        for el in doc.select(f'link[rel="{rel}"], a[rel="{rel}"]'):
            if "href" in el.attrs:
                add(el.attrs["href"], None)
    return out


def contact_page(doc: Document, base=None) -> str | None:
    for a in doc.select("a[href]"):
        href = a.attrs["href"].strip()
        if _CONTACT.search(href) or _CONTACT.search("".join(a.texts())):
            return href
    return None


def business_name(doc: Document) -> str | None:
    for el in doc.select("[itemtype*=Organization][itemscope] [itemprop=name]"):
        if name := el.attrs.get("content", "").strip() or el.joined():
            return name
    for el in doc.select('meta[property="og:site_name"]'):
        if name := el.attrs.get("content", "").strip():
            return name
    for el in doc.by_tag.get("title", ()):
        if full := el.joined():
            for cut in (" | ", *(f" {d} " for d in "-–—"), " |", " -"):
                name = full.split(cut)[0].strip()
                if name and len(name.encode()) < 80:
                    return name
            return full
    return None


def contacts(doc: Document, base=None) -> dict:
    return {
        "emails": emails(doc), "phones": phones(doc), "addresses": addresses(doc), "social_links": social_links(doc),
        "business_name": business_name(doc),
    }
