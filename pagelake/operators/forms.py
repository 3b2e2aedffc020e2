"""Forms of a parsed page: fields, labels, purpose, token and challenge flags."""

from __future__ import annotations

from .dom import Document

INPUTS = frozenset("color date email number password range search tel text textarea time url".split())
_TYPES = INPUTS | frozenset("button checkbox file hidden radio submit".split()) - {"textarea"}
_CSRF = ("csrf", "token", "xsrf")
_CAPTCHA = ("captcha", "turnstile", "security_code", "verification_code")
FORM_TYPES = "checkout comment contact login newsletter password_reset registration search unknown upload".split()
#: purpose by words in names, ids and action of a form without a password field, first hit wins
_PURPOSE = (
    ("search", ("find", "q=", "query", "search")),
    ("upload", ("attachment", "file", "upload")),
    ("contact", ("contact", "enquiry", "feedback", "inquiry", "support")),
    ("newsletter", ("mailing_list", "newsletter", "subscribe", "subscription")),
    ("checkout", ("billing", "cart", "checkout", "order", "payment")),
    ("comment", ("comment", "reply")),
    ("registration", ("create_account", "register", "registration", "sign_up", "signup")),
)
_LOGIN = ("log-in", "log_in", "login", "sign_in", "signin")
_REGISTER = ("create-account", "create_account", "register", "sign-up", "sign_up", "signup")
_RESET = ("forgot-password", "forgot_password", "password_reset", "recover", "reset-password", "reset_password")
FIELD = (
    "struct<name:string,id:string,field_type:string,label:string,placeholder:string,value:string,required:boolean,"
    "disabled:boolean,readonly:boolean,autocomplete:string,pattern:string,min_length:bigint,max_length:bigint,"
    "options:array<struct<value:string,label:string,selected:boolean>>>"
)
SCHEMA = (
    "array<struct<id:string,name:string,action:string,method:string,enctype:string,"
    f"fields:array<{FIELD}>,form_type:string,has_csrf:boolean,has_captcha:boolean,submit_text:string>>"
)


def _size(value):
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


def field_type(kind):
    if kind is None:
        return "text"
    kind = kind.strip().lower()
    return kind if kind in _TYPES else "unknown"


def _field(doc, el):
    a = el.attrs.get
    out = dict(name=a("name"), id=a("id"), field_type=el.tag, label=None, placeholder=None, value=None,
               required="required" in el.attrs, disabled="disabled" in el.attrs, readonly=False, autocomplete=None,
               pattern=None, min_length=None, max_length=None, options=[])
    if el.tag == "select":
        for o in doc.select("option", el):
            value = o.attrs.get("value", "")
            out["options"].append({"value": value, "label": o.joined(" ") or value, "selected": "selected" in o.attrs})
        return out
    out |= {"placeholder": a("placeholder"), "readonly": "readonly" in el.attrs, "max_length": _size(a("maxlength"))}
    if el.tag == "textarea":
        return out | {"value": el.joined(" ")}
    return out | {
        "field_type": field_type(a("type")), "value": a("value"), "autocomplete": a("autocomplete"),
        "pattern": a("pattern"), "min_length": _size(a("minlength")),
    }


def has_csrf(fields) -> bool:
    return any(f["field_type"] == "hidden" and any(p in (f["name"] or "").lower() for p in _CSRF) for f in fields)


def has_captcha(fields) -> bool:
    return any(p in ((f[k] or "").lower()) for f in fields for k in ("name", "id") for p in _CAPTCHA)


def form_type(form) -> str:
    fields = form["fields"]
    kinds = {f["field_type"] for f in fields}
    names = [f["name"].lower() for f in fields if f["name"] is not None]
    said = names + [f["id"].lower() for f in fields if f["id"] is not None]
    said += [(form[k] or "").lower() for k in ("name", "id", "action")]

    text = "\n".join(said)  # no word holds a line break

    def any_of(words):
        return any(w in text for w in words)

    if "password" in kinds:
        if any_of(_LOGIN):
            return "login"
        if any_of(_REGISTER):
            return "registration"
        if "email" in kinds and any("remember" in n or "stay" in n for n in names):
            return "login"
        return "password_reset" if any_of(_RESET) else "login"
    for kind, words in _PURPOSE:
        if (kind == "search" and ("search" in kinds or "q" in said)) or (kind == "upload" and "file" in kinds) or any_of(words):
            return kind
    return "unknown"


def _submit_text(doc, el):
    for b in doc.select("button[type=submit], input[type=submit]", el):
        text = b.attrs.get("value")
        if b.tag == "button":
            text = b.joined(" ") or text
        if text is not None:
            return text
    return None


def _label(doc, fields):
    """Labels by their for attribute, else by the control that stands directly inside; a field's first label wins."""
    by_id = {f["id"]: f for f in fields if f["id"] is not None}
    with_id = list(by_id.values())
    for el in doc.by_tag.get("label", ()):
        field = by_id.get(el.attrs["for"]) if "for" in el.attrs else None
        if field is None:
            control = next((c for c in el.elements() if c.tag in ("input", "select", "textarea")), None)
            if control is None:
                continue
            field = by_id.get(control.attrs.get("id")) if "id" in control.attrs else None
            if field is None and "name" in control.attrs:
                field = next((f for f in with_id if f["name"] == control.attrs["name"]), None)
        if field is not None and field["label"] is None:
            field["label"] = el.joined(" ")
    return [f for f in fields if f["id"] is None or by_id[f["id"]] is f]


def forms(doc: Document, base=None) -> list[dict]:
    """Every form; fields in document order (of fields that share an id the last one counts)."""
    out = []
    for el in doc.by_tag.get("form", ()):
        a = el.attrs.get
        method = a("method", "get").strip().lower()
        form = {"id": a("id"), "name": a("name"), "action": a("action"), "method": method if method in ("post", "dialog") else "get"}
        form |= {"enctype": a("enctype"), "fields": [_field(doc, f) for f in doc.select("input, select, textarea", el)]}
        form |= {"has_csrf": has_csrf(form["fields"]), "has_captcha": has_captcha(form["fields"])}
        form |= {"form_type": form_type(form), "submit_text": _submit_text(doc, el)}
        out.append(form | {"fields": _label(doc, form["fields"])})
    return out
