"""Configuration records; presets as class methods."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ParserConfig:
    extract_links: bool = True
    extract_images: bool = True
    extract_tables: bool = True
    extract_code_blocks: bool = True
    extract_structured_data: bool = True
    compute_readability: bool = False
    min_paragraph_length: int = 20
    content_selectors: tuple[str, ...] = ()

    @classmethod
    def minimal(cls):
        return cls(extract_images=False, extract_tables=False, extract_code_blocks=False, extract_structured_data=False)

    @classmethod
    def full(cls):
        return cls(compute_readability=True)

    def add_content_selector(self, css: str) -> ParserConfig:
        return replace(self, content_selectors=(*self.content_selectors, css))


@dataclass(frozen=True)
class DownloadConfig:
    max_file_size: int | None = 50 << 20
    max_concurrent: int = 10
    timeout_secs: int = 30
    encode_base64: bool = False
    max_retries: int = 2
    retry_delay_ms: int = 1000
    user_agent: str = "pagelake"


@dataclass(frozen=True)
class MediaConfig:
    extract_images: bool = True
    extract_videos: bool = True
    extract_audio: bool = True
    extract_documents: bool = True
    extract_embeds: bool = True
    extract_links: bool = True
    include_data_urls: bool = False
    filter_placeholders: bool = True
    min_image_width: int | None = None
    min_image_height: int | None = None
    download: DownloadConfig = field(default_factory=DownloadConfig)

    @classmethod
    def minimal(cls):
        return cls(extract_videos=False, extract_audio=False, extract_documents=False, extract_embeds=False)

    @classmethod
    def full(cls):
        return cls(include_data_urls=True)


@dataclass(frozen=True)
class FetchConfig:
    timeout_secs: float = 30.0
    max_redirects: int = 10
    max_retries: int = 3
    max_concurrent: int = 16
    user_agent: str | None = None
    random_user_agent: bool = True
    name: str = "http"
    proxy_url: str | None = None
    proxy_user: str | None = None
    proxy_pass: str | None = None


@dataclass(frozen=True)
class SiteConfig:
    """A site to scrape: where its list of articles is, and the selectors of what is wanted."""

    name: str
    url: str
    list_selector: str = "body"
    link_selector: str = "a[href]"
    title_selector: str = "h1"
    content_selector: str = "article"
    enabled: bool = True


@dataclass(frozen=True)
class LimitRule:
    domain_glob: str = "*"
    parallelism: int = 1
    delay_s: float = 0.0
    random_delay_s: float = 0.0

    @property
    def pattern(self) -> str:
        """The glob as an unanchored regular expression; only * is special, a dot stays a wild card."""
        return self.domain_glob.replace("*", ".*")


def valid_patterns(patterns) -> tuple[str, ...]:
    """Those that compile; the others are silently dropped."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return tuple(out)


@dataclass(frozen=True)
class CrawlConfig:
    follow_links: bool = False
    max_depth: int = 10
    #: seeds or URLs that a level has under way at once; 0: the greatest parallelism of any rule, else 16
    max_concurrency: int = 0
    headers: tuple[tuple[str, str], ...] = ()
    link_selector: str = "a[href]"
    link_selector_type: str = "css"
    detect_bot_challenge: bool = True
    detect_access_denied: bool = True
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    disallowed_domains: tuple[str, ...] = ()
    limits: tuple[LimitRule, ...] = ()

    def add_url_filter(self, pattern: str) -> CrawlConfig:
        return replace(self, allow=(*self.allow, *valid_patterns([pattern])))

    def add_disallowed_url_filter(self, pattern: str) -> CrawlConfig:
        return replace(self, deny=(*self.deny, *valid_patterns([pattern])))

    @property
    def concurrency(self) -> int:
        return self.max_concurrency or max((r.parallelism for r in self.limits), default=16)

    def add_limit(self, *rules: LimitRule) -> CrawlConfig:
        return replace(self, limits=(*self.limits, *rules))


@dataclass(frozen=True)
class UrlRule:
    name: str = "default"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    link_selector: str | None = None

    def with_include(self, pattern: str) -> UrlRule:
        re.compile(pattern)
        return replace(self, include=(*self.include, pattern))

    def with_exclude(self, pattern: str) -> UrlRule:
        re.compile(pattern)
        return replace(self, exclude=(*self.exclude, pattern))


@dataclass(frozen=True)
class ExtractorConfig:
    score_threshold: float = 1.5
    cluster_depth: int = 4
    cluster_min_size: int = 4
    min_text_len: int = 8
    use_url_rule: bool = True
    non_article_paths: tuple[str, ...] = tuple(
        """/sitemap /faq /donate /support- /whistleblower /ranking-member /chairman- /subcommittee- /committee-
        /jurisdiction /internships /press-inquiries /accessibility /subscribe /terms /copyright /join /privacy /board/
        /leadership/ /staff/ /careers/ /contact/ /about/ /team/ /people/""".split()
    )
