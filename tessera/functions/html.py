"""HTML page to markdown text, a per-page helper run inside
Spark tasks. Built on the standard library parser (no third-party HTML
library is available); tolerant of unclosed tags, comments and ``</p>``
inside script strings (script and style content is skipped as raw text).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urlparse, urlunparse

# Fixed values that must equal the reference's for the same results.
KEPT_SCHEMES = ("http", "https", "file")
DROPPED_BLOCKS = ("script", "style")
WIKI_ADDRESS = r"^https?://[a-zA-Z]{2,3}\.wikipedia.org/"
VIDEO_ADDRESS = "https://www.youtube.com/watch?"
VIDEO_TITLE, VIDEO_DESCRIPTION = ("title", "og:title", "name"), ("description", "og:description")
VIDEO_STATS = {"Views": "interactionCount", "Keywords": "keywords", "Runtime": "duration"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BLOCKS = ("p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "tr",
          "blockquote", "pre")


def clean_href(href: str | None) -> str | None:
    """None for non-http(s)/file schemes; otherwise the href with its path
    re-escaped (quote(unquote(path)))."""
    if not href:
        return href
    try:
        p = urlparse(href)
    except ValueError:
        return None
    if p.scheme and p.scheme.lower() not in KEPT_SCHEMES:
        return None
    return urlunparse(p._replace(path=quote(unquote(p.path))))


class _ToMarkdown(HTMLParser):
    def __init__(self, only_id: str | None = None):
        super().__init__(convert_charrefs=True)
        self.only_id = only_id          # convert only inside the element with this id
        self.capture = only_id is None
        self.cap_tag: str | None = None
        self.cap_depth = 0
        self.main_title: list[str] | None = None
        self.in_main_title = False
        self.meta: dict[str, str] = {}
        self.out: list[str] = []
        self.skip = 0
        self.in_title = False
        self.title: list[str] = []
        self.in_body = False
        self.body_seen = False
        self.link: list | None = None  # [href, text parts]
        self.heading: list | None = None  # [level, text parts]

    def _emit(self, s: str):
        if not self.capture:
            return
        if self.link is not None:
            self.link[1].append(s)
        elif self.heading is not None:
            self.heading[1].append(s)
        else:
            self.out.append(s)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED_BLOCKS:
            self.skip += 1
            return
        if tag == "meta":
            for k in ("itemprop", "property", "name"):
                if k in a:
                    self.meta[a[k]] = a.get("content") or ""
                    break
        if tag == "span" and "mw-page-title-main" in (a.get("class") or "").split():
            self.in_main_title, self.main_title = True, []
        if self.only_id is not None:
            if self.cap_tag is None and a.get("id") == self.only_id:
                self.capture, self.cap_tag, self.cap_depth = True, tag, 1
                return
            if self.cap_tag == tag:
                self.cap_depth += 1
        if tag == "title":
            self.in_title = True
        elif tag == "body" and self.only_id is None:
            self.body_seen = True
            self.out = []  # only the body is converted when there is one
        elif tag in HEADINGS:
            self.heading = [HEADINGS[tag], []]
        elif tag == "a":
            self.link = [a.get("href"), []]
        elif tag == "img":
            src = a.get("src") or ""
            if src.startswith("data:"):
                src = src.split(",")[0] + "..."
            self._emit(f"![{a.get('alt') or ''}]({src})")
        elif tag == "br":
            self._emit("\n")
        elif tag == "li":
            self._emit("\n* ")
        elif tag in ("strong", "b"):
            self._emit("**")
        elif tag in ("em", "i"):
            self._emit("*")
        elif tag in BLOCKS:
            self._emit("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED_BLOCKS:
            self.skip = max(0, self.skip - 1)
            return
        if tag == "span" and self.in_main_title:
            self.in_main_title = False
        if self.only_id is not None and self.cap_tag == tag:
            self.cap_depth -= 1
            if self.cap_depth == 0:
                self.capture, self.cap_tag = False, None
                return
        if tag == "title":
            self.in_title = False
        elif tag in HEADINGS and self.heading is not None:
            level, parts = self.heading
            self.heading = None
            text = " ".join("".join(parts).split())
            if text:
                self.out.append("\n" + "#" * level + " " + text + "\n\n")
        elif tag == "a" and self.link is not None:
            href, parts = self.link
            self.link = None
            text = "".join(parts).strip()
            if not text:
                return
            h = clean_href(href)
            self._emit(f"[{text}]({h})" if h else text)
        elif tag in ("strong", "b"):
            self._emit("**")
        elif tag in ("em", "i"):
            self._emit("*")
        elif tag in BLOCKS:
            self._emit("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_main_title and self.main_title is not None:
            self.main_title.append(data)
        if self.in_title:
            self.title.append(data)
            return
        self._emit(re.sub(r"\s+", " ", data))


def _finish(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _parse(html: str, only_id: str | None = None) -> _ToMarkdown:
    p = _ToMarkdown(only_id)
    p.feed(html)
    p.close()
    return p


def html_to_markdown(html: str | None, url: str | None = None) -> tuple[str | None, str | None]:
    """(title, markdown) of a whole page; runs of 3+ newlines collapse to 2. The
    URL picks a site-specific extractor (D3)."""
    if html is None:
        return None, None
    route = route_for_url(url)
    if route == "wikipedia":
        p = _parse(html, only_id="mw-content-text")
        if p.cap_tag is not None or "".join(p.out).strip():
            title = ("".join(p.main_title).strip() if p.main_title else "".join(p.title).strip()) or None
            return title, _finish(f"# {title}\n\n" + "".join(p.out))
    p = _parse(html)
    if route == "youtube":
        return _video_page(p)
    return "".join(p.title).strip() or None, _finish("".join(p.out))


def _video_page(p: _ToMarkdown) -> tuple[str | None, str]:
    """D3: the metadata of a video page as sections; one without content is left out."""
    page_title = "".join(p.title).strip()
    first = lambda names: next((p.meta[n] for n in names if p.meta.get(n)), "")
    title = first(VIDEO_TITLE) or page_title
    stats = "".join(f"- **{label}:** {p.meta[name]}\n" for label, name in VIDEO_STATS.items() if p.meta.get(name))
    sections = [("## ", title, "\n"), ("### Video Metadata\n", stats, "\n"), ("### Description\n", first(VIDEO_DESCRIPTION), "\n")]
    return title or None, "# YouTube\n" + "".join(f"\n{head}{body}{end}" for head, body, end in sections if body)


def route_for_url(url: str | None) -> str:
    """D3: which extractor a URL goes to."""
    if url and re.search(WIKI_ADDRESS, url):
        return "wikipedia"
    return "youtube" if url and url.startswith(VIDEO_ADDRESS) else "generic"
