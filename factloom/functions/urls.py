"""URL scalars as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells an article's address from others.
STATIC_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3")
BLOCKED_HINTS = ("/lien-he", "/gioi-thieu", "/about", "/careers", "/tuyen-dung", "/privacy", "/dieu-khoan", "/tag/", "/video/", "/podcast/", "/rss", "/search")
ARTICLE_HINTS = ("tin", "news", "article", "chi-tiet", "su-kien", "ngan-hang", "tai-chinh", "kinh-doanh")
ARTICLE_ENDINGS = (".html", ".htm", ".chn", ".aspx", ".cms")
BOT_WALL = ("access denied", "forbidden", "just a moment", "captcha", "cloudflare", "verify you are human")


def host(url: Column) -> Column:
    """The part between the scheme and the path, as written; empty if there is none."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(netloc: Column) -> Column:
    """Lower case, without user, port and a leading www."""
    bare = F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), ":.*$", "")
    return F.regexp_replace(F.trim(F.lower(bare)), "^www\\.", "")


def same_domain(base: Column, candidate: Column) -> Column:
    """Whether the candidate is the base domain or below it; false if either is empty."""
    b, c = domain(base), domain(candidate)
    return (b != "") & (c != "") & ((b == c) | F.endswith(c, F.concat(F.lit("."), b)))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def slug(url: Column, most: int = 60) -> Column:
    """The path with underscores, its last ``most`` characters; "post" if empty."""
    flat = F.replace(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.when(flat == "", F.lit("post")).otherwise(F.right(flat, F.lit(most)))


def skip_href(href: Column) -> Column:
    """Whether a link target leads nowhere: empty, mail, telephone or a fragment."""
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (low == "") | low.startswith("mailto:") | low.startswith("tel:") | low.startswith("#")


def variants(url: Column) -> Column:
    """The address and its twin with or without www."""
    bare = F.regexp_replace(url, "^([A-Za-z]+://)www\\.", "$1")
    twin = F.when(bare != url, bare).otherwise(F.regexp_replace(url, "^([A-Za-z]+://)", "$1www."))
    return F.array_distinct(F.array(url, twin))


def _any_of(column: Column, parts: tuple[str, ...], how: str) -> Column:
    return F.greatest(*[getattr(column, how)(x) for x in parts])


def blocked(url: Column) -> Column:
    """Whether an address is a file or lies in a section without articles."""
    return _any_of(F.lower(path(url)), STATIC_ENDINGS, "endswith") | _any_of(F.lower(url), BLOCKED_HINTS, "contains")


def article_score(url: Column, title: Column) -> Column:
    """Points for looking like an article; 0 for roots, files and blocked sections. Articles have 2 or more."""
    low, p = F.lower(url), F.lower(path(url))
    points = (
        F.when(low.rlike(r"(?:^|[/-])20\d{2}(?:[/-]|$)"), 2).otherwise(0)
        + F.when(_any_of(p, ARTICLE_ENDINGS, "endswith"), 2).otherwise(0)
        + F.when(_any_of(low, ARTICLE_HINTS, "contains"), 1).otherwise(0)
        + F.when(F.length(p) - F.length(F.replace(p, F.lit("/"))) >= 2, 1).otherwise(0)
        + F.when(F.length(F.coalesce(title, F.lit(""))) >= 20, 1).otherwise(0)
    )
    return F.when((p == "") | (p == "/") | blocked(url), 0).otherwise(points)


def behind_bot_wall(content: Column) -> Column:
    """Whether a short text is the notice of a bot wall."""
    low = F.lower(content)
    return F.greatest(*[low.contains(h) for h in BOT_WALL]) & (F.length(content) < 2500)


def first_match(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


# Where an address carries the id of a user, a group or a post.
USER_IDS = (r"profile\.php\?id=(\d+)", r"/profile/(\d+)", r"id=(\d+)")
GROUP_IDS = (r"/groups/(\d+)", r"group_id=(\d+)", r"gid=(\d+)")
POST_IDS = (r"/posts/(?:[^/]+/)?(\d+)", r"story_fbid=(\d+)")


def user_id(url: Column) -> Column:
    return first_match(url, *USER_IDS)


def group_id(url: Column) -> Column:
    return first_match(url, *GROUP_IDS)


def post_id(url: Column) -> Column:
    return first_match(url, *POST_IDS)


def display_host(url: Column) -> Column:
    """The host for display; of an invalid address the first 40 characters and three dots."""
    h = F.lower(F.regexp_replace(host(url), "^.*@|:[0-9]*$", ""))
    return F.when(h != "", F.regexp_replace(h, "^www\\.", "")).otherwise(F.concat(F.substring(url, 1, 40), F.lit("...")))


def feed_kind(link: Column) -> Column:
    """"group" for links to groups, else "page"."""
    return F.when(link.contains("/groups/") | link.contains("/group/"), "group").otherwise("page")
