"""Source and channel URLs: platform, id, whether the id is provisional."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of precedence: platform, pattern behind a host boundary, provisional.
SOURCES = (
    ("douyin", r"douyin\.com/video/(\d+)", False),
    ("douyin", r"douyin\.com/note/(\d+)", False),
    ("douyin", r"douyin\.com/[\w/-]*\?(?:.*&)?modal_id=(\d+)", False),
    ("douyin", r"v\.douyin\.com/([A-Za-z0-9_-]+)", True),
    ("douyin", r"iesdouyin\.com/share/video/(\d+)", False),
    ("bilibili", r"bilibili\.com/video/(BV[A-Za-z0-9]+)", False),
    ("bilibili", r"b23\.tv/([A-Za-z0-9]+)", True),
    ("kuaishou", r"kuaishou\.com/short-video/([A-Za-z0-9_-]+)", False),
    ("kuaishou", r"v\.kuaishou\.com/([A-Za-z0-9]+)", True),
    ("xiaohongshu", r"xiaohongshu\.com/explore/([a-f0-9]+)", False),
    ("xiaohongshu", r"xhslink\.com/([A-Za-z0-9]+)", True),
    ("weibo", r"weibo\.com/tv/show/([\w:-]+)", False),
    ("weibo", r"video\.weibo\.com/show\?fid=([\w:-]+)", False),
    ("youtube", r"youtube\.com/watch\?(?:.*&)?v=([\w-]+)", False),
    ("youtube", r"youtube\.com/shorts/([\w-]+)", False),
    ("youtube", r"youtu\.be/([\w-]+)", False),
    ("tiktok", r"tiktok\.com/@[\w.-]+/video/(\d+)", False),
    ("tiktok", r"vm\.tiktok\.com/([A-Za-z0-9]+)", True),
    ("tiktok", r"tiktok\.com/t/([A-Za-z0-9]+)", True),
    ("instagram", r"instagram\.com/(?:reels?|p|tv)/([\w-]+)", False),
    ("facebook", r"facebook\.com/reel/(\d+)", False),
    ("facebook", r"facebook\.com/watch/?\?(?:.*&)?v=(\d+)", False),
    ("facebook", r"facebook\.com/[\w.]+/videos/(\d+)", False),
    ("facebook", r"fb\.watch/([\w-]+)", True),
    ("twitter", r"(?:twitter|x)\.com/\w+/status/(\d+)", False),
)
#: Domains whose platform is known where no pattern fits.
DOMAINS = (
    ("douyin.com", "douyin"), ("bilibili.com", "bilibili"), ("kuaishou.com", "kuaishou"), ("xiaohongshu.com", "xiaohongshu"), ("weibo.com", "weibo"), ("youtube.com", "youtube"),
    ("youtu.be", "youtube"), ("tiktok.com", "tiktok"), ("instagram.com", "instagram"), ("facebook.com", "facebook"), ("twitter.com", "twitter"), ("x.com", "twitter"),
)
#: Patterns of channel pages, without a host boundary.
CHANNELS = (
    ("douyin", r"douyin\.com/user/([A-Za-z0-9_-]+)"),
    ("bilibili", r"space\.bilibili\.com/(\d+)"),
    ("kuaishou", r"kuaishou\.com/profile/([A-Za-z0-9_-]+)"),
    ("xiaohongshu", r"xiaohongshu\.com/user/profile/([A-Za-z0-9_-]+)"),
)
#: How a platform's url is rewritten.
CANONICAL = {"douyin": "https://www.douyin.com/video/"}
BOUNDARY = r"(?:^|//|\.)"


def host_of(url: Column) -> Column:
    """The url's host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def source(url: Column) -> Column:
    """struct<platform, id, provisional, url> of a video's url; null unless it is http(s).

    The first pattern that fits decides; else the platform of a known domain or its subdomain, or "other", with a
    provisional id made of the url. A full id of a platform with a canonical form rewrites the url.
    """
    u = F.trim(url)
    made = F.concat(F.lit("u"), F.substring(F.md5(u), 1, 16))
    row = lambda p, i, provisional, target: F.struct(F.lit(p).alias("platform"), i.alias("id"), F.lit(provisional).alias("provisional"), target.alias("url"))
    host, out = host_of(u), row("other", made, True, u)
    for domain, platform in reversed(DOMAINS):
        out = F.when((host == domain) | host.endswith("." + domain), row(platform, made, True, u)).otherwise(out)
    for platform, pattern, provisional in reversed(SOURCES):
        regex = "(?U)" + BOUNDARY + pattern
        found = F.regexp_extract(u, regex, 1)
        target = u
        if platform in CANONICAL and not provisional:
            target = F.when(found.rlike("^[0-9]+$"), F.concat(F.lit(CANONICAL[platform]), found)).otherwise(u)
        out = F.when(u.rlike(regex), row(platform, found, provisional, target)).otherwise(out)
    return F.when(u.startswith("http://") | u.startswith("https://"), out)


def channel(url: Column) -> Column:
    """struct<platform, id> of a channel's url; null if no pattern fits."""
    u, out = F.trim(url), F.lit(None).cast("struct<platform:string,id:string>")
    for platform, pattern in reversed(CHANNELS):
        out = F.when(u.rlike(pattern), F.struct(F.lit(platform).alias("platform"), F.regexp_extract(u, pattern, 1).alias("id"))).otherwise(out)
    return F.when(u.startswith("http://") | u.startswith("https://"), out)
