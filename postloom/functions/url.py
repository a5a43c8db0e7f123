"""The grammar of post URLs: classification, canonical form, cleaning and destination types.

Steps that many later expressions use are columns of their own, so that no expression is computed again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Hosts of the two platforms, and query parameters that only track.
X_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")
FACEBOOK_HOSTS = ("facebook.com", "www.facebook.com", "m.facebook.com", "web.facebook.com")
TRACKING = ("__cft__", "__tn__", "comment_id", "eid", "fbclid", "mibextid", "rdid")
RESERVED_PROFILE_WORDS = ("permalink.php", "story.php", "posts", "groups", "reel", "watch", "photo", "photos", "videos")
RESERVED_GROUP_WORDS = ("posts", "permalink", "user", "media", "members", "search")

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """The entities that occur in URLs; &amp; last, so that nothing is undone twice."""
    for name, mark in _ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def unquote(c: Column) -> Column:
    """Percent-decoding of a path: a plus stays, and so does what can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def quote(c: Column) -> Column:
    """Percent-encoding with no character safe but letters, digits and _.-~"""
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(F.url_encode(c) if a == "+" else c, F.lit(a), F.lit(b))
    return c


def query_values(query: Column, name: str) -> Column:
    """Decoded values of a parameter, blank ones dropped, in order."""
    own = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}=") & (F.length(p) > len(name) + 1))
    return F.transform(own, lambda p: F.coalesce(F.try_url_decode(F.substring(p, len(name) + 2, 1 << 30)), p))


def first_query_value(query: Column, name: str) -> Column:
    return F.nullif(strip(F.get(query_values(query, name), 0)), F.lit(""))


def with_url_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds _scheme, _host, _path, _query and _segments of a cleaned absolute URL."""
    clean = F.regexp_replace(strip(unescape(F.col(url))), r"[\t\r\n]", "")
    out = df.withColumn("_clean", clean)
    out = out.withColumns({
        "_scheme": F.lower(F.regexp_extract("_clean", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "_host": F.lower(F.regexp_extract("_clean", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)", 1)),
        "_path": F.regexp_replace(F.regexp_extract("_clean", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), ";[^/]*$", ""),
        "_query": F.regexp_extract("_clean", r"^[^?#]*\?([^#]*)", 1),
    })
    return out.withColumn("_segments", F.transform(F.filter(F.split("_path", "/"), lambda s: s != ""), unquote))


def classify(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds platform, post_id, canonical_url and context_type: all null where the URL is no supported post."""
    d = with_url_parts(df, url)
    seg = lambda k: F.get("_segments", F.lit(k))
    n, web = F.size("_segments"), F.col("_scheme").isin("http", "https")
    digits = lambda c: c.rlike(r"^\p{Nd}+$")
    fb_id = lambda c: digits(c) | (c.startswith("pfbid") & c.rlike(r"^[\p{L}\p{N}]+$"))
    on_x, on_fb = web & F.col("_host").isin(*X_HOSTS), web & F.col("_host").isin(*FACEBOOK_HOSTS)
    d = d.withColumns({"_fbid": F.when(on_fb & (n == 1), first_query_value(F.col("_query"), "story_fbid")),
                       "_acct": F.when(on_fb & (n == 1), first_query_value(F.col("_query"), "id"))})
    none = F.lit(None).cast("string")

    def post(platform: str, post_id: Column, canonical: Column, context: Column = none) -> Column:
        return F.struct(F.lit(platform).alias("platform"), post_id.alias("post_id"), canonical.alias("canonical_url"), context.alias("context_type"))

    x = (
        F.when((n >= 4) & (seg(0) == "i") & (seg(1) == "web") & (seg(2) == "status"),
               F.when(digits(seg(3)), post("x", seg(3), F.concat(F.lit("https://x.com/i/web/status/"), seg(3)))))
        .when((n >= 3) & (seg(1) == "status") & digits(seg(2)),
              post("x", seg(2), F.concat(F.lit("https://x.com/"), quote(seg(0)), F.lit("/status/"), seg(2))))
    )
    fb = (
        F.when((n >= 4) & (seg(0) == "groups") & seg(2).isin("posts", "permalink"), F.when(fb_id(seg(3)), post(
            "facebook", seg(3), F.concat(F.lit("https://www.facebook.com/groups/"), quote(seg(1)), F.lit("/posts/"), quote(seg(3))), F.lit("group"))))
        .when((n >= 3) & (seg(1) == "posts"), F.when(fb_id(seg(2)), post(
            "facebook", seg(2), F.concat(F.lit("https://www.facebook.com/"), quote(seg(0)), F.lit("/posts/"), quote(seg(2))), F.lit("profile"))))
        .when((n == 1) & seg(0).isin("permalink.php", "story.php") & F.col("_fbid").rlike(r"^[\p{L}\p{N}]+$"), post(
            "facebook", F.col("_fbid"), F.concat(
                F.lit("https://www.facebook.com/"), seg(0), F.lit("?story_fbid="), quote(F.col("_fbid")),
                F.coalesce(F.concat(F.lit("&id="), quote(F.col("_acct"))), F.lit("")))))
    )
    d = d.withColumn("_post", F.when(on_x, x).when(on_fb, fb))
    # a generator is a border that no filter is pushed through, so the grammar is evaluated once a row
    return d.select(*df.columns, F.inline(F.array("_post")))


def clean_tracking(url: Column) -> Column:
    """The URL without tracking parameters (exact names only), blank parameters, closing slashes and fragment."""
    u = strip(url)
    base = F.regexp_replace(F.regexp_extract(u, r"^([^?#]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]*=."))
    form = lambda c: F.url_encode(F.coalesce(F.try_url_decode(c), c))
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(pairs, lambda p: ~F.coalesce(F.try_url_decode(name(p)), name(p)).isin(*TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(
        form(name(p)), F.lit("="), form(F.substring(p, F.length(name(p)) + 2, F.length(p))))), "&")
    return F.when(query == "", base).otherwise(F.concat_ws("?", base, query))


def destination_type(path: Column, query: Column) -> Column:
    """Where a final URL leads; the tests are in order of precedence."""
    p = F.lower(path)
    return (
        F.when((p == "/login") | p.startswith("/login/"), "login")
        .when(p.startswith("/watch/") | ((p == "/watch") & query.rlike("(^|&)v=.")), "watch")
        .when(p.contains("/videos/"), "video").when(p.startswith("/reel/") | p.startswith("/reels/"), "reel")
        .when(p.contains("/groups/"), "group").when(p.contains("/posts/"), "standard_post")
        .when(p.rlike(r"/(story|permalink)\.php$"), "story_or_permalink").otherwise("unknown")
    )


def strip_query_fragment(url: Column) -> Column:
    """An absolute URL without query, fragment and closing slashes; null where it isn't absolute."""
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.regexp_replace(F.regexp_replace(url, "[?#].*", ""), "/+$", ""))


def preflight_accepted(kind: Column, login: Column, unavailable: Column, signal: Column, error: Column) -> Column:
    return kind.isin("standard_post", "story_or_permalink") & ~login & ~unavailable & signal & error.isNull()


def rejection_reason(kind: Column, login: Column, unavailable: Column, signal: Column, error: Column) -> Column:
    """Why a preflight was rejected; messages are fixed values of the format."""
    return (
        F.when(error != "", F.concat(F.lit("Preflight failed: "), error))
        .when(login, "Redirected to Facebook login").when(unavailable, "Facebook reported unavailable content")
        .when(kind.isin("watch", "video"), "Unsupported Facebook Watch/video destination")
        .when(kind == "reel", "Unsupported Facebook Reel destination")
        .when(kind == "group", "Unsupported Facebook group destination")
        .when(kind == "unknown", "Unknown Facebook final destination")
        .when(~signal, "No plausible post semantic signal found").otherwise("Rejected by conservative preflight rules")
    )


def is_profile_url(host: Column, path: Column) -> Column:
    first = F.regexp_extract(path, "^/*([^/]*)", 1)
    allowed = F.coalesce(host, F.lit("")).isin("", "facebook.com", "www.facebook.com", "m.facebook.com")
    return allowed & (is_group_user_path(path) | ((first != "") & ~first.isin(*RESERVED_PROFILE_WORDS)))


def normalize_profile_url(path: Column) -> Column:
    inner = F.regexp_replace(path, "^/+|/+$", "")
    member = F.regexp_extract(inner, "^(groups/[^/]+/user/[^/]+)", 1)
    return F.regexp_replace(F.concat(F.lit("https://www.facebook.com/"), F.when(is_group_user_path(path), member).otherwise(inner)), "/+$", "")


def is_login_path(path: Column) -> Column:
    return path.rlike("^/login(/.*)?$")


def is_group_user_path(path: Column) -> Column:
    return path.rlike("^/?groups/[^/]+/user/[^/]+")


def group_url(url: Column, strict: bool = False) -> Column:
    """The group's root of a group URL; strict: null for posts, members and other inner pages."""
    group = F.regexp_extract(url, r"/groups/([^/?#]+)", 1)
    inner = F.regexp_extract(url, r"/groups/[^/?#]+/([^/?#]+)", 1).isin(*RESERVED_GROUP_WORDS) if strict else F.lit(False)
    return F.when((group != "") & ~inner, F.concat(F.lit("https://www.facebook.com/groups/"), group))


def comment_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]comment_id=([^&#]+)", 1), F.lit(""))
