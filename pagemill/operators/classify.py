"""Classify captured responses: challenge pages, protection vendors, API endpoints. Nothing is fetched or answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Patterns by kind of challenge, in order; then those of unnamed ones.
CHALLENGES = (
    ("recaptcha_v2", r"google\.com/recaptcha|g-recaptcha|grecaptcha|recaptcha/api\.js"),
    ("hcaptcha", r"hcaptcha\.com|h-captcha"),
    ("cloudflare_turnstile", r"challenges\.cloudflare\.com|cf-turnstile|turnstile/v0/api\.js"),
    ("geetest", r"geetest\.com|geetest_|gt_lib|initgeetest"),
    ("funcaptcha", r"funcaptcha\.com|arkoselabs\.com|client-api\.arkoselabs"),
)
UNNAMED_CHALLENGE = r"checking your browser|just a moment\.\.\.|please verify you are a human|access denied|blocked"

# Signatures of vendors, in order: (vendor, headers with patterns, cookie name parts, body patterns, script patterns).
VENDORS = (
    ("cloudflare_bot_management", (("cf-ray", ".+"), ("cf-mitigated", ".+"), ("cf-chl-bypass", ".+")), ("cf_clearance", "cf_chl_"), ("challenge-platform", "cdn-cgi/challenge-platform", "Checking if the site connection is secure", "ray ID"), (r"challenges\.cloudflare\.com",)),
    ("cloudflare_turnstile", (("cf-ray", ".+"),), ("cf_clearance",), ("turnstile", r"challenges\.cloudflare\.com/turnstile", 'class="cf-turnstile"'), (r"challenges\.cloudflare\.com/turnstile",)),
    ("cloudflare_basic", (("cf-ray", ".+"), ("server", "cloudflare")), ("__cf_bm",), (), ()),
    ("akamai", (("x-akamai-transformed", ".+"), ("akamai-grn", ".+"), ("server", "AkamaiGHost")), ("_abck", "ak_bmsc", "bm_sz"), ("_acPuzzleEncoder", r"akamaized\.net"), ()),
    ("datadome", (("x-datadome", ".+"), ("x-dd-b", ".+"), ("server", "DataDome")), ("datadome",), ("datadome", r"dd\.js", r"geo\.captcha-delivery\.com"), (r"js\.datadome\.co",)),
    ("kasada", (("x-kpsdk-ct", ".+"), ("x-kpsdk-v", ".+")), ("_kpsdk",), (r"ips\.js", "kpsdk"), ()),
    ("perimeterx", (("x-px-block", ".+"),), ("_px", "_pxhd", "_pxvid"), ("perimeterx", "px-captcha", "human-challenge", r"captcha\.px-cdn\.net"), ()),
    ("aws_waf", (("x-amzn-waf-action", ".+"),), ("aws-waf-token",), ("aws-waf", r"captcha\.awswaf\.com"), ()),
    ("recaptcha", (), (), (r"google\.com/recaptcha", "g-recaptcha", "grecaptcha"), (r"www\.google\.com/recaptcha",)),
    ("hcaptcha", (), (), (r"hcaptcha\.com", "h-captcha"), (r"hcaptcha\.com",)),
)
POINTS = {"header": 2, "cookie": 3, "body": 1, "script": 2}
SAMPLE_CHARS = 10_240

# URLs that are no endpoints, URLs that are, and signs of paging in order.
IGNORED_URLS = (
    r"\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)(\?|$)|google-analytics\.com|googletagmanager\.com|facebook\.net|doubleclick\.net|"
    r"amazonaws\.com/analytics|sentry\.io|hotjar\.com|segment\.io|intercom\.io"
)
API_URLS = r"/api/|/v[0-9]+/|/graphql|/query|/search|/data|\.json$"
PAGING = (("offset", r"offset=|skip=|start="), ("cursor", r"cursor=|after=|before=|next_token="), ("page", r"page=|pagenumber=|p="))


def challenge_kind(html: Column) -> Column:
    """The kind of challenge a page holds, unknown for an unnamed one, null for none. Patterns run on lower case."""
    page = F.lower(html)
    out = F.when(F.rlike(page, F.lit(UNNAMED_CHALLENGE)), "unknown")
    for kind, pattern in reversed(CHALLENGES):
        out = F.when(F.rlike(page, F.lit(pattern)), kind).otherwise(out)
    return out


def signatures(spark: SparkSession) -> DataFrame:
    """VENDORS as rows (seq, vendor, kind, name, pattern), in lower case but for escapes. A few dozen rows."""
    rows = []
    for i, (vendor, headers, cookies, bodies, scripts) in enumerate(VENDORS):
        rows += [(i, vendor, "header", n, p.lower()) for n, p in headers] + [(i, vendor, "cookie", None, c.lower()) for c in cookies]
        rows += [(i, vendor, "body", None, p.lower()) for p in bodies] + [(i, vendor, "script", None, p.lower()) for p in scripts]
    return spark.createDataFrame(rows, "seq int, vendor string, kind string, name string, pattern string")


def _holds(part: str):
    return lambda name: F.contains(F.lower(name), F.lit(part))


def vendor_scores(responses: DataFrame, key: str, headers: str | None, cookies: str | None, body: str) -> DataFrame:
    """The vendor with the highest score of each response (first of ties), and confidence = score / 8, at most 1; none if no sign is found.

    headers and cookies are maps, or None. One expression a vendor: no join and no shuffle.
    """
    sample = F.lower(F.substring(F.col(body), 1, SAMPLE_CHARS))
    hit = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    names = F.map_from_entries(F.transform(F.map_entries(F.col(headers)), lambda e: F.struct(F.lower(e["key"]), F.lower(e["value"])))) if headers else None
    scored = []
    for i, (vendor, hs, cs, bodies, scripts) in enumerate(VENDORS):
        total = F.lit(0)
        if names is not None:
            for name, pattern in hs:
                total = total + hit(F.rlike(F.element_at(names, F.lit(name)), F.lit(pattern.lower())), POINTS["header"])
        if cookies:
            for part in cs:
                total = total + POINTS["cookie"] * F.coalesce(F.size(F.filter(F.map_keys(F.col(cookies)), _holds(part.lower()))), F.lit(0))
        for pattern, kind in [*((p, "body") for p in bodies), *((p, "script") for p in scripts)]:
            total = total + hit(F.rlike(sample, F.lit(pattern.lower())), POINTS[kind])
        scored.append(F.struct(total.alias("score"), F.lit(-i).alias("first"), F.lit(vendor).alias("vendor")))
    best = F.array_max(F.array(*scored))
    out = responses.select(key, best.alias("b"))
    return out.select(key, F.when(F.col("b.score") > 0, F.col("b.vendor")).otherwise("none").alias("vendor"), F.when(F.col("b.score") > 0, F.least(F.col("b.score") / 8, F.lit(1.0))).otherwise(1.0).alias("confidence"))


def paging_kind(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PAGING):
        out = F.when(F.rlike(F.lower(url), F.lit(pattern)), kind).otherwise(out)
    return out


def endpoints(requests: DataFrame) -> DataFrame:
    """API endpoints among captured requests (url, method, status, mime_type, headers): kind, paging, auth_type.

    Kept are answers of 200 to 399 that are neither static nor analytics and look like JSON, GraphQL or an API path.
    auth_type is told from an `authorization` header in lower case; other spellings are "unknown".
    """
    url = F.lower("url")
    json = F.contains(F.coalesce("mime_type", F.lit("")), F.lit("json")) | F.contains(url, F.lit("json"))
    graphql, api = F.contains(url, F.lit("graphql")), F.rlike(url, F.lit(API_URLS))
    kept = requests.where(F.col("status").between(200, 399) & ~F.rlike(url, F.lit(IGNORED_URLS)) & (json | graphql | api))
    has = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "authorization")
    value = F.element_at("headers", F.lit("authorization"))
    auth = F.when(F.coalesce(has, F.lit(False)), F.when(F.startswith(value, F.lit("Bearer")), "bearer").when(F.startswith(value, F.lit("Basic")), "basic").otherwise("custom"))
    return kept.withColumns({"kind": F.when(graphql, "graphql").when(json, "json").otherwise("other"), "paging": paging_kind(F.col("url")), "auth_type": auth})


def endpoint_report(requests: DataFrame, domain: Column) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return endpoints(requests).groupBy(domain.alias("domain")).agg(n("json"), n("graphql"), n("other"), F.count("paging").alias("paged"))


def best_signature(scores: DataFrame, key: str) -> DataFrame:
    """The best of several scored rows of each key: highest score, then first in sequence."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "seq"))
    return scores.withColumn("place", place).where("place = 1").drop("place")
