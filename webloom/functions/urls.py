"""URL scalars as Column expressions: normalising, domains, keys, mirror paths, scope and status rules."""

from __future__ import annotations

import posixpath
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", r"^[^?#]*\?([^#]*)", r"#(.*)$",
)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def host(u: Column) -> Column:
    """Lower-cased host without user and port; '' where the URL has none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, AUTHORITY, 1), r"^.*@", ""), r":[0-9]*$", ""))


def port(u: Column) -> Column:
    """Port unless it is the scheme's own; ''."""
    p = F.regexp_extract(F.regexp_extract(u, AUTHORITY, 1), r":([0-9]+)$", 1)
    return F.when((scheme(u) == "http") & (p == "80") | (scheme(u) == "https") & (p == "443"), "").otherwise(p)


def path(u: Column) -> Column:
    p = F.regexp_extract(u, PATH, 1)
    return F.when(p == "", "/").otherwise(p)


def query(u: Column) -> Column:
    """'?' and the query, or ''."""
    return F.when(u.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), F.regexp_extract(u, QUERY, 1))).otherwise("")


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, FRAGMENT, 1)


def parses(u: Column) -> Column:
    return u.isNotNull() & (host(u) != "")


def userinfo(u: Column) -> Column:
    """User and password with the '@', or ''."""
    return F.regexp_extract(F.regexp_extract(u, AUTHORITY, 1), r"^(.*@)", 1)


def with_parts(u: Column, **parts: Column) -> Column:
    """The URL with some of its parts replaced: scheme, user ('name' or 'name:password'), host, port, path, query, fragment.

    Parts come without their marks; an empty one goes, but for the path, which then is '/'. A default port is left
    out. Null for a URL that doesn't parse, and where a new part is null.
    """
    if unknown := set(parts) - {"scheme", "user", "host", "port", "path", "query", "fragment"}:
        raise ValueError(f"no part of a URL: {sorted(unknown)}")
    s = F.lower(parts["scheme"]) if "scheme" in parts else scheme(u)
    p = parts["port"].cast("string") if "port" in parts else port(u)
    p = F.when((s == "http") & (p == "80") | (s == "https") & (p == "443"), "").otherwise(p)
    marked = lambda mark, x, behind=False: F.when(x == "", "").otherwise(F.concat(x, F.lit(mark)) if behind else F.concat(F.lit(mark), x))
    way = F.concat(F.lit("/"), F.regexp_replace(parts["path"], "^/", "")) if "path" in parts else path(u)
    return F.when(parses(u), F.concat(
        s, F.lit("://"), marked("@", parts["user"], True) if "user" in parts else userinfo(u), F.lower(parts["host"]) if "host" in parts else host(u), marked(":", p), way,
        marked("?", parts["query"]) if "query" in parts else query(u), marked("#", parts["fragment"] if "fragment" in parts else fragment(u)),
    ))


def path_segments(u: Column) -> Column:
    """The path's parts between slashes; the root has one, which is empty."""
    return F.split(F.regexp_replace(path(u), "^/", ""), "/", -1)


def origin(u: Column) -> Column:
    return F.concat(scheme(u), F.lit("://"), host(u), F.when(port(u) == "", "").otherwise(F.concat(F.lit(":"), port(u))))


def normalize_url(u: Column) -> Column:
    """No fragment, user or default port, one trailing slash less, query kept; what doesn't parse is lower-cased."""
    p = path(u)
    p = F.when(p != "/", F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(parses(u), F.concat(origin(u), p, query(u))).otherwise(F.lower(u))


normalize_for_lookup = normalize_url


def link_domain(u: Column) -> Column:
    return F.coalesce(host(u), F.lit(""))


def rate_domain(u: Column) -> Column:
    """What is between '://' and any of / ? # :, without a lower-case 'www.', lower-cased; works without a scheme."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(u, r"^.*?://", ""), r"^([^/?#:]*)", 1), r"^www\.", ""))


def breaker_domain(u: Column) -> Column:
    """The host, null where there is none."""
    return F.when(host(u) != "", host(u))


def index_domain(u: Column) -> Column:
    """What follows http(s):// up to the next slash: port, user and query stay."""
    return F.regexp_extract(F.regexp_replace(u, r"^https?://", ""), r"^([^/]*)", 1)


def cache_key(u: Column) -> Column:
    """scheme://host/path without trailing slashes, query, fragment and port; null where it doesn't parse."""
    p = F.regexp_replace(path(u), "/+$", "")
    return F.when(parses(u), F.concat(scheme(u), F.lit("://"), host(u), F.when(p == "", "/").otherwise(p)))


def download_key(u: Column) -> Column:
    """No default port, no trailing slashes; query stays."""
    return F.when(parses(u), F.concat(origin(u), F.regexp_replace(path(u), "/+$", ""), query(u))).otherwise(u)


def start_url(u: Column) -> Column:
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def html_path_to_markdown(p: Column) -> Column:
    return F.replace(F.replace(p, F.lit("/index.html"), F.lit("/index.md")), F.lit(".html"), F.lit(".md"))


def output_dir(u: Column) -> Column:
    return F.replace(F.regexp_replace(host(u), r"[:/\\]", "_"), F.lit(".."), F.lit("_"))


def strip_weak_etag(e: Column) -> Column:
    return F.regexp_replace(e, "^W/", "")


def is_valid_url(u: Column) -> Column:
    return F.coalesce(scheme(u).isin("http", "https") & parses(u), F.lit(False))


def mirror_path(u: Column, root: str, filename: str) -> Column:
    """root/host/path/filename; the root path adds no segment."""
    p = F.regexp_replace(path(u), r"^/+|/+$", "")
    return F.concat_ws("/", F.lit(root.rstrip("/")), host(u), F.when(p != "", p), F.lit(filename))


def uri_from_path(p: Column, root: str) -> Column:
    """The https URL of a mirrored file."""
    rest = F.regexp_replace(F.substr(p, F.lit(len(root.rstrip("/")) + 2)), "/[^/]*$", "")
    return F.concat(F.lit("https://"), rest)


def valid_domain(d: Column) -> Column:
    return F.coalesce(d.rlike(r"^[A-Za-z0-9.-]+$") & (F.length(d) <= 253) & ~d.rlike(r"^[.-]|[.-]$") & d.contains("."), F.lit(False))


def url_from_index_path(p: Column, root: str) -> Column:
    """https://domain/parts/ of root/domain/parts/index.md(.gz): null without a valid domain; odd parts are dropped."""
    rest = F.regexp_replace(F.substr(p, F.lit(len(root.rstrip("/")) + 2)), r"/index\.md(\.gz)?$", "")
    parts = F.split(rest, "/")
    kept = F.filter(parts, lambda x, i: (i > 0) & ~x.contains("..") & (F.octet_length(x) <= 255) & (x != ""))
    tail = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise("")
    return F.when(~rest.rlike(r"^index\.md(\.gz)?$") & valid_domain(parts[0]), F.concat(F.lit("https://"), parts[0], F.lit("/"), tail))


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, rel: pd.Series) -> pd.Series:
    def one(b, r):
        try:
            return urljoin(b, r)
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b, r) for b, r in zip(base, rel, strict=True)])


@F.pandas_udf(T.StringType())
def relative_path(from_file: pd.Series, to_file: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else posixpath.relpath(b, posixpath.dirname(a) or ".") for a, b in zip(from_file, to_file, strict=True)])


def excluded(u: Column, patterns: list[str]) -> Column:
    """Each pattern counts as an anchored glob (* alone is special, other regex characters act as such) and as a substring."""
    out = F.lit(False)
    for p in patterns:
        out = out | u.contains(p) | u.rlike("^" + p.replace("*", ".*") + "$")
    return out


def in_scope(u: Column, start: str, allowed_domains: list[str] | None = None, exclude: list[str] = ()) -> Column:
    """Same scheme and host as the start, an allowed domain or its subdomain, a path at or under the start's, not excluded."""
    s = F.lit(start)
    base = F.regexp_replace(path(s), "/+$", "")
    under = (F.regexp_replace(path(u), "/+$", "") == base) | path(u).startswith(F.concat(base, F.lit("/")))
    ok = parses(u) & (scheme(u) == scheme(s)) & (host(u) == host(s)) & under & ~excluded(u, list(exclude))
    if allowed_domains:
        near = F.lit(False)
        for d in allowed_domains:
            near = near | (host(u) == d) | host(u).endswith(f".{d}")
        ok = ok & near
    return F.coalesce(ok, F.lit(False))


def status_check(status: Column) -> Column:
    """(valid, confidence): an HTTP status from 400 on is invalid with 0.95; none is valid."""
    return F.when(status >= 400, F.struct(F.lit(False).alias("valid"), F.lit(0.95).alias("confidence"))).otherwise(F.struct(F.lit(True).alias("valid"), F.lit(1.0).alias("confidence")))


def content_type_checked(c: Column, most: int = 512) -> Column:
    """Short types pass; of longer ones the main type and the first charset stay, cut to the limit."""
    parts = F.split(c, ";")
    charset = F.filter(parts, lambda x: F.lower(F.trim(x)).startswith("charset="))
    return F.when(F.length(c) <= most, c).otherwise(F.substring(F.concat_ws("; ", F.trim(parts[0]), F.trim(F.get(charset, F.lit(0)))), 1, most))


#: Failure kinds by the first substring found in the lower-cased message, whether to retry, delay factor.
FAILURES = (
    ("rate_limited", ("429", "too many requests", "rate limit"), True, 3.0),
    ("network", ("timeout", "timed out", "connection refused", "connection reset", "dns", "network", "unreachable", "eof"), True, 1.0),
    ("browser", ("browser", "page", "chrome", "cdp", "target", "session"), True, 1.5),
    ("content_extraction", ("extract", "validation", "content", "html", "parse", "selector"), False, 1.0),
)


def failure_class(message: Column) -> Column:
    """struct(kind, retryable, factor) of an error message; unknown ones are retried at factor 1."""
    m = F.lower(message)
    row = lambda k, r, x: F.struct(F.lit(k).alias("kind"), F.lit(r).alias("retryable"), F.lit(x).alias("factor"))
    out = row("unknown", True, 1.0)
    for kind, keys, retry, factor in reversed(FAILURES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | m.contains(k)
        out = F.when(hit, row(kind, retry, factor)).otherwise(out)
    return out


def backoff_ms(retries: Column, factor: Column, jitter: Column | None = None) -> Column:
    """min(30 s, 1000 * 2^min(retries, 5) * factor * (1 + jitter)); jitter in -0.2..0.2, by default none."""
    return F.least(F.lit(30_000.0), 1000 * F.pow(F.lit(2.0), F.least(retries, F.lit(5))) * factor * (1 + (jitter if jitter is not None else F.lit(0.0))))
