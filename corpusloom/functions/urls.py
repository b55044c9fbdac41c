"""URL functions.

Native column expressions wherever the built-in functions can say it; the full
normaliser, which must agree with the standard library's parsing and percent-encoding, is
one vectorised function over a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import parse_qsl, quote, urldefrag, urlencode, urljoin, urlparse, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that serve snapshots, with the form of their snapshot addresses.
SNAPSHOT_FORMS = {"web.archive.org": r"/web/\d+(?:[a-z]+_)?/(.+)$", "archive.org": r"/web/\d+(?:[a-z]+_)?/(.+)$", "ghostarchive.org": r"/archive/[^/]+/(.+)$"}
# Query parameters that only track.
TRACKERS = ("utm_*", "fbclid", "gclid", "mc_eid", "ref_src", "_ga", "yclid", "_openstat", "wt_*", "msclkid", "igshid", "spm")
# Footnote marks that stick to harvested addresses.
FOOTNOTES = ("[↑]", "%5B%E2%86%91%5D", "%5b%e2%86%91%5d")
# File endings that are no pages.
BINARY_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".ico", ".pdf", ".txt", ".csv", ".xls", ".xlsx", ".doc", ".docx", ".ppt", ".pptx", ".zip", ".mp4", ".webm", ".mp3", ".wav")
# Parameters that carry a redirect's target.
REDIRECT_PARAMS = ("url", "session_redirect")
#: Layers of wrapping that are taken off at most.
LAYERS = 8


@dataclass(frozen=True)
class UrlRules:
    """What the normaliser does; the defaults are the corpus's own."""

    unwrap_archive: bool = True
    unwrap_redirect: bool = False
    force_https: bool = False
    strip_www: bool = False
    strip_mobile: bool = False
    lowercase_host: bool = True
    trackers: tuple[str, ...] = TRACKERS
    sort_query: bool = True
    trailing_slash: str = "preserve"


def snapshot_target(url: str) -> str | None:
    """The address inside a snapshot address, or None."""
    parts = urlsplit(url)
    form = SNAPSHOT_FORMS.get(parts.netloc.lower())
    if form is None:
        return None
    inner = re.search(form, urlunsplit(("", "", parts.path, parts.query, parts.fragment)))
    return inner[1] if inner else None


def redirect_target(url: str) -> str | None:
    parts = urlsplit(url)
    host = parts.netloc.lower()
    if not (host == "linkedin.com" or host.endswith(".linkedin.com")):
        return None
    given = dict(parse_qsl(parts.query, keep_blank_values=True))
    return next((given[k] for k in REDIRECT_PARAMS if given.get(k, "").startswith(("http://", "https://"))), None)


def unwrap(url: str, layer: Callable[[str], str | None]) -> str:
    """Takes off layers until none is left."""
    for _ in range(LAYERS):
        inner = layer(url)
        if inner is None or inner == url:
            break
        url = inner
    return url


def unwrap_archive(url: str) -> str:
    return unwrap(url, snapshot_target)


def trim_junk(url: str) -> str:
    """Without footnote marks, closing brackets that nothing opens, and final punctuation."""
    cut = next((at for at in (url.find(m) for m in FOOTNOTES) if at > 0), -1)
    if cut > 0:
        url = url[:cut]
    while url[-1:] in (")", "]") and url.count(url[-1]) > url.count("(" if url[-1] == ")" else "["):
        url = url[:-1]
    return re.sub(r"[.,;»]+$", "", url)


def _slash(path: str, policy: str) -> str:
    if policy == "add":
        return path if path.endswith("/") or "." in path.rpartition("/")[2] else path + "/"
    return path.rstrip("/") if policy == "strip" and len(path) > 1 else path


def _query(query: str, rules: UrlRules) -> str:
    """Each step that applies re-encodes the query."""
    if not query or not (rules.trackers or rules.sort_query):
        return query
    pairs = [p for p in parse_qsl(query, keep_blank_values=True) if not any(fnmatchcase(p[0], t) for t in rules.trackers)]
    return urlencode(sorted(pairs, key=lambda p: p[0]) if rules.sort_query else pairs)


def normalize_url(url: str | None, rules: UrlRules = UrlRules()) -> str | None:
    """The normal form of an address; what cannot be parsed, and null or empty values, come back unchanged."""
    if not url:
        return url
    try:
        now = trim_junk(re.sub(r"^https?://(?=https?://)", "", url.partition("#")[0], flags=re.I))
        if rules.unwrap_archive:
            now = unwrap_archive(now)
        if rules.unwrap_redirect:
            now = unwrap(now, redirect_target)
        parts = urlparse(trim_junk(now.partition("#")[0]))
        scheme = "https" if rules.force_https and parts.scheme == "http" else parts.scheme
        user, at, host = parts.netloc.rpartition("@")
        netloc = user + at + (host.lower() if rules.lowercase_host else host)
        for wanted, label in ((rules.strip_www, "www."), (rules.strip_mobile, "m.")):
            if wanted and netloc.lower().startswith(label):
                netloc = netloc[len(label) :]
        return parts._replace(scheme=scheme, netloc=netloc, path=_slash(parts.path, rules.trailing_slash), query=_query(parts.query, rules), fragment="").geturl()
    except ValueError:
        return url


def _vectorised(f: Callable[[str], object], kind: str) -> Callable[[Column | str], Column]:
    def apply(col: Column | str) -> Column:
        return F.pandas_udf(lambda s: pd.Series([f(x) if x is not None else None for x in s], dtype=object if kind != "boolean" else None), kind)(col)

    return apply


def normalize(col: Column | str, rules: UrlRules = UrlRules()) -> Column:
    return _vectorised(lambda u: normalize_url(u, rules), "string")(col)


def unwrapped(col: Column | str) -> Column:
    def safe(u: str) -> str:
        try:
            return unwrap_archive(u)
        except ValueError:
            return u

    return _vectorised(safe, "string")(col)


def request_url(col: Column | str) -> Column:
    """Unwrapped and percent-encoded for a service's query."""
    return _vectorised(lambda u: quote(unwrap_archive(u), safe=":/?&=%"), "string")(col)


def joined(base: Column | str, ref: Column | str, lower: bool = False) -> Column:
    """Reference resolution; ``lower`` gives the form that media addresses take."""

    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(b, r):
            try:
                whole = urljoin(x or "", y) if y is not None else None
            except ValueError:
                whole = y
            out.append(whole.lower() if lower and whole is not None else whole)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(base, ref)


def same_page_key(url: str | None) -> str | None:
    try:
        bare = urldefrag(url or "")[0]
        return normalize_url(bare) if bare else None
    except ValueError:
        return None


def same_page(base: Column | str, target: Column | str) -> Column:
    """Whether a link only moves within its own page."""

    def run(b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([(k := same_page_key(x)) is not None and same_page_key(y) == k for x, y in zip(b, t)])

    return F.pandas_udf(run, "boolean")(base, target)


# --- native expressions -----------------------------------------------------------


def host(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1), F.lit(""))


def without_anchor(col: Column) -> Column:
    """Cut at the first ``#`` that is not the first character."""
    return F.when(F.instr(col, "#") > 1, F.substring_index(col, "#", 1)).otherwise(col)


def single_scheme(col: Column) -> Column:
    return F.regexp_replace(col, "(?i)^https?://(?=https?://)", "")


def normalize_native(col: Column) -> Column:
    """The normaliser for well-formed addresses: ASCII, queries already percent-encoded, no wrapping by archives or redirects. ``normalize`` is the one for any address."""
    bare = single_scheme(F.substring_index(col, "#", 1))
    head = F.regexp_extract(bare, "^([A-Za-z]+://)([^/?]*)([^?]*)", 1)
    site = F.lower(F.regexp_extract(bare, "^([A-Za-z]+://)([^/?]*)([^?]*)", 2))
    path = F.regexp_extract(bare, "^([A-Za-z]+://)([^/?]*)([^?]*)", 3)
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, "^[^?]*\\?", "")).otherwise("")
    tracked = "^(utm_.*|fbclid|gclid|mc_eid|ref_src|_ga|yclid|_openstat|wt_.*|msclkid|igshid|spm)(=|$)"
    items = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked))
    # by key alone: pairs of one key keep their order
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.array_join(F.array_sort(items, lambda x, y: F.when(name(x) < name(y), -1).when(name(x) > name(y), 1).otherwise(0)), "&")
    whole = F.concat(F.lower(head), site, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(head == "", col).otherwise(whole)


def with_slash_policy(col: Column, policy: str) -> Column:
    """Trailing slash of an address without query: preserve, strip or add."""
    if policy == "strip":
        return F.regexp_replace(col, "(?<=[^/:])/+$", "")
    if policy == "add":
        last = F.element_at(F.split(F.regexp_replace(col, "^[A-Za-z]+://[^/]*", ""), "/"), -1)
        return F.when(col.endswith("/") | F.contains(last, F.lit(".")), col).otherwise(F.concat(col, F.lit("/")))
    return col


def is_snapshot(col: Column) -> Column:
    return F.coalesce(F.lower(host(col)).isin(*SNAPSHOT_FORMS), F.lit(False))


def classified(col: Column) -> Column:
    """struct(is_archive, scheme, host, has_anchor, has_query)."""
    return F.struct(
        is_snapshot(col).alias("is_archive"),
        F.lower(F.regexp_extract(col, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)).alias("scheme"),
        F.coalesce(host(col), F.lit("")).alias("host"),
        (F.regexp_extract(col, "#(.+)$", 1) != "").alias("has_anchor"),
        (F.regexp_extract(col, "^[^#]*?\\?([^#]+)", 1) != "").alias("has_query"),
    )


def canonical(col: Column) -> Column:
    """Key for merging search results: lower scheme and host, no fragment, one final slash less unless the path is the root."""
    bare = F.substring_index(F.trim(col), "#", 1)
    head = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)(/[^?]*)?(\\?.*)?$", 1))
    path = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)(/[^?]*)?(\\?.*)?$", 2)
    query = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)(/[^?]*)?(\\?.*)?$", 3)
    shorter = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(head == "", bare).otherwise(F.concat(head, shorter, F.when(query == "?", "").otherwise(query)))


def relaxed_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "/+$", ""))


def host_path_key(col: Column) -> Column:
    """Host without ``www.``, path without final slashes and query; null without a host."""
    where = F.regexp_replace(F.lower(F.coalesce(host(col), F.lit(""))), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(col, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(col, "^[^#?]*\\?([^#]*)", 1)
    return F.when(where != "", F.concat(where, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def crawlable(col: Column) -> Column:
    """Starts with http(s) and its path ends in none of the binary endings."""
    path = F.lower(F.regexp_extract(col, "^https?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(col.rlike("^https?://") & ~path.rlike("\\.(" + "|".join(e[1:] for e in BINARY_ENDINGS) + ")$"), F.lit(False))


def redacted(col: Column) -> Column:
    return F.regexp_replace(col, "api_key=[^&\\s]+", "api_key=***")
