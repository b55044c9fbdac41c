"""Logical domains: the publisher behind an address on a shared platform."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.html import Document, parse
from corpusloom.functions.platforms import PLATFORMS
from corpusloom.functions.urls import unwrap_archive


class Platforms:
    """The platform table, looked up by host suffix; the first entry in table order wins."""

    def __init__(self, entries=PLATFORMS):
        self.entries = [(host, re.compile(url) if url else None, signal, extra) for host, url, signal, extra in entries]
        self.at = {}
        for i, entry in enumerate(self.entries):
            self.at.setdefault(entry[0], i)

    def rule(self, address: str):
        host = (urlparse(address).netloc if "/" in address else address).lower()
        host = host.removeprefix("www.")
        labels = host.split(".")
        hits = [self.at[s] for s in (".".join(labels[i:]) for i in range(len(labels))) if s in self.at]
        return self.entries[min(hits)] if hits else None


def _named(entity: str, extra: dict) -> str:
    entity = extra.get("prefix", "") + unquote(entity)
    if extra.get("lower"):
        entity = entity.lower()
    if extra.get("alias") and "/" in entity:
        entity = extra["alias"] + "/" + entity.partition("/")[2]
    return entity


def from_url(url: str, platforms: Platforms) -> str:
    """The entity that the address names on a listed platform, else the host part as written."""
    try:
        plain = unwrap_archive(url)
        netloc = urlparse(plain).netloc
    except ValueError:
        return ""
    rule = platforms.rule(netloc)
    if rule and rule[1]:
        found = rule[1].search(plain)
        if found:
            return _named(found[1], rule[3])
    return netloc


def needs_page(url: str, platforms: Platforms) -> bool:
    """Whether the page could tell more than the address does."""
    rule = platforms.rule(url)
    return bool(rule and rule[2]) and from_url(url, platforms) == urlparse(unwrap_archive(url)).netloc


def from_page(url: str, page: Document, platforms: Platforms) -> str | None:
    rule = platforms.rule(url)
    if not rule:
        return None
    better = page.signal(rule[2] or "canonical", url)
    return from_url(better, platforms) if better else None


def resolved(url: Column | str, html: Column | str | None = None) -> Column:
    """The logical domain of each address; pages are read only where the address leaves it open."""
    platforms = Platforms()

    def by_url(u: pd.Series) -> pd.Series:
        return pd.Series([from_url(x, platforms) if x is not None else None for x in u], dtype=object)

    def by_both(u: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for x, page in zip(u, h):
            domain = from_url(x, platforms) if x is not None else None
            if x and page and needs_page(x, platforms):
                domain = from_page(x, parse(page), platforms) or domain
            out.append(domain)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(by_url, "string")(url) if html is None else F.pandas_udf(by_both, "string")(url, html)


def is_open(url: Column | str) -> Column:
    """Pages that lack what only their HTML could tell."""
    platforms = Platforms()
    return F.pandas_udf(lambda u: pd.Series([bool(x) and needs_page(x, platforms) for x in u]), "boolean")(url)
