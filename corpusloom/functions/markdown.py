"""Markdown functions: link targets, images and the paragraph around a link."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDRESS = re.compile(r"(?:https?|ftp)://", re.I)
_OPENING = re.compile(r"<((?:https?|ftp)://[^> ]*)>|\[[^\]]*\]\(|[<\[]", re.I | re.S)
_PARENS = re.compile(r"[()\s]")


def link_targets(text: str | None) -> list[str]:
    """Targets of inline links and autolinks as written, images left out, in order, repeats kept.

    A target ends at white space or at the parenthesis that closes the link; parentheses inside are balanced.
    """
    out: list[str] = []
    at = 0
    while text and (m := _OPENING.search(text, at)):
        at = m.end()
        if m[1]:
            out.append(m[1])
        elif m[0].endswith("("):
            depth, end = 0, len(text)
            for p in _PARENS.finditer(text, at):
                if p[0] == "(":
                    depth += 1
                elif p[0] == ")" and depth:
                    depth -= 1
                else:
                    end = p.start()
                    break
            if end > at and text[m.start() - 1 : m.start()] != "!":
                out.append(text[at:end])
            at = end
    return out


def resolved_links(text: str | None, base: str | None) -> list[str]:
    """Absolute http, https and ftp targets, repeats kept."""
    out = []
    for target in link_targets(text):
        try:
            whole = urljoin(base, target) if base else target
        except ValueError:
            continue
        if _ADDRESS.match(whole):
            out.append(whole)
    return out


def links(text: Column | str, base: Column | str) -> Column:
    return F.pandas_udf(lambda t, b: pd.Series([resolved_links(x, y) for x, y in zip(t, b)]), "array<string>")(text, base)


def links_with_raw(text: Column | str, base: Column | str) -> Column:
    """array<struct<url, raw_url>> of distinct http(s) targets."""

    def run(t: pd.Series, b: pd.Series) -> pd.Series:
        rows = []
        for x, y in zip(t, b):
            seen: dict[str, str] = {}
            for raw in link_targets(x):
                try:
                    whole = urljoin(y or "", raw)
                except ValueError:
                    continue
                if whole.lower().startswith(("http://", "https://")):
                    seen.setdefault(whole, raw)
            rows.append([{"url": u, "raw_url": r} for u, r in seen.items()])
        return pd.Series(rows)

    return F.pandas_udf(run, "array<struct<url: string, raw_url: string>>")(text, base)


def images(text: Column) -> Column:
    """array<struct<alt, url, title>> of the images of a text."""
    form = F.lit("!\\[([^\\]]*)\\]\\(([^)\\s]+)(?:\\s+\"([^\"]*)\")?\\)")
    return F.arrays_zip(F.regexp_extract_all(text, form, 1).alias("alt"), F.regexp_extract_all(text, form, 2).alias("url"), F.regexp_extract_all(text, form, 3).alias("title"))


def paragraph_of(text: Column, url: Column, limit: int = 1000) -> Column:
    """The first paragraph that holds the address, or else the address without final slashes; null without one."""
    paragraphs = F.split(text, "\\n\\s*\\n")
    bare = F.regexp_replace(url, "/+$", "")
    first = F.get(F.filter(paragraphs, lambda p: F.contains(p, url)), F.lit(0))
    second = F.when(bare != "", F.get(F.filter(paragraphs, lambda p: F.contains(p, bare)), F.lit(0)))
    found = F.when(url != "", F.coalesce(first, second))
    return F.substring(F.regexp_replace(found, "^\\s+|\\s+$", ""), 1, limit)
