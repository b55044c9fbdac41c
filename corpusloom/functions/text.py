"""Text functions: tokens, paragraphs, relevance, verdicts, slugs, prompts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem

#: Least and greatest length of a paragraph.
PARAGRAPH_CHARS = (150, 6000)
# White space of any kind, as Python's ``\\s`` has it.
_SPACE = "(?U)[\\s\\x1c-\\x1f]"
#: Words of the title count so much more.
TITLE_WEIGHT = 10


def tokens(text: Column) -> Column:
    """Runs of letters of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("(\\p{L}+)"), 1)


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE + "+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def paragraphs(text: Column, least: int = PARAGRAPH_CHARS[0], most: int = PARAGRAPH_CHARS[1]) -> Column:
    """Cleaned blocks between blank lines of fitting length; without any, the start of the whole text; empty for blank text."""
    parts = F.transform(F.split(text, "(?U)\\n[\\s\\x1c-\\x1f]*\\n+"), cleaned)
    fitting = F.filter(parts, lambda p: F.length(p).between(least, most))
    whole = cleaned(text)
    return F.when(text.isNull() | (whole == ""), F.array().cast("array<string>")).when(F.size(fitting) > 0, fitting).otherwise(F.array(F.substring(whole, 1, most)))


def stemmed(text: Column | str, lang: Column | str) -> Column:
    """Stems of a text's tokens in the row's language, joined by spaces; languages without a stemmer keep their words."""

    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([" ".join(stem(w, x) for w in re.findall(r"[^\W\d_]+", str(s).lower())) for s, x in zip(t, g)], dtype=object)

    return F.pandas_udf(run, "string")(text, lang)


def lemma(term: Column | str, lang: Column | str) -> Column:
    """Stems of the words of a dictionary term."""

    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else " ".join(stem(w, x) for w in s.split(" ")) for s, x in zip(t, g)], dtype=object)

    return F.pandas_udf(run, "string")(term, lang)


def text_language(expr_lang: Column, land_langs: Column) -> Column:
    """The page's base language if the land accepts it, else the land's first; French where nothing is given."""
    accepted = F.filter(F.transform(F.split(F.coalesce(land_langs, F.lit("fr")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    bases = F.transform(accepted, lambda x: F.substring_index(x, "-", 1))
    own = F.lower(F.trim(F.substring_index(F.coalesce(expr_lang, F.lit("")), "-", 1)))
    return F.when((own != "") & F.array_contains(bases, own), own).otherwise(F.coalesce(F.get(bases, F.lit(0)), F.lit("fr")))


def language_accepted(expr_lang: Column, land_langs: Column) -> Column:
    """Whether one of the page's languages has the base of one of the land's; nothing given accepts."""

    def bases(col: Column) -> Column:
        some = F.filter(F.transform(F.split(col, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
        return F.transform(some, lambda x: F.substring_index(x, "-", 1))

    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(blank(expr_lang) | blank(land_langs), True).otherwise(F.coalesce(F.arrays_overlap(bases(expr_lang), bases(land_langs)), F.lit(False)))


def phrase_hits(stems: Column, phrase: Column) -> Column:
    """Non-overlapping whole-word hits of a phrase in a text of stems."""
    return F.when(phrase == "", 0).otherwise(F.regexp_count(stems, F.concat(F.lit("(?U)\\b\\Q"), phrase, F.lit("\\E\\b"))))


def verdict(answer: Column) -> Column:
    """oui, non or ? from the start of an answer."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(low.startswith("no"), "non").when(low.startswith("oui") | low.startswith("yes"), "oui").otherwise("?")


def slug(title: Column | str) -> Column:
    """File-name form of a title. Names start with ``b-`` as in existing archives; null gives ``b``."""

    def one(x: str | None) -> str:
        plain = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore")
        return re.sub(r"[^a-z0-9]+", "-", str(plain).lower()).strip("-")

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=object), "string")(title)


def prompt(land_name: Column, land_description: Column, terms: Column, title: Column, url: Column, readable: Column, limit: int = 12_000) -> Column:
    """The question to a language model whether a page belongs to a land; ``terms`` is an array."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string(
        "Corpus: %s\nSubject: %s\nTerms: %s\n\nPage: %s\nAddress: %s\n\n%s\n\nDoes the page belong to the corpus? Answer oui or non.",
        none(land_name), none(land_description), none(F.array_join(terms, ", ")), none(title), none(url), F.substring(none(readable), 1, limit),
    )


# Frequent short words by language, for telling the language of a text.
COMMON = {
    "en": "the of and to in is that for was with as on by are this from",
    "fr": "le la les des et est dans que pour une du sur pas par qui",
    "de": "der die das und ist von den mit nicht ein eine auf dem im zu",
    "es": "el los las que del una por con para es como pero sus ha",
    "it": "il di che della per non una sono con gli nel alla del ha",
    "pt": "o os que do da uma para com não dos das em no por ao",
}


def detected_language(text: Column, fallback: Column) -> Column:
    """The language with most frequent words in the text; texts under 20 characters, or without any, keep the fallback."""
    low = F.lower(text)

    def hits(common: str) -> Column:
        return F.regexp_count(low, F.lit("(?U)\\b(?:" + common.replace(" ", "|") + ")\\b"))

    scores = [F.struct(hits(v).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(COMMON.items())]
    best = F.greatest(*scores)
    long = F.length(F.trim(F.coalesce(text, F.lit("")))) >= 20
    return F.when(long & (best["n"] > 0), best["lang"]).otherwise(fallback)
