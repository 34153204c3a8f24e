"""Text functions as Columns: links, titles, cleaning, sentences, chunks, tokens, citations, markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# ------------------------------------------------------------------ identity


def canonical_link(link: Column) -> Column:
    """A link for comparison: https, lower-case host, no query, fragment or trailing slashes. Null without a scheme and host."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
    path = F.rtrim(F.regexp_extract(stripped(link), parts, 2), F.lit("/"))
    return F.when(stripped(link).rlike(parts), F.concat(F.lit("https://"), F.lower(F.regexp_extract(stripped(link), parts, 1)), path))


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def article_id(link: Column) -> Column:
    return F.substring(F.sha1(canonical_link(link).cast("binary")), 1, 12)


# ------------------------------------------------------------------ cleaning


@dataclass(frozen=True)
class Rule:
    """A named removal: each match becomes one space. needs: text that every match contains, in lower case; without it the pattern isn't tried."""

    name: str
    pattern: str
    needs: str


#: Fixed values, in their order: publisher boilerplate in scraped news.
NEWS_RULES = [
    Rule("paywall", r"(?iUs)PREMIUM\s+Upgrade to read.*?(?:Sign in|$)", "upgrade to read"),
    Rule("hedge_fund_pitch", r"(?iUs)(?:Why are we interested in|At Insider Monkey we are obsessed with) the stocks that hedge funds pile into[.?].*?\(see more details here\)\.?", "hedge funds pile into"),
    Rule("read_next_links", r"(?Us)READ NEXT:.*$", "read next:"),
    Rule("story_continues", r"(?iU)\bStory Continues\b", "story continues"),
    Rule("zacks_promo", r"(?iUs)Want the latest recommendations from Zacks Investment Research\?.*$", "zacks investment research?"),
    Rule("yahoo_video_roll", r"(?iU)Yahoo Finance Video\s*•\s*\d+\s+\w+\s+ago(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?", "yahoo finance video"),
    Rule("view_comments", r"(?iU)\bView Comments\b", "view comments"),
    Rule("insider_monkey_footer", r"(?iU)Disclosure:\s*None\.?", "disclosure:"),
    Rule("insider_monkey_footer", r"(?iU)This article is originally published at\s*Insider Monkey\.?", "originally published at"),
    Rule("motley_fool_attribution", r"(?iU)was originally published by The Motley Fool", "published by the motley fool"),
    Rule("byline", r"(?iU)This post was written by [A-Z][\w.'\-]*(?: [A-Z][\w.'\-]*){0,3}\.?", "this post was written by "),
    Rule("benzinga_disclaimer", r"(?iU)Benzinga does not provide investment advice\.(?:\s*All rights reserved\.)?", "benzinga does not provide"),
    Rule("yahoo_footer", r"(?iU)Read the latest financial and business news from Yahoo Finance", "business news from yahoo finance"),
    Rule("continue_reading", r"(?iU)\bContinue Reading\s*$", "continue reading"),
    Rule("promo_free_link", r"(?iU)[^.]*available to you FREE via this link\.?", "free via this link"),
]


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode normal form KC; only texts with characters beyond ASCII go through Python, as the others are in that form."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def cleaned(text: Column, rules: Iterable[Rule] = NEWS_RULES) -> Column:
    """struct(text, rules_applied, paywalled) of a text in normal form: the rules in order, each on what the ones before left."""
    state = F.struct(text.alias("t"), F.array().cast("array<string>").alias("names"))
    for rule in rules:

        def step(s: Column, rule: Rule = rule) -> Column:
            hit = F.lower(s["t"]).contains(rule.needs) & s["t"].rlike(rule.pattern)
            return F.when(hit, F.struct(F.regexp_replace(s["t"], rule.pattern, " ").alias("t"), F.array_union(s["names"], F.array(F.lit(rule.name))).alias("names"))).otherwise(s)

        state = let(state, step)
    return let(state, lambda s: F.struct(collapsed(s["t"]).alias("text"), s["names"].alias("rules_applied"), F.array_contains(s["names"], "paywall").alias("paywalled")))


def headline_only(clean: Column, min_chars: int = 400) -> Column:
    return clean["paywalled"] | (F.char_length(clean["text"]) < min_chars)


# ------------------------------------------------------------------ sentences and chunks

#: Fixed value: white space after the end of a sentence, with its closing quote or bracket, and before the start of one.
BOUNDARY = r"""(?U)(?:(?<=[.!?])|(?<=[.!?]["”’)]))\s+(?=[A-Z0-9"“‘(])"""


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BOUNDARY, -1), lambda s: stripped(s)), lambda s: s != "")


def hard_split(sentence: Column, most: int) -> Column:
    """Pieces of at most so many characters, cut at the last space where there is one."""
    fit = rf"(?s)(.{{1,{most}}}\z|.{{1,{max(most - 1, 1)}}}(?= )|.{{{most}}}) *" if most > 1 else r"(?s)(.) *"
    pieces = F.transform(F.regexp_extract_all(sentence, F.lit(fit), F.lit(1)), lambda p: stripped(p))
    return F.when(F.char_length(sentence) > most, pieces).otherwise(F.array(sentence))


def chunks(text: Column, most: int = 1100, overlap: int = 1) -> Column:
    """Whole sentences packed into pieces of at most so many characters; the last overlap sentences of a piece open the next one
    if there is room. Over-long sentences are split."""
    if most < 1:
        raise ValueError("most must be positive")
    if overlap < 0:
        raise ValueError("overlap must be 0 or more")
    parts = F.flatten(F.transform(sentences(text), lambda s: hard_split(s, most)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
    weight = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.char_length(x) + 1)

    def pack(a: Column, s: Column) -> Column:
        more = F.char_length(s) + 1
        full = (F.size(a["open"]) > 0) & (a["size"] + more > most)
        tail = F.slice(a["open"], F.greatest(F.size(a["open"]) - overlap, F.lit(0)) + 1, overlap) if overlap else F.array().cast("array<string>")
        kept = let(tail, lambda t: F.when(weight(t) + more > most, F.array().cast("array<string>")).otherwise(t))
        begun = let(F.when(full, kept).otherwise(a["open"]), lambda t: F.concat(t, F.array(s)))
        done = F.when(full, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"])
        return let(begun, lambda t: F.struct(done.alias("done"), t.alias("open"), F.when(full, weight(t)).otherwise(a["size"] + more).alias("size")))

    finish = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"])
    return F.aggregate(parts, start, pack, finish)


# ------------------------------------------------------------------ tokens

#: Words without meaning for retrieval, and what questions are framed with.
STOPWORDS = """
    a about above after again all also am an and any are as at be because been before being below between both but by can could did
    do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its
    just me more most my no nor not of off on once only or other our out over own s same she should so some such t than that the
    their them then there these they this those through to too under until up very was we were what whats when where which while
    who whom why will with would you your
    tell give show explain describe summarize summarise summary overview please compare compares compared comparison versus vs
    difference differences latest recent recently news lately today currently current happening going
""".split()


def tokens(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 but stopwords and single letters, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS) & ((F.length(w) > 1) | w.rlike("[0-9]")))


# ------------------------------------------------------------------ citations and markup


def citation_numbers(text: Column) -> Column:
    """The numbers in [1] and [1, 2], in order, with repeats; ASCII digits."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.try_cast("int")))), lambda n: n.isNotNull())


def without_citations(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s*\[\d+(?:\s*,\s*\d+)*\]", ""))


def checked_citations(text: Column, numbers: Column) -> Column:
    """struct(cited, invalid): the distinct numbers cited that are and aren't among numbers, by first appearance."""
    return let(F.array_distinct(citation_numbers(text)), lambda c: F.struct(F.array_intersect(c, numbers).alias("cited"), F.array_except(c, numbers).alias("invalid")))


def escaped(text: Column, quotes: bool = False) -> Column:
    """Markup characters as entities."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
