"""Companies, and where texts mention them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import collapsed, let


@dataclass(frozen=True)
class Company:
    ticker: str
    name: str
    aliases: tuple[str, ...] = ()


#: The companies known by default.
COMPANIES = (
    Company("AAPL", "Apple", ("iphone", "ipad", "macbook", "tim cook", "apple intelligence")),
    Company("MSFT", "Microsoft", ("azure", "satya nadella", "copilot")),
    Company("AMZN", "Amazon", ("aws", "amazon web services", "andy jassy", "prime video")),
    Company("NFLX", "Netflix"),
    Company("NVDA", "Nvidia", ("jensen huang", "geforce", "blackwell")),
    Company("INTC", "Intel", ("pat gelsinger",)),
    Company("IBM", "IBM", ("international business machines", "watsonx")),
)
#: A mention in the title counts for so many; mentions, and share of the most mentioned, that make a text about a company.
TITLE_WEIGHT, MIN_MENTIONS, MIN_SHARE = 5, 3, 0.25


class Registry:
    """Columns over a fixed list of companies, which is code or configuration and so may be part of a plan."""

    def __init__(self, companies: tuple[Company, ...] = COMPANIES) -> None:
        self.companies = companies
        self.aliases = {a.lower(): c.ticker for c in companies for a in (c.ticker, c.name, *c.aliases)}
        longest = sorted(self.aliases, key=len, reverse=True)
        self.pattern = r"(?iU)\b(" + "|".join(re.sub(r"([^\w ])", r"\\\1", a) for a in longest) + r")\b"

    @staticmethod
    def _map(pairs: dict[str, str]) -> Column:
        return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))

    @property
    def tickers(self) -> list[str]:
        return [c.ticker for c in self.companies]

    def mentions(self, text: Column) -> Column:
        """Tickers of all mentions in order."""
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(1))
        return F.filter(F.transform(found, lambda m: F.try_element_at(self._map(self.aliases), F.lower(m))), lambda t: t.isNotNull())

    def tickers_in(self, text: Column) -> Column:
        """Distinct tickers by first mention."""
        return F.array_distinct(self.mentions(text))

    def without(self, text: Column) -> Column:
        """The text without its mentions."""
        return collapsed(F.regexp_replace(text, self.pattern, " "))

    def names(self, tickers: Column) -> Column:
        return F.array_join(F.transform(tickers, lambda t: F.try_element_at(self._map({c.ticker: c.name for c in self.companies}), t)), " ")

    def about(self, title: Column, text: Column, feeds: Column) -> Column:
        """What an article is about: companies in its title, or mentioned often enough; else the feeds it came from. Sorted."""
        count = lambda ms, t: F.size(F.filter(ms, lambda m: m == t))

        def scored(both: Column) -> Column:
            score = lambda t: TITLE_WEIGHT * count(both["title"], t) + count(both["body"], t)
            every = F.array_distinct(F.concat(both["title"], both["body"]))
            scores = F.transform(every, lambda t: F.struct(t.alias("t"), score(t).alias("s"), F.array_contains(both["title"], t).alias("named")))
            least = lambda xs: F.greatest(F.lit(float(MIN_MENTIONS)), MIN_SHARE * F.array_max(F.transform(xs, lambda x: x["s"])))
            return let(scores, lambda xs: F.transform(F.filter(xs, lambda x: x["named"] | (x["s"] >= least(xs))), lambda x: x["t"]))

        found = let(F.struct(self.mentions(title).alias("title"), self.mentions(text).alias("body")), scored)
        return let(found, lambda ts: F.array_sort(F.when(F.size(ts) > 0, ts).otherwise(feeds)))
