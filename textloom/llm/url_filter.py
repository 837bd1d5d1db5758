"""URL filter: a weighted vocabulary of terms counted by Aho-Corasick, and rules.

Rules name a host and a path: a rule fits its host and all subdomains if the
URL's path starts with the rule's; the longest fitting rule decides.  Without a
rule the vocabulary decides: terms count where no letter or digit (ASCII)
touches them; one strict term, or several distinct soft terms of a total weight
of at least ``soft_limit`` (more than any term weighs), reject the URL.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  Null URLs and URLs
without ``://`` have neither, and are allowed.

Defined cases: empty tables give empty tables; repeated rows are judged alike;
other columns pass through, and the operator's columns replace columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwrapped, wrapped

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# The vocabulary.  One strict term rejects; soft terms add up, each once.
STRICT = (
    "bestiality", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "hentai", "jackpot", "malware", "milf",
    "phishing", "porn", "porno", "ransomware", "sexcam", "spyware", "viagra", "warez", "xxx",
)
SOFT = {
    "adult": 2, "bet": 2, "betting": 2, "bingo": 2, "bonus": 1, "cheap": 1, "coupon": 1, "crack": 2, "crypto": 1, "dating": 2,
    "discount": 1, "download": 1, "drugs": 1, "erotic": 2, "free": 1, "gambling": 2, "girls": 1, "hot": 1, "keygen": 2,
    "loan": 1, "loans": 2, "lottery": 2, "naked": 2, "nude": 2, "nudes": 2, "payday": 2, "pharmacy": 1, "pills": 2, "poker": 2,
    "promo": 1, "replica": 2, "roulette": 2, "serial": 1, "sex": 2, "sexy": 2, "slots": 2, "spam": 1, "strip": 1, "torrent": 2,
    "torrents": 2, "weed": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_WORD = frozenset(_LOWER + "0123456789")


def _hits(automaton: ahocorasick.Automaton, url: str | None) -> tuple[int, int]:
    """Strict occurrences, and total weight of distinct soft terms."""
    if not url:
        return 0, 0
    url = url.translate(_FOLD)
    strict, soft = 0, {}
    for end, (term, weight) in automaton.iter(url):
        begin = end - len(term) + 1
        if (begin == 0 or url[begin - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            if weight:
                soft[term] = weight
            else:
                strict += 1
    return strict, sum(soft.values())


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` and ``host``, ``path``, ``rule``, ``verdict``, ``strict_hits``, ``soft_weight``."""
    terms = {t: (t, 0) for t in strict} | {t: (t, w) for t, w in soft.items() if t not in strict}

    @F.pandas_udf("strict_hits int, soft_weight int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for t, v in terms.items():
            automaton.add_word(t, v)
        automaton.make_automaton()
        for urls in batches:
            yield pd.DataFrame([_hits(automaton, u) for u in urls], columns=["strict_hits", "soft_weight"])

    address = F.col("row").getField(url)
    rows = wrapped(pages).withColumn("hits", hits(address))
    host = F.translate(F.coalesce(F.regexp_extract(address, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)
    rows = rows.withColumn("host", host).withColumn("path", F.coalesce(F.regexp_extract(address, "://[^/?#]*([^?#]*)", 1), F.lit("")))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    mine = F.when((F.col("hits.strict_hits") > 0) | (F.col("hits.soft_weight") >= soft_limit), "block").otherwise("allow")
    rows = rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(said, mine))
    added = {c: F.col(c) for c in ("host", "path", "rule", "verdict")}
    return unwrapped(rows, added | {c: F.col("hits").getField(c) for c in ("strict_hits", "soft_weight")})
