"""URL filtering: host and path rules, then a weighted vocabulary.

A url is matched against the vocabulary in one Aho-Corasick pass over its
lower-cased host and path.  A hit counts only between boundaries (no letter or
digit on either side).  A url is rejected when the weights of its distinct terms
reach ``limit``: a strict term weighs as much as the limit, a soft one less, so
that one strict term rejects, and so do several distinct soft ones.

Edge cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, has no hits and is allowed; an empty host fits no rule; repeated
rows are judged alike; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules as (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# The vocabulary.
STRICT_TERMS = ("camgirls", "casino", "cialis", "escorts", "hentai", "malware", "phishing", "porn", "porno", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "adult", "affiliate", "banner", "bet", "betting", "cheap", "click", "crack", "dating", "free", "keygen", "loans", "nude", "payday", "pills", "poker", "popup", "promo", "replica", "torrent", "track", "tracker", "webcam", "x")

# The weight of a rejection, and of a soft term.
LIMIT, SOFT_WEIGHT = 2, 1
VOCABULARY = tuple((term, "strict", LIMIT) for term in STRICT_TERMS) + tuple((term, "soft", SOFT_WEIGHT) for term in SOFT_TERMS)

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; else nulls."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.when(fits, F.lit(rule_host + rule_path)).otherwise(named)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return named, verdict


def vocabulary_hits(vocabulary: tuple[tuple[str, str, int], ...] = VOCABULARY):
    """A vectorised function: text to distinct strict terms, distinct soft terms and their weight.

    ``vocabulary`` holds (term, "strict" or "soft", weight); terms are in lower case.
    """
    kinds = {kind for _, kind, _ in vocabulary}
    if not kinds <= {"strict", "soft"} or len({term for term, _, _ in vocabulary}) < len(vocabulary) or any(not term for term, _, _ in vocabulary):
        raise ValueError("the vocabulary needs distinct terms, each strict or soft")

    @F.pandas_udf("strict_hits long, soft_hits long, weight long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, kind, weight in vocabulary:
            automaton.add_word(term, (term, kind, weight))
        if vocabulary:
            automaton.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                found = set()
                for last, entry in automaton.iter(text) if vocabulary else ():
                    first = last - len(entry[0])
                    if (first < 0 or text[first] not in _ALNUM) and (last + 1 == len(text) or text[last + 1] not in _ALNUM):
                        found.add(entry)
                strict = sum(kind == "strict" for _, kind, _ in found)
                out.append((strict, len(found) - strict, sum(weight for _, _, weight in found)))
            yield pd.DataFrame(out, columns=["strict_hits", "soft_hits", "weight"])

    return hits


def judge_urls(pages: DataFrame, id_column: str = "page_id", rules=RULES, vocabulary: tuple[tuple[str, str, int], ...] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Returns the id, host, path, rule, verdict, strict_hits and soft_hits."""
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    hits = split.withColumn("__hits", vocabulary_hits(vocabulary)(F.concat(F.col("host"), lower_ascii(F.col("path")))))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("__hits.weight") >= limit, "block").otherwise("allow")
    return hits.select(id_column, "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_terms).alias("verdict"), "__hits.strict_hits", "__hits.soft_hits")


def oracle(strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, min_soft: int = 2) -> str:
    """The same result as DuckDB SQL, with one pattern per term."""
    count = lambda terms: " + ".join(f"regexp_matches(seen, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH split AS (
  SELECT page_id, {lower(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
lowered AS (SELECT *, host || {lower('path')} AS seen FROM split),
counted AS (SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits FROM lowered)
SELECT page_id, host, path, {pick(1)} AS rule,
       coalesce({pick(2)}, CASE WHEN strict_hits >= 1 OR soft_hits >= {min_soft} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM counted
"""
