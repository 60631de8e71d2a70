"""Intent of a query, and additive scores of results, as integer columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules
from . import text as T
from . import urls


def _rule(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts).cast("int")


def _word(pattern: str) -> str:
    """The pattern between ASCII word bounds."""
    return f"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def detect_intent(query: Column) -> Column:
    """The first intent whose words the query has: discussion, code, docs, factual, else general."""
    q = F.lower(F.coalesce(query, F.lit("")))
    out = None
    for intent in ("discussion", "code", "docs"):
        test = q.rlike(_word(rules.INTENT_WORDS[intent]))
        out = F.when(test, intent) if out is None else out.when(test, intent)
    factual = q.rlike(f"^({rules.FACTUAL_START})(?![A-Za-z0-9_])") | q.rlike(_word(rules.FACTUAL_WORDS))
    return out.when(factual, "factual").otherwise("general")


def base_score(tokens: Column, parsed: Column, title: Column, snippet: Column) -> Column:
    """What host, path and text of a result are worth for the query's tokens; 0 if its URL is not valid."""
    host, path = parsed["host"], parsed["path"]
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    doc_host = host.rlike(rules.DOC_HOST)
    parts = [
        _rule(doc_host, 5),
        _rule(path.rlike(rules.SCORED_PATH), 4),
        _rule(host.rlike(rules.HOSTED_DOCS), 4),
        _rule(parsed["domain"].isin(rules.OFFICIAL_DOMAINS) | host.isin(rules.OFFICIAL_DOMAINS), 5),
        _rule(host == "github.com", 4),
        _rule(host.endswith(".org"), 1),
        _rule((path == "/") & ~doc_host, -2),
        _rule(path.contains("/search"), -6),
        _rule(path.contains("/issues") | path.contains("/pull/"), -4),
        _rule(path.contains("/discussions"), -2),
        _rule(path.contains("/releases"), 2),
        _rule(path.contains("/blog"), -2),
        _rule(host.rlike(rules.LOW_SIGNAL), -5),
        T.overlap(host, tokens, 3),
        T.overlap(F.lower(path), tokens, 2),
        T.overlap(hay, tokens, 1),
        _rule(hay.contains("official"), 2),
        _rule(hay.contains("documentation") | hay.contains("docs"), 3),
        _rule(hay.contains("api reference"), 2),
        _rule(hay.contains("tutorial"), -1),
        _rule(hay.contains("top ") | hay.contains("best "), -1),
        _rule(hay.contains(" vs "), -1),
    ]
    return F.when(parsed["valid"], _sum(parts)).otherwise(0)


def cross_engine_boost(n: Column) -> Column:
    return F.when(n >= 4, 12).when(n == 3, 8).when(n == 2, 4).otherwise(0)


def star_bonus(stars: Column) -> Column:
    """Whole decimal digits of the stars, 5 at most."""
    return F.when(stars > 0, F.least(F.floor(F.log10(stars + 1)), F.lit(5))).otherwise(0).cast("int")


def fork_penalty(fork: Column) -> Column:
    return F.when(F.coalesce(fork, F.lit(False)), -3).otherwise(0)


def known_official(parsed: Column) -> Column:
    return parsed["host"].isin(rules.KNOWN_OFFICIAL) | parsed["domain"].isin(rules.KNOWN_OFFICIAL)


def officialish(parsed: Column) -> Column:
    """A documentation host or path, a package registry, or a known official domain."""
    registry = parsed["host"].isin(rules.REGISTRY_HOSTS) | parsed["domain"].isin(rules.REGISTRY_HOSTS)
    return parsed["host"].rlike(rules.DOC_HOST) | parsed["path"].rlike(rules.OFFICIAL_PATH) | registry | known_official(parsed)


def intent_adjustment(intent: Column, parsed: Column) -> Column:
    """Points that the intent adds for the kind of page."""
    domain = parsed["domain"]
    tests = [officialish(parsed), known_official(parsed), *(domain.isin(list(h)) for h in (rules.CODE_HOSTS, rules.DISCUSSION_HOSTS, rules.FACTUAL_HOSTS))]
    out = F.lit(0)
    for name, points in rules.ADJUSTMENTS.items():
        if any(points):
            out = F.when(intent == name, _sum([_rule(t, p) for t, p in zip(tests, points, strict=True) if p])).otherwise(out)
    return out.cast("int")


def high_confidence(intent: Column, parsed: Column, score: Column) -> Column:
    """Whether one engine's row alone answers a query of this intent well."""
    domain, official = parsed["domain"], officialish(parsed)
    code, talk, fact = (domain.isin(list(h)) for h in (rules.CODE_HOSTS, rules.DISCUSSION_HOSTS, rules.FACTUAL_HOSTS))
    return (
        F.when(intent == "docs", ~code & ~talk & ~fact & official)
        .when(intent == "code", code | official | (score >= 18))
        .when(intent == "discussion", talk | (score >= 14))
        .when(intent == "factual", fact | official | (score >= 14))
        .otherwise(score >= 18)
    )


def score_url(query: Column, url: Column, title: Column, snippet: Column) -> Column:
    return base_score(T.keyword_tokens(query), urls.parse(url), title, snippet)
