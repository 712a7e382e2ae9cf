"""URL rules, fetched by their rarest literal token."""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one pass holds; more rules are judged in further passes over the same rows.
RULES_PER_PASS = 100_000
_TOKEN = re.compile(r"[^\W_]+")


class Rule(NamedTuple):
    text: str
    verdict: str
    regex: str
    tokens: frozenset[str]
    prefix: bool


def _literal_tokens(literal: str, left: bool, right: bool) -> set[str]:
    """Tokens of a literal that are whole tokens of any url it occurs in; ``left`` and ``right``: whether its ends are token borders."""
    return {m[0] for m in _TOKEN.finditer(literal) if (left or m.start() > 0) and (right or m.end() < len(literal))}


def prefix_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the url's path starts with the rule's."""
    host, slash, path = text.partition("/")
    literal = host.lower() + slash + path
    return Rule(text, verdict, r"^(?:[^/]*\.)?" + re.escape(literal), frozenset(_literal_tokens(literal, True, False)), True)


def pattern_rule(text: str, verdict: str) -> Rule:
    """A pattern anywhere in host and path: ``*`` is any run of characters, ``||`` at the start is the start of a part of the host."""
    anchored = text.startswith("||")
    pieces = (text[2:] if anchored else text).split("*")
    tokens = set().union(*(_literal_tokens(p, anchored and k == 0, False) for k, p in enumerate(pieces)))
    return Rule(text, verdict, (r"^(?:[^/]*\.)?" if anchored else "") + ".*".join(map(re.escape, pieces)), frozenset(tokens), False)


#: Rules of the contract, and patterns for all other urls: parts of host names that advertising, gambling and spam sites use.
SITE_RULES = tuple(prefix_rule(text, verdict) for text, verdict in (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")))
PATTERNS = tuple(pattern_rule(text, "block") for text in (
    "||ads-", "||ad-", "||adult-", "||bets-", "||casino-", "||cheap-", "||pills-", "||poker-", "||spam-", "||track-",
    "-ads.", "-bets.", "-casino.", "-farm.", "-pills.", "-poker.", "-track.", "-tracker.", "-win.", "-xxx."))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next of ``/ ? #``, A-Z in lower case. Path: from there to ``?`` or ``#``. Else both are empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), capitals, capitals.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many urls (``host``, ``path``) each of the rules' tokens occurs. The result has a token of a rule per row, never one of the urls."""
    tokens = sorted(set().union(*(r.tokens for r in rules))) if rules else []
    if not tokens:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    own = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return {r.token: r.n for r in urls.select(F.explode(own).alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


class RuleIndex:
    """Rules under their rarest token; a rule without a token is tried on every url."""

    def __init__(self, rules: Sequence[Rule], counts: Mapping[str, int]) -> None:
        self.under: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex, re.DOTALL))
            if rule.tokens:
                self.under[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(entry)
            else:
                self.always.append(entry)

    def fitting(self, subject: str) -> Iterator[Rule]:
        for token in set(_TOKEN.findall(subject)):
            for rule, regex in self.under.get(token, ()):
                if regex.search(subject):
                    yield rule
        for rule, regex in self.always:
            if regex.search(subject):
                yield rule


def judge_urls(df: DataFrame, rules: Sequence[Rule] = SITE_RULES, patterns: Sequence[Rule] = PATTERNS, id_col: str = "page_id",
               url_col: str = "url", per_pass: int = RULES_PER_PASS) -> DataFrame:
    """One row per url: id, ``host``, ``path``, ``rule``, ``verdict``.

    Of the site rules that fit, the longest decides (of equally long ones a blocking one); without one, a fitting pattern decides, a blocking
    one before others; else the url is allowed. ``rule`` is the deciding site rule or null. Rows are judged where they are, without a shuffle; a pass
    holds a bounded number of rules, and longer lists take more passes. Only the counts of the rules' own tokens are collected.

    A null url, or one without ``://``, has an empty host and path, fits no rule that names a host, and is allowed. Repeated rows get equal results.
    """
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    every = [*rules, *patterns]
    counts = token_counts(urls, every)
    state = urls.withColumns({"rule": F.lit(None).cast("string"), "site": F.lit(None).cast("string"), "other": F.lit(None).cast("string")})
    kind = dict(urls.dtypes)["id"]
    worse = {None: 0, "allow": 1, "block": 2}

    def one_pass(chunk: Sequence[Rule]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(chunk, counts)
            for batch in batches:
                hosts, paths, *state = (batch.column(k).to_pylist() for k in range(1, 6))
                out: list[list] = [[], [], []]
                for host, path, text, site, other in zip(hosts, paths, *state):
                    for rule in index.fitting(host + path):
                        if not rule.prefix:
                            other = max(other, rule.verdict, key=worse.__getitem__)
                        elif text is None or (len(rule.text), worse[rule.verdict], rule.text) > (len(text), worse[site], text):
                            text, site = rule.text, rule.verdict
                    for column, value in zip(out, (text, site, other)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(c, pa.string()) for c in out)],
                                                 ["id", "host", "path", "rule", "site", "other"])
        return run

    for at in range(0, len(every), per_pass):
        state = state.mapInArrow(one_pass(every[at: at + per_pass]), f"id {kind}, host string, path string, rule string, site string, other string")
    return state.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("site", "other", F.lit("allow")).alias("verdict"))
