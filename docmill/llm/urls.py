"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host with a path prefix, or a pattern over the whole URL with `^` for an edge
between alphanumeric and other characters and `*` for anything.  Every alphanumeric run of a
rule that must stand in the URL as a whole token is a literal token; the rule is filed under the
one that the fewest URLs of the table hold (counted over all of them).  A URL looks up its own
tokens and runs the regular expressions of the rules found there, and no others.  Rules without
a literal token are tried on every URL.

The rule list is a parameter of the job, bounded by MAX_RULES, and goes to the tasks with the
function; the URLs are judged where they are, without a shuffle, so a hot host costs nothing.

Defined cases: of fitting host rules with names of one length a block outweighs an allow, then the
name that sorts last decides, and of fitting patterns the first by name; URLs of any length are read whole; a null URL, or one without `://`, has an empty host and path, meets no host rule
and is allowed unless a pattern fits its text; repeated rows are judged alike; an empty table
gives an empty result; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWERED)


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with `path`; of the host rules that fit, the longest decides."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        """Over host + path; the host ends at the first slash."""
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    linear = regex

    def tokens(self) -> list[str]:
        """Runs of host and path, lower-cased like the URL's, that stand there whole; one at the open end may go on."""
        name = self.name.translate(_FOLD)
        return [m.group() for m in _TOKEN.finditer(name) if m.end() < len(name)]


@dataclass(frozen=True)
class PatternRule:
    """Blocks or allows by its text; asked where no host rule fits; a block outweighs an allow."""

    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def regex(self) -> str:
        """Over the lower-cased URL."""
        parts = re.split(r"([\^*])", self.pattern)
        return "".join(".*" if part == "*" else self._edge(parts, i) for i, part in enumerate(parts))

    @staticmethod
    def _edge(parts: list[str], i: int) -> str:
        if parts[i] != "^":
            return re.escape(parts[i])
        return r"(?:[^a-z0-9]|$)" if not any(parts[i + 1 :]) else r"(?:^|[^a-z0-9])"

    def linear(self) -> str:
        """The same language as regex(), in time that grows with the URL: what stands between stars is taken where it first
        comes, and never tried again (atomic groups), as later parts only gain by it."""
        parts = re.split(r"([\^*])", self.pattern)
        runs = [[]]
        for i, part in enumerate(parts):
            if part == "*":
                runs.append([])
            else:
                runs[-1].append(self._edge(parts, i))
        return r"\A" + "".join(f"(?>.*?{text})" for run in runs if (text := "".join(run)))

    def tokens(self) -> list[str]:
        p = self.pattern
        whole = lambda m: m.start() > 0 and p[m.start() - 1] != "*" and m.end() < len(p) and p[m.end()] != "*"
        return [m.group() for m in _TOKEN.finditer(p) if whole(m)]


Rule = HostRule | PatternRule

HOST_RULES = (
    HostRule("allow", "org"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PATTERN_RULES = tuple(
    PatternRule("block", f"^{p}^")
    for p in ("ads-track", "adserver", "adult-x", "casino", "casino-win", "cheap-pills", "free-download", "online-poker", "porn", "spam-farm", "viagra", "xxx")
)
RULES: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_frequency(df: DataFrame, url: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many rows of df each literal token of the rules stands; at most one entry per token of a rule.

    The wanted tokens are a small table, bounded as the rules are, that is sent to every task.
    """
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{url}`"), _UPPER, _LOWERED), F.lit("[a-z0-9]+"), F.lit(0)))
    table = df.sparkSession.createDataFrame(pd.DataFrame({"token": wanted}))
    counts = df.select(F.explode(tokens).alias("token")).join(F.broadcast(table), "token").groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counts.toLocalIterator()}


def index(rules: Sequence[Rule], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; "" holds those without any."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the list sent to every task is bounded by {MAX_RULES}")
    out: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        out.setdefault(min(rule.tokens(), key=lambda t: (frequency.get(t, 0), t), default=""), []).append(k)
    return out


def judged(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with host, path, rule (the deciding host rule, or null), pattern (the deciding pattern, or null), n_candidates and verdict."""
    filed = index(rules, token_frequency(df, url, rules))
    facts = [(isinstance(r, HostRule), r.action, r.name, r.linear()) for r in rules]

    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, re.Pattern] = {}  # rules are compiled when they are first asked
        fits = lambda k, text: (compiled.get(k) or compiled.setdefault(k, re.compile(facts[k][3], re.DOTALL))).search(text)
        always = filed.get("", [])
        for urls, hosts, paths in parts:
            out = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                text = (url or "").translate(_FOLD)
                found = set(always)
                for token in set(_TOKEN.findall(text)):
                    found.update(filed.get(token, ()))
                key, best, patterns = host + path, None, []
                for k in found:
                    of_host, action, name, _ = facts[k]
                    if of_host:
                        rank = (len(name), action == "block", name)
                        if (best is None or rank > best[0]) and fits(k, key):
                            best = (rank, action, name)
                    elif fits(k, text):
                        patterns.append((action != "block", name))
                first = min(patterns, default=None)
                verdict = best[1] if best else ("allow" if first is None or first[0] else "block")
                out.append((best and best[2], None if best or first is None else first[1], len(found), verdict))
            yield pd.DataFrame(out, columns=["rule", "pattern", "n_candidates", "verdict"])

    verdicts = F.pandas_udf(judge, "rule string, pattern string, n_candidates int, verdict string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "pattern", "n_candidates", "verdict")]
    link = F.col(f"`{url}`")
    parts = df.select(*kept, host_of(link).alias("host"), path_of(link).alias("path"), verdicts(link, host_of(link), path_of(link)).alias("__url_verdict"))
    return parts.select(*kept, "host", "path", *[F.col(f"__url_verdict.{c}").alias(c) for c in ("rule", "pattern", "n_candidates", "verdict")])


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


_VALUES = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in HOST_RULES)
_PATTERNS = ", ".join(f"('{r.pattern}', '{r.regex()}')" for r in PATTERN_RULES)
SQL = rf"""
WITH host_rules(action, rhost, rpath) AS (VALUES {_VALUES}),
patterns(pattern, re) AS (VALUES {_PATTERNS}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWERED}') AS url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWERED}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT rid, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM parts JOIN host_rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
hits AS (SELECT rid, min(pattern) AS pattern FROM parts JOIN patterns ON regexp_matches(url, re) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hits.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN rule IS NULL THEN hits.pattern END AS pattern
FROM parts LEFT JOIN fits USING (rid) LEFT JOIN hits USING (rid)"""
