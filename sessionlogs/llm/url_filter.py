"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with literal tokens that every
matching URL must contain. Each rule is filed under the one of its tokens that the
fewest URLs contain, so a URL's tokens fetch few candidate rules and only those run
their expressions. Everything is one projection of built-in functions: no shuffle,
no join, and equal URLs or page ids need no special care.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Columns besides the id and url are passed through untouched;
clashing names are avoided by building the result columns from the two inputs only.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the index; a lookup is one array access.
BUCKETS = 1024
#: The rules are part of the plan, so their number is bounded; more are refused.
MAX_RULES = 20_000

_RULE = "struct<token:string,pattern:string,name:string,verdict:string,rank:int>"


@dataclass(frozen=True)
class Rule:
    """``tokens``: lower-case literals, each a whole token of any URL that the pattern matches.

    Among fitting rules the highest ``rank`` wins, then the smaller name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Rule for a host, its subdomains, and paths that start with ``path``; longer rules win.

    The last piece of a path that doesn't end with a separator may go on in the URL, so it is no token.
    """
    whole = [*re.findall(r"[a-z0-9]+", host), *re.findall(r"[^\W_]+(?=[\W_])", path.lower(), re.ASCII)]
    return Rule(
        host + path, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}" if path else rf"^(?:[^/]*\.)?{_quoted(host)}(?:/|$)",
        tuple(dict.fromkeys(whole)), len(host) + len(path),
    )


def word_rule(*words: str) -> Rule:
    """Blocks hosts in which the words stand next to each other, joined by one sign or none of a host's."""
    name = "-".join(words)
    return Rule(f"host:{name}", "block", rf"^(?:[^/]*[.-])?{'[.-]'.join(map(_quoted, words))}(?:[.-][^/]*)?(?:/|$)", words, 0)


#: Junk hosts that the method blocks where no site rule fits.
JUNK_HOSTS = tuple(
    word_rule(*words)
    for words in (
        ("casino",), ("adult",), ("porn",), ("xxx",), ("escort",), ("viagra",), ("poker",), ("betting",),
        ("cheap", "pills"), ("free", "bets"), ("ads", "track"), ("ad", "server"), ("spam", "farm"), ("link", "farm"), ("click", "bait"),
    )
)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(address), F.lit("([a-z0-9]+)"), 1))


def token_counts(urls: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands. The result is bounded by the rules."""
    address = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    found = urls.select(F.explode(F.filter(tokens_of(address), lambda t: t.isin(tokens))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> Column:
    """Rules in hash buckets of their rarest token, as a constant; rules without a token go to bucket 0, which every URL reads."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are supported")
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS + 1)]
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        place = 1 + zlib.crc32(token.encode()) % BUCKETS if token else 0
        buckets[place].append({"token": token, "pattern": r.pattern, "name": r.name, "verdict": r.verdict, "rank": r.rank})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_RULE}>>")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def fitting(address: Column, rules: Column) -> Column:
    """The best fitting rule as a struct, or NULL."""

    def fetched(tokens: Column) -> Column:
        places = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(tokens, lambda t: F.crc32(t.cast("binary")) % F.lit(BUCKETS) + 1))
        return F.filter(
            F.flatten(F.transform(F.array_distinct(places), lambda p: rules[p.cast("int")])),
            lambda r: ((r["token"] == "") | F.array_contains(tokens, r["token"])) & F.regexp_like(address, r["pattern"]),
        )

    best = F.transform(
        _bound(tokens_of(address), fetched),
        lambda r: F.struct((-r["rank"]).alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict")),
    )
    return F.array_min(best)


def judge(df: DataFrame, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``fit`` (the winning rule's name) and ``verdict``; replaces columns of these names."""
    counts = token_counts(df, url, sorted({t for r in rules for t in r.tokens}))
    found = index(rules, counts)
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("fit", fitting(F.concat("host", "path"), found))
    return out.withColumns({"verdict": F.coalesce("fit.verdict", F.lit(default)), "fit": F.col("fit.name")})
