"""URL filter: pattern rules found through their rarest literal token.

A rule is a pattern over ``host + path``. The grammar is that of common
filter lists: literal text, ``*`` for any run, ``^`` for one separator or
the end, a leading ``||`` for "at the start of the host or of one of its
parent domains", a leading or trailing ``|`` for the start or the end.

Every rule is filed under one of its literal tokens: the one that the
fewest URLs of the corpus hold. A URL is cut into tokens, each token is
looked up in a hash table of rules, and only the rules fetched that way run
their regular expression. The table is a literal of the plan, so the pass
over the URLs is one narrow projection: no shuffle, no join, no Python.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_RE = r"(?s)^.*?://([^/?#]*)"
PATH_RE = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Bytes of the rules' table, which is a literal of the plan; more are an error.
TABLE_BYTES = 8 << 20
TABLE_TYPE = "array<array<struct<t:string,r:array<struct<regex:string,kind:int,len:int,rule:string,verdict:string>>>>>"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported as the rule; None makes the rule a fallback that
    only gives a verdict, where no named rule fits."""

    pattern: str
    verdict: str
    name: str | None = None

    @classmethod
    def domain(cls, host_path: str, verdict: str) -> Rule:
        """A rule on a host, its subdomains and a start of the path."""
        return cls("||" + host_path, verdict, host_path)


def rules_from(table: DataFrame) -> list[Rule]:
    """Rules of a table (pattern, verdict, name), name null for fallbacks; read
    no further than what filter_urls takes, and an error beyond that."""
    out, size = [], 0
    for r in table.select("pattern", "verdict", "name").orderBy("pattern", "verdict", "name").toLocalIterator():
        out.append(Rule(r["pattern"], r["verdict"], r["name"]))
        size += len(r["pattern"]) + len(r["name"] or "")
        if size > TABLE_BYTES:
            raise ValueError(f"the rules have more than {TABLE_BYTES} bytes")
    return out


def to_regex(pattern: str) -> str:
    """Regular expression of a pattern; it is searched for, not matched whole."""
    head, body, tail = "", pattern, ""
    if body.startswith("||"):
        head, body = r"^(?:[^/]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    special = {"*": "(?s:.*)", "^": r"(?:[^0-9A-Za-z_.%-]|\z)"}
    return head + "".join(special.get(c) or (c if c.isalnum() and c.isascii() else f"\\{c}" if c.isascii() else c) for c in body) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL has as whole tokens.

    A run of letters and digits counts only if what borders it is sure not
    to be a letter or digit: a literal separator or an anchor.
    """
    anchored, body = pattern.startswith("|"), pattern.lstrip("|")
    closed, body = body.endswith("|"), body.rstrip("|")
    out = []
    for m in re.finditer(r"[0-9A-Za-z]+", body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = closed if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.append(m[0])
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    host = F.translate(F.regexp_extract(url, HOST_RE, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PATH_RE, 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(target, "[^0-9A-Za-z]+"), lambda t: t != ""))


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens: at most one row a token."""
    if not tokens:
        return {}
    host, path = url_parts(F.col(url))
    found = F.array_intersect(_tokens(F.concat(host, path)), F.array(*map(F.lit, tokens)))
    rows = pages.select(F.explode(found).alias("t")).groupBy("t").count().collect()
    return {t: 0 for t in tokens} | {r["t"]: r["count"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[list, list]:
    """Hash table of rules by their rarest token, and the rules without one."""
    by_token: dict[str, list] = {}
    loose = []
    for r in rules:
        entry = {"regex": to_regex(r.pattern), "kind": int(r.name is not None), "len": len(r.name or r.pattern), "rule": r.name, "verdict": r.verdict}
        tokens = literal_tokens(r.pattern)
        if tokens:
            by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(entry)
        else:
            loose.append(entry)
    table: list[list] = [[] for _ in range(1 << max(1, len(by_token)).bit_length())]
    for t, entries in sorted(by_token.items()):
        table[zlib.crc32(t.encode()) % len(table)].append({"t": t, "r": entries})
    return table, loose


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Judge every row of ``pages``; adds host, path, rule and verdict.

    The longest named rule that fits wins (ties: the greater name); without
    one, the longest fallback rule (ties: the greater verdict); without any,
    ``default``. A null URL or one without ``://`` has empty host and path
    and gets ``default``. Rows are kept as they are, repeated ones too; the
    four new names replace columns of the same name, if there are any.
    """
    tokens = sorted({t for r in rules for t in literal_tokens(r.pattern)})
    table, loose = build_index(rules, token_counts(pages, url, tokens))
    if len(text := json.dumps(table)) > 4 * TABLE_BYTES:
        raise ValueError("the rules are too many for one table")
    index = F.from_json(F.lit(text), TABLE_TYPE)
    always = F.from_json(F.lit(json.dumps([[{"t": "", "r": loose}]])), TABLE_TYPE)[0][0]["r"]
    host, path = url_parts(F.col(url))
    target = F.concat(host, path)

    def fetch(t: Column) -> Column:
        slot = F.get(index, F.pmod(F.crc32(t), F.lit(len(table))).cast("int"))
        return F.flatten(F.transform(F.filter(slot, lambda e: e["t"] == t), lambda e: e["r"]))

    candidates = F.concat(F.flatten(F.transform(_tokens(target), fetch)), always)
    hits = F.filter(candidates, lambda r: F.rlike(target, r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["kind"].alias("kind"), r["len"].alias("len"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    keep = [pages[c] for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    return pages.select(*keep, host.alias("host"), path.alias("path"), best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
