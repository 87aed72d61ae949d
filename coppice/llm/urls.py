"""URL filters: allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import pick, ship

# Bytes of rule text that may go to every task; a longer list is joined.
MAX_RULE_BYTES = 8 * 1024 * 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    host: str
    path: str  # starts with "/"
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def _node() -> dict:
    return {"labels": {}, "segments": {}, "rules": []}


def build_trie(rules: Sequence[Rule]) -> dict:
    """Host labels from the right, then whole path segments; what is left of a rule's
    path, a prefix of the next segment, hangs at the last node. Of equal rules the first counts."""
    root = _node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node["labels"].setdefault(label, _node())
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node["segments"].setdefault(segment, _node())
        if rest not in [known for known, _ in node["rules"]]:
            node["rules"].append((rest, rule))
    return root


def longest(trie: dict, host: str, path: str) -> Rule | None:
    """The rule of most characters (host and path) that fits; the longer host among equals."""
    best, found = (-1, -1), None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        below = node
        for i, segment in enumerate(segments):
            for rest, rule in below["rules"]:
                length = (len(rule.text), len(rule.host))
                if segment.startswith(rest) and length > best:
                    best, found = length, rule
            below = below["segments"].get(segment)
            if below is None or i + 1 == len(segments):
                break
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _by_trie(parts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    @F.pandas_udf("rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = build_trie(rules)
        for hosts, paths in batches:
            found = [longest(trie, host, path) for host, path in zip(hosts, paths)]
            columns = {"rule": [r and r.text for r in found], "verdict": [r and r.verdict for r in found]}
            yield pd.DataFrame(columns, dtype=object)

    return parts.withColumn("found", match("host", "path")).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict")
    )


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct host and path meets the rules of its host and of the domains above."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1000), "."))
    known = parts.select("host", "path").distinct()
    named = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    text = F.concat("r_host", "r_path")
    order = F.struct(F.length(text).alias("n"), F.length("r_host").alias("h"), text.alias("rule"), "r_verdict")
    best = (
        known.withColumn("r_host", F.explode(above))
        .join(named, "r_host")
        .filter(F.startswith("path", "r_path"))
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict")
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """Per row: page_id, host, path, rule (its host and path, or null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's, character
    by character; the longest wins, and a page that none fits gets ``default``. The rules
    go to the tasks as a trie while they stay within ``max_bytes``, else by a join. A null
    URL, or one without ``://``, has an empty host and path. Repeated rows each give a
    row, an empty table none; a very long URL is read whole; other columns are ignored.
    """
    wrong = [rule for rule in rules if not rule.path.startswith("/") or rule.verdict not in ("allow", "block")]
    if wrong:
        raise ValueError(f"a rule needs a path from '/' and a verdict allow or block: {wrong}")
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if sum(len(rule.text.encode()) for rule in rules) <= max_bytes:
        judged = _by_trie(parts, list(rules))
    else:
        first = list({rule.text: rule for rule in reversed(rules)}.values())
        judged = _by_join(parts, pages.sparkSession.createDataFrame(first, "host string, path string, verdict string"))
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
