"""Allow and block rules for urls.

The rules form one trie: host labels from the last to the first, then path segments. A url
walks down it once; the deepest rule met decides. The trie is as large as the rule list,
whose size is checked before it is broadcast.
"""

import pandas as pd
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
HERE, PATHS, REST = 0, 1, 2  # keys of a node besides labels: rule, path trie, unfinished segments


def split_url(url):
    """(host, path) columns. No ``://`` or null: both empty.

    The host ends at ``/``, ``?`` or ``#``, the path at ``?`` or ``#``; only A-Z of the host
    are lower-cased.
    """
    url = F.col(f"`{url}`") if isinstance(url, str) else url
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def build(rules):
    """Trie of ``(host, path, verdict)``; the path begins with ``/`` or is empty.

    Of two verdicts for one host and path, block wins.
    """
    root = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no verdict: {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        # the last piece is a prefix of a segment, often the empty one
        entry = node.setdefault(REST, {})
        if entry.get(last, ("", ""))[1] != "block":
            entry[last] = (host + path, verdict)
    return root


def _below(node, segments):
    """The longest rule of a path trie that fits."""
    best = None
    for segment in segments:
        rest = node.get(REST)
        if rest:
            fits = [p for p in ([segment[:n] for n in range(len(segment) + 1)] if len(segment) < len(rest) else rest)
                    if p in rest and segment.startswith(p)]
            if fits:
                best = rest[max(fits, key=len)]
        node = node.get(segment)
        if node is None:
            break
    return best


def look_up(trie, host, path):
    """(rule, verdict) of the longest match: the longer host first, then the longer path."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if PATHS in node:
            best = _below(node[PATHS], segments) or best
    return best


def judge(df, rules, url_col="url", default="allow"):
    """``df`` with host, path, rule and verdict of each url, in place of such columns.

    ``rules``: list of (host, path, verdict). A rule fits its host and all subdomains where
    the url's path begins with the rule's. No rule: null, and ``default``. A null url or one
    without ``://`` has an empty host and path, which no rule with a host fits. Rows
    are independent; an empty table gives an empty one.
    """
    rules = list(rules)
    size = sum(len(h) + len(p) + 200 for h, p, _ in rules)
    if size > MAX_BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of rules: split the list by top-level label")
    sent = df.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, verdict string")
    def verdicts(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = sent.value
        found = [look_up(trie, h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    host, path = split_url(url_col)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    out = df.select(*rest, host.alias("host"), path.alias("path")) if url_col not in ("host", "path", "rule", "verdict") \
        else df.select(host.alias("host"), path.alias("path"), *rest)
    return out.withColumn("found", verdicts("host", "path")).select(
        *[c for c in out.columns], F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
