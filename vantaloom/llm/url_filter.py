"""URL filter: a trie over reversed host labels, then over path segments.

Allow and block entries are (host, path) rules. A rule fits its host and every
subdomain of it if the path of the url starts with the path of the rule. Of the
rules that fit, the longest wins; of an allow and a block entry with equal text
the block entry wins. A url that no rule fits gets ``default``.

Cases: a null url, or one without ``://``, has empty host and path and gets the
default. Letters A-Z of the host are lower-cased, other characters stay. Rows
that repeat give rows that repeat. An empty table gives an empty result. Columns
of the input stay, save those named like a column that is added, which the new
one replaces.

The trie is broadcast. Its size follows the rules, not the urls, and is checked
against ``max_trie_mb``; larger rule sets are matched by joins instead, on the
host suffixes of a url, with the same result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantaloom.sources.runtime import ship_package

Rule = tuple[str, str, str]  # verdict, host, path

_HERE = ("paths",)  # among the labels of a host node, the trie of its paths

OUT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the module's contract cuts them."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


@dataclass
class _Paths:
    """A trie node of path segments: whole segments lead on, partial ones end a rule."""

    into: dict
    ends: list  # (last partial segment, rule text, verdict)


class HostPathTrie:
    """Rules by reversed host labels; below each host a trie of path segments."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            paths = node.setdefault(_HERE, _Paths({}, []))
            *whole, partial = path.split("/")
            for segment in whole:
                paths = paths.into.setdefault(segment, _Paths({}, []))
            paths.ends.append((partial, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits and its verdict."""
        best: tuple[int, int, str, str] | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(_HERE)
            for segment in segments:
                if paths is None:
                    break
                for partial, text, verdict in paths.ends:
                    if segment.startswith(partial):
                        found = (len(text), verdict == "block", text, verdict)
                        best = found if best is None else max(best, found)
                paths = paths.into.get(segment)
        return best and best[2:]


def _by_trie(df: DataFrame, url_col: str, payload: bytes, default: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(payload)

    def judge(urls: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pickle.loads(held.value)
        for batch in urls:
            hosts, paths, rules, verdicts = [], [], [], []
            for url in batch.column(url_col).to_pylist():
                host, path = split_url(url)
                rule, verdict = trie.match(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                rules.append(rule)
                verdicts.append(verdict)
            kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in OUT.names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts)],
                names=[batch.schema.names[i] for i in kept] + list(OUT.names),
            )

    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in OUT.names] + OUT.fields)
    return df.mapInArrow(judge, schema)


def _by_join(df: DataFrame, url_col: str, rules: Sequence[Rule], default: str) -> DataFrame:
    """For rule sets over the broadcast bound: join each url's host suffixes with the rules."""
    spark = df.sparkSession
    urls = df.select(F.col(url_col).alias("__vantaloom_url")).distinct()
    rest = F.regexp_extract("__vantaloom_url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    urls = urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    known = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "verdict string, rule_host string, rule_path string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        urls.select("__vantaloom_url", "path", F.explode(suffixes).alias("rule_host"))
        .join(known, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("__vantaloom_url")
        .agg(F.max(F.struct(F.length("rule"), F.col("verdict"), F.col("rule"))).alias("best"))
        .withColumnRenamed("__vantaloom_url", "__vantaloom_fit")
    )
    judged = urls.join(fits, F.col("__vantaloom_url").eqNullSafe(F.col("__vantaloom_fit")), "left").select("__vantaloom_url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    base = df.select(*[c for c in df.columns if c.lower() not in OUT.names], df[url_col].alias("__vantaloom_key"))
    return base.join(judged, F.col("__vantaloom_key").eqNullSafe(F.col("__vantaloom_url")), "left").drop("__vantaloom_key", "__vantaloom_url")


def filter_urls(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow", max_trie_mb: float = 64) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``df``."""
    ship_package(df.sparkSession)
    payload = pickle.dumps(HostPathTrie(rules))
    if len(payload) <= max_trie_mb * 1e6:
        return _by_trie(df, url_col, payload, default)
    return _by_join(df, url_col, rules, default)
