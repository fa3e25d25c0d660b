"""URL filter: a trie over reversed host labels and path segments, longest match first.

Rules are (host, path, verdict).  A rule fits its host and all subdomains if
the path of the url starts with the rule's path; the rule with most host
labels, then the longest path, decides, whether it allows or blocks.  The
trie is broadcast, so its size is checked; a larger rule table is matched by
an equi-join on every suffix of the host (``judge_by_join``), with the same
result.

Defined results: a null url or one without ``://`` has an empty host and path
and gets the default verdict; repeated rows are judged one by one; of equal
rules that disagree, block wins; an empty rule table gives every url the
default; existing columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strataspark.llm.common import need_columns, ship

RESULTS = ("host", "path", "rule", "verdict")
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str


class UrlTrie:
    """Nodes are dictionaries; host labels and path segments have separate levels."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.root: dict = {}
        self.size = 0
        for rule in rules:
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {rule.verdict!r} is neither {ALLOW} nor {BLOCK}")
            self._add(rule)

    def _add(self, rule: UrlRule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(("h", label), {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault(("p", segment), {})
        # The last segment may be cut inside a segment of the url: it is kept beside the node and compared as a prefix.
        ends = node.setdefault("ends", {})
        if ends.get(rest, (None, ALLOW))[1] == ALLOW:
            ends[rest] = (rule.host + rule.path, rule.verdict)
        self.size += len(rule.host) + len(rule.path) + 64

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for start in reversed(hosts):
            best, node = None, start
            for segment in segments:
                fits = [rest for rest in node.get("ends", ()) if segment.startswith(rest)]
                if fits:
                    best = node["ends"][max(fits, key=len)]
                node = node.get(("p", segment))
                if node is None:
                    break
            if best:
                return best
        return None


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url as columns."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: Sequence[UrlRule], default: str = ALLOW, broadcast_limit: int = 64 << 20) -> DataFrame:
    """``pages`` with host, path, the rule that decided (null: none) and the verdict."""
    need_columns(pages, "url")
    trie = UrlTrie(rules)
    if trie.size > broadcast_limit:
        table = pages.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
        return judge_by_join(pages, table, default)
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    host, path = split_url(F.col("url"))
    own = [c for c in pages.columns if c not in RESULTS]
    table = pages.select(*own, host.alias("host"), path.alias("path"))
    schema = StructType([*table.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [find(h, p) for h, p in zip(hosts, paths)]
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return table.mapInArrow(run, schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The same for a rule table of any size: an equi-join on host suffixes, then the longest rule per url.

    A url is unfolded into one row per suffix of its host (a handful), and
    urls are grouped first, so a hot url is one row.  A rule host that many
    rules share meets its urls in one partition, which adaptive execution
    splits.
    """
    host, path = split_url(F.col("url"))
    own = pages.select(*[c for c in pages.columns if c not in RESULTS])
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = urls.select(
        "url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix")
    )
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fits = suffixes.join(named, F.col("suffix") == F.col("rule_host")).filter(F.expr("startswith(path, rule_path)"))
    length = F.struct(F.size(F.split("rule_host", r"\.")), F.char_length("rule_path"), (F.col("rule_verdict") == BLOCK).cast("int"))
    best = fits.groupBy("url").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), length).alias("best")
    )
    answered = urls.join(best, "url", "left").select(
        F.col("url").alias("_url"), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return own.join(answered, F.col("url").eqNullSafe(F.col("_url")), "left").select(
        *own.columns, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
