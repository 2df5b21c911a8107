"""URL rules matched by a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host and every subdomain where the url's path starts with the rule's path. Of the
rules that fit, the one with the most host labels, then the longest path, decides; urls without one get the default. A trie of
up to MOST_RULES rules is broadcast. A longer list, whose trie would not fit beside a worker's batches, is joined instead: each url
meets the rules of its host suffixes and leading folders by equal keys, so no rule is sent to all tasks.

Rows: a null url, or one without "://", has empty host and path and gets the default verdict (no rule has an empty host).
Empty tables, repeated urls and further columns of any name are fine. Two rules with the same host and path are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prooflake.llm.common import stored, table

#: Rules, and bytes of their text, whose trie may be broadcast: it takes about 1 KB a rule, so some 50 MB in a worker.
MOST_RULES, MOST_RULE_BYTES = 50_000, 4 << 20
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nodes are dictionaries by host label (last label first); a node's "/" entry is the trie of its paths.

    A path trie goes by whole segments; the piece after a rule's last slash may end inside a segment of the url, so each
    path node keeps such pieces, longest first, with the rule's text and verdict.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {"next": {}, "ends": []})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "ends": []})
        if any(rest == end for end, _, _ in node["ends"]):
            raise ValueError(f"two rules for {host}{path}")
        node["ends"].append((rest, host + path, verdict))
        node["ends"].sort(key=lambda end: (-len(end[0]), end[0]))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def longest_rule(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The deciding rule's text and verdict: the deepest host node, and there the deepest path, that fits."""
    node, tries = trie, []
    for label in reversed(host.split(".")):
        node = node.get(label) if label != "/" else None
        if node is None:
            break
        if "/" in node:
            tries.append(node["/"])
    segments = path.split("/")
    for paths in reversed(tries):
        best, node, k = None, paths, 0
        while True:
            rest = segments[k] if k < len(segments) else None
            if rest is None:
                break
            for end, rule, verdict in node["ends"]:
                if rest.startswith(end):
                    best = rule, verdict
                    break
            # a whole segment must be followed by a slash in the url
            node = node["next"].get(rest) if k + 1 < len(segments) else None
            if node is None:
                break
            k += 1
        if best:
            return best
    return None


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; one narrow pass that reads only the id and the url, or a join if rules are many."""
    spark = pages.sparkSession
    if len(rules) > MOST_RULES or sum(len(h) + len(p) for h, p, _ in rules) > MOST_RULE_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default, id_col, url_col)
    shared = spark.sparkContext.broadcast(build_trie(rules))
    kind = pages.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [longest_rule(trie, h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [f and f[0] for f in found], [f[1] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(work, f"id {kind.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As judge_urls, for rules (host, path, verdict) of any number. A rule's key is its host and its path up to the last slash; what follows
    that must begin the url's next segment."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folder = F.regexp_extract("path", r"(?s)^.*/", 0)
    keys = rules.select(F.translate("host", upper, lower).alias("r_host"), folder.alias("r_folder"), F.substring("path", F.length(folder) + 1, F.lit(1 << 30)).alias("r_rest"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("says"))
    keys = stored(keys, "url-rules")
    if not keys.groupBy("r_host", "r_folder", "r_rest").count().where("count > 1").isEmpty():
        raise ValueError("two rules for one host and path")
    url = F.col("url")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    host = F.regexp_extract("tail", r"^[^/?#]*", 0)
    path = F.substring(F.regexp_extract("tail", r"^[^?#]*", 0), F.length(host) + 1, F.lit(1 << 30))
    split = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("row", "id", rest.alias("tail"))
    rows = stored(split.select("row", "id", F.translate(host, upper, lower).alias("host"), path.alias("path")), "urls")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffix = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(n.alias("n"), suffix(n).alias("host")))
    # the folder of k segments, and what stands behind it
    begin = lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))
    folders = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), begin)
    each = rows.select("row", "path", F.explode(hosts).alias("h"), F.col("path").alias("p")).select("row", "p", "h.n", F.col("h.host").alias("host"), F.explode(folders).alias("folder"))
    met = each.join(keys, (F.col("host") == F.col("r_host")) & (F.col("folder") == F.col("r_folder")))
    fits = met.where(F.startswith(F.substring("p", F.length("folder") + 1, F.lit(1 << 30)), F.col("r_rest")))
    best = fits.groupBy("row").agg(F.max(F.struct("n", (F.length("r_folder") + F.length("r_rest")).alias("m"), "rule", "says")).alias("b"))
    out = rows.join(best, "row", "left").select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.says", F.lit(default)).alias("verdict"))
    return out.withColumnRenamed("id", id_col)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM cut
), rules(rhost, rpath, says) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, says,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
