"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short digests, then confirmed. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: The rules of the registered query as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Null or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names in pages are replaced).

    rules: host, path, verdict. A rule fits its host and all subdomains, if the URL's path starts with the rule's path; the
    longest fitting rule wins, at equal length the one with the longer host, then 'block' before 'allow'. Without a fitting rule,
    rule is null and verdict is `default`.

    Each distinct (host, path) is expanded once into the host's suffixes of as many labels as rules' hosts have, times the path's prefixes of those lengths
    that the rules' paths have, so that long hosts and paths cost their length only; the first `short` hex digits of each expression's SHA-256 are equi-joined with the rules', and the full
    digests confirm. Spark broadcasts the rules only if they are under its size limit, else it shuffles both sides. A host with a third of all rows is
    pre-aggregated by the distinct. Null and odd URLs have host and path '' and fit no rule; rules with null host or path fit nothing.
    """
    digest = lambda c: F.sha2(c, 256)
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host IS NOT NULL AND r_path IS NOT NULL")
    rules = rules.select("*", F.concat("r_host", "r_path").alias("r_rule"), digest(F.concat_ws("\n", "r_host", "r_path")).alias("r_digest")).withColumn("r_short", F.substring("r_digest", 1, short))
    lengths = sorted(r.n for r in rules.select(F.length("r_path").alias("n")).distinct().collect())  # at most as many as characters in a path
    host, path = host_and_path(F.col(url))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    depths = sorted(r.n for r in rules.select((dots(F.col("r_host")) + 1).alias("n")).distinct().collect())  # at most as many as labels in a host
    suffixes = F.array_compact(F.array(*[F.when(dots(F.col("host")) + 1 >= n, F.substring_index("host", ".", -n)) for n in depths]).cast("array<string>"))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    kinds = parsed.where("host <> ''").select("host", "path").distinct()
    asked = kinds.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    asked = asked.select("host", "path", digest(F.concat_ws("\n", "suffix", "prefix")).alias("digest")).withColumn("short", F.substring("digest", 1, short))
    hits = asked.join(rules, asked.short == rules.r_short).where("digest = r_digest")
    best = F.max(F.struct(F.length("r_rule"), F.length("r_host"), (F.col("r_verdict") == "block").alias("block"), "r_rule", "r_verdict")).alias("best")
    best = hits.groupBy("host", "path").agg(best).select("host", "path", F.col("best.r_rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    return parsed.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
