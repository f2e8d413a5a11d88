"""URL filters by hashed expressions (operator 3), DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions. The short
hash prefixes of the expressions meet those of the rules in an equi-join; the
full digest then confirms a match and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Hex digits of the SHA-256 digest that form the join key.
PREFIX_HEX = 8

#: Fixed values of the query's contract: (host, path, action).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Digest of each rule's expression. Rules without a host are left out; block wins where two actions are given."""
    expr = F.concat(F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit("")))
    return (
        rules.filter("host is not null and host <> '' and action in ('allow', 'block')")
        .groupBy(expr.alias("rule"), F.translate("host", _UPPER, _LOWER).alias("rule_host"))
        .agg(F.max("action").alias("action"))
        .withColumn("rule_digest", F.sha2(F.col("rule").cast("binary"), 256))
        .withColumn("key", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``urls``; input columns of these names give way.

    A rule fits its host and all subdomains, if the path starts with the
    rule's. The longest rule (host and path together, then the longer host)
    wins; where none fits, ``rule`` is null and ``verdict`` is ``default``.
    Null URLs and those without ``://`` have an empty host and path, so that no
    rule fits. Every input row gives one row, repeated ones too; an empty
    table gives an empty one.

    Distinct (host, path) pairs are judged once, so a hot page costs one row.
    Rules are joined by key: Spark broadcasts them only below its own size
    threshold, and otherwise shuffles with skew splitting.
    """
    rules = prepare_rules(rules)
    # Two lists of distinct lengths, bounded by the longest host and path of a rule.
    sizes = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))),
        F.array_sort(F.collect_set(F.length("rule") - F.length("rule_host"))),
    ).first()
    labels, lengths = ([int(x) for x in part] for part in sizes)
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = urls.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    own = [F.col(f"row.`{c}`").alias(c) for c in own]
    if not labels:
        return parts.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(F.split("host", r"\."))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    expanded = (
        parts.filter("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("expression", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))))
        .withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256))
        .withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    )
    best = (
        expanded.join(rules, "key")
        .filter("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "action", "rule")).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        *own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the contract's rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
SQL = rf"""
with rules(rhost, rpath, action) as (values {_VALUES}),
u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), p as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u
), d as (select distinct host, path from p),
m as (
  select d.host, d.path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from d join rules on (d.host = rhost or ends_with(d.host, '.' || rhost)) and starts_with(d.path, rpath)
  group by 1, 2
)
select page_id, p.host, p.path, rule, coalesce(action, 'allow') as verdict
from p left join m on p.host = m.host and p.path = m.path
"""
