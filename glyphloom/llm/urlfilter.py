"""Verdicts on addresses: rules first, then purity of path templates.

Paths are reduced to shapes (digits become ``N``) and counted for each host before
anything is shuffled by host.  On the counts a tree of host and all segments is generalised
level by level: the very many children of a node become one wildcard branch before their
own children are counted, and children whose share of blocked pages does not stand out
from their parent's, on either side, are merged in the templates.  A template is rejected if its smoothed share of blocked pages is at least one half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: verdict, and host with the start of a path
RULES = (("block", "net/"), ("allow", "example.net/en/"),
         ("block", "example.com/de/"), ("allow", "org/fr/"))

MANY_CHILDREN = 32
CHILD_SHARE = 0.2
Z = 1.96
PRIOR, PRIOR_WEIGHT = 0.1, 2.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``rule, verdict`` of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _levels(first: Column, rest: Column) -> Column:
    """The segments of a shape and an end mark, "" (all segments but the first begin with a slash)."""
    deeper = F.regexp_extract_all(rest, F.lit(r"/[^/]+/\z|/[^/]*"), F.lit(0))
    return F.concat(F.array(first), deeper, F.array(F.lit("")))


def _templates(counts: DataFrame) -> DataFrame:
    """``counts`` (one row a shape) with ``template``: its segments, ``*`` where merged, without a tail of them.

    The tree is walked from the host down, one level of branches a round; segments that
    all shapes of a node share are passed in one step, and a node of one shape is done.
    """
    node, done = ["host", "at"], []
    none = F.array().cast("array<string>")
    active = counts.withColumns({
        "todo": _levels(F.col("first"), F.col("rest")), "at": none, "template": none, "stars": F.lit(0)})
    while True:
        ends = active.groupBy(*node).agg(F.min("todo").alias("low"), F.max("todo").alias("high"))
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        active = stage(active.join(
            ends.select(*node, (F.array_position(same, False) - 1).cast("int").alias("common")), node))
        done.append(active.where("common < 0").select(*counts.columns, "template"))
        branching = active.where("common >= 0").withColumn("child", F.get("todo", F.col("common")))
        if branching.isEmpty():
            return reduce(DataFrame.unionByName, done)
        nodes = branching.groupBy(*node, "child").agg(F.sum("visits").alias("v"), F.sum("blocked").alias("b"))
        above = nodes.groupBy(*node).agg(
            F.count(F.lit(1)).alias("children"), F.sum("v").alias("pv"), F.sum("b").alias("pb"))
        share, base = F.col("b") / F.col("v"), F.col("pb") / F.col("pv")
        stands_out = F.abs(share - base) > Z * F.sqrt(base * (1 - base) / F.col("v"))
        variable = (F.col("children") > MANY_CHILDREN) & (F.col("children") > CHILD_SHARE * F.col("pv"))
        told = nodes.join(above, node).select(
            *node, "child", variable.alias("variable"), (stands_out & ~variable).alias("own"))
        passed = F.col("stars") + F.col("common")
        active = branching.join(told, [*node, "child"]).select(
            *counts.columns,
            F.expr("slice(todo, common + 2, size(todo))").alias("todo"),
            F.concat("at", F.expr("slice(todo, 1, common)"),
                     F.array(F.when(F.col("variable"), "*").otherwise(F.col("child")))).alias("at"),
            F.when(F.col("own"), F.concat("template", F.array_repeat(F.lit("*"), passed), F.array("child")))
            .otherwise(F.col("template")).alias("template"),
            F.when(F.col("own"), 0).otherwise(passed + 1).alias("stars"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    A null address, or one without ``://``, has an empty host and path and no rule; such
    rows share one template.  Repeated rows count as visits each and get a row each.
    Null keys are kept.  Addresses that no rule fits and whose template has no blocked
    page are allowed.  Other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({
        "rule": rule, "says": verdict,
        "first": F.regexp_replace(F.regexp_extract("path", "^/?([^/]*)", 1), "[0-9]+", "N"),
        "rest": F.regexp_replace(F.regexp_extract("path", "^/?[^/]*([\\s\\S]*)$", 1), "[0-9]+", "N"),
    })
    shapes = ["host", "first", "rest"]
    counts = rows.groupBy(*shapes).agg(
        F.count(F.lit(1)).alias("visits"),
        F.coalesce(F.sum((F.col("says") == "block").cast("long")), F.lit(0)).alias("blocked"))
    judged = stage(_templates(counts))
    template = ["host", "template"]
    pure = judged.groupBy(*template).agg(F.sum("visits").alias("tv"), F.sum("blocked").alias("tb")).select(
        *template, ((F.col("tb") + PRIOR * PRIOR_WEIGHT) / (F.col("tv") + PRIOR_WEIGHT)).alias("purity"))
    judged = judged.select(*shapes, "template").join(pure, template)
    return rows.join(judged.select(*shapes, "purity"), shapes).select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("purity") >= 0.5, "block").otherwise("allow")).alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(regexp_extract(path, '^/?([^/]*)', 1), '[0-9]+', 'N', 'g') AS first,
    regexp_replace(regexp_extract(path, '^/?[^/]*([\s\S]*)$', 1), '[0-9]+', 'N', 'g') AS rest FROM p),
r AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says
  FROM fits),
c AS (SELECT host, first, rest, count(*) AS visits, count(*) FILTER (says = 'block') AS blocked FROM r GROUP BY ALL),
up2 AS (SELECT host, first, count(*) AS children, sum(visits) AS pv, sum(blocked) AS pb FROM c GROUP BY ALL),
c2 AS (SELECT c.*, CASE WHEN blocked / visits - pb / pv > 1.96 * sqrt(pb / pv * (1 - pb / pv) / visits)
    AND NOT (children > 32 AND children > 0.2 * pv) THEN rest ELSE '*' END AS to_rest
  FROM c JOIN up2 USING (host, first)),
n1 AS (SELECT host, first, sum(visits) AS v, sum(blocked) AS b FROM c GROUP BY ALL),
up1 AS (SELECT host, count(*) AS children, sum(v) AS pv, sum(b) AS pb FROM n1 GROUP BY ALL),
t1 AS (SELECT host, first, CASE WHEN b / v - pb / pv > 1.96 * sqrt(pb / pv * (1 - pb / pv) / v)
    AND NOT (children > 32 AND children > 0.2 * pv) THEN first ELSE '*' END AS to_first
  FROM n1 JOIN up1 USING (host)),
t AS (SELECT * FROM c2 JOIN t1 USING (host, first)),
pure AS (SELECT host, to_first, to_rest, (sum(blocked) + 0.1 * 2.0) / (sum(visits) + 2.0) AS purity FROM t GROUP BY ALL)
SELECT page_id, r.host, path, rule,
  coalesce(says, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN t ON r.host = t.host AND r.first = t.first AND r.rest = t.rest
  JOIN pure ON pure.host = t.host AND pure.to_first = t.to_first AND pure.to_rest = t.to_rest
"""
