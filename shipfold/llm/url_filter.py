"""URL filter: rules first, then a path-template tree per host.

1. A URL's host and path come from column expressions; the longest rule that fits a host
   (or its parent domains) and the start of the path decides. Rules are a short policy
   list, at most ``MAX_RULES``, and become one expression.
2. Path segments that hold a digit are variable at once; a URL's shape is its first
   ``DEPTH`` segments and whether more follow (one wildcard for the tail). URLs are
   counted per (host, shape) with a partial aggregation, so a hot host is a few rows a task.
3. Level by level under each host and template so far, a segment stays literal if at
   least ``MIN_SUPPORT`` URLs and one in ``LITERALS`` of the node's URLs have it; all
   others become the wildcard. So a node has at most ``LITERALS + 1`` branches.
4. Branches of a node that are statistically alike are merged: in the order of their
   shares, a branch joins the one before it if the shares of rejected, of accepted, of
   ending and of variable next segments all differ by less than Hoeffding's bound at
   ``ALPHA`` (as in state merging for stochastic automata).
5. A template's purity is (rejected + 1) / (labelled + 2) over its labelled URLs; from
   ``REJECT`` on the template is rejected. A template without labels is accepted.
   Labels are a boolean column of the caller's, or what the rules say.

Only column expressions, joins and aggregations run. Each level's counted shapes are
written to the shared folder, so no level is computed twice.

Defined cases: a null URL, or one without ``://``, has an empty host and path; an empty
path has no segments; repeated rows get one row each; empty segments count for nothing
(``/a//b/`` is ``/a/b``); an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, write_scratch

# The rules of the query, (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MAX_RULES = 500
#: Segments that the tree tells apart; the rest is one wildcard.
DEPTH = 4
MIN_SUPPORT = 5
LITERALS = 32
ALPHA = 0.05
HOEFFDING = math.sqrt(math.log(2 / ALPHA) / 2)
REJECT = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _longest_first(rules) -> list[tuple[str, str, str, str]]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules become one expression, not {len(rules)}")
    return [(v, r, r[:r.index("/")], r[r.index("/"):]) for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))]


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, text, rule_host, rule_path in reversed(_longest_first(rules)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The first segments, ``=literal`` or ``*`` each, joined by slashes; ``/**`` if more follow."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    head = F.transform(F.slice(segments, 1, DEPTH), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(F.concat(F.lit("="), s)))
    return F.concat(F.array_join(head, "/"), F.when(F.size(segments) > DEPTH, "/**").otherwise(""))


def _segment(level: int) -> Column:
    """A shape's segment at a level (from 1), null past its end; the tail is no segment."""
    return F.when(F.col("shape") != "", F.get(F.split("shape", "/"), F.lit(level - 1)))


_SHARES = ("bad", "good", "ends", "variable")


def merge_branches(branches: DataFrame) -> DataFrame:
    """(host, node, token, name): each branch with the name of its class, the least token."""
    order = Window.partitionBy("host", "node").orderBy(*[F.col(s) / F.col("n") for s in _SHARES], "token")
    wide = F.lit(HOEFFDING) * (F.lit(1.0) / F.sqrt("n") + F.lit(1.0) / F.sqrt(F.lag("n").over(order)))
    near = [F.abs(F.col(s) / F.col("n") - F.lag(F.col(s) / F.col("n")).over(order)) <= wide for s in _SHARES]
    alike = F.coalesce(reduce(lambda a, b: a & b, near), F.lit(False))
    numbered = branches.withColumn("new", F.when(alike, 0).otherwise(1)).withColumn("class", F.sum("new").over(order))
    least = F.min("token").over(Window.partitionBy("host", "node", "class"))
    return numbered.select("host", "node", "token", least.alias("name"))


def grow(shapes: DataFrame) -> DataFrame:
    """Shapes (host, shape, n, good, bad) with ``node``, their template."""
    at = shapes.withColumn("node", F.lit(""))
    for level in range(1, DEPTH + 1):
        here = at.withColumn("segment", _segment(level))
        counts = (here.where(F.col("segment").startswith("=")).groupBy("host", "node", "segment")
                  .agg(F.sum("n").alias("has")).where(F.col("has") >= MIN_SUPPORT))
        totals = here.where(F.col("segment").isNotNull()).groupBy("host", "node").agg(F.sum("n").alias("total"))
        literal = (counts.join(totals, ["host", "node"]).where(F.col("has") * LITERALS >= F.col("total"))
                   .select("host", "node", "segment", F.col("segment").alias("literal")))
        marked = write_scratch(
            here.join(literal, ["host", "node", "segment"], "left")
            .withColumn("token", F.when(F.col("segment").isNotNull(), F.coalesce("literal", F.lit("*"))))
            .drop("segment", "literal"), "url-tokens")
        after = _segment(level + 1) if level < DEPTH else F.when(F.col("shape").endswith("/**"), "*")
        branches = (marked.where(F.col("token").isNotNull()).withColumn("after", after)
                    .groupBy("host", "node", "token")
                    .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                         F.sum(F.when(F.col("after").isNull(), F.col("n")).otherwise(0)).alias("ends"),
                         F.sum(F.when(F.col("after") == "*", F.col("n")).otherwise(0)).alias("variable")))
        at = write_scratch(
            marked.join(merge_branches(branches), ["host", "node", "token"], "left")
            .withColumn("node", F.when(F.col("name").isNull(), F.col("node"))
                        .otherwise(F.concat("node", F.lit("/"), "name"))).drop("token", "name"), "url-nodes")
    return at.withColumn("node", F.when(F.col("shape").endswith("/**"), F.concat("node", F.lit("/**"))).otherwise(F.col("node")))


def judge_templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every counted shape."""
    grown = grow(shapes)
    purity = (F.sum("bad") + F.lit(1.0)) / (F.sum("bad") + F.sum("good") + F.lit(2.0))
    judged = grown.groupBy("host", "node").agg(purity.alias("purity"))
    return grown.select("host", "node", "shape").join(judged, ["host", "node"]).select(
        "host", "shape", F.col("node").alias("template"), "purity")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                label: Column | None = None) -> DataFrame:
    """One row per row: id, host, path, rule, verdict, template, purity.

    ``label`` (true: to be rejected) is a boolean of ``pages``; without it the rules'
    verdicts label the URLs that they decide.
    """
    host, path = host_and_path(column(pages, url_col))
    urls = pages.select(column(pages, id_col).alias("id"), host.alias("host"), path.alias("path"),
                        (F.lit(None).cast("boolean") if label is None else label).alias("label"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    urls = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
                       (F.col("label") if label is not None else verdict == "block").alias("label"), shape_of(F.col("path")).alias("shape"))
    shapes = write_scratch(
        urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label")).alias("good"),
                                          F.count_if("label").alias("bad")), "url-shapes")
    judged = write_scratch(judge_templates(shapes), "url-templates")
    return (urls.join(judged, ["host", "shape"], "left")
            .select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))


# --- the same in SQL ----------------------------------------------------------

def _sql_level(level: int) -> str:
    at = "shapes_" if level == 1 else f"at_{level - 1}"
    segment = f"CASE WHEN shape <> '' THEN string_split(shape, '/')[{level}] END"
    after = (f"CASE WHEN shape <> '' THEN string_split(shape, '/')[{level + 1}] END" if level < DEPTH
             else "CASE WHEN shape LIKE '%/**' THEN '*' END")
    alike = " AND ".join(f"abs({s} / n - lag({s} / n) OVER o) <= {HOEFFDING!r} * (1.0 / sqrt(n) + 1.0 / sqrt(lag(n) OVER o))"
                         for s in _SHARES)
    order = "PARTITION BY host, node ORDER BY " + ", ".join(f"{s} / n" for s in _SHARES) + ", token"
    return f"""
    here_{level} AS (SELECT *, {segment} AS segment FROM {at}),
    literal_{level} AS (
        SELECT c.* FROM (SELECT host, node, segment, sum(n) AS has FROM here_{level} WHERE segment LIKE '=%' GROUP BY ALL) c
        JOIN (SELECT host, node, sum(n) AS total FROM here_{level} WHERE segment IS NOT NULL GROUP BY ALL) t USING (host, node)
        WHERE has >= {MIN_SUPPORT} AND has * {LITERALS} >= total),
    marked_{level} AS (
        SELECT h.* EXCLUDE (segment), CASE WHEN h.segment IS NOT NULL THEN coalesce(l.segment, '*') END AS token, {after} AS after
        FROM here_{level} h LEFT JOIN literal_{level} l USING (host, node, segment)),
    branch_{level} AS (
        SELECT host, node, token, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(good) AS DOUBLE) AS good,
               CAST(sum(CASE WHEN after IS NULL THEN n ELSE 0 END) AS DOUBLE) AS ends,
               CAST(sum(CASE WHEN after = '*' THEN n ELSE 0 END) AS DOUBLE) AS variable
        FROM marked_{level} WHERE token IS NOT NULL GROUP BY host, node, token),
    new_{level} AS (SELECT *, CASE WHEN {alike} THEN 0 ELSE 1 END AS new FROM branch_{level} WINDOW o AS ({order})),
    class_{level} AS (SELECT *, sum(new) OVER ({order}) AS class FROM new_{level}),
    name_{level} AS (SELECT host, node, token, min(token) OVER (PARTITION BY host, node, class) AS name FROM class_{level}),
    at_{level} AS (
        SELECT m.* EXCLUDE (node, token, after), CASE WHEN name IS NULL THEN m.node ELSE m.node || '/' || name END AS node
        FROM marked_{level} m LEFT JOIN name_{level} x ON m.host = x.host AND m.node = x.node AND m.token = x.token)"""


def oracle(rules=RULES) -> str:
    """DuckDB SQL of ``filter_urls`` over ``pages`` with the rules as labels."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", r, v) for v, r, h, p in _longest_first(rules)]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    levels = ",".join(_sql_level(k) for k in range(1, DEPTH + 1))
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
    parsed AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
                      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
    ruled AS (SELECT *, {rule} AS rule, {ruled} AS ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM parsed),
    urls AS (SELECT *, array_to_string(list_transform(segments[1:{DEPTH}],
                        lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE '=' || s END), '/')
                       || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS shape FROM ruled),
    shapes_ AS (SELECT host, shape, '' AS node, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad
                FROM urls GROUP BY host, shape),
    {levels},
    done AS (SELECT host, shape, bad, good, node || CASE WHEN shape LIKE '%/**' THEN '/**' ELSE '' END AS template FROM at_{DEPTH}),
    judged AS (SELECT host, template, (sum(bad) + 1.0::DOUBLE) / (sum(bad) + sum(good) + 2.0::DOUBLE) AS purity
               FROM done GROUP BY host, template)
    SELECT page_id, u.host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
           template, purity
    FROM urls u JOIN done USING (host, shape) JOIN judged USING (host, template)"""
