"""Filtering of urls by rules and by path templates: a tree of segments for each host.

The tree grows level by level. At each of its nodes the next segments are counted: one that makes up a good part of the node's pages is a branch of its own, all
others are variable and share the wildcard `*` (numbers and long hexadecimal ids always stand for themselves as `*`, with their extension). Branches whose
shares of bad labels don't differ from those of the others at their node (chi-square of the two by two table) are merged, `{a|b|*}`, and grow on as one. A page's
template is its way through the tree. Its purity is the share of good labels, smoothed towards its host's, which is smoothed towards that of all pages; templates that are
more likely bad than the threshold are rejected.

Counts are taken by (host, node, segment) and summed from there, so that no page of a hot host is gathered; what the counts say is looked up by
common.spread_join, in which hot keys are a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

#: (verdict, host/path): a rule fits its host and all subdomains, where the path of the url starts with the rule's; the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of the tree; what lies deeper is `**`.
DEPTH = 6
#: A segment with one of so many pages of its node, and with so many pages, is a branch.
BRANCHES, LEAST_PAGES = 20, 3
#: Chi-square of one degree of freedom at 5 %.
DIFFERS = 3.841
#: Labels that the smoothing counts as, and the share of bad ones from which a template is rejected.
STRENGTH, REJECT = 4.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ID = r"^([0-9]+|[0-9a-fA-F-]{12,})(\.[A-Za-z0-9]{1,5})?\z"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; empty for null and without ://."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1))
    return F.translate(F.coalesce(F.substring_index(F.substring_index(after, "?", 1), "#", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null and without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""))
    return F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (of two as long, the first by name) that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _named(segment: Column) -> Column:
    """A segment as the tree knows it: ids are wildcards already, and signs with a meaning of their own are marked."""
    own = F.when(F.substring(segment, 1, 1).isin("*", "{", "\\"), F.concat(F.lit("\\"), segment)).otherwise(segment)
    return F.when(segment.rlike(_ID), F.concat(F.lit("*"), F.regexp_extract(segment, _ID, 2))).otherwise(own)


def _node_key(*parts: str) -> Column:
    return F.unhex(F.sha2(F.concat_ws("/", *parts), 256))


def _branches(rows: DataFrame, branches: int, least_pages: int, differs: float) -> DataFrame:
    """(key, copies, _branch) for each (host, template, _child) of rows: the merged branch that it belongs to."""
    count = lambda df: (F.sum(c).alias(c) for c in df)
    sums = "pages", "good", "bad"
    child = materialize(rows.groupBy("host", "template", "_child").agg(F.count("*").alias("pages"), *count(("good", "bad"))).withColumn("_at", _node_key("host", "template")))
    node = materialize(child.groupBy("_at").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in sums)))
    total = int(node.agg(F.sum("children")).first()[0] or 0)
    child = spread_join(child, node, "_at", "children", total)
    own = (F.col("pages") * branches >= F.col("all_pages")) & (F.col("pages") >= least_pages)
    child = materialize(child.withColumn("_own", F.when(own, F.col("_child")).otherwise(F.lit("*"))))
    # No node has more than `branches` branches and the wildcard.
    branch = child.groupBy("_at", "_own").agg(*count(sums), *(F.first(f"all_{c}").alias(f"all_{c}") for c in sums))
    n1, n2 = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
    cross = (F.col("bad") * (F.col("all_good") - F.col("good")) - (F.col("all_bad") - F.col("bad")) * F.col("good")).cast("double")
    apart = (n1 + n2).cast("double") * cross * cross > F.lit(differs) * n1.cast("double") * n2.cast("double") * F.col("all_bad").cast("double") * F.col("all_good").cast("double")
    branch = branch.withColumn("_apart", apart)
    alike = F.array_sort(F.collect_list(F.when(~F.col("_apart"), F.col("_own"))))
    merged = branch.groupBy("_at").agg(alike.alias("_alike"), F.collect_set(F.when(F.col("_apart"), F.col("_own"))).alias("_others"))
    name = F.when(F.size("_alike") == 1, F.col("_alike")[0]).otherwise(F.concat(F.lit("{"), F.array_join("_alike", "|"), F.lit("}")))
    merged = merged.select("_at", "_others", name.alias("_merged")).join(node.select("_at", "children"), "_at")
    found = spread_join(child.select("host", "template", "_child", "pages", "_own", "_at"), merged, "_at", "children", total)
    chosen = F.when(F.array_contains("_others", F.col("_own")), F.col("_own")).otherwise(F.col("_merged"))
    return found.select(_node_key("host", "template", "_child").alias("key"), F.col("pages").alias("copies"), chosen.alias("_branch"))


def _labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages with good and bad: how many labels of either kind a page has."""
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.col("quality").cast("int").alias("quality")).where("page_id IS NOT NULL").groupBy("page_id")
    marks = marks.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    marks = materialize(marks.join(pages.groupBy("page_id").agg(F.count("*").alias("copies")), "page_id"))
    none, total = F.lit(0).cast("long"), int(marks.agg(F.sum("copies")).first()[0] or 0)
    found = spread_join(pages, marks, "page_id", "copies", total)
    return found.withColumn("good", F.coalesce("good", none)).withColumn("bad", F.coalesce("bad", none))


def judge(
    pages: DataFrame, labels: DataFrame, rules=RULES, depth: int = DEPTH, branches: int = BRANCHES, least_pages: int = LEAST_PAGES, differs: float = DIFFERS, strength: float = STRENGTH, reject: float = REJECT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, labels, bad_share) for every row of pages(page_id, url).

    Host: after the first :// up to /, ?, # or the end, A to Z lower-cased; path: from there up to ? or #. A null url, or one without ://, has neither, and is a page of the
    empty host. Empty segments are passed over. verdict: that of the longest rule that fits; else block if the template's smoothed share of bad labels is over
    reject, else allow. labels(doc_id, quality): quality 0 is bad and 1 good, others and null no label; a page with several labels counts each, a
    label of several rows of one page_id each row. Without labels nothing is rejected. Repeated rows are rows of their own; ties have no part in any
    choice. Other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = materialize(_labelled(rows, labels).withColumn("template", F.lit("")))
    total, good, bad = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    longest = rows.agg(F.max(F.size(segments))).first()[0] or 0
    for level in range(min(longest, depth)):
        inner = F.size(segments) > level
        child = _named(segments[level])
        at = materialize(rows.withColumn("_child", F.when(inner, child)).withColumn("_to", F.when(inner, _node_key("host", "template", "_child"))))
        ways = materialize(_branches(at.where("_child IS NOT NULL"), branches, least_pages, differs))
        gone = spread_join(at, ways.withColumnRenamed("key", "_to"), "_to", "copies", total)
        further = F.when(F.col("_child").isNotNull(), F.concat("template", F.lit("/"), "_branch")).otherwise(F.col("template"))
        rows = materialize(gone.withColumn("template", further).drop("_child", "_to", "_branch"))
    deeper = F.size(segments) > depth
    rows = rows.withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    rows = rows.withColumn("_leaf", _node_key("host", "template"))
    leaves = materialize(rows.groupBy("host", "template").agg(F.count("*").alias("pages"), F.sum("good").alias("own_good"), F.sum("bad").alias("own_bad")))
    hosts = leaves.groupBy("host").agg(F.count("*").alias("templates"), F.sum("own_good").alias("host_good"), F.sum("own_bad").alias("host_bad"))
    n_leaves = leaves.count()
    base = float(bad) / float(good + bad) if good + bad else 0.0
    smooth = lambda b, g, prior: (b.cast("double") + F.lit(strength) * prior) / ((b + g).cast("double") + F.lit(strength))
    prior = smooth(F.col("host_bad"), F.col("host_good"), F.lit(base))
    rated = spread_join(leaves, hosts, "host", "templates", n_leaves).select(
        _node_key("host", "template").alias("_leaf"), "pages", (F.col("own_good") + F.col("own_bad")).alias("labels"), smooth(F.col("own_bad"), F.col("own_good"), prior).alias("bad_share")
    )
    out = spread_join(rows, materialize(rated), "_leaf", "pages", total)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("bad_share") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "labels", "bad_share")


def _oracle() -> str:
    def level(i: int) -> str:
        """The CTEs of a level: rows, children, nodes, branches and merged branches."""
        return f"""
c{i} AS (
  SELECT *, CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-fA-F-]{{12,}})(\\.[A-Za-z0-9]{{1,5}})?\\z') THEN '*' || regexp_extract(s, '^([0-9]+|[0-9a-fA-F-]{{12,}})(\\.[A-Za-z0-9]{{1,5}})?\\z', 2)
              WHEN s[1] IN ('*', '{{', '\\') THEN '\\' || s ELSE s END AS child FROM (SELECT *, segs[{i + 1}] AS s FROM t{i})),
k{i} AS (SELECT host, template, child, count(*) AS pages, sum(good) AS good, sum(bad) AS bad FROM c{i} WHERE child IS NOT NULL GROUP BY ALL),
n{i} AS (SELECT *, sum(pages) OVER w AS ap, sum(good) OVER w AS ag, sum(bad) OVER w AS ab FROM k{i} WINDOW w AS (PARTITION BY host, template)),
o{i} AS (SELECT *, CASE WHEN pages * {BRANCHES} >= ap AND pages >= {LEAST_PAGES} THEN child ELSE '*' END AS own FROM n{i}),
b{i} AS (SELECT host, template, own, sum(good) AS g, sum(bad) AS b, any_value(ag) AS ag, any_value(ab) AS ab FROM o{i} GROUP BY ALL),
a{i} AS (
  SELECT host, template, own, CAST(ag + ab AS DOUBLE) * CAST(b * (ag - g) - (ab - b) * g AS DOUBLE) * CAST(b * (ag - g) - (ab - b) * g AS DOUBLE)
         > CAST({DIFFERS} AS DOUBLE) * CAST(g + b AS DOUBLE) * CAST(ag + ab - g - b AS DOUBLE) * CAST(ab AS DOUBLE) * CAST(ag AS DOUBLE) AS apart FROM b{i}),
m{i} AS (SELECT host, template, CASE WHEN count(*) = 1 THEN min(own) ELSE '{{' || string_agg(own, '|' ORDER BY own) || '}}' END AS merged FROM a{i} WHERE NOT apart GROUP BY ALL),
w{i} AS (
  SELECT o.host, o.template, o.child, CASE WHEN a.apart THEN o.own ELSE m.merged END AS branch
  FROM o{i} o JOIN a{i} a ON a.host = o.host AND a.template = o.template AND a.own = o.own LEFT JOIN m{i} m ON m.host = o.host AND m.template = o.template),
t{i + 1} AS (
  SELECT c.page_id, c.host, c.path, c.segs, c.good, c.bad, CASE WHEN c.child IS NULL THEN c.template ELSE c.template || '/' || w.branch END AS template
  FROM c{i} c LEFT JOIN w{i} w ON w.host = c.host AND w.template = c.template AND w.child = c.child),"""

    fits = "\n".join(
        f"        WHEN (host = '{n.partition('/')[0]}' OR ends_with(host, '.{n.partition('/')[0]}')) AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'"
        for _, n in sorted(RULES, key=lambda r: -len(r[1]))
    )
    said = " ".join(f"WHEN '{n}' THEN '{v}'" for v, n in RULES)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
marks AS (SELECT doc_id, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM labels GROUP BY doc_id),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
t0 AS (
  SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, '' AS template
  FROM parsed LEFT JOIN marks ON doc_id = page_id),
{"".join(level(i) for i in range(DEPTH))}
final AS (SELECT * REPLACE (CASE WHEN len(segs) > {DEPTH} THEN template || '/**' ELSE template END AS template) FROM t{DEPTH}),
base AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(good) + sum(bad), 0), 0) AS p FROM final),
leaves AS (SELECT host, template, sum(good) AS g, sum(bad) AS b FROM final GROUP BY ALL),
hosts AS (SELECT host, (CAST(sum(b) AS DOUBLE) + CAST({STRENGTH} AS DOUBLE) * any_value(p)) / (CAST(sum(b) + sum(g) AS DOUBLE) + CAST({STRENGTH} AS DOUBLE)) AS prior FROM leaves, base GROUP BY host),
rated AS (SELECT host, template, g + b AS labels, (CAST(b AS DOUBLE) + CAST({STRENGTH} AS DOUBLE) * prior) / (CAST(b + g AS DOUBLE) + CAST({STRENGTH} AS DOUBLE)) AS bad_share FROM leaves JOIN hosts USING (host)),
ruled AS (
  SELECT page_id, host, path, template, CASE
{fits}
    END AS rule FROM final)
SELECT page_id, host, path, rule, coalesce(CASE rule {said} END, CASE WHEN bad_share > CAST({REJECT} AS DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict, template, CAST(labels AS BIGINT) AS labels, bad_share
FROM ruled JOIN rated USING (host, template)"""


ORACLE = _oracle()
