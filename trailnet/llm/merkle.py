"""A manifest of a dataset that proves each row: a Merkle tree for each language, and one over their roots.

Leaves are sorted in ranges and numbered, so that a partition holds a run of consecutive leaves of a tree and knows where it begins. A task goes
through its run with a stack, like a mountain range: a node is pushed, and while the last nodes on the stack are all children of one parent they are
carried, which completes that parent. The last parent of a level takes the children there are (even one): nothing is padded. What stays on the stack are the
run's peaks, a few dozen, among them nodes at its unaligned edges whose siblings lie in other runs.

Peaks are merged by the same stack in regions, each REGION_LEVELS levels higher than the one before, until a tree is one node. A region takes
some thousand runs' peaks, so rounds grow with the logarithm of the rows. On the way back every peak is told the siblings above it, and a second
pass over the runs joins these to the siblings inside. Only leaves (a few hundred bytes each, never texts) are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, in_ranges, materialize

#: Leaves of a run at least; with the root of the number of rows, neither runs nor the leaves of one become too many.
RUN_ROWS = 8192
REGION_LEVELS = 10
TAMPER_EVERY = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Range:
    """The nodes that a run of a tree of n leaves completes, by (level, place)."""

    def __init__(self, n: int, fanout: int) -> None:
        self.n, self.fanout, self.nodes, self.stack = n, fanout, {}, []

    def siblings(self, level: int, place: int) -> range:
        """The places of a node's run: its own and those of its siblings."""
        first = place // self.fanout * self.fanout
        there = -(-self.n // self.fanout**level)
        return range(first, min(first + self.fanout, there))

    def push(self, level: int, place: int, value: str) -> None:
        self.nodes[level, place] = value
        self.stack.append((level, place))
        while self.n > self.fanout**level:
            run = self.siblings(level, place)
            if place != run[-1] or self.stack[-len(run) :] != [(level, p) for p in run]:
                return
            value = digest("".join(self.nodes[level, p] for p in run))
            del self.stack[-len(run) :]
            level, place = level + 1, place // self.fanout
            self.nodes[level, place] = value
            self.stack.append((level, place))

    def path(self, level: int, place: int) -> tuple[list[str], tuple[int, int]]:
        """Siblings "left,right" at each level up to the peak above a node, and that peak."""
        path = []
        while self.n > self.fanout**level and (level + 1, place // self.fanout) in self.nodes:
            run = self.siblings(level, place)
            path.append(f"{''.join(self.nodes[level, p] for p in run if p < place)},{''.join(self.nodes[level, p] for p in run if p > place)}")
            level, place = level + 1, place // self.fanout
        return path, (level, place)


def fold(leaf: str, path: Iterable[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        left, right = step.split(",")
        leaf = digest(left + leaf + right)
    return leaf


def proof_digest(path: Iterable[str]) -> str:
    return digest("".join(path).replace(",", ""))


_PEAKS = "_tree string, _part int, n long, level int, place long, value string"
_STEPS = "_tree string, n long, level int, place long, path array<string>, up_level int, up_place long, up_value string"


def _depth(n: int, fanout: int) -> int:
    levels = 0
    while fanout**levels < n:
        levels += 1
    return levels


def _merged(items: DataFrame, region: int, depth: int, fanout: int) -> DataFrame:
    """items(_tree, n, level, place, value) with their siblings up to the node that their region of `region` levels completes."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        found, rows = Range(n, fanout), []
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: int(pdf["place"].iat[i]) * fanout ** int(pdf["level"].iat[i]))]
        for level, place, value in zip(pdf["level"], pdf["place"], pdf["value"], strict=True):
            found.push(int(level), int(place), value)
        for tree, level, place in zip(pdf["_tree"], pdf["level"], pdf["place"], strict=True):
            path, top = found.path(int(level), int(place))
            rows.append((tree, n, level, place, path, *top, found.nodes[top]))
        return pd.DataFrame(rows, columns=["_tree", "n", "level", "place", "path", "up_level", "up_place", "up_value"])

    # The region of a node is that of its first leaf; a lone node at a tree's end may be higher than its region.
    levels = range(max(region, depth) + 1)
    power = lambda k: F.lit(min(fanout ** max(k, 0), 1 << 62)).cast("long")
    at = F.col("level") + 1
    wide, high = (F.element_at(F.array(*powers), at) for powers in ([power(region - k) for k in levels], [power(k - region) for k in levels]))
    placed = items.withColumn("_wide", wide).withColumn("_high", high).withColumn("_region", F.expr("place DIV _wide * _high"))
    return placed.drop("_wide", "_high").groupBy("_tree", "_region").applyInPandas(merge, _STEPS)


def _numbered(rows: DataFrame, order: list[Column], run_rows: int | None) -> DataFrame:
    """rows(_tree, leaf, ...) with _part, n (leaves of the tree) and place (from 0, by order), dealt into runs and written."""
    total = rows.count()
    parts = blocks_for(total, run_rows or max(RUN_ROWS, isqrt(total)))
    dealt = in_ranges(rows.withColumn("_tie", F.monotonically_increasing_id()), ["_tree", *order, "leaf", "_tie"], parts)
    sizes, tree = dealt.groupBy("_tree", "_part").agg(F.count("*").alias("_rows")), Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_tree", "_part", before.alias("_before"), F.sum("_rows").over(tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("_tree", "_part").orderBy(*order, "leaf", "_tie"))
    numbered = dealt.withColumn("_within", within).join(sizes, ["_tree", "_part"])
    return materialize(numbered.withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_within", "_before", "_tie"))


def _run(pdf: pd.DataFrame, fanout: int) -> Range:
    found = Range(int(pdf["n"].iloc[0]), fanout)
    for place, leaf in zip(pdf["place"], pdf["leaf"], strict=True):
        found.push(0, int(place), leaf)
    return found


def grow(
    rows: DataFrame, order: list[Column], finish: Callable[[pd.DataFrame, list[list[str]]], pd.DataFrame], schema: str, above: Callable[[DataFrame], DataFrame] | None = None,
    fanout: int = 2, run_rows: int | None = None, region_levels: int = REGION_LEVELS,
) -> DataFrame:
    """finish(rows of a run with subroot and root, their paths), in schema, for every row of rows(_tree, leaf, ...): _tree is not null, leaves are in order.

    above(subroots(_tree, subroot)) gives (_tree, root, path) where the trees are leaves of another; without it a tree's root is its subroot.
    """
    numbered = _numbered(rows, order, run_rows)

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _run(pdf.sort_values("place"), fanout)
        tree, part = pdf["_tree"].iloc[0], pdf["_part"].iloc[0]
        return pd.DataFrame([(tree, part, found.n, *at, found.nodes[at]) for at in found.stack], columns=["_tree", "_part", "n", "level", "place", "value"])

    first = materialize(numbered.select("_tree", "_part", "n", "place", "leaf").groupBy("_tree", "_part").applyInPandas(peaks, _PEAKS))
    longest, most = first.agg(F.max("n"), F.max("level")).first()
    rounds, items, region, depth = [], first.drop("_part"), int(most or 0), _depth(int(longest or 1), fanout)
    while not rounds or region < depth:
        region += region_levels
        rounds.append(materialize(_merged(items, region, depth, fanout)))
        items = rounds[-1].select("_tree", "n", F.col("up_level").alias("level"), F.col("up_place").alias("place"), F.col("up_value").alias("value")).distinct()
    subroots = items.select("_tree", F.col("value").alias("subroot"))
    if above:
        subroots = materialize(subroots)
        tops = above(subroots).join(subroots, "_tree")
    else:
        tops = subroots.select("_tree", "subroot", F.col("subroot").alias("root"), F.array().cast("array<string>").alias("path"))
    outer = None
    for steps in reversed(rounds):
        ups = tops.withColumnRenamed("path", "_above") if outer is None else outer.select("_tree", F.col("level").alias("up_level"), F.col("place").alias("up_place"), "subroot", "root", F.col("path").alias("_above"))
        on = ["_tree"] if outer is None else ["_tree", "up_level", "up_place"]
        outer = steps.join(ups, on).select("_tree", "level", "place", F.concat("path", "_above").alias("path"), "subroot", "root")
    outer = first.select("_tree", "_part", "level", "place").join(outer, ["_tree", "level", "place"])

    def end(leaves: pd.DataFrame, ups: pd.DataFrame) -> pd.DataFrame:
        leaves, paths = leaves.sort_values("place"), []
        found = _run(leaves, fanout)
        beyond = {(int(level), int(place)): list(path) for level, place, path in zip(ups["level"], ups["place"], ups["path"], strict=True)}
        for place in leaves["place"]:
            path, top = found.path(0, int(place))
            paths.append(path + beyond[top])
        return finish(leaves.assign(subroot=ups["subroot"].iloc[0], root=ups["root"].iloc[0]), paths)

    return numbered.groupBy("_tree", "_part").cogroup(outer.groupBy("_tree", "_part")).applyInPandas(end, schema)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    """The leaf of a row of documents with n_chars in place of its own."""
    return F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def _over_subroots(fanout: int, run_rows: int | None, region_levels: int) -> Callable[[DataFrame], DataFrame]:
    def finish(pdf: pd.DataFrame, paths: list[list[str]]) -> pd.DataFrame:
        return pd.DataFrame({"_tree": pdf["_own"], "root": pdf["root"], "path": paths})

    def above(subroots: DataFrame) -> DataFrame:
        rows = subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_own"), F.col("subroot").alias("leaf"))
        return grow(rows, [F.col("_own")], finish, "_tree string, root string, path array<string>", None, fanout, run_rows, region_levels)

    return above


def manifest(docs: DataFrame, fanout: int = 2, run_rows: int | None = None, region_levels: int = REGION_LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, told_leaf, subroot, root, path) for every row of docs(doc_id, text, lang, source, n_chars).

    A leaf hashes a row's values with their lengths, so that no two rows with different values share one; null is a mark of its own. The leaves of a
    lang (null is one) ascend by doc_id (null first; rows of one doc_id by leaf; equal rows are interchangeable). Nodes are hashed in runs of fanout, the last run of a level may have fewer.
    The subroots, ordered by the bytes of lang, null first, are hashed likewise into root. path: for each level up to root the siblings left of the node and
    right of it, "left,right". told_leaf is what the row would hash to after TAMPER_EVERY's change (see verify). Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"),
    )
    told = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    # Null before all others, the empty string among them.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    own = F.col("doc_id").cast("string").alias("_id")  # pandas has no long that may be null
    leaves = materialize(rows.select(tree.alias("_tree"), "doc_id", own, "lang", leaf_of(F.col("n_chars")).alias("leaf"), leaf_of(told).alias("told_leaf")))

    def finish(pdf: pd.DataFrame, paths: list[list[str]]) -> pd.DataFrame:
        return pdf.assign(path=paths)[["_id", "lang", "leaf", "told_leaf", "subroot", "root", "path"]]

    schema = "_id string, lang string, leaf string, told_leaf string, subroot string, root string, path array<string>"
    proved = grow(leaves, [F.col("doc_id").asc_nulls_first()], finish, schema, _over_subroots(fanout, run_rows, region_levels), fanout, run_rows, region_levels)
    return proved.select(F.col("_id").cast("long").alias("doc_id"), "lang", "leaf", "told_leaf", "subroot", "root", "path")


def verify(proved: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of a manifest.

    Where TAMPER_EVERY divides the CRC-32 of the decimal doc_id, one character more is claimed than there is (a null n_chars stays null, and a null doc_id is left alone). folded_root is
    the root that the claimed leaf and the manifest's siblings give; a row is verified if it is the manifest's root.
    """

    def check(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            folded = pd.Series([fold(leaf, path) for leaf, path in zip(pdf["told_leaf"], pdf["path"], strict=True)], pdf.index, object)
            yield pdf.assign(proof_sha256=[proof_digest(p) for p in pdf["path"]], folded_root=folded, verified=folded == pdf["root"])[["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    names = "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    sent = proved.select(F.col("doc_id").cast("string").alias("_id"), "leaf", "told_leaf", "subroot", "root", "path")
    checked = sent.mapInPandas(check, "_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return checked.select(F.col("_id").cast("long").alias("doc_id"), *names)


_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_HASHED = "sha256(concat({}))".format(", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")))

ORACLE = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS tab),
summed AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc
  FROM documents d, crc),
leaves AS (SELECT doc_id, lang, {_HASHED.replace("{n}", "n_chars")} AS leaf, {_HASHED.replace("{n}", "CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS told FROM summed),
placed AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
inner_nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS value FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(value, '' ORDER BY place)) FROM inner_nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroots AS (SELECT tree, value AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, place, n, subroot AS value FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(value, '' ORDER BY place)) FROM outer_nodes WHERE n > 1 GROUP BY level, place // 2, n),
climbed AS (
  SELECT doc_id, leaf, told, p.tree, 0 AS step, p.place, p.n, CAST(NULL AS BIGINT) AS outer_place, '' AS proof, told AS folded, subroot, 0 AS outer_level, s.place AS s_place, s.n AS s_n FROM placed p JOIN subroots s ON s.tree = p.tree
  UNION ALL
  SELECT doc_id, leaf, told, c.tree, step + 1, CASE WHEN c.n > 1 THEN c.place // 2 ELSE c.place END, CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE c.n END, outer_place,
         proof || coalesce(i.value, o.value, ''),
         CASE WHEN (CASE WHEN c.n > 1 THEN c.place ELSE s_place END) % 2 = 0 THEN sha256(folded || coalesce(i.value, o.value, '')) ELSE sha256(coalesce(i.value, o.value, '') || folded) END,
         subroot, CASE WHEN c.n > 1 THEN outer_level ELSE outer_level + 1 END, CASE WHEN c.n > 1 THEN s_place ELSE s_place // 2 END, CASE WHEN c.n > 1 THEN s_n ELSE (s_n + 1) // 2 END
  FROM climbed c
  LEFT JOIN inner_nodes i ON c.n > 1 AND i.tree = c.tree AND i.level = step AND i.place = xor(c.place, 1)
  LEFT JOIN outer_nodes o ON c.n = 1 AND o.level = outer_level AND o.place = xor(s_place, 1)
  WHERE c.n > 1 OR s_n > 1)
SELECT doc_id, leaf, subroot, r.value AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.value AS verified
FROM climbed, (SELECT value FROM outer_nodes WHERE n = 1) r WHERE climbed.n = 1 AND s_n = 1"""
