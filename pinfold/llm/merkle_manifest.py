"""Merkle manifest of a table, with a proof for every row.

Every row is a leaf; the leaves of a group (a language) ascend by id, runs of eight become
one hash until one is left, the subroot, and the subroots in order of their groups likewise
become the root.

A parent is stored as its preimage: the hashes of its children, one after the other.  A row
that is joined with the preimages of its ancestors has all it needs: without its own slot of
64 characters a preimage is the list of its siblings, and with another hash spliced into
the slot it is what the parent would have been.

Built from DataFrame operations only.  Leaves are numbered by sorting ranges and adding the
counts of earlier ranges, so a group that holds a third of all rows is spread over tasks.
Ancestors are joined from the top down, level by level: the eighth part of the rows, and
the eighth part of those, carry the growing paths; the rows themselves are joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinfold.llm.checksums import crc32_sql
from pinfold.runtime import broadcast_checked, materialise

#: Children of a node as a power of two, and characters of a hash.
FAN_BITS, HASH = 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(text if f == 'text' else f) for f in FIELDS)})"


#: Both trees as tables of nodes; siblings by their places; folding level by level.
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS total FROM documents),
low AS (
  SELECT lang, 0 AS lvl, idx AS pos, leaf AS h, total AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 8, n),
subs AS (SELECT lang, lvl AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rn, count(*) OVER () AS langs FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, rn AS pos, subroot AS h, langs AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8, n),
nodes AS (
  SELECT lang, lvl, pos, h, n FROM low WHERE n > 1
  UNION ALL
  SELECT s.lang, s.top + h.lvl, h.pos, h.h, h.n FROM high h, subs s WHERE h.n > 1),
steps AS (
  SELECT l.doc_id, n.lvl, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < mine) AS before, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > mine) AS after
  FROM (SELECT l.doc_id, l.lang, k.lvl, CASE WHEN k.lvl < s.top THEN l.idx // CAST(pow(8, k.lvl) AS BIGINT) ELSE s.rn // CAST(pow(8, k.lvl - s.top) AS BIGINT) END AS mine
        FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT lang, lvl FROM nodes) k ON l.lang IS NOT DISTINCT FROM k.lang) l
  JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.lvl = l.lvl AND n.pos // 8 = mine // 8
  GROUP BY l.doc_id, n.lvl),
proofs AS (SELECT doc_id, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY lvl) AS siblings FROM steps GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0 AS lvl, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.after, '')) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.lvl = f.lvl),
ends AS (SELECT doc_id, max_by(h, lvl) AS folded_root FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN ends e USING (doc_id) LEFT JOIN proofs p USING (doc_id) CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of the fields of a row: ``-`` for null, else length in bytes, colon, value."""
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return _digest(*[written(columns[f].cast("string")) for f in FIELDS])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place of each within its group ``g`` by ``order`` from 0,
    and ``total``, the rows of the group.  Rows that are all alike may be in any order."""
    keys = ["g", *order, "tie"]
    ascending = [F.col(k).asc_nulls_first() for k in keys]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*ascending).sortWithinPartitions(*ascending)
    # the id that Spark gives rows holds the partition and the place in it
    placed = materialise(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("tie"), "merkle-order")
    runs = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    runs = materialise(runs.select("g", "part", "first", before.alias("before"), F.sum("n").over(group).alias("total")), "merkle-runs")
    return placed.join(broadcast_checked(runs, "g"), ["g", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _parents(nodes: DataFrame, place: str, hash_: str) -> DataFrame:
    """``g, pos, pre, total``: the preimages of runs of eight nodes."""
    run = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), F.col(hash_).alias("h")))), lambda x: x["h"])
    return nodes.groupBy("g", F.shiftright(place, FAN_BITS).alias("pos")).agg(F.array_join(run, "").alias("pre"), F.max("total").alias("total"))


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels ``g, pos, pre, total, h, last`` of the trees over ``leaves(g, idx, total,
    leaf)``, lowest first; ``last`` marks the node that is the root of its group.  The one
    leaf of a group is its root: it stands on the first level with itself as preimage."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    levels, nodes, height = [], None, 1
    while not levels or most > 1 << FAN_BITS * (height - 1):
        above = _parents(leaves, "idx", "leaf") if nodes is None else _parents(nodes.where("not last"), "pos", "h")
        hashed = above.withColumn("h", F.when(F.col("total") == 1, F.col("pre")).otherwise(_digest(F.col("pre"))))
        nodes = materialise(hashed.withColumn("last", F.col("total") <= 1 << FAN_BITS * height), "merkle-level")
        levels.append(nodes)
        height += 1
    return levels


def _step(pre: str, place: str) -> Column:
    """One ancestor: its preimage, and the slot of the child in it."""
    return F.array(F.struct(F.col(pre).alias("pre"), F.col(place).bitwiseAND(F.lit((1 << FAN_BITS) - 1)).cast("int").alias("slot")))


def _ancestors(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``g, pos, pre, path, end`` of the lowest level: ``path`` holds the ancestors of the
    node from the nearest on, and goes on with those of the root of its group (``above``:
    ``g, path, end``)."""
    lower = None
    for nodes in reversed(levels):
        roots = nodes.where("last").join(above, "g").select("g", "pos", "pre", "path", "end")
        if lower is not None:
            parents = lower.select("g", F.col("pos").alias("up"), F.col("pre").alias("up_pre"), "path", "end")
            inner = nodes.where("not last").withColumn("up", F.shiftright("pos", FAN_BITS)).join(parents, ["g", "up"])
            roots = roots.unionByName(inner.select("g", "pos", "pre", F.concat(_step("up_pre", "pos"), F.col("path")).alias("path"), "end"))
        lower = roots
    return lower


def _with_paths(leaves: DataFrame, lowest: DataFrame) -> DataFrame:
    """``leaves`` with ``path`` from each leaf to the root, and ``end``."""
    met = leaves.withColumn("pos", F.shiftright("idx", FAN_BITS)).join(lowest, ["g", "pos"])
    return met.withColumn("path", F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(_step("pre", "idx"), F.col("path")))).drop("pre", "pos")


def _around(step: Column) -> tuple[Column, Column]:
    """What stands before and after the slot of a step."""
    at = step["slot"] * HASH
    return F.substring(step["pre"], F.lit(1), at), F.substring(step["pre"], at + HASH + 1, F.length(step["pre"]))


def siblings(path: Column) -> Column:
    """The hashes beside a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(*_around(s))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf would make with the siblings of a path."""

    def up(h: Column, s: Column) -> Column:
        before, after = _around(s)
        return _digest(before, h, after)

    return F.aggregate(path, leaf, up)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``.

    Leaves hash ``doc_id, source, lang, n_chars, text``; groups are languages, null first
    and then by their bytes; ids ascend within a group, null first, and rows that share an
    id by their hashes.  Where 3 divides the CRC-32 of the id in decimals, ``folded_root``
    is made from the row with A-Z of its text lower-cased, elsewhere from the row as it is;
    ``verified`` tells whether it is the root.  A null text, a null id or a text without
    A-Z is not changed by that.  Repeated rows are leaves of their own, extra columns are
    ignored, and an empty table has no rows and no root.
    """
    kinds = {"doc_id": "long", "n_chars": "long"}
    row = {f: F.col(f).cast(kinds.get(f, "string")) for f in FIELDS}
    changed = F.translate(row["text"], _UPPER, _LOWER)
    tampered = (F.crc32(row["doc_id"].cast("string")) % 3 == 0) & (changed != row["text"])
    group = F.when(row["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), row["lang"]))
    hashed = docs.select(group.alias("g"), row["doc_id"].alias("doc_id"), leaf_hash(row).alias("leaf"), F.when(tampered, leaf_hash({**row, "text": changed})).alias("probe"))
    leaves = _numbered(materialise(hashed, "merkle-leaves"), ["doc_id", "leaf"])
    levels = tree_levels(leaves)

    subroots = levels[0].where("last")
    for nodes in levels[1:]:
        subroots = subroots.unionByName(nodes.where("last"))
    groups = _numbered(materialise(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("h").alias("leaf")), "merkle-subroots"), ["name"])
    upper = tree_levels(groups)
    root = upper[-1].where("last").select("h").first()
    ends = groups.select("g").distinct().select("g", F.array().cast("array<struct<pre:string,slot:int>>").alias("path"), F.lit(None).cast("string").alias("end"))
    above = _with_paths(groups, _ancestors(upper, ends)).select(F.col("name").alias("g"), "path", F.col("leaf").alias("end"))

    told = _with_paths(leaves, _ancestors(levels, materialise(above, "merkle-above")))
    made = folded(F.col("path"), F.coalesce("probe", "leaf"))
    out = told.select("doc_id", "leaf", F.col("end").alias("subroot"), F.lit(root.h if root else None).cast("string").alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), made.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
