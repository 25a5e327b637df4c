"""Merkle manifest of a dataset: leaves by group, trees of fan-out 16 by group, and one tree over the groups' roots.

Per level, lag and lead columns at fixed offsets, masked by a node's slot and its run's length,
supply the siblings; the first child of each run hashes its parent. Paths are handed down from
the root one level at a time, so no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.shared import crc32_sql, materialise, scratch
from lociflow.operators.ranges import ranked

FANOUT = 16


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone in lower case; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (group, pos from 0, n nodes of the group at this level, digest) with parent, and the siblings' digests left and right."""
    w = Window.partitionBy("group", "parent").orderBy("pos")
    slot = F.col("pos") % fanout
    length = F.least(F.lit(fanout), F.col("n") - F.col("parent") * fanout)
    left = [F.when(slot >= i, F.lag("digest", i).over(w)).otherwise("") for i in range(fanout - 1, 0, -1)]
    right = [F.when(slot + i < length, F.lead("digest", i).over(w)).otherwise("") for i in range(1, fanout)]
    return nodes.withColumn("parent", F.floor(F.col("pos") / fanout)).withColumn("left", F.concat(*left)).withColumn("right", F.concat(*right))


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels of all groups' trees, leaves first; a group ends at the level where it has one node."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        first = _runs(levels[-1], fanout).filter((F.col("pos") % fanout == 0) & (F.col("n") > 1))
        up = first.select("group", F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(materialise(up, "merkle-level"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    out = None
    for level in levels:
        own = level.filter("n = 1").select("group", F.col("digest").alias("top"))
        out = own if out is None else out.union(own)
    return out


def _descend(levels: list[DataFrame], above: DataFrame, keep: list[str], fanout: int) -> DataFrame:
    """The lowest level's rows with ``keep`` and path: the siblings at each level up, then those of ``above`` (group, keep, path)."""
    down = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        single = own.filter("n = 1").join(above, "group")
        if down is not None:
            step = F.array(F.struct("left", "right"))
            up = down.select("group", F.col("pos").alias("parent"), *keep, F.col("path").alias("rest"))
            many = _runs(own.filter("n > 1"), fanout).join(up, ["group", "parent"]).withColumn("path", F.concat(step, "rest")).drop("parent", "left", "right", "rest")
            single = many.unionByName(single)
        down = single if k == 0 else materialise(single, "merkle-paths")
    return down


def prove(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with subroot, root and path, the (left, right) siblings at each level from the leaf to the root.

    Per group (null is one, the first), leaves ascend by ``order``; every ``fanout`` consecutive
    nodes, the last ones fewer, become the hash of their digests while more than one remain. The
    groups' roots, in order of group, make the last tree in the same way. Rows equal in ``order``
    must have equal digests for a stable result, so name the digest last. An empty table gives no
    rows. Columns named subroot, root or path are replaced.
    """
    own = leaves.select([c for c in leaves.columns if c not in ("subroot", "root", "path")])
    row = F.struct(*(F.col(f"`{c}`") for c in own.columns))
    placed = own.select(row.alias("row"), F.col(group).alias("by"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(digest).alias("digest"))
    placed = ranked(placed, ["by"], [f"o{i}" for i in range(len(order))], "rank", "n")
    levels = _climb(materialise(placed.select("row", F.struct("by").alias("group"), (F.col("rank") - 1).alias("pos"), "n", "digest"), "merkle-leaves"), fanout)
    tops = ranked(_roots(levels).select(F.col("group.by").alias("by"), F.col("top").alias("digest")), [], ["by"], "rank", "n")
    over = _climb(materialise(tops.select("by", F.struct(F.lit(0).alias("one")).alias("group"), (F.col("rank") - 1).alias("pos"), "n", "digest"), "merkle-tops"), fanout)
    summit = _roots(over).select("group", F.col("top").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    above = materialise(_descend(over, summit, ["root"], fanout).select(F.struct("by").alias("group"), F.col("digest").alias("subroot"), "root", "path"), "merkle-above")
    return _descend(levels, above, ["subroot", "root"], fanout).select("row.*", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document: leaf, subroot of its source, root, digest of its proof, and the root folded anew after tampering.

    Where 5 divides the crc32 of the id's digits, tampering lower-cases the text's A-Z. Rows with
    a null id come first in their source and are not tampered with; repeated rows are leaves of
    their own. Null fields are ``-``. Empty tables give no rows, extra columns are ignored.
    """
    with scratch(docs.sparkSession):
        given = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
        hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
        fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
        leaves = given.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"), F.when(hit, leaf_digest(*fields, ascii_lower(F.col("text")))).alias("tampered"))
        out = prove(materialise(leaves, "merkle-digests"), "source", ["doc_id", "leaf"])
        out = out.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
        return materialise(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "manifest", keep=True)


def oracle_sql() -> str:
    """DuckDB twin of ``manifest`` over documents, level by level in a recursive query."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"

    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree = """{t}(g, lev, pos, n, d) AS (SELECT g, 0, pos, n, d FROM {base}
 UNION ALL SELECT g, lev + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY g, lev, pos // 16)"""
    sibs = """{t}_sib AS (SELECT a.g, a.lev, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
 FROM {t} a JOIN {t} b ON a.g = b.g AND a.lev = b.lev AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL)"""
    return f"""WITH RECURSIVE {crc32_sql()},
x AS (SELECT doc_id, source, sha256({fields} || {field('text')}) AS leaf, CASE WHEN {crc32_sql('doc_id::varchar')} % 5 = 0 THEN sha256({fields} || {field(lowered)}) END AS tampered FROM documents),
y AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS d FROM x),
{tree.format(t='t', base='y')},
{sibs.format(t='t')},
s AS (SELECT 'all' AS g, g AS src, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, d FROM t WHERE n = 1),
{tree.format(t='u', base='s')},
{sibs.format(t='u')},
walk(rid, g, src, lev, pos, leaf, d, proof, top) AS (
 SELECT row_number() OVER (), y.g, y.g, 0, y.pos, y.leaf, coalesce(tampered, leaf), '', false FROM y
 UNION ALL SELECT w.rid, CASE WHEN e.g IS NULL THEN 'all' ELSE w.g END, w.src, CASE WHEN e.g IS NULL THEN 0 ELSE w.lev + 1 END, CASE WHEN e.g IS NULL THEN s.pos ELSE w.pos // 16 END, w.leaf,
  CASE WHEN e.g IS NULL THEN w.d ELSE sha256(e.l || w.d || e.r) END, w.proof || coalesce(e.l || e.r, ''), w.top OR e.g IS NULL
 FROM walk w LEFT JOIN (SELECT false AS up, * FROM t_sib UNION ALL SELECT true, * FROM u_sib) e ON e.up = w.top AND e.g = w.g AND e.lev = w.lev AND e.pos = w.pos LEFT JOIN s ON s.src = w.src WHERE NOT (w.top AND e.g IS NULL)),
done AS (SELECT rid, d, proof FROM (SELECT rid, d, proof, row_number() OVER (PARTITION BY rid ORDER BY top DESC, lev DESC) AS k FROM walk) WHERE k = 1),
named AS (SELECT row_number() OVER () AS rid, * FROM y)
SELECT n.doc_id, n.leaf, s.d AS subroot, top.d AS root, sha256(done.proof) AS proof_sha256, done.d AS folded_root, done.d = top.d AS verified
FROM named n JOIN done USING (rid) JOIN s ON s.src = n.g CROSS JOIN (SELECT d FROM u WHERE n = 1) top"""
