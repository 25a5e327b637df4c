"""Fixture tables made from the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.basestore import chunked
from lociflow.operators.reads import depth

CTES = {
    "span": "SELECT (max(o_orderkey) + 1) * 40 AS len, greatest(1000, (max(o_orderkey) + 1) * 40 - 12000) AS m FROM orders",
    "contigs": "SELECT chrom, len FROM span CROSS JOIN (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE '22' END AS chrom FROM orders) AS named",
    "frag": """SELECT l_orderkey AS ok, l_linenumber AS ln, l_orderkey*31 + l_linenumber*7 AS h, CAST(min(l_quantity) AS INT) AS q
  FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "site": """SELECT *, CASE WHEN ok % 2 = 0 THEN '12' ELSE '22' END AS c1, CASE WHEN h % 29 = 0 OR ok % 2 = 1 THEN '22' ELSE '12' END AS c2,
  1000 + (ok*7919 + ln*104729) % (SELECT m FROM span) AS p1, 1000 + (ok*7919 + ln*104729) % (SELECT m FROM span) + 150 + (h*13) % 700 AS p2r,
  (h % 5 = 0) AS rev1, (h % 3 <> 0) AS rev2, (h % 37 = 0) AS unm2, (h % 11 <> 0) AS prop, (h % 41 = 0) AS dup FROM frag""",
    "mates": "SELECT *, CASE WHEN unm2 THEN c1 ELSE c2 END AS c2m, CASE WHEN unm2 THEN p1 ELSE p2r END AS p2 FROM site",
    "reads": """SELECT concat('q', CAST(ok AS STRING), '_', CAST(ln AS STRING)) AS qname,
  CASE WHEN c1 = '12' THEN 0 ELSE 100000000 END + p1*10 + 1 AS ord,
  1 + CASE WHEN prop THEN 2 ELSE 0 END + CASE WHEN unm2 THEN 8 ELSE 0 END + CASE WHEN rev1 THEN 16 ELSE 0 END + CASE WHEN rev2 THEN 32 ELSE 0 END + 64 + CASE WHEN dup THEN 1024 ELSE 0 END AS flag,
  c1 AS chrom, p1 AS pos0, q + 10 AS mapq,
  CASE h % 8 WHEN 0 THEN '20S80M' WHEN 1 THEN '80M20S' WHEN 2 THEN '15S70M15S' WHEN 3 THEN '50M12D50M' WHEN 4 THEN '40M16I44M' WHEN 5 THEN '30M60D70M' ELSE '100M' END AS cigar,
  c2m AS next_chrom, p2 AS next_pos0, CASE WHEN c1 = c2m THEN p2 - p1 + 100 ELSE 0 END AS tlen, h % 31 AS nm,
  CASE WHEN h % 8 < 3 AND h % 3 = 0 THEN concat(CASE WHEN h % 10 = 0 THEN '22' ELSE c1 END, ',', CAST(p1 + 300 - (h % 2)*290 AS STRING), ',',
    CASE WHEN h % 4 = 0 THEN '-' ELSE '+' END, ',', CASE WHEN h % 8 = 1 THEN '80S20M' ELSE '20M80S' END, ',', CAST(h % 23 AS STRING), ',0;') END AS sa
  FROM mates
  UNION ALL
  SELECT concat('q', CAST(ok AS STRING), '_', CAST(ln AS STRING)), CASE WHEN c2m = '12' THEN 0 ELSE 100000000 END + p2*10 + 2,
  1 + CASE WHEN prop THEN 2 ELSE 0 END + CASE WHEN unm2 THEN 4 ELSE 0 END + CASE WHEN rev2 THEN 16 ELSE 0 END + CASE WHEN rev1 THEN 32 ELSE 0 END + 128 + CASE WHEN dup THEN 1024 ELSE 0 END,
  c2m, p2, CASE WHEN unm2 THEN 0 ELSE q END,
  CASE WHEN unm2 THEN NULL WHEN h % 7 = 0 THEN '30S70M' WHEN h % 7 = 1 THEN '70M30S' ELSE '100M' END,
  c1, p1, CASE WHEN c1 = c2m THEN p1 - p2 - 100 ELSE 0 END, (h*5) % 17, NULL FROM mates""",
    "cand": """SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE '22' END AS chrom,
  2000 + (o_orderkey*7907) % (SELECT m FROM span) AS l, 2000 + (o_orderkey*7907) % (SELECT m FROM span) + 50 + (o_custkey*13) % 1500 AS r,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 AS qual,
  CASE (o_orderkey*11 + o_custkey) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS caller,
  CASE WHEN o_orderkey % 9 = 0 THEN 'INV' WHEN o_orderkey % 9 = 3 THEN 'DUP' ELSE 'DEL' END AS svtype
  FROM orders """,
    "truth": """SELECT call_id AS tid, chrom, l + off + call_id % 81 - 40 AS s1, l + off + call_id % 81 - 39 AS e1,
  r + off + call_id % 61 - 30 AS s2, r + off + call_id % 61 - 29 AS e2, svtype FROM (SELECT *, CASE WHEN call_id % 13 = 5 THEN 5000 ELSE 0 END AS off FROM cand) AS moved WHERE call_id % 7 < 3""",
    "regions": """SELECT CASE WHEN p_partkey % 2 = 0 THEN '12' ELSE '22' END AS chrom, (p_partkey*1931) % (SELECT m FROM span) AS s,
  (p_partkey*1931) % (SELECT m FROM span) + 20 + p_size*4 AS e FROM part """,
}
#: Spark's columns of reads, those of both halves of the twin's text side by side. What is long comes before the halves are
#: told apart, so that filters hold a short text of it: a generated method of over 8,000 bytes is never compiled further.
PAIR_COLUMNS = [
    "1 + CASE WHEN prop THEN 2 ELSE 0 END + CASE WHEN dup THEN 1024 ELSE 0 END AS flags",
    "CASE WHEN unm2 THEN 8 ELSE 0 END + CASE WHEN rev1 THEN 16 ELSE 0 END + CASE WHEN rev2 THEN 32 ELSE 0 END + 64 AS flags1",
    "CASE WHEN unm2 THEN 4 ELSE 0 END + CASE WHEN rev2 THEN 16 ELSE 0 END + CASE WHEN rev1 THEN 32 ELSE 0 END + 128 AS flags2",
    "CASE h % 8 WHEN 0 THEN '20S80M' WHEN 1 THEN '80M20S' WHEN 2 THEN '15S70M15S' WHEN 3 THEN '50M12D50M' WHEN 4 THEN '40M16I44M' WHEN 5 THEN '30M60D70M' ELSE '100M' END AS cigar1",
    "CASE WHEN unm2 THEN NULL WHEN h % 7 = 0 THEN '30S70M' WHEN h % 7 = 1 THEN '70M30S' ELSE '100M' END AS cigar2",
    """CASE WHEN h % 8 < 3 AND h % 3 = 0 THEN concat(CASE WHEN h % 10 = 0 THEN '22' ELSE c1 END, ',', CAST(p1 + 300 - (h % 2)*290 AS STRING), ',',
    CASE WHEN h % 4 = 0 THEN '-' ELSE '+' END, ',', CASE WHEN h % 8 = 1 THEN '80S20M' ELSE '20M80S' END, ',', CAST(h % 23 AS STRING), ',0;') END AS sa1""",
]
READ_COLUMNS = [
    "concat('q', CAST(ok AS STRING), '_', CAST(ln AS STRING)) AS qname",
    "CASE WHEN mate = 1 THEN CASE WHEN c1 = '12' THEN 0 ELSE 100000000 END + p1*10 + 1 ELSE CASE WHEN c2m = '12' THEN 0 ELSE 100000000 END + p2*10 + 2 END AS ord",
    "flags + CASE WHEN mate = 1 THEN flags1 ELSE flags2 END AS flag",
    "CASE WHEN mate = 1 THEN c1 ELSE c2m END AS chrom", "CASE WHEN mate = 1 THEN p1 ELSE p2 END AS pos0", "CASE WHEN mate = 1 THEN q + 10 WHEN unm2 THEN 0 ELSE q END AS mapq",
    "CASE WHEN mate = 1 THEN cigar1 ELSE cigar2 END AS cigar", "CASE WHEN mate = 1 THEN c2m ELSE c1 END AS next_chrom", "CASE WHEN mate = 1 THEN p2 ELSE p1 END AS next_pos0",
    "CASE WHEN c1 = c2m THEN CASE WHEN mate = 1 THEN p2 - p1 + 100 ELSE p1 - p2 - 100 END ELSE 0 END AS tlen", "CASE WHEN mate = 1 THEN h % 31 ELSE (h*5) % 17 END AS nm",
    "CASE WHEN mate = 1 THEN sa1 END AS sa",
]
NEEDS = {"span": [], "contigs": ["span"], "frag": [], "site": ["span", "frag"], "mates": ["site"], "reads": ["mates"], "cand": ["span"], "truth": ["cand"], "regions": ["span"]}
#: Each order gives the bases of 40 positions of both contigs.
BASE = "CASE WHEN pos % 5003 < 7 THEN 'N' ELSE substr('ACTG', CAST(1 + (pos*pos + 3*pos + pos % 7 + o_custkey) % 4 AS INT), 1) END"
TABLES = ("lineitem", "orders", "part")
#: Rows of the line table to a task, and what a task gets at least while there are cores for more.
TASK_ROWS, LEAST_ROWS = 100_000, 5_000


def with_ctes(*names: str, after: tuple[str, ...] = ()) -> str:
    """``WITH`` text of the named fixtures and what they need; to follow a text that has those of ``after``, without these."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in after:
        add(n)
    known = len(order)
    for n in names:
        add(n)
    return ("" if after else "WITH ") + ",\n".join(f"{n} AS ({CTES[n]})" for n in order[known:])


#: DuckDB text of the bases.
DUCK_BASES = f"SELECT chrom, pos, {BASE} AS base FROM (SELECT o_custkey, o_orderkey * 40 + unnest(range(40)) AS pos FROM orders), (SELECT unnest(['12', '22']) AS chrom)"


class Fixtures:
    """Lazy DataFrames of the fixture tables for one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _fixture(self, name: str) -> DataFrame:
        return self._sql(f"{with_ctes(name)} SELECT * FROM {name}".replace("(SELECT m FROM span)", str(self.modulus)))

    def _sql(self, text: str) -> DataFrame:
        used = [t for t in TABLES if f"FROM {t} " in text or f"FROM {t})" in text]
        for t in used:
            text = re.sub(rf"FROM {t}(?=[ )])", f"FROM {{{t}}}", text)
        return self.spark.sql(text, **{t: self.lines if t == "lineitem" else self.table(t) for t in used})

    @cached_property
    def lines(self) -> DataFrame:
        """What reads are made from, dealt out by key into partitions of a fixed number of rows.

        These rows are narrow and come in few partitions, but a read becomes many rows in the task that makes
        it. The number is given, so Spark does not join partitions by their size before that; grouping by
        the same key needs no other exchange.
        """
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition(self.parts, "l_orderkey", "l_linenumber")

    @cached_property
    def parts(self) -> int:
        """Partitions for what is made from the line table, in proportion to its rows."""
        n = self.table("lineitem").count()  # from the files' footers
        return max(-(-n // TASK_ROWS), min(self.spark.sparkContext.defaultParallelism, n // LEAST_ROWS), 1)

    @cached_property
    def depth(self) -> DataFrame:
        """Run-length depth of the reads."""
        return depth(self.reads, parts=self.parts)

    @cached_property
    def reads(self) -> DataFrame:
        """Both reads of each pair, from one pass over the pairs.

        A union of both halves, as in the twin's text, would make the pairs twice, filter them before they are dealt
        out, and make them anew where a query joins reads with what comes of them.
        """
        return self._fixture("mates").selectExpr("*", *PAIR_COLUMNS).withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(*READ_COLUMNS)

    @cached_property
    def cand(self) -> DataFrame:
        return self._fixture("cand")

    @cached_property
    def truth(self) -> DataFrame:
        return self._fixture("truth")

    @cached_property
    def regions(self) -> DataFrame:
        return self._fixture("regions")

    @cached_property
    def modulus(self) -> int:
        """What positions are taken modulo of: one number, so that plans hold a literal and no subquery for each use."""
        return self._sql(f"{with_ctes('span')} SELECT m FROM span").first()["m"]

    @cached_property
    def contigs(self) -> DataFrame:
        return self._sql(f"{with_ctes('contigs')} SELECT * FROM contigs")

    @cached_property
    def store(self) -> DataFrame:
        """The bases in chunks; each order gives a stretch of 40."""
        first = "o_orderkey * 40"
        # A pattern apart from the unknown bases: places count by their remainder of 28 only, and keys by that of 4.
        letters = [["ACTG"[(p * p + 3 * p + p % 7 + c) % 4] for p in range(28 + 40)] for c in range(4)]
        plain = f"substring(get(array({', '.join(repr(''.join(x)) for x in letters)}), CAST(pmod(o_custkey, 4) AS INT)), CAST(pmod({first}, 28) AS INT) + 1, 40)"
        # Seven unknown bases stand at each multiple of 5003: the last ones before the stretch's first place, or those that begin within it.
        low, ahead = f"CAST({first} % 5003 AS INT)", f"CAST(5003 - {first} % 5003 AS INT)"
        text = f"CASE WHEN {low} < 7 THEN concat(repeat('N', 7 - {low}), substring(plain, 8 - {low})) WHEN {ahead} < 40 THEN substring(concat(substring(plain, 1, {ahead}), 'NNNNNNN', substring(plain, {ahead} + 8)), 1, 40) ELSE plain END AS text"
        stretches = self.table("orders").selectExpr("o_orderkey", f"{plain} AS plain").selectExpr(f"{first} AS pos", text)
        pieces = stretches.selectExpr("explode(array('12', '22')) AS chrom", "pos", "text")
        return chunked(pieces)

    @cached_property
    def bases(self) -> DataFrame:
        places = self.table("orders").selectExpr("o_custkey", "o_orderkey * 40 AS first", "explode(sequence(0L, 39L)) AS i").selectExpr("o_custkey", "first + i AS pos")
        return places.selectExpr("explode(array('12', '22')) AS chrom", "pos", f"{BASE} AS base")
