"""Merkle manifest of a dataset: leaves of rows, a tree a language, a tree over these, and proofs by the preimages of parents.

A leaf is the hash of its row's fields. Leaves are numbered by group and order; every `FAN` consecutive nodes become their parent, whose
preimage is their hashes one after another. Parents are stored with their preimages; going down again, each parent gets those of all its ancestors
(`pre`) and, for each of these, the slot of the node below (`slots`). A leaf joins its parent's row once. Leaving out its own 64 characters at a slot
gives a level's siblings; putting the hash folded so far in their place gives the next one.

Scale: numbers come from a range partitioning of small rows (id, two hashes), its tasks' counts, and a window within each; joins go by (group,
parent), which at most `FAN` rows share, so no group, however large, is in one task. Each level has an eighth of the rows of the one below. Only
the number of levels comes to the driver.

Defined cases: a null field is `-`. Leaves of null id come first in their group, equal ids in the order of their leaves; rows that are equal in all fields have
equal leaves and roots, each with the proof of its own place. A null id is not tampered with. A null group comes first, as one of its own. A lone leaf is its group's
subroot, a lone subroot the root; with neither siblings nor parents, the proof is the hash of nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grouping

FAN = 8
DIGEST = 64
#: Rows of the tasks' counts that are broadcast at most; beyond, they are joined by shuffle.
MOST_BROADCAST = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a null, else its UTF-8 bytes' number, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def group_key(group: Column) -> Column:
    """A key that is never null and is ordered as the groups are: null first, then their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, grp, node, other), one row a row of docs: its leaf, and the leaf with the tampered values where that holds, else null."""
    own = digest(*[field(F.col(f)) for f in fields])
    other = digest(*[field((tampered or {}).get(f, F.col(f))) for f in fields])
    changed = F.lit(None).cast("string") if where is None else F.when(where, other)
    return docs.select(F.col(key).alias("key"), group_key(F.col(group)).alias("grp"), own.alias("node"), changed.alias("other"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, their number from 0 within their grp by the columns of order, and `n`, the rows of the grp.

    Rows are sorted in ranges of (grp, order), one a task, and written with their place; a task's rows of a grp are numbered from the sum of those of the tasks before.
    """
    by = ["grp", *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = grouping.cut(sorted_.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("grp", "task").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    w = Window.partitionBy("grp")
    upto = F.sum("size").over(w.orderBy("task"))
    starts = grouping.cut(runs.select("grp", "task", (upto - F.col("size") - F.col("first")).alias("shift"), F.sum("size").over(w).alias("n")))
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts
    return dealt.join(starts, ["grp", "task"]).withColumn("at", F.col("place") + F.col("shift")).drop("task", "place", "shift")


def parents(nodes: DataFrame) -> list[DataFrame]:
    """Each level's parents (grp, at, n, node, pre), from the lowest, of nodes (grp, at, n, node). A group of one node has no parent, so its last level has one row."""
    found = []
    while True:
        child = F.struct((F.col("at") % FAN).alias("slot"), "node")
        pre = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["node"]), "")
        up = (nodes if not found else found[-1]).where("n > 1").groupBy("grp", F.floor(F.col("at") / FAN).alias("at"), F.ceil(F.col("n") / FAN).alias("n")).agg(pre.alias("pre"))
        up = grouping.cut(up.select("grp", "at", "n", F.sha2("pre", 256).alias("node"), "pre"))
        if up.isEmpty():
            return found
        found.append(up)


def _below(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """nodes with subroot, pre and slots of all that is above them: by their parent's row in above, or by their group's in tops where they are its only node."""
    alone = nodes.where("n = 1").join(tops, "grp")
    if above is None:
        return alone
    higher = above.withColumnsRenamed({"at": "parent_at", "node": "parent_node", "n": "parent_n"}).drop("parent_node", "parent_n")
    joined = nodes.where("n > 1").withColumn("parent_at", F.floor(F.col("at") / FAN)).join(higher, ["grp", "parent_at"]).drop("parent_at")
    return joined.withColumn("slots", F.concat(F.array((F.col("at") % FAN).cast("int")), "slots")).unionByName(alone)


def paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """nodes with the preimages of their ancestors up to the root, each one's slot in them, and subroot.

    tops has one row a grp: its subroot, and pre and slots above that.
    """
    above = None
    for level in reversed(levels):
        own = _below(level.withColumnRenamed("pre", "own"), above, tops)
        own = own.withColumn("pre", F.concat(F.array("own"), "pre")).drop("own")
        above = own if level is levels[0] else grouping.cut(own)
    return _below(nodes, above, tops)


def siblings(pre: Column, slots: Column) -> Column:
    """The digests beside the path, level by level, each level's from left to right."""
    beside = lambda p, s: F.concat(F.substring(p, F.lit(1), s * DIGEST), F.substring(p, s * DIGEST + (DIGEST + 1), F.lit(FAN * DIGEST)))
    return F.array_join(F.zip_with(pre, slots, beside), "")


def folded(node: Column, pre: Column, slots: Column) -> Column:
    """The root that node leads to in the place of what the path began from."""
    steps = F.zip_with(pre, slots, lambda p, s: F.struct(p.alias("pre"), s.alias("slot")))
    put = lambda h, x: F.concat(F.substring(x["pre"], F.lit(1), x["slot"] * DIGEST), h, F.substring(x["pre"], x["slot"] * DIGEST + (DIGEST + 1), F.lit(FAN * DIGEST)))
    return F.aggregate(steps, node, lambda h, x: F.sha2(put(h, x), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """The rows of `leaves` with subroot, root, pre and slots."""
    spark = rows.sparkSession
    nodes = grouping.cut(numbered(grouping.cut(rows), ["key", "node"]))
    own = parents(nodes)
    subroots = nodes.where("n = 1").select("grp", "node")
    for level in own:
        subroots = subroots.union(level.where("n = 1").select("grp", "node"))
    heads = grouping.cut(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"]))
    upper = parents(heads)
    root = (upper[-1] if upper else heads).where("n = 1").select("node").head()
    if root is None:
        return rows.select("*", *[F.lit(None).cast("string").alias(x) for x in ("subroot", "root")], F.array().cast("array<string>").alias("pre"), F.array().cast("array<int>").alias("slots"))
    nothing = spark.range(1).select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("pre"), F.array().cast("array<int>").alias("slots"))
    tops = grouping.cut(paths(heads, upper, nothing).select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "pre", "slots"))
    return paths(nodes, own, tops).drop("at", "n").withColumn("root", F.lit(root[0]))


def tampered_text(text: Column) -> Column:
    """The text with A to Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    where = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(leaves(docs, tampered={"text": tampered_text(F.col("text"))}, where=where))
    done = rows.withColumn("folded_root", folded(F.coalesce("other", "node"), F.col("pre"), F.col("slots")))
    return done.select(
        F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("pre"), F.col("slots")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP13_SQL = r"""
WITH RECURSIVE
crc_bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
crcs(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, rest[2:], xor(c >> 8, t[(xor(c, ascii(rest)) & 255) + 1]) FROM crcs, crc_table WHERE rest <> ''),
marked AS (SELECT doc_id, xor(c, 4294967295) % 3 = 0 AS tampered FROM crcs WHERE rest = ''),
fields AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.lang, d.text,
         coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         CASE WHEN coalesce(tampered, false) THEN translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE d.text END AS other
  FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id),
leaves AS (
  SELECT id, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang COLLATE "C" NULLS FIRST) - 1 AS grp
  FROM leaves),
nodes(grp, lvl, pos, n, node) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL SELECT grp, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 8),
subroots AS (SELECT grp, max(lvl) AS depth, max_by(node, lvl) AS subroot FROM nodes WHERE n = 1 GROUP BY grp),
tops(lvl, pos, n, node) AS (
  SELECT 0, grp, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 8),
root AS (SELECT max_by(node, lvl) AS root FROM tops WHERE n = 1),
runs AS (
  SELECT grp, lvl, pos // 8 AS parent, list(node ORDER BY pos) AS run FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT s.grp, s.depth + t.lvl, t.parent, t.run
  FROM subroots s, (SELECT lvl, pos // 8 AS parent, list(node ORDER BY pos) AS run FROM tops WHERE n > 1 GROUP BY ALL) t
  WHERE t.parent = s.grp // CAST(8 ** (t.lvl + 1) AS BIGINT)),
walk(id, grp, depth, lvl, pos, beside, h) AS (
  SELECT p.id, p.grp, s.depth, 0, CASE WHEN s.depth = 0 THEN p.grp ELSE p.pos END, '', p.changed FROM placed p JOIN subroots s USING (grp)
  UNION ALL
  SELECT w.id, w.grp, w.depth, w.lvl + 1, CASE WHEN w.lvl + 1 = w.depth THEN w.grp ELSE w.pos // 8 END,
         w.beside || array_to_string(r.run[:w.pos % 8] || r.run[w.pos % 8 + 2:], ''),
         sha256(array_to_string(r.run[:w.pos % 8] || [w.h] || r.run[w.pos % 8 + 2:], ''))
  FROM walk w JOIN runs r ON r.grp = w.grp AND r.lvl = w.lvl AND r.parent = w.pos // 8),
ends AS (SELECT id, max_by(beside, lvl) AS beside, max_by(h, lvl) AS folded_root FROM walk GROUP BY id)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(e.beside) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subroots s USING (grp) JOIN ends e USING (id), root
"""
