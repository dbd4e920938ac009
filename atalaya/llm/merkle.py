"""Merkle manifest of a dataset with proofs by pointer jumping: segments of siblings double until leaves reach the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.common import shuffle_partitions, written

#: The columns of documents that a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one grouping builds: a group holds 2 ** LEVELS digests at most.
LEVELS = 8
#: Rows of a jump that share one join key: 2 ** SHARED at most, however long the jump is.
SHARED = 8
#: Documents whose crc32 is divisible by it are tampered with.
TAMPERED = 7
#: The trees' own tree.
TOP = ""


def sha256(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows make the same text; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def levels_above(n: Column) -> Column:
    """Levels above n leaves: how often n is halved, rounding up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def counted_from_zero(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _halved(layer: Column) -> Column:
    pair = lambda j: sha256(F.get(layer, 2 * j), F.coalesce(F.get(layer, 2 * j + 1), F.lit("")))
    return F.transform(counted_from_zero(F.ceil(F.size(layer) / 2)), pair)


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """The rows with their place in their tree (pos, from 0 without gaps) and the tree's number of leaves (n).

    Rows are dealt over ranges of (tree, order), so no tree needs one task; a range's rows are counted and the counts
    of the ranges before it are added.
    """
    parts = shuffle_partitions(leaves.sparkSession)
    dealt = leaves.repartitionByRange(parts, "tree", *order).withColumn("run", F.spark_partition_id())
    dealt = written(dealt, "merkle")
    counts = dealt.groupBy("tree", "run").agg(F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "run", before.alias("before"), F.sum("own").over(tree).alias("n"))
    in_run = F.row_number().over(Window.partitionBy("tree", "run").orderBy(*order))
    placed = dealt.withColumn("in_run", in_run).join(counts, ["tree", "run"])
    return written(placed.withColumn("pos", F.col("before") + F.col("in_run") - 1).drop("before", "in_run", "run"), "merkle")


def siblings_and_roots(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, n, digest) to the sibling of every node and to the root of every tree.

    Siblings: tree, level, idx, path with one element, null where the node is alone in its run. Roots: tree, digest.
    A grouping builds LEVELS levels at once; most is the largest n.
    """
    current = leaves.select("tree", F.col("pos").alias("idx"), "n", "digest")
    nodes, roots, level = None, None, 0
    while True:
        entry = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        block = current.groupBy("tree", "n", F.shiftright("idx", LEVELS).alias("block")).agg(entry.alias("entries"))
        height = F.least(F.lit(LEVELS), levels_above(F.col("n")))
        start = F.array(F.transform("entries", lambda x: x["digest"]))
        grown = F.aggregate(counted_from_zero(height), start, lambda acc, _: F.concat(acc, F.array(_halved(F.element_at(acc, -1)))))
        block = written(block.select("tree", "n", "block", height.alias("height"), grown.alias("layers")), "merkle")
        # The last layer has one node: it goes to the next grouping, or is the root.
        layers = block.where("height > 0").select(
            "tree", "block", "height", F.posexplode(F.slice("layers", F.lit(1), F.col("height"))).alias("layer", "digests")
        )
        pair = F.transform("digests", lambda _, j: F.unhex(F.get("digests", j.bitwiseXOR(F.lit(1)))))
        node = layers.select("tree", "block", "height", "layer", F.posexplode(pair).alias("nth", "sibling"))
        first = F.col("block") * F.expr(f"shiftleft(1L, {LEVELS} - layer)")
        found = node.select(
            "tree", (F.col("layer") + level).alias("level"), (first + F.col("nth")).alias("idx"), F.array("sibling").alias("path")
        )
        nodes = found if nodes is None else nodes.unionByName(found)
        size = 1 << LEVELS
        top = block.select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.element_at("layers", -1)[0].alias("digest")
        )
        done = top.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        current, most, level = top.where("n > 1"), -(-most // size), level + LEVELS
        if most <= 1:
            return nodes, roots


def jumped(nodes: DataFrame, most: int) -> DataFrame:
    """tree, pos, path: the siblings from every leaf up to its root, by doubling the ancestor distance.

    After a round with distance d the nodes of every 2d-th level hold the siblings towards their 2d-th ancestor: their
    own segment and, by a self-join, that of the ancestor at d. Other levels are not needed any more. A long jump
    has few ancestors for many nodes, so an ancestor's row is repeated for each run of 2 ** SHARED nodes.
    """
    current, distance = written(nodes, "merkle"), 1
    while distance < max(1, most - 1).bit_length():
        spread = max(0, distance - SHARED)
        near = current.where(F.col("level") % (2 * distance) == 0)
        near = near.withColumn("meet", F.shiftright("idx", min(distance, SHARED)))
        far = current.where(F.col("level") % (2 * distance) == distance)
        runs = F.sequence(F.expr(f"shiftleft(idx, {spread})"), F.expr(f"shiftleft(idx + 1, {spread}) - 1"))
        far = far.select("tree", (F.col("level") - distance).alias("level"), F.explode(runs).alias("meet"), F.col("path").alias("more"))
        both = near.join(far, ["tree", "level", "meet"], "left")
        none = F.array().cast("array<binary>")
        path = F.concat("path", F.coalesce("more", none))
        current = written(both.select("tree", "level", "idx", path.alias("path")), "merkle")
        distance *= 2
    return current.where("level = 0").select("tree", F.col("idx").alias("pos"), "path")


def proved(leaves: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, digest and more columns) with pos, n and path; and the roots of the trees (tree, digest)."""
    placed = ranked(leaves, *order)
    most = placed.agg(F.max("n")).first()[0] or 0
    nodes, roots = siblings_and_roots(placed, most)
    paths = jumped(nodes, most)
    placed = placed.join(paths, ["tree", "pos"], "left")
    return placed.withColumn("path", F.coalesce("path", F.array().cast("array<binary>"))), written(roots, "merkle")


def folded(digest: Column, pos: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""

    def step(acc: Column, level: Column) -> Column:
        sibling = hex_of(F.get(path, level))
        on_right = F.call_function("shiftright", pos, level) % 2 == 1
        return F.when(sibling.isNull(), sha256(acc)).when(on_right, sha256(sibling, acc)).otherwise(sha256(acc, sibling))

    return F.aggregate(counted_from_zero(F.size(path)), digest, step)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", number: str = "n_chars") -> DataFrame:
    """One leaf per document, one tree per value of a column, one tree over these; a proof for every leaf, and its check.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf of the row as it is later; where
    TAMPERED divides the crc32 of the id, its number is then larger by one), verified. Leaves ascend by doc_id, rows
    of one id by their leaf; repeated rows are leaves of their own. Null values are dashes; a null id comes first and
    is never tampered with; null in the tree column is a tree of its own, before the others. A lone leaf is its own
    subroot, with an empty proof if there is no other tree. Long texts enter a leaf's digest only. An empty table
    gives no rows. Other columns play no part.
    """
    rows = docs.select(*fields)
    later = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    changed = {number: F.col(number).cast("decimal(20,0)") + 1}
    leaf = sha256(*(field(F.col(c)) for c in fields))
    tampered = sha256(*(field(changed.get(c, F.col(c))) for c in fields))
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    # `later` is null for a null id; the second digest is made for tampered rows only.
    made = written(
        rows.select(
            name.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), F.when(later, tampered).alias("changed")
        ),
        "merkle",
    )
    below, subroots = proved(made, "doc_id", "digest")
    above, roots = proved(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("part"), "digest"), "part")
    above = above.select(
        F.col("part").alias("tree"), F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("path").alias("top_path")
    )
    root = roots.select(F.col("digest").alias("root"))
    both = below.join(above.join(F.broadcast(root.limit(1))), "tree")  # the top tree has one root
    proof = F.array_join(F.transform(F.concat("path", "top_path"), hex_of), "")
    sub = folded(F.coalesce("changed", "digest"), F.col("pos"), F.col("path"))
    return (
        both.withColumn("folded_sub", sub)
        .withColumn("folded_root", folded(F.col("folded_sub"), F.col("top_pos"), F.col("top_path")))
        .select(
            "doc_id",
            F.col("digest").alias("leaf"),
            "subroot",
            "root",
            F.sha2(proof, 256).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


#: crc32 of a decimal text in DuckDB, which has no such function: a byte is mixed in, then eight bits are shifted out.
CRC32_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

OP11_SQL = f"""
WITH RECURSIVE enc AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id,
    {CRC32_SQL.format(text="doc_id::VARCHAR")} % 7 = 0 AS later,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS number,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS changed,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
),
leaves AS (
  SELECT tree, doc_id, sha256(head || number || tail) AS leaf,
    CASE WHEN later THEN sha256(head || changed || tail) ELSE sha256(head || number || tail) END AS after
  FROM enc
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops AS (
  SELECT 0 AS level, pos AS idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
),
steps AS (
  SELECT p.tree, p.pos, m.level AS step, (p.pos // (2 ** m.level)::BIGINT) % 2 AS side, s.digest AS sibling
  FROM placed p
  JOIN nodes m ON m.tree = p.tree AND m.idx = p.pos // (2 ** m.level)::BIGINT AND m.n > 1
  LEFT JOIN nodes s ON s.tree = m.tree AND s.level = m.level AND s.idx = xor(m.idx, 1)
  UNION ALL
  SELECT p.tree, p.pos, 1000 + m.level, (r.pos // (2 ** m.level)::BIGINT) % 2, s.digest
  FROM placed p
  JOIN subroots r USING (tree)
  JOIN tops m ON m.idx = r.pos // (2 ** m.level)::BIGINT AND m.n > 1
  LEFT JOIN tops s ON s.level = m.level AND s.idx = xor(m.idx, 1)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS nth FROM steps),
proofs AS (
  SELECT tree, pos, count(*) AS steps, sha256(coalesce(string_agg(sibling, '' ORDER BY nth), '')) AS proof FROM numbered GROUP BY tree, pos
),
folds AS (
  SELECT tree, pos, 0::BIGINT AS nth, after AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, s.nth,
    sha256(CASE WHEN s.sibling IS NULL THEN f.digest WHEN s.side = 1 THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folds f JOIN numbered s ON s.tree = f.tree AND s.pos = f.pos AND s.nth = f.nth + 1
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p
JOIN subroots r USING (tree)
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.nth = coalesce(q.steps, 0)
"""
