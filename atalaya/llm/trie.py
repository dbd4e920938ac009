"""Prefix trie of conversations: nodes by chained digests, totals of subtrees by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.common import SPACE, written
from atalaya.llm.merkle import CRC32_SQL

#: Conversations of one family share the beginning of its first one: at most three turns.
FAMILY, HEADS = 20, 4
#: Components of at most so many nodes are decomposed further inside one task.
LOCAL = 4096
#: Nodes of such components that share a task, about.
SHARED = 50_000
#: Conversation ids whose texts are joined before they are hashed in order.
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, rank (from 1, by turn, null first; ties by digest), digest of role and text, words of the text.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, content = text("role"), text("text")
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), content)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(content, F.lit(SPACE)).cast("long").alias("words"),
    )
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest"))
    return rows.select("conv", rank.alias("rank"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that begin with turns of their family's first one: conv, part, rank, digest, words.

    The first one's id is conv - conv % FAMILY; as in SQL, the remainder of a negative id is negative.
    """
    heads = lambda c: F.crc32(F.col(c).cast("string")) % HEADS
    own = turns.where(F.col("rank") > heads("conv")).select("conv", F.lit(1).alias("part"), "rank", "digest", "words")
    convs = turns.where("rank = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), heads("conv").alias("taken"))
    shared = turns.where(F.col("rank") < HEADS).withColumnRenamed("conv", "first")
    taken = convs.join(shared, "first").where("rank <= taken")
    return taken.select("conv", F.lit(0).alias("part"), "rank", "digest", "words").unionByName(own)


def chained(turns: DataFrame) -> DataFrame:
    """conv, depth (from 1), node (digest of the turns so far), words. A task reads its conversations in order and holds one digest."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node = None, 0, b""
        for batch in batches:
            depths, nodes = [], []
            for own, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != conv:
                    conv, depth, node = own, 0, b""
                depth, node = depth + 1, hashlib.sha256(node + digest).digest()
                depths.append(depth)
                nodes.append(node)
            columns = [batch.column(0), pa.array(depths, pa.int32()), pa.array(nodes, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "depth", "node", "words"])

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "part", "rank")
    return dealt.select("conv", "digest", "words").mapInArrow(chain, "conv long, depth int, node binary, words long")


def paths_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """Every conversation's way down the trie: conv, depth, owner, next, up, below, words, ends.

    A node is named by its depth and its owner, its smallest member. next and up are the owners one level below and
    above on the same way; below counts the nodes from here down that conv owns; ends marks the last depth.
    """
    first = convs.agg(F.min("conv")).first()[0]
    owners = members.groupBy("depth", "node").agg(F.min("conv").alias("owner"))
    own = members.join(owners, ["depth", "node"]).select("conv", "depth", "owner", "words")
    top = convs.select("conv", F.lit(0).alias("depth"), F.lit(first).cast("long").alias("owner"), F.lit(0).cast("long").alias("words"))
    way = Window.partitionBy("conv").orderBy("depth")
    back = Window.partitionBy("conv").orderBy(F.desc("depth"))
    return top.unionByName(own).select(
        "conv",
        "depth",
        "owner",
        F.lead("owner").over(way).alias("next"),
        F.lag("owner").over(way).alias("up"),
        F.count_if(F.col("owner") == F.col("conv")).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
        "words",
        F.lead("owner").over(way).isNull().alias("ends"),
    )


def local_totals(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Totals of all subtrees of trees whose nodes come parents first (-1: none), by centroid decomposition.

    A component is split at its centroid; the centroid's total goes to the nodes on the way up to the component's top.
    """
    out = np.zeros_like(values)
    label = [0] * len(parent)
    tops = 0
    for v, p in enumerate(parent):
        if p < 0:
            tops += 1
            label[v] = tops
        else:
            label[v] = label[p]
    groups: dict[int, list[int]] = {}
    for v, own in enumerate(label):
        groups.setdefault(own, []).append(v)
    stack, used = list(groups.items()), tops
    size = [0] * len(parent)
    while stack:
        own, nodes = stack.pop()
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes):
            if (p := parent[v]) >= 0 and label[p] == own:
                size[p] += size[v]
        centroid = next(v for v in reversed(nodes) if 2 * size[v] >= len(nodes))
        parts: dict[int, list[int]] = {}
        below = [centroid]
        label[centroid] = 0  # no component
        lower = {}  # nodes under the centroid: their new component
        for v in nodes:
            p = parent[v]
            if v == centroid:
                continue
            if p == centroid:
                used += 1
                lower[v] = used
            elif p in lower:
                lower[v] = lower[p]
            if v in lower:
                label[v] = lower[v]
                below.append(v)
            parts.setdefault(label[v], []).append(v)
        total = values[below].sum(axis=0)
        out[centroid] += total
        v = parent[centroid]
        while v >= 0 and label[v] == own:
            out[v] += total
            v = parent[v]
        stack += parts.items()
    return out


def rolled_up(paths: DataFrame, nodes: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """owner, depth and the totals of the value columns over each node's subtree.

    nodes: owner, depth, up, size (nodes of the subtree), values; paths: see paths_of. Every component, named by its
    top, is split at its centroid, the deepest node that has half of it below. The centroid's total is one partial
    aggregate; it is added to the centroid and along its way to the top, where sizes shrink by what is split off. What
    lies below goes to the components of the centroid's children, found by the ways' owners at that depth. A component
    loses half of its nodes in each round at least, so a long chain or a very wide node costs a logarithm of rounds.
    Components of at most `local` nodes are decomposed to the end inside a task.
    """
    names = [f"t_{v}" for v in values]
    comp = ["top", "top_depth"]
    first = nodes.where("depth = 0").select("owner").first()
    current = nodes.withColumn("top", F.lit(first[0] if first else None).cast("long")).withColumn("top_depth", F.lit(0))
    current = current.withColumnRenamed("size", "sub")
    added, ready = [], []
    while True:
        totals = current.groupBy(*comp).agg(F.count("*").alias("total"))
        current = written(current.join(totals, comp), "trie")
        ready.append(current.where(F.col("total") <= local).drop("total"))
        large = current.where(F.col("total") > local)
        if large.isEmpty():
            break
        half = large.where("2 * sub >= total").groupBy(*comp).agg(F.min(F.struct("sub", "owner", "depth")).alias("c"))
        half = half.select(*comp, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.sub").alias("c_sub"))
        half = written(half, "trie")
        way = paths.select(
            F.col("conv").alias("owner"), F.col("depth").alias("c_depth"), F.col("owner").alias("there"), F.col("next").alias("then")
        )
        marked = large.join(half, comp).join(way, ["owner", "c_depth"], "left")
        under = F.coalesce((F.col("depth") >= F.col("c_depth")) & (F.col("there") == F.col("c_owner")), F.lit(False))
        marked = written(marked.withColumn("under", under), "trie")
        sums = marked.where("under").groupBy(*comp).agg(*(F.sum(v).alias(t) for v, t in zip(values, names, strict=True)))
        half = written(half.join(sums, comp), "trie")
        up = paths.select(F.col("conv").alias("c_owner"), F.col("depth").alias("at"), F.col("owner").alias("there"))
        climbed = half.join(up, "c_owner").where((F.col("at") >= F.col("top_depth")) & (F.col("at") <= F.col("c_depth")))
        climbed = written(climbed.select(F.col("there").alias("owner"), F.col("at").alias("depth"), "c_sub", *names), "trie")
        added.append(climbed.select("owner", "depth", *names))
        at_centroid = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        rest = marked.where(~at_centroid).withColumns(
            {
                "top": F.when(F.col("under"), F.col("then")).otherwise(F.col("top")),
                "top_depth": F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
            }
        )
        rest = rest.drop("c_sub").join(climbed.select("owner", "depth", "c_sub"), ["owner", "depth"], "left")
        rest = rest.withColumn("sub", F.col("sub") - F.coalesce("c_sub", F.lit(0)))
        current = rest.select("owner", "depth", "up", "sub", *values, *comp)

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("depth", "ascending")])
        owner, depth, above, top_depth = (table.column(c).to_pylist() for c in ("owner", "depth", "up", "top_depth"))
        place = {key: i for i, key in enumerate(zip(owner, depth, strict=True))}
        parent = [-1 if d == t else place[u, d - 1] for u, d, t in zip(above, depth, top_depth, strict=True)]
        found = local_totals(parent, np.stack([table.column(v).to_numpy() for v in values], axis=1))
        columns = [table.column("owner"), table.column("depth"), *(pa.array(found[:, i]) for i in range(len(values)))]
        return pa.table(columns, names=["owner", "depth", *names])

    small = ready[0]
    for more in ready[1:]:
        small = small.unionByName(more)
    lots = max(1, -(-small.count() // SHARED))
    small = small.withColumn("lot", F.pmod(F.xxhash64(*comp), F.lit(lots)))
    kinds = "owner long, depth int, " + ", ".join(f"{t} long" for t in names)
    out = small.groupBy("lot").applyInArrow(finish, kinds)
    for more in added:
        out = out.unionByName(more)
    return out.groupBy("owner", "depth").agg(*(F.sum(t).alias(v) for v, t in zip(values, names, strict=True)))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, conv) to owner, depth, ends_sha256: conversation ids ascending, joined by commas.

    Ids meet in chunks of a bounded number first; a task then hashes its nodes' chunks in order, one at a time.
    """
    listed = F.array_join(F.sort_array(F.collect_list("conv")), ",")
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    chunks = ends.groupBy("owner", "depth", chunk).agg(listed.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = ["owner", "depth", "ends_sha256"]
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (owner, depth) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([state.hexdigest()])], names)

    dealt = chunks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk")
    return dealt.select("owner", "depth", "ids").mapInArrow(hashed, "owner long, depth int, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, the empty one included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns are
    ordered by turn, null first, ties by the digest of role and text; null roles and texts are empty, repeated rows are
    turns of their own. Rows without conv_id are left out, and an empty table gives no rows. A conversation without
    turns ends at the root. Very long conversations pass a task turn by turn, as digests. Other columns play no part.
    """
    turns = written(ordered_turns(conversations), "trie")
    convs = turns.where("rank = 1").select("conv")
    members = written(chained(rebuilt(turns)), "trie")
    paths = written(paths_of(members, convs), "trie")
    own = paths.where("owner = conv").select("owner", "depth", "up")
    counted = paths.groupBy("owner", "depth").agg(
        F.count("*").alias("n_convs"), F.sum("below").alias("size"), F.max("words").alias("words")
    )
    children = own.where("depth > 0").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = own.join(counted, ["owner", "depth"]).join(children, ["owner", "depth"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = written(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "trie")
    values = ["n_leaves", "saved_tokens"]
    totals = rolled_up(paths, nodes.select("owner", "depth", "up", "size", *values), values, local)
    ends = digests_of_ends(paths.where("ends").select("owner", "depth", "conv"))
    both = nodes.drop(*values).join(totals, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
    return both.select(
        F.col("owner").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        *values,
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS content,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
),
ordered AS (
  SELECT conv_id, digest, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS r
  FROM turns
),
convs AS (SELECT conv_id AS c, {CRC32_SQL.format(text="conv_id::VARCHAR")} % 4 AS h FROM ordered WHERE r = 1),
rebuilt AS (
  SELECT c, 0 AS part, r, digest, words FROM convs JOIN ordered ON conv_id = c - c % 20 AND r <= h
  UNION ALL
  SELECT c, 1, r, digest, words FROM convs JOIN ordered ON conv_id = c AND r > h
),
members AS (
  SELECT c, row_number() OVER way AS d, string_agg(digest, '') OVER way AS path, words FROM rebuilt
  WINDOW way AS (PARTITION BY c ORDER BY part, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT c, 0, '', 0 FROM convs
),
nodes AS (
  SELECT d, path, left(path, 64 * (d - 1)) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved
  FROM members GROUP BY d, path
),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes x WHERE x.d = n.d + 1 AND x.above = n.path) AS n_children FROM nodes n),
sums AS (
  SELECT a.d, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM counted a JOIN counted b ON b.d >= a.d AND left(b.path, 64 * a.d) = a.path GROUP BY a.d, a.path
),
lasts AS (SELECT c, max(d) AS d, max_by(path, d) AS path FROM members GROUP BY c),
ends AS (SELECT d, path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM lasts GROUP BY d, path)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted n
JOIN sums s USING (d, path)
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.above
LEFT JOIN ends e ON e.d = n.d AND e.path = n.path
"""
