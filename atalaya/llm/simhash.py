"""SimHash near-duplicates: byte-position inverted indexes with count filtering, then verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.common import checkpointed, local_labels, mixed, rows_of, shuffle_partitions, utf8
from atalaya.llm.components import components

BITS = 64
DISTANCE = 3
#: Fingerprints of distance 3 or less differ in at most three bytes, so five of eight positional bytes are equal.
LEAST_EQUAL_BYTES = 8 - DISTANCE
#: Any five of eight positions hold three of one half: these triples reach every pair that shares five bytes.
TRIPLES = tuple(combinations(range(4), 3)) + tuple(combinations(range(4, 8), 3))
#: Members of one posting that are compared in one task; longer postings are dealt over pairs of blocks.
BLOCK = 4096

#: A wide fingerprint has WIDE words of 64 bits. Sets at a Jaccard similarity of 0.8 have a cosine of 0.889 or more, so a bit
#: differs with a chance of 0.152 (0.19 for the smallest, four shingles of five), against 0.5 for sets that share nothing.
WIDE = 5
#: Bits in which wide fingerprints of a candidate pair differ at most: 6 deviations over the mean at 0.8, 8 under that of strangers.
WIDE_DISTANCE = 90
#: Neighbours in a group that are compared in one pass; in larger groups what they leave apart is compared in full.
STEPS = 8
SEEDS = mixed(np.arange(1, WIDE + 1, dtype=np.uint64))


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text's words (ASCII lower case); no words give zero."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 or len(words) == shingle else (b" ".join(words),)
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_of(batches):
            prints = np.array([fingerprint(x.as_py(), shingle) for x in table.column("data")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(prints)], ["id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("data"))
    return rows.mapInArrow(run, "id long, fp long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one task to a spanning forest of its verified pairs."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    col = {n: table.column(n).to_numpy() for n in table.column_names}
    order = np.lexsort((col["fp"], col["block"], col["other"], col["first"], col["key"]))
    key, first, other, block, fp = (col[n][order] for n in ("key", "first", "other", "block", "fp"))
    nodes, at = np.unique(fp, return_inverse=True)
    bits = fp.view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (other[1:] != other[:-1])
    group = np.cumsum(new)
    label, pairs_a, pairs_b, waiting = np.arange(len(nodes)), [], [], 0
    alive = np.arange(len(fp))
    step = 0
    while True:
        step += 1
        alive = alive[alive + step < len(fp)]
        alive = alive[group[alive + step] == group[alive]]
        if not len(alive):
            break
        compare = alive[(first[alive] == other[alive]) | (block[alive] != block[alive + step])]
        different = bits[compare] ^ bits[compare + step]
        tally = (different.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        kept = tally >= LEAST_EQUAL_BYTES
        kept[kept] = np.bitwise_count(different[kept]) <= DISTANCE
        pairs_a.append(at[compare[kept]])
        pairs_b.append(at[compare[kept] + step])
        waiting += int(kept.sum())
        if waiting > 2_000_000:
            label = _merged(label, pairs_a, pairs_b)
            pairs_a, pairs_b, waiting = [], [], 0
    label = _merged(label, pairs_a, pairs_b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def _merged(label: np.ndarray, a: list, b: list) -> np.ndarray:
    if not a:
        return label
    own = np.arange(len(label))
    return local_labels(len(label), np.concatenate([own, *a]), np.concatenate([label, *b]))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) to edges (a, b) that connect all pairs of at most three differing bits.

    The inverted index has a posting for each triple of byte positions and its three bytes. In a posting the
    shared positional bytes of each pair are tallied; pairs with fewer than five are dropped, the rest are
    verified by their differing bits. A task returns a spanning forest, not the pairs. A posting of over BLOCK
    members is dealt over pairs of blocks, each compared in its own group.
    """
    spark = prints.sparkSession
    keys = []
    for i, triple in enumerate(TRIPLES):
        key = F.lit(i).cast("long")
        for position in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255)))
        keys.append(key)
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = checkpointed(postings).join(checkpointed(sizes), "key")
    blocks = F.ceil(F.col("size") / BLOCK)
    entries = entries.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("long"))
    entries = entries.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    entries = entries.select(
        "key", "fp", "block", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("other")
    )
    dealt = entries.repartition(shuffle_partitions(spark), "key", "first", "other")
    return dealt.mapInArrow(_linked, "a long, b long")


def wide_print(hashes: np.ndarray) -> bytes:
    """The wide fingerprint of a set of 64-bit hashes; an empty set gives zeros."""
    ones = np.zeros(WIDE * BITS, np.int64)
    for at in range(0, len(hashes), 16_384):
        own = mixed(hashes[at : at + 16_384, None] ^ SEEDS[None, :]).astype("<u8").view(np.uint8)
        bits = np.unpackbits(own, axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wide fingerprints to the postings of their byte positions; those of one posting travel as one value."""
    for table in rows_of(batches, column="print"):
        prints = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
        for position in range(8 * WIDE - 1):  # the last position has none after it
            order = np.argsort(prints[:, position], kind="stable")
            values, first = np.unique(prints[order, position], return_index=True)
            own = [prints[rows].tobytes() for rows in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32) + 256 * position), pa.array(own, pa.binary())], ["posting", "prints"])


def _far(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of wide fingerprints a and b, whose shapes are broadcast."""
    return sum(np.bitwise_count(words[a, w] ^ words[b, w]).astype(np.int16) for w in range(WIDE))


def _wide_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one task to a spanning forest of their pairs that share a second byte and differ in few bits."""
    posting, prints = [np.zeros(0, np.int64)], []
    for batch in batches:
        for number, own in zip(batch.column("posting").to_pylist(), batch.column("prints").to_pylist(), strict=True):
            posting.append(np.full(len(own) // (8 * WIDE), number, np.int64))
            prints.append(own)
    posting = np.concatenate(posting)
    if not len(posting):
        return
    words = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE)
    single = words.view(np.uint8).reshape(-1, 8 * WIDE)
    name = np.zeros(len(words), np.uint64)
    for w in range(WIDE):
        name = mixed(name * np.uint64(31) + words[:, w])
    _, first, node = np.unique(name, return_index=True, return_inverse=True)
    label = np.arange(len(first))
    for position in range(1, 8 * WIDE):
        rows = np.flatnonzero(posting >> 8 < position)
        key = posting[rows] << 8 | single[rows, position]
        order = np.argsort(key, kind="stable")
        label = _grouped(rows[order], key[order], words, node, label)
    moved = np.flatnonzero(label != np.arange(len(label)))
    a, b = ([words[r].tobytes() for r in first[x]] for x in (moved, label[moved]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _grouped(rows: np.ndarray, key: np.ndarray, words: np.ndarray, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of the nodes after the near pairs of each run of equal keys are joined; pairs joined before are not compared."""
    if not len(rows):
        return label
    near_a, near_b, alive = [], [], np.arange(len(rows))
    for step in range(1, STEPS + 1):
        alive = alive[alive + step < len(rows)]
        alive = alive[key[alive + step] == key[alive]]
        a, b = rows[alive], rows[alive + step]
        apart = label[node[a]] != label[node[b]]
        a, b = a[apart], b[apart]
        near = _far(words, a, b) <= WIDE_DISTANCE
        near_a.append(node[a[near]])
        near_b.append(node[b[near]])
    if sum(map(len, near_a)):
        label = _merged(label, near_a, near_b)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(starts, append=len(key))
    large = np.flatnonzero(sizes > STEPS + 1)
    if len(large):
        own = label[node[rows]]
        mixed_labels = np.minimum.reduceat(own, starts)[large] != np.maximum.reduceat(own, starts)[large]
        for g in large[mixed_labels].tolist():
            label = _joined_group(rows[starts[g] : starts[g] + sizes[g]], words, node, label)
    return label


def _joined_group(rows: np.ndarray, words: np.ndarray, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The same for one large group: members outside its largest label are compared with all that are not joined to them."""
    own = label[node[rows]]
    values, n = np.unique(own, return_counts=True)
    outside = own != values[n.argmax()]
    rows = np.concatenate([rows[outside], rows[~outside]])
    own, left = label[node[rows]], int(outside.sum())
    lot = max(1, 200_000 // len(rows))
    for at in range(0, left, lot):
        some = np.arange(at, min(left, at + lot))
        near = _far(words, rows[some][:, None], rows[None, at:]) <= WIDE_DISTANCE
        i, j = np.nonzero(near & (own[some][:, None] != own[None, at:]))
        if len(i):
            label = _merged(label, [node[rows[some[i]]]], [node[rows[at + j]]])
            own = label[node[rows]]
    return label


def wide_links(prints: DataFrame) -> DataFrame:
    """Distinct wide fingerprints (column print) to edges (a, b) that connect their candidate pairs.

    The inverted index has a posting for each byte position and its byte. A pair is a candidate if it shares two positional
    bytes or more and differs in at most WIDE_DISTANCE bits: one at a Jaccard similarity of 0.8 is missed with a chance of 0.0001
    (0.0025 for the smallest sets). It is met in the posting of its first shared byte, where members are grouped by each
    later one. A task returns a spanning forest, not the pairs; the caller verifies what is connected.
    """
    postings = prints.mapInArrow(_posted, "posting int, prints binary")
    return postings.repartition(shuffle_partitions(prints.sparkSession), "posting").mapInArrow(_wide_linked, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each input row: id, fp (signed long), component (smallest id that can be reached).

    Rows without text or words have fingerprint zero and are linked like any other. Rows with a null id count as
    rows; they never name a component unless all of its ids are null, which gives null. Repeated ids are kept as
    rows. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, id_column, text_column, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(fingerprint_links(nodes.select("fp")))
    placed = checkpointed(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        )
    )
    smallest = checkpointed(placed.groupBy("root").agg(F.min("first_id").alias("component")))
    named = checkpointed(placed.join(smallest, "root").select("fp", "component"))
    return rows.join(named, "fp").select("id", "fp", "component")


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
