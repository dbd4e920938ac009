"""Near dedup of documents by the byte-position index over wide SimHash fingerprints."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from atalaya.llm import near, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def linked(prints):
    """The roots of prints after one task has read all postings."""
    posted = list(simhash._posted(iter([pa.RecordBatch.from_arrays([pa.array(prints, pa.binary())], ["print"])])))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for batch in simhash._wide_linked(iter(posted)):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root[find(a)] = find(b)
    return [find(p) for p in prints]


def far(a, b):
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def test_fingerprint_is_a_majority_of_each_bit():
    hashes = np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64)
    got = np.unpackbits(np.frombuffer(simhash.wide_print(hashes), np.uint8), bitorder="little")
    words = simhash.mixed(hashes[:, None] ^ simhash.SEEDS[None, :])
    for bit in (0, 1, 63, 64, 200, 319):
        ones = sum((int(w) >> bit % 64) & 1 for w in words[:, bit // 64])
        assert got[bit] == (2 * ones > len(hashes))
    assert simhash.wide_print(hashes[:0]) == bytes(8 * simhash.WIDE)


def test_pairs_at_the_least_similarity_are_connected_and_strangers_are_not():
    rng = np.random.default_rng(7)
    for common, more, other in ((8, 1, 1), (8, 2, 0), (40, 5, 5), (40, 10, 0), (400, 50, 50)):
        prints = []
        for _ in range(300):
            own = rng.integers(0, 2**63, common + more + other).astype(np.uint64)
            prints += [simhash.wide_print(own[: common + more]), simhash.wide_print(np.delete(own, np.s_[common : common + more]))]
        roots = linked(prints)
        assert sum(a != b for a, b in zip(roots[::2], roots[1::2], strict=True)) <= 1
        assert len(set(roots)) >= 299


def test_large_groups_give_the_components_of_all_pairs():
    """Two families that share leading bytes, with chains inside, against every pair."""
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(2):
        head, tail = bytes([9, 9, 9]), rng.bytes(8 * simhash.WIDE - 3)
        for _ in range(60):
            bits = np.unpackbits(np.frombuffer(tail, np.uint8))
            bits[rng.choice(len(bits), int(rng.integers(20, 70)), replace=False)] ^= 1
            prints.add(head + np.packbits(bits).tobytes())
    prints = sorted(prints)
    roots = linked(prints)
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if far(prints[i], prints[j]) <= simhash.WIDE_DISTANCE and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    pairs = {(r, x) for r, x in zip(roots, label, strict=True)}
    assert len(pairs) == len(set(roots)) == len(set(label))


def test_the_stage_meets_its_candidates_in_the_index(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "edited", *words[101:]]), " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()} == {0, 2}
    monkeypatch.setattr(near.simhash, "wide_links", lambda prints: prints.selectExpr("print as a", "print as b").where("false"))
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()} == {0, 1, 2}
