"""The Merkle manifest, the prefix trie and best-fit packing against brute-force versions, on given and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import cases
import numpy as np
import pytest

from atalaya.llm import bestfit, merkle, trie

SF = "/root/testdata/sf0.001"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(params=["given", "awkward", "empty"])
def docs(request, spark):
    given = lambda spark: spark.read.parquet(f"{SF}/documents.parquet")
    return {"given": given, "awkward": cases.awkward, "empty": cases.nothing}[request.param](spark)


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def layers_of(leaves):
    layers = [leaves]
    while len(layers[-1]) > 1:
        last = layers[-1]
        layers.append([sha256("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return layers


def climb(digest, place, layers):
    """The root that a digest gives, and the siblings on its way."""
    found = []
    for layer in layers[:-1]:
        other = place ^ 1
        if other < len(layer):
            found.append(layer[other])
            digest = sha256(layer[other] + digest if place & 1 else digest + layer[other])
        else:
            digest = sha256(digest)
        place //= 2
    return digest, found


def manifest_want(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha256("".join(map(enc, r)))
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: layers_of([leaf(r) for r in groups[name]]) for name in names}
    top = layers_of([trees[name][-1][0] for name in names])
    want = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            later = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            sub, below = climb(later, i, trees[name])
            root, above = climb(sub, k, top)
            want.append((r[0], leaf(r), trees[name][-1][0], top[-1][0], sha256("".join(below + above)), root, root == top[-1][0]))
    return Counter(want)


def manifest_rows(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_manifest(docs):
    got = Counter(map(tuple, merkle.manifest(docs).collect()))
    assert got == manifest_want(manifest_rows(docs))


@pytest.mark.parametrize(("levels", "shared", "n"), [(2, 1, 70), (3, 0, 33), (1, 2, 17)])
def test_manifest_over_many_groupings(spark, monkeypatch, levels, shared, n):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SHARED", shared)
    rows = [(i * 3, "s", ["de", "en", None, "x"][min(3, i % 11)], i, f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == manifest_want(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_manifest_of_one_tree(spark, n):
    rows = [(i, None, "en", 7, "same text") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == manifest_want(rows)


def test_manifest_of_largest_numbers(spark):
    rows = [(1, "s", "en", 2**63 - 1, "t"), (14, "s", "en", 2**63 - 1, "t"), (8, "s", "en", -1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == manifest_want(rows)


# --- Prefix trie -----------------------------------------------------------------------------------------------------


def trie_want(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}:{text}")
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(found)] for c, found in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))  # SQL's remainder
        whole = [*turns.get(first, [])[:h], *own[h:]]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children, want = Counter(p[:-1] for p in members if p), []
    words = lambda t: len([w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w])
    saved = {p: (len(m) - 1) * words(p[-1][1]) if p else 0 for p, m in members.items()}
    leaves, total = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            total[p[:d]] += saved[p]
            leaves[p[:d]] += p not in children
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        up = min(members[p[:-1]]) if p else None
        want.append((min(m), len(p), up, len(m), children[p], leaves[p], total[p], sha256(ids)))
    return Counter(want)


def conversation_rows(name):
    if name == "empty":
        return []
    if name == "given":
        import pyarrow.parquet as pq

        return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi there", "a b\tc", "", None, "x\x0by"])) for c in range(45) for t in range(c % 7)]
    rows += [(0, t, "user", f"turn {t}") for t in range(4)]  # a family's first conversation
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(1 + c % 3)]  # copies, and prefixes of each other
    rows += [(200, t, "user", str(t)) for t in range(300)] + [(201, t, "user", str(t)) for t in range(150)] + [(202, 0, "bot", "long " * 50_000)]
    rows += [(300, None, None, None), (300, None, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "user", "tie")]
    return rows + [(None, 0, "user", "nobody"), (None, None, None, None), (-7, 0, "user", "same"), (2**62, 0, "user", "same")]


@pytest.mark.parametrize("local", [2, 16, 4096])
@pytest.mark.parametrize("name", ["given", "awkward", "empty"])
def test_trie(spark, name, local):
    if (name, local) in (("given", 2), ("empty", 16), ("empty", 2)):
        pytest.skip("another size of it is enough")
    rows = conversation_rows(name)
    kinds = "conv_id long, turn long, role string, text string, node string, owner string, depth string, words string"
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], kinds)
    assert Counter(map(tuple, trie.prefix_trie(table, local).collect())) == trie_want(rows)


def test_local_totals():
    rng = random.Random(1)
    for n in (1, 2, 7, 60, 400):
        for reach in (1, 3, n):
            parent = [-1 if i == 0 or (i == n // 2 and reach == 3) else rng.randrange(max(0, i - reach), i) for i in range(n)]
            values = np.array([[rng.randrange(100), 1] for _ in range(n)], np.int64)
            want = values.copy()
            for v in reversed(range(n)):
                if parent[v] >= 0:
                    want[parent[v]] += want[v]
            assert np.array_equal(trie.local_totals(parent, values), want)


def test_chunks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    ids = [-5, -4, -3, -1, 0, 1, 2, 3, 10, 100, 101]
    table = spark.createDataFrame([(-5, 1, i) for i in ids] + [(0, 0, 7)], "owner long, depth int, conv long")
    got = {(r.owner, r.depth): r.ends_sha256 for r in trie.digests_of_ends(table).collect()}
    assert got == {(-5, 1): sha256(",".join(map(str, ids))), (0, 0): sha256("7")}


# --- Best-fit packing ------------------------------------------------------------------------------------------------


def test_best_fit_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r.doc_id, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    rows = bestfit.packed(docs, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    sequences = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows])
    counts = np.bincount([r.length for r in rows if r.length], minlength=4097)
    assert len(sequences) == bestfit.lower_bound(counts)  # the bound says that fewer are not possible


def check_sequences(rows, capacity=4096):
    sequences = defaultdict(list)
    for sequence, offset, length in rows:
        sequences[sequence].append((offset, length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_special_tokens_and_long_blanks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b <|startoftext|>", " " * 300_000, "x" * 100_000, "É́ ﬁ 漢字 🙂\r\n\t"]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(bestfit.packed(docs, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += r.ids
    assert dict(got) == {i: [*encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def fewest(lengths, capacity):
    """The smallest number of bins, by trying all subsets."""
    n = len(lengths)
    fits = [sum(x for i, x in enumerate(lengths) if m >> i & 1) <= capacity for m in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low, sub = m & -m, m
        while sub:
            if sub & low and fits[sub]:
                best[m] = min(best[m], best[m ^ sub] + 1)
            sub = (sub - 1) & m
    return best[-1]


def test_bounds_and_best_fit_of_small_sets():
    rng = random.Random(5)
    tight = 0
    for _ in range(120):
        capacity = rng.choice([10, 12, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        bins = bestfit.best_fit(np.array(lengths), capacity)
        assert max(np.bincount(bins, lengths)) <= capacity
        bound, best = bestfit.lower_bound(np.bincount(lengths, minlength=capacity + 1)), fewest(lengths, capacity)
        assert -(-sum(lengths) // capacity) <= bound <= best <= bins.max() + 1
        tight += bound == best
    assert tight > 100
    # Halves and a bit: the sum alone says 6 bins, the rounding functions say 10.
    assert bestfit.lower_bound(np.bincount([6] * 10, minlength=11)) == 10
    assert bestfit.lower_bound(np.bincount([4] * 10, minlength=11)) == 5


def test_dual_feasible_functions():
    """Every set of lengths that fills one bin has a bound of one."""
    for capacity in (7, 12):
        for k in range(1, 5):
            for lengths in combinations(list(range(1, capacity + 1)) * 2, k):
                if sum(lengths) <= capacity:
                    assert bestfit.lower_bound(np.bincount(lengths, minlength=capacity + 1)) == 1


@pytest.mark.parametrize("kind", ["mixed", "large", "equal"])
def test_exchange_between_partitions(spark, monkeypatch, kind):
    monkeypatch.setattr(bestfit, "PIECES", 60)
    monkeypatch.setattr(bestfit, "OFFERED", 50)
    monkeypatch.setattr(bestfit, "FAN", 3)
    rng = random.Random(7)
    sizes = {"mixed": lambda: rng.randint(1, 99), "large": lambda: rng.randint(34, 66), "equal": lambda: 51}[kind]
    items = [(i * 5, sizes()) for i in range(1000)]
    got = bestfit.placed(spark.createDataFrame(items, "uid long, length long"), 100).collect()
    size = dict(items)
    assert Counter(r.uid for r in got) == Counter(size.keys())
    bins = len(check_sequences([(r.bin, r.offset, size[r.uid]) for r in got], 100))
    bound = bestfit.lower_bound(np.bincount(list(size.values()), minlength=101))
    one = int(bestfit.best_fit(np.array(list(size.values())), 100).max()) + 1
    apart = sum(int(bestfit.best_fit(np.array([n for u, n in items if u % 17 == k]), 100).max()) + 1 for k in range(17))
    assert bound <= bins <= max(one * 1.04, bound) and bins <= apart  # partitions of 60 pieces are far too small
    if kind == "equal":
        assert bins == bound == 1000


def test_production_partitions_are_close_to_the_bound(spark):
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 4096, 12_000), np.minimum(4095, rng.lognormal(6, 1, 12_000).astype(int) + 1)):
        got = bestfit.placed(spark.createDataFrame(list(enumerate(sizes.tolist())), "uid long, length long")).collect()
        bins = len(check_sequences([(r.bin, r.offset, int(sizes[r.uid])) for r in got]))
        assert bins <= 1.005 * bestfit.lower_bound(np.bincount(sizes, minlength=4097))


def test_best_fit_takes_the_fullest_bin():
    assert bestfit.best_fit(np.array([7, 5, 3, 5, 1]), 10).tolist() == [0, 1, 0, 1, 2]
    table = bestfit.repacked(np.array([9, 4, 8]), np.array([60, 60, 40]), None, 100, last=True)
    assert table.column("bin").to_pylist() == [4, 4, 9] or table.column("bin").to_pylist() == [4, 8, 8]


def test_query_names():
    from atalaya.llm.queries import CHECKS, QUERIES

    assert {"op11_merkle", "op12_trie", "op13_bestfit"} <= set(QUERIES) and {"op11_merkle", "op12_trie"} <= set(CHECKS)
