"""What the second review found: each test fails on the code before its finding was settled."""

import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from atalaya.llm import exact_stream, lines  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_exact_copies_of_null_ids(spark, tmp_path):
    rows = [(None, "only null ids"), (None, "Only null ids"), (None, "x"), (3, "x"), (None, "alone"), (None, None), (None, "")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for digest in (exact_stream.sha256, lambda text: text.substr(1, 0)):  # with the second all rows are hits of one digest
        found = exact_stream.exact_duplicates(spark, path, digest=digest, files_per_batch=1).collect()
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str)
        none = (None, None, 2, True)
        assert got == sorted([none, none, none, none, (None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)], key=str)


def groups(sets, linked):
    root = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if linked(sets[a], sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return root


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_short_lines_are_removed(spark):
    texts = ["Les.\nAnd ornd.\nok", "Les.\n\nx\nWh the.", "And ornd.\nLes.\nok\nOk", "\n  \nx \nWh the."]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "Les.\nAnd ornd.\nok", 1: "\nx\nWh the.", 2: "Ok", 3: "\n  "}


def test_lines_with_one_edit(spark):
    """Lines of 60 characters or more with one substituted character in the middle, and a brute-force version at 0.8."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    own = list(dict.fromkeys(x.strip() for r in texts for x in (r.text or "").split("\n") if len(x.strip()) >= 60))[:150]
    edited = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in own]
    found = own + edited
    root = groups([{x[k : k + 5] for k in range(len(x) - 4)} for x in found], alike)
    assert all(root[i] == root[i + len(own)] for i in range(len(own)))
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    kept = {r.doc_id for r in lines.deduplicated(docs).where("text <> ''").collect()}
    assert kept == set(root)


def test_near_documents_at_five_words(spark):
    """Planted copies with edited words around a similarity of 0.8, against a brute-force version."""
    rng = np.random.default_rng(5)
    texts = []
    for n in (3, 4, 5, 12, 60, 200, 700):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.1):
                texts.append(" ".join("Edited" if rng.random() < share else w.upper() for w in base))
    texts += ["", " \n", "one", "One"]
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    root = groups(sets, alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()}
    assert kept == set(root) and any(root[i] != i for i in range(len(root)))


def test_packing_of_a_literal_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from atalaya.llm import packing

    text = "how <|endoftext|> it ends<|endoftext|><|endoftext|>\n <|endoftext"
    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 1]
    rows = packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).collect()
    assert 50256 in ids and [x for r in sorted(rows, key=lambda r: r.start) for x in r.ids] == ids


def test_extraction_without_article_elements():
    from atalaya.llm import extraction

    first = [f"Sentence number {i} of the first part." for i in range(3)]
    second = ["Opening words of the lighter part.", "By <a href=1>An author with a long name</a>"]
    noise = "".join(f"<div class='ad'>Buy item {i} of this shop</div>" for i in range(4))
    nav = "<div><a href=1>Home</a> | <a href=2>About us</a></div>"
    page = f"<body>{nav}<p>{'</p><p>'.join(first)}</p>{noise}<p>{'</p><p>'.join(second)}</p>{nav}</body>"
    assert extraction.main_text(page)[0] == "\n\n".join([*first, second[0], "By An author with a long name"])


def test_extraction_is_the_same_without_article_tags(spark):
    from atalaya.llm import extraction

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert extraction.main_text(plain)[0] == extraction.main_text(r.html)[0]


def test_imatch_counts_terms_exactly(spark):
    """Two terms that meet in one of 2^20 slots, each in one document: neither is in the band."""
    from collections import Counter

    from atalaya.llm import imatch

    hashes, pair = {}, None
    for i in range(20_000):
        slot = int(imatch.term_hashes(f"t{i}".encode())[0]) % (1 << 20)
        if slot in hashes:
            pair = (hashes[slot], f"t{i}")
            break
        hashes[slot] = f"t{i}"
    texts = [f"{pair[0]} both other", f"{pair[1]} both"] + [f"filler{i} other" * (i == 1) for i in range(28)]
    counts = Counter(int(h) for t in texts for h in imatch.term_hashes(t.encode()))
    band = np.sort(np.array([h for h, n in counts.items() if 2 <= n <= 0.1 * len(texts)], np.uint64))
    got = {r.doc_id: r for r in imatch.compared_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        edited = t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]
        assert got[i].fingerprint == imatch.written(imatch.fingerprint(imatch.term_hashes(t.encode()), band))
        assert got[i].edited_fingerprint == imatch.written(imatch.fingerprint(imatch.term_hashes(edited.encode()), band))
    assert got[1].fingerprint == imatch.written(imatch.fingerprint(imatch.term_hashes(b"both"), band))


def test_suffix_hot_keys_by_runs(spark, monkeypatch):
    """A gram with many surroundings in two parts is hot by its distinct runs; copies of one run are not."""
    from atalaya.llm import suffixes

    gram = b"a common phrase of twenty four bytes or more than that"
    rng = np.random.default_rng(2)
    texts = [b"".join((rng.bytes(40).hex().encode(), gram, rng.bytes(40).hex().encode())) for _ in range(40)]
    got = []
    for own in (texts[:20], texts[20:], texts[:1] * 500):
        ends = np.cumsum([0, *map(len, own)])
        data = np.frombuffer(b"".join(own), np.uint8)
        key, first, held = suffixes.runs(data, ends)
        got.append(suffixes.counted_runs(key, suffixes.run_marks(data, first, held)))
    values, n = got[0]
    top = values[n.argmax()]
    assert n.max() > 3 and max(got[2][1], default=0) < n.max()
    assert top in suffixes.keys_over(got[:2], int(n.max())) and top not in suffixes.keys_over(got[:1], int(n.max()))
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = sorted(map(tuple, suffixes.repeated_passages(docs).collect()))
    monkeypatch.setattr(suffixes, "HOT_RUNS", 3)
    assert sorted(map(tuple, suffixes.repeated_passages(docs).collect())) == plain and any(r[2] for r in plain)
