"""Every corpus operator against a brute-force version, on given tables and on awkward rows."""

import hashlib
import re
import sys
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import brute_pii
import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from atalaya.llm import exact_stream, extraction, imatch, lines, mixing, packing, pii, quality, simhash, suffixes
from atalaya.llm.components import components

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["given", "awkward", "empty"])
def docs(request, spark):
    return {"given": documents, "awkward": cases.awkward, "empty": cases.nothing}[request.param](spark)


def documents_of(sf):
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()]


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def joined(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def order(i):
    return -(1 << 63) if i is None else i


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (5, 4), (7, 7), (4, 5), (20, 30), (30, 25), (None, 1)] + [(100, 101 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 5: 4, 30: 20, 25: 20} | {101 + i: 100 for i in range(300)}


def test_mixing_meets_targets(spark):
    cells = mixing.rake(
        mixing.mixed_rates(documents(spark)).groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")),
        mixing.DEFAULT_TARGETS,
        60,
    ).collect()
    wanted = mixing.DEFAULT_TARGETS["lang"]
    total = sum(wanted.values())
    for lang, share in wanted.items():
        assert abs(sum(c.weight for c in cells if c.lang == lang) - share / total) < 1e-2
    assert max(c.residual for c in cells) < 1e-2


def test_mixing_rates_hold_the_budget(spark):
    got = mixing.mixed_rates(documents(spark)).collect()
    tokens = sum(r.mix_tokens for r in got)
    assert abs(sum(r.mix_tokens * r.mix_rate for r in got) / tokens - mixing.BUDGET) < 1e-6
    assert all(0 <= r.mix_rate <= 1 for r in got)


def test_mixing_keeps_columns(docs):
    got = mixing.sample(docs)
    assert got.columns == docs.columns
    assert got.count() <= docs.count()


def test_suffix_passages(docs):
    rows = sorted(((i, t.encode()) for i, t in rows_of(docs)), key=lambda r: (order(r[0]), r[1]))
    first, want = {}, []
    for i, data in rows:
        for s in range(len(data) - suffixes.LENGTH + 1):
            first.setdefault(data[s : s + suffixes.LENGTH], order(i))
    for i, data in rows:
        cover = np.zeros(len(data) + 1, int)
        for s in range(len(data) - suffixes.LENGTH + 1):
            if first[data[s : s + suffixes.LENGTH]] < order(i):
                cover[s : s + suffixes.LENGTH] = 1
        kept = bytes(b for b, c in zip(data, cover, strict=False) if not c)
        spans = int((np.diff(np.concatenate([[0], cover])) == 1).sum())
        want.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.repeated_passages(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_hot_keys_by_content(spark, monkeypatch):
    plain = sorted(map(tuple, suffixes.repeated_passages(documents(spark)).collect()))
    monkeypatch.setattr(suffixes, "HOT_PARTS", 1)
    assert sorted(map(tuple, suffixes.repeated_passages(documents(spark)).collect())) == plain


def test_suffix_order():
    rng = np.random.default_rng(1)
    for alphabet in (2, 3, 256):
        pieces = [rng.integers(0, alphabet, rng.integers(50, 82)).astype(np.uint8).tobytes() for _ in range(200)]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        size = np.array([len(p) for p in pieces])
        starts = np.cumsum(size + 1) - size - 1
        got = suffixes.sort_suffixes(text, starts, size - 49, starts + size)
        data = text.tobytes()
        wanted = sorted(s for a, n in zip(starts, size - 49, strict=True) for s in range(a, a + n))
        assert sorted(got.tolist()) == wanted
        keys = [data[s : s + 50] for s in got.tolist()]
        assert keys == sorted(keys)


def exact_want(rows, same):
    want = []
    for i, t in rows:
        group = [j for j, u in rows if same(u) == same(t)]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep))
    return sorted(want, key=str)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("which", ["given", "awkward", "empty"])
def test_exact_stream(spark, tmp_path, which, weak):
    table = {"given": documents, "awkward": cases.awkward, "empty": cases.nothing}[which](spark)
    path = str(tmp_path / "documents.parquet")
    table.repartition(4).write.parquet(path)
    digest = (lambda text: F.length(text).cast("string")) if weak else exact_stream.sha256
    found = exact_stream.exact_duplicates(spark, path, digest=digest, files_per_batch=1)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)
    assert got == exact_want(rows_of(table), lower)


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode().lower()) if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = [(i, plain_fingerprint(t)) for i, t in rows_of(docs)]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (rows[a][1] ^ rows[b][1]).bit_count() <= 3]
    root = joined(len(rows), near)
    name = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            name[r] = min(name.get(r, i), i)
    want = [(i, f"{fp:016x}", name.get(r)) for (i, fp), r in zip(rows, root, strict=True)]
    assert sorted(map(tuple, simhash.op4(docs).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_dense_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 24, 2), 2)] + [base ^ 0xFFFF, 5, 5 ^ 7]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    root = joined(len(prints), [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    groups = {}
    for p, r in zip(signed, root, strict=True):
        groups.setdefault(r, set()).add(p)
    found = {}
    for p in signed:
        found.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_imatch(docs):
    rows = sorted(rows_of(docs), key=lambda r: (order(r[0]), r[1]))
    df = Counter(int(h) for _, t in rows for h in imatch.term_hashes(t.encode()))
    chosen = [h for h, n in df.items() if imatch.LEAST_DOCUMENTS <= n <= imatch.MOST_SHARE * len(rows)]
    band = np.sort(np.array(chosen, np.uint64))
    want, prints = [], [imatch.fingerprint(imatch.term_hashes(t.encode()), band) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        half, following = len(t) // 2, (k + 1) % len(rows)
        edited = t[: len(t) - half] + rows[following][1][:half]
        fp = imatch.fingerprint(imatch.term_hashes(edited.encode()), band)
        want.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), imatch.written(prints[k]), imatch.written(fp))
            + (imatch.likeness(prints[k], fp), imatch.likeness(prints[k], prints[following]))
        )
    got = [tuple(r) for r in imatch.compared_with_edits(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])) for i, t in rows_of(docs))
    rows = packing.packed(docs, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    texts = {}
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    got = Counter()
    for (i, n), found in texts.items():
        copies = sum(s == 0 for s, _ in found)
        if copies == 1:
            ids = [x for _, p in sorted(found) for x in p]
            assert len(ids) == n
            got[i, tuple(ids)] += 1
        else:  # rows that are repeated, pieces and all
            got += Counter({k: v for k, v in want.items() if k[0] == i and len(k[1]) == n})
    assert got == want


@pytest.mark.parametrize("blank", [" ", "\t", "\xa0"])
def test_packing_of_very_long_blanks(blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "a" + blank * 1_000_000 + "b"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.ids_of(text, packing.default_vocabulary()) == want


def test_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        found = packing.binary_lengths(n)
        assert sum(found) == n and all(x & (x - 1) == 0 for x in found) and found == sorted(found, reverse=True)


def similar_lines_kept(rows):
    rows = sorted(rows, key=lambda r: (order(r[0]), r[1]))
    first = {}
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if len(line := line.strip()) >= lines.LEAST_CHARS:
                first.setdefault(line, (order(i), n))
    found = list(first)
    sets = [{x[k : k + lines.SHINGLE] for k in range(max(1, len(x) - lines.SHINGLE + 1))} for x in found]  # a short line is one shingle
    near = [(a, b) for a, b in combinations(range(len(found)), 2) if len(sets[a] & sets[b]) >= lines.SIMILARITY * len(sets[a] | sets[b])]
    root = joined(len(found), near)
    keep = {}
    for x, r in zip(found, root, strict=True):
        keep[r] = min(keep.get(r, first[x]), first[x])
    place = {x: keep[r] for x, r in zip(found, root, strict=True)}
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if place.get(x.strip(), (order(i), n)) == (order(i), n))) for i, t in rows]


def test_line_dedup(docs):
    want = similar_lines_kept(rows_of(docs))
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    told = lines.deduplicated(docs, with_rows=False).collect()
    assert Counter((r.doc_id, r.kept_sha256) for r in told) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_recall_of_bands():
    """Planted edits of given lines, long and short, at a similarity of 0.8 to 0.87: nearly all share a key."""
    rng = np.random.default_rng(1)
    own = [x.strip() for t in documents_of("sf0.01") for x in t.split("\n") if x.strip()][:3000]
    own += [x[:n] for x in own[:1500] for n in (8, 9, 10, 12, 16, 24)]
    pairs = []
    shingled = lambda x: {x[k : k + 5] for k in range(len(x) - 4)}
    for x in own:
        for _ in range(2):
            y = x
            for _ in range(rng.integers(1, 6)):
                i = int(rng.integers(0, len(y) + 1))
                y = [y[:i] + "#" + y[i + 1 :], y[:i] + y[i + 1 :], y[:i] + "é" + y[i:], y + "!"][rng.integers(0, 4)]
            a, b = shingled(x), shingled(y)
            if a and b and a != b and 0.8 <= len(a & b) / len(a | b) < 0.87:
                pairs.append((x, y))
    found = []
    for side in zip(*pairs, strict=True):
        keys, owners = lines.band_keys(list(side))
        found.append(set(zip(owners.tolist(), keys.tolist(), strict=True)))
    met = {owner for owner, _ in found[0] & found[1]}
    assert len(pairs) > 1500 and len(met) >= 0.998 * len(pairs)


def test_ascending_numbers_round_trip():
    for x in ([0, 0, 5, 300, 70_000], [3, 4], [0], [255, 255 + 256]):
        assert lines._unpacked_ascending(lines._packed_ascending(np.array(x))).tolist() == x


@pytest.mark.parametrize("block", [3, 2048])
def test_line_dedup_dense_group(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    base = "every one of these lines is the same but for one number near its very end, which is "
    docs = spark.createDataFrame([(i, base + str(i)) for i in range(60)], "doc_id long, text string")
    assert [r.doc_id for r in lines.deduplicated(docs).where("text <> ''").collect()] == [0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var a = "</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this page</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>
words.<br>Same block.</p><div class="ad">Buy this</div><p>Tiny.</p><form>Name <input></form><p title="a > b">Last &lt;tag&gt;.
<section id="comments"><p>First!</p></section></article><aside>More</aside><footer>&copy; 2020</footer></body></html>"""


def test_extraction():
    assert extraction.main_text(PAGE)[0] == "A & B\n\nFirst bold words. Same block.\n\nTiny.\n\nLast <tag>."
    plain = "<div><a href=1>Home</a> <a href=2>About</a></div>" + "<p>" + "</p><p>".join(["text of some length"] * 4) + "</p>"
    assert extraction.main_text(plain)[0] == "\n\n".join(["text of some length"] * 4)
    for unit in ("<b", "<a ", '<a "', "<!--", "</script", "<a x=", "<script/>"):  # a megabyte of broken markup
        start = time.process_time()
        assert extraction.main_text("<p>some text of twenty letters</p>" + unit * (1_000_000 // len(unit)))[0].startswith("some text of")
        assert time.process_time() - start < 4
    start = time.process_time()
    assert extraction.main_text("<p " + "x" * 500_000 + ">text that is long enough</p>")[0] == "text that is long enough"
    assert time.process_time() - start < 4
    assert extraction.main_text("") == ("", -1, -1) and extraction.main_text("<p>unclosed <a href='x")[0] == "unclosed <a href='x"


def test_extraction_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extraction.extracted(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in extraction.extracted(odd).collect()] == [("", 0)] * 3


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scored = {r.doc_id: r for r in quality.op9(table, labels).collect()}
    judged = [(scored[r.doc_id], r.quality) for r in labels.collect() if scored[r.doc_id].held_out]
    assert sum(s.predicted == q for s, q in judged) / len(judged) > 0.98
    assert all(s.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, s in scored.items())


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0), (99, 1)], "doc_id long, quality int")
    for docs in (cases.awkward(spark), cases.nothing(spark)):
        got = quality.op9(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_good(docs, labels)
        assert kept.columns == [c for c in docs.columns if c != "quality_score"] and kept.count() <= docs.count()


def test_personal_data(docs):
    want = Counter((i, *brute_pii.base(t)) for i, t in rows_of(docs))
    assert Counter(tuple(r)[:6] for r in pii.op10(docs).collect()) == want


def test_personal_data_spans(spark):
    texts = [
        "a@b.c.d-e@f.g x@y.z_w@v.u and +1 (415) 555-0100, 1.2.3.4.5.6.7.8 or 300.1.1.1",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 and +12 3 4567 89()",
        "é" * 5 + " jo@ex.org",
        "1" * 50_000 + "a" * 50_000 + "@b.c",
        "call 415-555-0100 or jo.do (at) mail (dot) example (dot) com",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op10(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_pii.base(t)
    assert got[2].spans == "email:6:15"


if __name__ == "__main__":
    sys.exit(pytest.main([str(Path(__file__))]))
