"""I-Match fingerprints: terms of an inverse-document-frequency band, hashed over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.common import id_bounds, mixed, shuffle_partitions, whole_text
from atalaya.llm.suffixes import _table, is_among

#: The band: terms in at least so many documents, and in at most this share of them.
LEAST_DOCUMENTS, MOST_SHARE = 2, 0.1
#: The lexicon as a whole, then five random subsets each of a half, a quarter, ... of it.
LEVELS, PER_LEVEL = 9, 5
KEEP = np.array([1.0] + [2.0**-k for k in range(1, LEVELS + 1) for _ in range(PER_LEVEL)])
SUBSETS = len(KEEP)
SEEDS = mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BELOW = np.minimum(KEEP * 2.0**64, 2.0**64 - 2**11).astype(np.uint64)
EMPTY = "0" * 8
CLEAN = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode()
)
FIRST = -(1 << 63)


def term_hashes(data: bytes) -> np.ndarray:
    """Distinct terms (ASCII lower case and punctuation as blanks) as sorted 64-bit hashes."""
    terms = set(data.translate(CLEAN).split())
    digest = xxhash.xxh64_intdigest
    return np.sort(np.fromiter(map(digest, terms), np.uint64, len(terms)))


def fingerprint(hashes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """band: the sorted hashes of the terms in the band, at least of those that occur here. One number per lexicon subset, zero where no term is left. A text without terms in the band keeps all terms."""
    kept = hashes[is_among(hashes, band)]
    if not len(kept):
        kept = hashes
    out = np.zeros(SUBSETS, np.uint32)
    if len(kept):
        chosen = mixed(kept[None, :] ^ SEEDS[:, None]) <= BELOW[:, None]
        chosen[0] = True
        for j in np.flatnonzero(chosen.any(axis=1)):
            out[j] = xxhash.xxh32_intdigest(kept[chosen[j]].tobytes()) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal hashes among subsets that hold a term of either text; two texts without terms are alike."""
    used = (a != 0) | (b != 0)
    n = int(used.sum())
    return float((a == b)[used].sum() / n) if n else 1.0


def written(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text's.

    The next document has the next larger doc_id; after the last comes the first. Null ids sort first, rows of one id
    by their text, null texts count as empty. A table of one row is its own next; an empty table gives no rows. Ids
    are dealt evenly over ranges whose bounds are ids of the table, and a range also gets the first row of
    the next one, so that no row needs another task.

    Terms are counted exactly: a range tells each of its terms once, with the number of its documents, to the task
    of the term's lot, and gets back one bit for each, whether it is in the band. Terms that an edit alone has are asked for too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(FIRST)))
    first = rows.agg(F.min("place")).first()[0]
    cuts = [c for c in id_bounds(rows, "place", shuffle_partitions(spark)) if c != first]
    bounds = np.array(cuts, np.int64)
    starts = {c: i for i, c in enumerate(cuts)} | {first: len(cuts)}
    most, parts = MOST_SHARE * rows.count(), shuffle_partitions(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.schema.names.index("place")).to_numpy()
            own = np.searchsorted(bounds, place, side="right")
            tails = np.flatnonzero([p in starts for p in place.tolist()])
            lots = np.concatenate([own, [starts[p] for p in place[tails].tolist()]]).astype(np.int32)
            both = pa.Table.from_batches([batch, batch.take(pa.array(tails))]).combine_chunks()
            is_tail = np.arange(len(lots)) >= len(own)
            for out in both.append_column("lot", pa.array(lots)).append_column("tail", pa.array(is_tail)).to_batches():
                yield out

    def texts_of(table: pa.Table) -> tuple[list, list[bytes], list[bytes]]:
        """The range's own rows in order, their texts and the next range's first one, and the edited texts."""
        columns = (table.column(c).to_pylist() for c in ("tail", "place", "text", "doc_id"))
        got = sorted(zip(*columns, strict=True), key=lambda r: r[:3])
        own = [r for r in got if not r[0]]
        texts = [r[2] for r in own] + [r[2] for r in got[len(own) : len(own) + 1]]
        halves = [len(r[2]) // 2 for r in own]
        edited = [t[: len(t) - h] + following[:h] for t, following, h in zip(texts, texts[1:], halves, strict=False)]
        return own, *([t.encode("utf-8", "surrogatepass") for t in x] for x in (texts, edited))

    def terms_of(own: list, texts: list[bytes], edited: list[bytes]) -> tuple:
        """Hashes per text and per edited text, and the range's distinct terms by lot with the number of its documents that hold each.

        Equal input gives equal order, so a range knows what it sent when the answers come.
        """
        hashes = [term_hashes(t) for t in texts]
        changed = [h if data == t else term_hashes(data) for h, t, data in zip(hashes, texts, edited, strict=False)]
        none = [np.zeros(0, np.uint64)]
        held, n = np.unique(np.concatenate([*none, *hashes[: len(own)]]), return_counts=True)
        asked = np.setdiff1d(np.concatenate([*none, *hashes[len(own) :], *changed]), held)
        terms, n = np.concatenate([held, asked]), np.concatenate([n, np.zeros(len(asked), n.dtype)])
        part = (mixed(terms) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return hashes, changed, terms[order], n[order], part[order]

    def count_terms(table: pa.Table) -> pa.Table:
        *_, terms, n, part = terms_of(*texts_of(table))
        cuts = np.flatnonzero(np.diff(part)) + 1
        split = [x for x in zip(*(np.split(x, cuts) for x in (part, terms, n)), strict=True) if len(x[0])]
        kinds = (("part", pa.int32()), ("lot", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary()))
        lot = table.column("lot")[0].as_py()
        return _table([(int(p[0]), lot, t.tobytes(), c.astype("<u4").tobytes()) for p, t, c in split], *kinds)

    def in_band(table: pa.Table) -> pa.Table:
        """One bit for each term sent, in the order sent."""
        told = [np.frombuffer(x, np.uint64) for x in table.column("terms").to_pylist()]
        values, which = np.unique(np.concatenate(told), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        n = np.bincount(which, counts, len(values))
        chosen = values[(n >= LEAST_DOCUMENTS) & (n <= most)]
        keys = zip(table.column("lot").to_pylist(), table.column("part").to_pylist(), told, strict=True)
        out = [(lot, part, np.packbits(is_among(t, chosen)).tobytes()) for lot, part, t in keys]
        return _table(out, ("lot", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()))

    def compare(table: pa.Table, told: pa.Table) -> pa.Table:
        own, texts, edited = texts_of(table)
        hashes, changed, terms, _, part = terms_of(own, texts, edited)
        bits = dict(zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True))
        sent = zip(*(x.tolist() for x in np.unique(part, return_counts=True)), strict=True)
        masks = [np.unpackbits(np.frombuffer(bits[p], np.uint8), count=size) for p, size in sent]
        flags = np.sort(terms[np.concatenate([np.zeros(0, np.uint8), *masks]).astype(bool)])
        prints, out = [fingerprint(h, flags) for h in hashes], []
        for i, row in enumerate(own):
            edit = prints[i] if changed[i] is hashes[i] else fingerprint(changed[i], flags)
            out.append(
                (
                    row[3],
                    len(row[2]),
                    hashlib.sha256(edited[i]).hexdigest(),
                    written(prints[i]),
                    written(edit),
                    likeness(prints[i], edit),
                    likeness(prints[i], prints[i + 1]),
                )
            )
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(NAMES))

    dealt = rows.mapInArrow(deal, "doc_id long, text string, place long, lot int, tail boolean")
    counted = dealt.groupBy("lot").applyInArrow(count_terms, "part int, lot int, terms binary, counts binary")
    band = counted.groupBy("part").applyInArrow(in_band, "lot int, part int, bits binary")
    return dealt.groupBy("lot").cogroup(band.groupBy("lot")).applyInArrow(
        compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
