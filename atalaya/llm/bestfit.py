"""Best-fit packing with certificates: dual-feasible bounds on the bins of a partition, and exchange where there is a gap."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.common import rows_of, whole_text, written

CAPACITY = 4096
END_ID = 1
#: Pieces of a partition in the first round, and how many partitions exchange with each other in a later one.
PIECES, FAN = 5000, 16
#: Pieces that a partition offers for exchange: whole bins, the emptiest first, full ones too (their short pieces fill gaps).
OFFERED = 4000
#: Of the rounding functions floor((k + 1) x) / k those with k up to this.
ROUNDINGS = 24


#: Words whose ids a task remembers before it begins anew, and how many new ones are encoded at a time.
REMEMBERED, AT_ONCE = 600_000, 2000
#: Bytes of the texts that are encoded together.
TOGETHER = 4_000_000
#: What the last token of a word of letters ends with in the vocabulary.
WORD_END = "</w>"


#: An ASCII word without an apostrophe falls into these parts, whatever stands beside them.
PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
LATIN = "\u0180"


def stems(word: str) -> tuple[str, ...]:
    """A word in lower case, cut where the vocabulary's pattern cuts it in any case: the ids are those of its parts.

    Letters, single digits and runs of other characters are apart. Beyond ASCII only a point or comma behind a letter
    is cut off, and only Latin letters are lowered. An added token is matched before letters are lowered, so a word
    that may hold one stays as it is.
    """
    if "<|" in word:
        return (word,)
    if word.isascii():
        low = word.lower()
        return (low,) if low.isalpha() or "'" in low else tuple(PARTS.findall(low))
    if max(word) < LATIN:
        low = word.lower()
        return (low[:-1], low[-1]) if low[-1] in ".," and low[-2:-1].isalpha() else (low,)
    return (word,)


class Encoder:
    """Ids of whole texts by the `tokenizers` JSON, word by word.

    The vocabulary drops white space, and neither its words nor its added tokens hold any, so the ids of a text are
    those of its stretches between ASCII white space, one after another. Each stretch is encoded by the library once
    and then remembered. With a vocabulary that keeps white space or capitals whole texts are encoded instead.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        probe, words = "Ab, b\tc\n\x0b\x0cd\r e.", ["ab", ",", "b", "c", "d", "e", "."]
        self.by_word = self.ids(probe) == b"".join(map(self.ids, words))
        entries = self.whole.get_vocab()
        self.ends = np.zeros(max(entries.values()) + 1, bool)
        self.ends[[i for token, i in entries.items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words of letters are encoded many at a time, as each has one last token; if their number is another, one by one."""
        (found,) = self.whole.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        data = np.array(found.ids, "<u4")
        cuts = (4 * np.flatnonzero(self.ends[data]) + 4).tolist()
        if len(cuts) != len(words):
            self.known.update(zip(words, map(self.ids, words), strict=True))
            return
        whole, start = data.tobytes(), 0
        for word, end in zip(words, cuts, strict=True):
            self.known[word] = whole[start:end]
            start = end

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts, known = list(map(stems, words)), self.known
        new = [w for w in {w for own in parts for w in own} if w not in known]
        letters = [w for w in new if w.isalpha()]
        for i in range(0, len(letters), AT_ONCE):
            self._learn(letters[i : i + AT_ONCE])
        for word in new:
            if word not in known:
                known[word] = self.ids(word)
        return [known[own[0]] if len(own) == 1 else b"".join(map(known.__getitem__, own)) for own in parts]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return list(map(self.ids, texts.to_pylist()))
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._ids_of_words(coded.dictionary.to_pylist()), pa.large_binary())
        per_text = pa.LargeListArray.from_arrays(words.offsets.cast(pa.int64()), ids.take(coded.indices))
        return pc.binary_join(per_text, pa.scalar(b"", pa.large_binary())).to_pylist()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for; only long documents are cut."""
    vocabulary = vocabulary or default_vocabulary()
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for table in rows_of(batches, TOGETHER):
            out = [[] for _ in schema.names]
            texts = table.column("data").combine_chunks()
            for doc_id, ids in zip(table.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    row = (doc_id, n, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4"))
                    for values, x in zip(out, row, strict=False):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("data"))
    return rows.mapInArrow(run, kinds)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length: longest first, each into the fullest bin that has room for it."""
    bins = np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the different free sizes, ascending
    having: dict[int, list[int]] = {}
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        k = bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            chosen = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        else:
            room, chosen, opened = capacity, opened, opened + 1
        bins[i] = chosen
        if left := room - length:
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(chosen)
    return bins


def shares(counts: np.ndarray) -> tuple[int, int]:
    """The largest bound that a dual-feasible function gives for lengths with these counts, as a fraction.

    counts[i] is the number of pieces of length i, up to the capacity. A dual-feasible function gives the lengths of any
    full bin a sum of at most one, so no packing has fewer bins than the sum over all pieces. Two families: lengths
    over capacity - e count as a whole bin and those under e as nothing; and multiples of a (k + 1)-th are rounded
    down to k-ths, unless they are exact.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1, dtype=np.int64)
    many, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    e = np.arange(capacity // 2 + 1)
    large = many[-1] - many[capacity - e + 1]
    best = (int((large * capacity + total[capacity - e + 1] - total[e]).max()), capacity)
    for k in range(1, ROUNDINGS + 1):
        up = size * (k + 1)
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        found = (int((counts * value).sum()), capacity * k)
        if found[0] * best[1] > best[0] * found[1]:
            best = found
    return best


def lower_bound(counts: np.ndarray) -> int:
    """No packing of these lengths has fewer bins."""
    total, unit = shares(counts)
    return -(-total // unit)


def repacked(uid: np.ndarray, length: np.ndarray, before: np.ndarray | None, capacity: int, last: bool) -> pa.Table:
    """One partition's certified packing: uid, length, bin, offset, and whether the bin is offered for exchange.

    A bin is named by the smallest uid in it. Bins that were there before stay if best fit has none fewer. A
    partition whose bins equal the share that its bound is made of has no gap and offers nothing.
    """
    order = np.argsort(uid, kind="stable")
    uid, length = uid[order], length[order]
    number = best_fit(length, capacity)
    if before is not None:
        _, old = np.unique(before[order], return_inverse=True)
        if old.max(initial=-1) <= number.max(initial=-1):
            number = old
    n_bins = int(number.max(initial=-1)) + 1
    name = np.full(n_bins, np.iinfo(np.int64).max)
    np.minimum.at(name, number, uid)
    fill = np.bincount(number, length, n_bins).astype(np.int64)
    open_bin = np.zeros(n_bins, bool)
    total, unit = shares(np.bincount(length, minlength=capacity + 1))
    if not last and n_bins * unit > total:
        emptiest = np.argsort(fill, kind="stable")
        held = np.bincount(number, minlength=n_bins)[emptiest]
        open_bin[emptiest[np.cumsum(held) - held < OFFERED]] = True
    by_bin = np.argsort(number, kind="stable")
    sums = np.cumsum(length[by_bin]) - length[by_bin]
    starts = np.cumsum(fill) - fill
    offset = sums - starts[number[by_bin]]
    columns = (uid[by_bin], length[by_bin], name[number[by_bin]], offset, open_bin[number[by_bin]])
    return pa.table([pa.array(c) for c in columns], names=["uid", "length", "bin", "offset", "open"])


def _packer(capacity: int, first: bool, last: bool):
    def pack(table: pa.Table) -> pa.Table:
        uid, length = table.column("uid").to_numpy(), table.column("length").to_numpy()
        out = repacked(uid, length, None if first else table.column("bin").to_numpy(), capacity, last)
        return out.append_column("lot", pa.array(np.full(out.num_rows, table.column("lot")[0].as_py()), pa.int64()))

    return pack


def placed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, length), unique uids and lengths up to the capacity, to uid, bin, offset.

    Partitions of about PIECES pieces are packed by best fit decreasing. Each is certified by dual-feasible functions;
    those with a gap between bins and bound offer their emptiest bins, and in the next round FAN partitions pack what
    they offer together. It ends when all bins together equal the bound of the whole table, or one partition is left.
    """
    counts = np.zeros(capacity + 1, np.int64)  # the table's lengths: at most capacity rows
    for row in items.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound, lots = lower_bound(counts), max(1, -(-int(counts.sum()) // PIECES))
    current = items.select("uid", "length", F.lit(None).cast("long").alias("bin"), F.pmod(F.xxhash64("uid"), F.lit(lots)).alias("lot"))
    done, settled = None, 0
    while True:
        last, first = lots == 1, done is None
        kinds = "uid long, length long, bin long, offset long, open boolean, lot long"
        packed = written(current.groupBy("lot").applyInArrow(_packer(capacity, first, last), kinds), "bestfit")
        total, still = packed.where("offset = 0").agg(F.count("*"), F.count_if("open")).first()
        over = last or not still or settled + total == bound
        found = (packed if over else packed.where("not open")).select("uid", "bin", "offset")
        done = found if first else done.unionByName(found)
        if over:
            return done
        settled += total - still
        lots = -(-lots // FAN)
        current = packed.where("open").select("uid", "length", "bin", F.floor(F.col("lot") / FAN).alias("lot"))


def packed(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """All documents in sequences of at most `capacity` ids, as few as can be found; only longer documents are cut.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequence numbers are any numbers;
    offsets run without gaps from 0. A full piece is a sequence of its own. Null and empty texts are the end id alone;
    null ids, repeated rows and ties of length are packed like any other row; an empty table gives no rows. A very
    long text differs only in its number of pieces. Other columns play no part.
    """
    cut = written(pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("uid", F.monotonically_increasing_id()), "bestfit")
    full = cut.where(F.col("length") == capacity).select("uid", F.col("uid").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = placed(cut.where(F.col("length") < capacity).select("uid", "length"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return cut.join(full.unionByName(rest), "uid").select(*columns, *(["ids"] if with_ids else []))
