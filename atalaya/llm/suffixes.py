"""Passages that repeat across documents, by suffix sorting in two stages and adjacent common prefixes.

Every string of LENGTH bytes has a key of its own content: the smallest hash of its grams. Consecutive strings with
one key form a run. Keys are counted over all documents first, so only runs whose key several documents share travel
as bytes; runs with one key meet in one bucket, where the suffixes at their strings are sorted. Documents are dealt
over parts, and each distinct run travels once per part, with the smallest doc_id that holds it there: very many
copies of a passage cost no more than one run for each part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.common import mixed, shuffle_partitions, utf8, words_of_8

LENGTH = 50
GRAM = 24
#: Strings in a run at most: their flags fit a 32-bit mask.
RUN = 32
#: Text that is hashed at a time, and text whose suffixes are sorted at a time.
HASHED, SORTED = 2_000_000, 4_000_000
#: A key with more runs than this, over all parts, is dealt by the content of each string, not by the key. A run has
#: at most RUN + LENGTH - 1 bytes, so a key that is not hot has under 1.7 MB, whatever the number of parts.
HOT_RUNS = 20_000
#: The same as a bound on parts: a key in more of them than this is hot too.
HOT_PARTS = 2000
LOW_48 = np.uint64((1 << 48) - 1)
FIRST = -(1 << 63)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the strings of joined documents: 48-bit key, first string's start, number of strings."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none
    word = np.concatenate([words_of_8(data), np.zeros(GRAM, np.uint64)])
    gram = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    gram ^= (word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7)
    gram += word[16 : n + 16] * np.uint64(0x165667B19E3779F9)
    low = mixed(gram)
    del word, gram
    width, grams = 1, LENGTH - GRAM + 1
    while width < grams:
        step = min(width, grams - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    starts = np.arange(n - LENGTH + 1)
    last = np.repeat(ends[1:] - LENGTH, np.diff(ends))[: len(starts)]
    inside = starts <= last
    key = low[: len(starts)]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | ~inside[:-1]
    begins = ends[:-1]
    new[begins[begins < len(starts)]] = True
    new &= inside
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(starts))
    held = np.minimum(stop, last[first] + 1) - first
    if len(held) and held.max() > RUN:  # one key over many strings, as in a long repetition
        pieces = -(-held // RUN)
        base = np.repeat(first, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(held, pieces) - nth * RUN
        first, held = base + nth * RUN, np.minimum(left, RUN)
    return mixed(key[first]) & LOW_48, first, held


def run_marks(data: np.ndarray, first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes."""
    word, end = words_of_8(data), first + held + LENGTH - 1 - 8
    mark = held.astype(np.uint64)
    for depth in range(0, RUN + LENGTH, 8):
        mark = mixed(mark * np.uint64(31) + word[np.minimum(first + depth, end)])
    return mark


def counted_runs(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with more than one distinct run, and how many they have."""
    order = np.lexsort((mark, key))
    key, mark = key[order], mark[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    values, n = np.unique(key[new], return_counts=True)
    return values[n > 1], n[n > 1]


def keys_over(counts: list[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """Keys whose numbers sum to more than most."""
    values, which = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return values[np.bincount(which, np.concatenate([n for _, n in counts]), len(values)) > most]


def documents_in_order(table: pa.Table) -> tuple[list, list[bytes]]:
    """The documents of a part by id (null first) and text: the same order whenever the part is read."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("data").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (FIRST if ids[i] is None else ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def stretches(texts: list[bytes]):
    """Neighbouring documents of about HASHED bytes: number of the first, joined bytes, boundaries."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= HASHED):
            size += len(texts[end])
            end += 1
        ends = np.zeros(end - at + 1, np.int64)
        np.cumsum([len(x) for x in texts[at:end]], out=ends[1:])
        yield at, b"".join(texts[at:end]), ends
        at = end


def packed48(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def is_among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """wanted is sorted."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys


def sort_suffixes(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """The suffixes at starts[i] .. starts[i] + counts[i] - 1, ordered by their first LENGTH bytes.

    Two stages. A suffix is direct if it is smaller than its successor, else induced. Direct suffixes are sorted by
    eight bytes at a time. Then the buckets of first bytes are scanned upwards: each suffix in turn puts its
    predecessor, if that is an induced one, at the next free place of the predecessor's bucket. A stretch of
    needed suffixes is continued to its first direct one, so every induced suffix has a sorted successor.
    Separators are zero bytes at the ends of the joined pieces.
    """
    n = len(text)
    index = np.arange(n)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(text[:-1].astype(np.int16) - text[1:])
    following = np.minimum.accumulate(np.where(change != 0, index, n - 1)[::-1])[::-1]
    induced = change[following] > 0
    induced[separators] = False
    next_direct = np.minimum.accumulate(np.where(induced, n - 1, index)[::-1])[::-1]
    last = next_direct[starts + counts]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, last + 1, -1)
    needed = np.cumsum(edge[:-1]) > 0
    direct = sort_direct(text, np.flatnonzero(needed & ~induced))
    heads = np.searchsorted(text[direct], np.arange(257))
    movable = needed & induced
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        turn = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        scans = [turn] if len(turn) else []
        for stage in (0, 1):
            if stage:
                scans = [direct[heads[c] : heads[c + 1]]] if heads[c + 1] > heads[c] else []
            while scans:
                turn = scans.pop()
                order.append(turn)
                before = turn - 1
                before = before[before >= 0]
                before = before[movable[before]]
                if not len(before):
                    continue
                first = text[before]
                if len(same := before[first == c]):
                    scans.append(same)
                before, first = before[first > c], first[first > c]
                by = np.argsort(first, kind="stable")
                before, first = before[by], first[by]
                cuts = np.flatnonzero(np.diff(first)) + 1
                for part in np.split(before, cuts):
                    if len(part):
                        waiting[text[part[0]]].append(part)
    out = np.concatenate(order) if order else np.zeros(0, np.int64)
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + counts, -1)
    return out[(np.cumsum(wanted[:-1]) > 0)[out]]


def sort_direct(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions ordered by the LENGTH bytes from them, eight bytes at a time among those still tied."""
    word = np.concatenate([words_of_8(text).byteswap(), np.zeros(LENGTH + 8, np.uint64)])
    at = at[np.argsort(word[at], kind="stable")]
    group = np.zeros(len(at), np.int64)
    key = word[at]
    if len(at):
        group[1:] = np.cumsum(key[1:] != key[:-1])
    for depth in range(8, LENGTH, 8):
        same = np.zeros(len(at), bool)
        equal = group[1:] == group[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        key = word[at[tied] + depth]
        by = np.lexsort((key, group[tied]))
        at[tied] = at[tied][by]
        key, own = key[by], group[tied][by]
        split = np.zeros(len(at), np.int64)
        split[tied[1:]] = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        group = group + np.cumsum(split)
    return at


def judged_pieces(contents: list[bytes], owners: np.ndarray) -> np.ndarray:
    """repeats() of the distinct pieces; a further copy of a piece is a repeat as a whole."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(c, len(number)) for c in contents), np.int64, len(contents))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owners)
    masks = repeats(list(number), least)[which]
    later = owners > least[which]
    size = np.fromiter(map(len, contents), np.int64, len(contents)) - LENGTH + 1
    masks[later] = ((1 << size[later]) - 1).astype(np.uint32)
    return masks


def repeats(contents: list[bytes], owners: np.ndarray) -> np.ndarray:
    """For each piece a mask of its strings that a piece with a smaller owner also has."""
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    starts = np.cumsum(size + 1) - size - 1
    counts = size - LENGTH + 1
    order = sort_suffixes(joined, starts, counts, starts + size)
    word = np.concatenate([words_of_8(joined), np.zeros(LENGTH, np.uint64)])
    equal = np.ones(max(0, len(order) - 1), bool)  # adjacent common prefixes of LENGTH bytes or more
    for depth in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        x = word[order + depth]
        equal &= x[1:] == x[:-1]
    group = np.concatenate([[0], np.flatnonzero(~equal) + 1]) if len(order) else np.zeros(0, np.int64)
    piece = np.searchsorted(starts, order, side="right") - 1
    owner = owners[piece]
    smallest = np.minimum.reduceat(owner, group) if len(order) else owner
    smallest = np.repeat(smallest, np.diff(np.append(group, len(order))))
    found = smallest < owner
    masks = np.zeros(len(contents), np.uint32)
    np.bitwise_or.at(masks, piece[found], np.uint32(1) << (order[found] - starts[piece[found]]).astype(np.uint32))
    return masks


def distinct_runs(ids: list, texts: list[bytes], shared: np.ndarray, hot: np.ndarray):
    """Distinct runs of a part with a shared key, in the order of their first documents.

    Returns (key, content) -> [number, smallest id], and per document its (start, strings, entry) list.
    """
    entries: dict[tuple[int, bytes], list] = {}
    found: list[list] = [[] for _ in texts]
    for at, data, ends in stretches(texts):
        key, first, held = runs(np.frombuffer(data, np.uint8), ends)
        kept = is_among(key, shared)
        key, first, held = key[kept], first[kept], held[kept]
        doc = np.searchsorted(ends, first, side="right") - 1
        is_hot = is_among(key, hot)
        base = ends[doc]
        for k, s, n, d, b, h in zip(key.tolist(), first.tolist(), held.tolist(), doc.tolist(), base.tolist(), is_hot.tolist(), strict=True):
            for s_, n_ in ((s, n),) if not h else ((s + i, 1) for i in range(n)):
                content = data[s_ : s_ + n_ + LENGTH - 1]
                name = (k, content)
                if (entry := entries.get(name)) is None:
                    place = FIRST if ids[at + d] is None else ids[at + d]
                    entry = entries[name] = [len(entries), place, h]
                found[at + d].append((s_ - b, n_, entry))
    return entries, found


def bucket_of_entry(key: int, content: bytes, hot: bool, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little") % buckets if hot else key % buckets


def _shared_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    shared = [unpacked48(x) for x in table.column("shared").to_pylist()]
    hot = [unpacked48(x) for x in table.column("hot").to_pylist()]
    join = lambda x: np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64)
    return join(shared), join(hot)


def repeated_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove every byte that a LENGTH-byte string covers which also starts in a document with a smaller id.

    One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and on request
    the kept bytes (cut between bytes, so not always valid UTF-8). Strings are judged on the input and never
    cross documents. Null texts count as empty; a null id is smaller than any other; rows with equal ids do not remove
    each other's text. Texts under LENGTH bytes are never touched; an empty table gives no rows; a text that repeats
    itself is not cut for it.
    """
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.length("data")), F.lit(buckets)).cast("int"))
    hot_parts, hot_runs = HOT_PARTS, HOT_RUNS

    def count_keys(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, texts = documents_in_order(table)
        once, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        own_keys, own_marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, data, ends in stretches(texts):
            key, first, held = runs(np.frombuffer(data, np.uint8), ends)
            own_keys.append(key)
            own_marks.append(run_marks(np.frombuffer(data, np.uint8), first, held))
            doc = np.searchsorted(ends, first, side="right") - 1
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            values, n = np.unique(key[new], return_counts=True)
            once.append(values)
            often.append(values[n > 1])
        values, n = np.unique(np.concatenate(once), return_counts=True)
        many = (n > 1) | is_among(values, np.unique(np.concatenate(often)))
        several, n_runs = counted_runs(np.concatenate(own_keys), np.concatenate(own_marks))
        number = np.ones(len(values), "<u4")
        number[np.searchsorted(values, several)] = n_runs
        lot = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(lot, kind="stable")
        values, many, lot, number = values[order], many[order], lot[order], number[order]
        cuts = np.flatnonzero(np.diff(lot)) + 1
        out = [
            (int(where[0]), part, packed48(v[~m]), packed48(v[m]), packed48(v[c > 1]), c[c > 1].tobytes())
            for where, v, m, c in zip(*(np.split(x, cuts) for x in (lot, values, many, number)), strict=True)
            if len(v)
        ]
        return _table(out, ("lot", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("once", "often", "several", "n_runs")))

    def find_shared(table: pa.Table) -> pa.Table:
        got = [(p, unpacked48(a), unpacked48(b)) for p, a, b in zip(*(table.column(c).to_pylist() for c in ("part", "once", "often")), strict=True)]
        values, n = np.unique(np.concatenate([x for _, a, b in got for x in (a, b)]), return_counts=True)
        shared = values[(n > 1) | is_among(values, np.unique(np.concatenate([b for _, _, b in got])))]
        # A key without a number has one run in its part; the others are counted by what they have beyond one.
        more = [
            (unpacked48(k), np.frombuffer(c, "<u4").astype(np.int64) - 1)
            for k, c in zip(table.column("several").to_pylist(), table.column("n_runs").to_pylist(), strict=True)
        ]
        hot = np.union1d(values[n > hot_parts], keys_over([(values, n), *more], hot_runs))
        out = []
        for part, a, b in got:
            own = np.concatenate([a, b])
            own = own[is_among(own, shared)]
            if len(own):
                out.append((part, packed48(own), packed48(own[is_among(own, hot)])))
        return _table(out, ("part", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()))

    def send_runs(table: pa.Table, keys: pa.Table) -> pa.Table:
        if not table.num_rows or not keys.num_rows:
            return _table([], *RUN_COLUMNS)
        part = table.column("part")[0].as_py()
        entries, _ = distinct_runs(*documents_in_order(table), *_shared_of(keys))
        lots: dict[int, list] = {}
        for (key, content), (_, owner, hot) in entries.items():
            held = lots.setdefault(bucket_of_entry(key, content, hot, buckets), ([], [], [], [], []))
            for values, x in zip(held, (key, len(content), owner, content, hot), strict=True):
                values.append(x)
        out = [
            (
                lot,
                part,
                packed48(np.array(k, np.uint64)),
                np.array(s, np.uint8).tobytes(),
                np.array(o, np.int64).tobytes(),
                b"".join(c),
                packed48(np.unique(np.array(k, np.uint64)[np.array(h, bool)])),
            )
            for lot, (k, s, o, c, h) in lots.items()
        ]
        return _table(out, *RUN_COLUMNS)

    def sort_bucket(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        got = [[table.column(c)[i].as_py() for c in ("keys", "sizes", "owners", "contents")] for i in range(len(parts))]
        order = sorted(range(len(parts)), key=parts.__getitem__)
        keys = np.concatenate([unpacked48(got[i][0]) for i in order])
        sizes = np.concatenate([np.frombuffer(got[i][1], np.uint8) for i in order]).astype(np.int64)
        owners = np.concatenate([np.frombuffer(got[i][2], np.int64) for i in order])
        data = b"".join(got[i][3] for i in order)
        at = np.cumsum(sizes) - sizes
        by_key = np.argsort(keys, kind="stable")
        masks = np.zeros(len(keys), np.uint32)
        total = np.cumsum(sizes[by_key])
        begin = 0
        while begin < len(by_key):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SORTED, side="right"))
            end = max(end, begin + 1)
            end = int(np.searchsorted(keys[by_key], keys[by_key[end - 1]], side="right"))
            chosen = by_key[begin:end]
            contents = [data[a : a + s] for a, s in zip(at[chosen].tolist(), sizes[chosen].tolist(), strict=True)]
            masks[chosen] = judged_pieces(contents, owners[chosen])
            begin = end
        lot = table.column("lot")[0].as_py()
        out, begin = [], 0
        for i in order:
            n = len(got[i][1])
            shared = packed48(np.unique(unpacked48(got[i][0])))
            out.append((parts[i], lot, masks[begin : begin + n].tobytes(), shared, table.column("hot")[i].as_py()))
            begin += n
        return _table(out, *((c, pa.int32()) for c in ("part", "lot")), *((c, pa.binary()) for c in ("masks", "shared", "hot")))

    def remove(table: pa.Table, keys: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], *result)
        ids, texts = documents_in_order(table)
        entries, found = distinct_runs(ids, texts, *_shared_of(keys))
        masks = {
            lot: iter(np.frombuffer(m, np.uint32).tolist())
            for lot, m in zip(keys.column("lot").to_pylist(), keys.column("masks").to_pylist(), strict=True)
        }
        for (key, content), entry in entries.items():
            entry.append(next(masks[bucket_of_entry(key, content, entry[2], buckets)]))
        out = []
        for doc_id, text, own in zip(ids, texts, found, strict=True):
            place = FIRST if doc_id is None else doc_id
            spans: list[list[int]] = []
            for start, n, (_, owner, _, mask) in own:
                if owner < place:
                    mask = (1 << n) - 1
                while mask:
                    low = (mask & -mask).bit_length() - 1
                    ones = ((mask >> low) ^ ((mask >> low) + 1)).bit_length() - 1
                    begin, end = start + low, start + low + ones - 1 + LENGTH
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                    mask &= ~(((1 << ones) - 1) << low)
            kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
            row = (doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
        return _table(out, *result)

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        result.append(("kept", pa.binary()))
        kinds += ", kept binary"
    counted = rows.groupBy("part").applyInArrow(count_keys, "lot int, part int, once binary, often binary, several binary, n_runs binary")
    shared = counted.groupBy("lot").applyInArrow(find_shared, "part int, shared binary, hot binary")
    sent = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        send_runs, "lot int, part int, keys binary, sizes binary, owners binary, contents binary, hot binary"
    )
    judged = sent.groupBy("lot").applyInArrow(sort_bucket, "part int, lot int, masks binary, shared binary, hot binary")
    return rows.groupBy("part").cogroup(judged.groupBy("part")).applyInArrow(remove, kinds)


RUN_COLUMNS = (
    ("lot", pa.int32()),
    ("part", pa.int32()),
    ("keys", pa.binary()),
    ("sizes", pa.binary()),
    ("owners", pa.binary()),
    ("contents", pa.binary()),
    ("hot", pa.binary()),
)


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.table([pa.array(v, k) for v, (_, k) in zip(values, columns, strict=True)], names=[n for n, _ in columns])
