"""Packing by power-of-two decomposition: every piece of a document has a binary length and a sequence of its own."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.common import bounded_broadcast, checkpointed, rows_of, shuffle_partitions, whole_text

LONGEST = 2048
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of a rank file; the ids are those of the same vocabulary's JSON form, added tokens too.

    The JSON form lies beside the rank file; a rank file without one has no added tokens.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = {}
    if os.path.exists(whole := os.path.splitext(vocabulary)[0] + ".json"):
        with open(whole, encoding="utf-8") as file:
            for token in json.load(file)["added_tokens"]:
                if any(token[k] for k in ("single_word", "lstrip", "rstrip")):
                    raise ValueError(f"added token {token['content']!r} matches by more than its literal")
                added[token["content"]] = token["id"]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def whole_encoder(vocabulary: str):
    """The JSON form that lies beside a rank file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.splitext(vocabulary)[0] + ".json")


def ids_of(text: str, vocabulary: str) -> list[int]:
    """Ids by the rank file; its pattern gives up on about a million blanks in a row, and the JSON form reads such texts."""
    try:
        return encoder(vocabulary).encode(text, allowed_special="all")  # a literal added token is one id
    except ValueError:
        return whole_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as full sequences and then the binary digits of what is left, largest first."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pieces(
    docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    vocabulary = vocabulary or default_vocabulary()
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    numbers = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(ids_of, vocabulary=vocabulary)
        for table in rows_of(batches):
            out, kept = [[], [], [], [], []], []
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("data").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                start = 0
                for length in binary_lengths(len(ids), longest):
                    part = ids[start : start + length]
                    for values, x in zip(out, (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        values.append(x)
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    start += length
            columns = [pa.array(x, pa.int64()) for x in out]
            schema = numbers
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                schema = numbers.append(pa.field("ids", pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("data"))
    return rows.mapInArrow(run, kinds)


def packed(
    docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """All documents as sequences of a power-of-two length: no padding, and no sequence crosses documents.

    A document's ids (with the end id) are cut into full sequences and then into the binary digits of the rest.
    Equal lengths share a bucket: sequence numbers run without gaps, longest bucket first, so that a batch of one
    shape is a range of numbers. Null and empty texts give one piece with the end id alone; null ids and repeated
    rows are packed like any other row; an empty table gives no rows. The longest and the shortest text differ only
    in their number of pieces.
    """
    cut = checkpointed(pieces(docs, vocabulary, longest, end_id, with_ids))
    parts = shuffle_partitions(docs.sparkSession)
    place = ("doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = cut.withColumn("lot", F.pmod(F.xxhash64(*place), F.lit(parts)))
    lots = dealt.groupBy("length", "lot").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("length"), "lot").rowsBetween(Window.unboundedPreceding, -1)
    before = lots.select("length", "lot", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    in_lot = F.row_number().over(Window.partitionBy("length", "lot").orderBy(*place))
    ranked = dealt.withColumn("in_lot", in_lot)
    joined = ranked.join(bounded_broadcast(checkpointed(before)), ["length", "lot"])
    extra = ["ids"] if with_ids else []
    number = (F.col("before") + F.col("in_lot") - 1).alias("sequence_id")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", number, F.lit(0).cast("long").alias("offset"), *extra
    )
