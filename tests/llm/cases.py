"""Small tables with awkward rows: nulls, empty and very long texts, repeated rows, clashing extra columns."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        *(StructField(c, StringType()) for c in ("part", "digest", "key", "fp", "lot", "quality_score", "tokens", "place")),
    ]
)
LINE = "A line of some length that is shared by several documents, word by word"
LONG = " ".join(f"wörd{i % 977} of a very long text {i}" for i in range(3000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog while nobody looks at the old red barn again today"),
    (2, "The quick brown fox jumps over the lazy dog while nobody looks at the old red barn again today"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "word"),
    (7, f"{LINE}\nanother line that only this document has in it\n{LINE}"),
    (8, f"first words here\n{LINE}!\nshort"),
    (8, f"first words here\n{LINE}!\nshort"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "aaaa" * 60 + " ÄÖÜ ñandú 漢字仮名 🙂 mail me at jo.do@mail.example.com or +1 (415) 555-0100"),
    (12, "aaaa" * 60 + " ÄÖÜ ñandú 漢字仮名 🙂"),
    (None, "a text without an id but with words in it"),
    (None, None),
    (13, "x\0y control\x01 bytes \x85 and   separators"),
]


def awkward(spark):
    rows = [(i, t, None if i and i % 3 == 0 else "en", None if i == 5 else f"src{(i or 0) % 2}", None, *"abcdefgh") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
