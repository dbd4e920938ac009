"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only. Two passes read the texts: the first counts the vote patterns of all candidates, the
second scores each candidate in its own row. Between them only the model, a few hundred numbers, is held by the driver.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns. A match starts where its run of characters does, or where the last match ended, and runs are
#: taken whole: the same matches as without these marks, in linear time on very long runs.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9]|[\x20-][0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: addresses spelled out, and numbers in groups without a plus sign.
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[(\[{{]at[)\]}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{{]dot[)\]}}])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Fixed values of the labelers.
DOMAINS = "com net org edu gov io info biz eu uk de fr es it nl ch at be pt pl ca au us br mx ar cl jp cn in".split()
CUES = {
    "email": r"mail|contact|write|correo|kontakt|adresse|courriel",
    "ip": r"\bip\b|addr|host|server|client|login|logged|servidor|adresse",
    "card": r"card|visa|master|amex|pay|credit|karte|carte|tarjeta|kredit",
    "phone": r"phone|tel|call|fax|mobile|cell|contact|whatsapp|anruf|appel|llam",
}
AROUND = 40
LABELERS = ("regex", "valid", "gazetteer", "context", "border")
STEPS = 8


def _matches(text: Column, pattern: str, kind: str, form: str) -> Column:
    """All matches with their places in code points: the gaps between them give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,form:string,start:int,end:int,span:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["span"])
        one = F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"), start.alias("start"), end.alias("end"), pair["span"].alias("span"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, s: F.struct(g.alias("gap"), s.alias("span")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda state: state["out"]))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(x: Column) -> Column:
    """The tests that a base match must pass."""
    digits = _digits(x["span"])
    n = F.length(digits)
    octets = F.forall(F.split(x["span"], r"\."), lambda o: o.try_cast("int") <= 255)
    return (
        F.when(x["kind"] == "email", True)
        .when(x["kind"] == "ip", F.coalesce(octets, F.lit(False)))
        .when(x["kind"] == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _known(x: Column) -> Column:
    digits = _digits(x["span"])
    last = F.lower(F.regexp_extract(x["span"], r"([A-Za-z]+)$", 1))
    return (
        F.when(x["kind"] == "email", last.isin(DOMAINS))
        .when(x["kind"] == "ip", ~x["span"].rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^169\.254\."))
        .when(x["kind"] == "card", digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"))
        .otherwise(~F.contains(x["span"], F.lit("+")) | digits.rlike("^[1-9]"))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (spans that pass), and further candidate spans as arrays in the document's own row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        there = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        if kind != "email":
            there = there & digit
        rows = rows.withColumn(f"raw_{kind}", F.when(there, _matches(F.col("text"), BASE[kind], kind, "base")))
    at = F.col("text").rlike(r"[(\[{]at[)\]}]")
    rows = rows.withColumn("loose_email", F.when(at, _matches(F.col("text"), LOOSE["email"], "email", "loose")))
    rows = rows.withColumn("loose_phone", F.when(digit, _matches(F.col("text"), LOOSE["phone"], "phone", "loose")))
    kind_of = "array<struct<kind:string,form:string,start:int,end:int,span:string>>"
    given = lambda c: F.coalesce(c, F.array().cast(kind_of))
    for kind in KINDS:
        rows = rows.withColumn(f"base_{kind}", F.filter(given(f"raw_{kind}"), _valid))
    rows = rows.withColumn("base", F.concat(*[F.col(f"base_{k}") for k in KINDS]))
    others = F.concat(given("loose_email"), given("loose_phone"), *[F.filter(given(f"raw_{k}"), lambda x: ~_valid(x)) for k in KINDS])
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    plausible = lambda x: (x["form"] == "loose") | F.length(_digits(x["span"])).between(7, 24) | (x["kind"] == "email")
    rows = rows.withColumn("others", F.filter(F.filter(others, plausible), free))
    return rows.select("doc_id", "text", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base", "others")


def _voted(text: Column, x: Column) -> Column:
    """A candidate with its votes (1 for, 0 against, -1 none) and shape features."""
    left = F.lower(F.substring(text, F.greatest(x["start"] - AROUND + 1, F.lit(1)), F.least(x["start"], F.lit(AROUND))))
    before = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")
    after = F.substring(text, x["end"] + 1, F.lit(1))
    cue = reduce(lambda rest, k: F.when(x["kind"] == k, left.rlike(CUES[k])).otherwise(rest), KINDS, F.lit(False))
    vote = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        x["kind"].alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        vote(x["form"] == "base").alias("regex"),
        vote(_valid(x)).alias("valid"),
        vote(_known(x)).alias("gazetteer"),
        F.when(cue, 1).otherwise(-1).alias("context"),
        vote(~(F.concat(before, F.lit(" "), after).rlike(r"[\p{L}\p{N}]"))).alias("border"),
        F.least(F.length(x["span"]).cast("int") / 4, F.lit(8)).cast("int").alias("size"),
        F.least(F.length(F.regexp_replace(x["span"], "[A-Za-z0-9]", "")), F.lit(6)).cast("int").alias("marks"),
    )


FEATURES = (*LABELERS, "size", "marks")


def train(rows: DataFrame) -> dict[str, float]:
    """The span classifier's weights by (kind, feature, value) and the prior by kind; a bounded dictionary.

    Vote patterns of all candidates are counted (at most kinds x votes x shapes rows). Expectation and maximisation
    steps run over the counted patterns as windows by kind. The expected labels then train a naive Bayes classifier
    over votes and shape. Without candidates the dictionary is empty.
    """
    spans = F.transform(F.concat("base", "others"), lambda x: _voted(F.col("text"), x))
    votes = rows.where("size(base) + size(others) > 0").select(F.inline(spans))
    table = votes.groupBy("kind", *FEATURES).agg(F.count("*").cast("double").alias("n"))
    by_kind = Window.partitionBy("kind")
    yes = reduce(lambda a, b: a + b, [(F.col(v) == 1).cast("int") for v in LABELERS])
    no = reduce(lambda a, b: a + b, [(F.col(v) == 0).cast("int") for v in LABELERS])
    table = table.withColumn("p", (yes + 0.5) / (yes + no + 1.0))
    log_odds = None
    for _ in range(STEPS):
        hits = [F.col("kind"), *FEATURES, F.col("n")]
        total = F.sum("n").over(by_kind)
        hits.append(((F.sum(F.col("n") * F.col("p")).over(by_kind) + 1) / (total + 2)).alias("prior"))
        for v in LABELERS:
            for name, mass in (("t", F.col("n") * F.col("p")), ("f", F.col("n") * (1 - F.col("p")))):
                for_ = F.sum(F.when(F.col(v) == 1, mass).otherwise(0.0)).over(by_kind)
                any_ = F.sum(F.when(F.col(v) >= 0, mass).otherwise(0.0)).over(by_kind)
                hits.append(((for_ + (2 if name == "t" else 1)) / (any_ + 3)).alias(f"{v}_{name}"))
        table = table.select(*hits)
        log_odds = F.log(F.col("prior") / (1 - F.col("prior")))
        for v in LABELERS:
            log_odds = log_odds + F.when(F.col(v) == 1, F.log(F.col(f"{v}_t") / F.col(f"{v}_f"))).when(
                F.col(v) == 0, F.log((1 - F.col(f"{v}_t")) / (1 - F.col(f"{v}_f")))
            ).otherwise(0.0)
        table = table.withColumn("p", 1 / (1 + F.exp(-log_odds))).select("kind", *FEATURES, "n", "p")
    entries = [F.concat_ws("|", "kind", F.lit(f), F.col(f).cast("string")) for f in FEATURES]
    long = table.select("kind", "n", "p", F.explode(F.array(F.concat_ws("|", "kind", F.lit("prior")), *entries)).alias("key"))
    sums = long.groupBy("kind", "key").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("n")).collect()
    prior = {r["kind"]: r for r in sums if r["key"].endswith("|prior")}
    weights = {}
    for r in sums:
        all_ = prior[r["kind"]]
        good, bad = r["good"] + 0.5, r["n"] - r["good"] + 0.5
        if r["key"].endswith("|prior"):
            weights[r["key"]] = log(good / bad)
        else:
            weights[r["key"]] = log(good / (all_["good"] + 1)) - log(bad / (all_["n"] - all_["good"] + 1))
    return weights


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and added spans (kind, start, end) of every row.

    Null texts count as empty; null ids and repeated rows are rows like others; documents without spans have empty
    arrays; an empty table gives no rows. Very long runs of one character class are read once. Base spans are
    those of the patterns and tests alone. A further candidate is added if the classifier's log odds are positive and it
    overlaps no base span nor an added one before it.
    """
    rows = candidates(docs)
    model = train(rows)
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform("base", place)
    if not model:
        added = F.filter(base, lambda _: F.lit(False))
    else:
        weights = F.create_map(*[F.lit(y) for kv in sorted(model.items()) for y in kv])
        weight = lambda *key: F.coalesce(F.element_at(weights, F.concat_ws("|", *key)), F.lit(0.0))
        score = lambda x: reduce(lambda a, f: a + weight(x["kind"], F.lit(f), x[f].cast("string")), FEATURES, weight(x["kind"], F.lit("prior")))
        voted = F.transform("others", lambda x: _voted(F.col("text"), x))
        good = F.transform(F.filter(voted, lambda x: (score(x) > 0) & (x["valid"] == 1)), place)
        in_order = F.array_sort(good, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
        apart = lambda out, x: F.when(F.exists(out, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])), out).otherwise(F.concat(out, F.array(x)))
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        added = F.when(F.size("others") > 0, F.aggregate(in_order, none, apart)).otherwise(none)
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], base.alias("base"), added.alias("added"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = personal_data(docs)
    everything = F.concat("base", "added")
    ordered = F.concat(*[F.array_sort(F.filter(everything, _of_kind(k))) for k in KINDS])
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(ordered).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
