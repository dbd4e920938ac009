"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.common import SPACE, bounded_broadcast, checkpointed, whole_text

#: Target of a margin: shares by value, or an exponent that tempers the corpus's own shares (1 keeps, 0 levels them).
Target = Mapping[str, float] | float
ROUNDS = 15
#: The share of all tokens that a sample keeps, and the steps that find the rates for it.
BUDGET, RATE_STEPS = 0.5, 8
#: What a document is about, as its surface shows it; the first test that holds gives the topic.
TOPICS = (("contact", "@"), ("legal", "icense"), ("table", " | "), ("noise", "!!"))
DEFAULT_TARGETS: dict[str, Target] = {
    "source": 0.7,
    "lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15},
    "topic": 0.8,
}


def topic_of(text: Column) -> Column:
    figures = F.when(text.rlike("[0-9]"), "figures").otherwise("prose")
    return reduce(lambda rest, t: F.when(F.contains(text, F.lit(t[1])), t[0]).otherwise(rest), reversed(TOPICS), figures)


def rake(cells: DataFrame, targets: Mapping[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """Cells (margin columns, tokens) with `weight`, the share of all tokens each cell has in the mix.

    Every round scales the weights of one margin after the other to its targets. Values that a mapping does not
    list keep the corpus's share, and the listed ones share the rest. The steps are windows over the cells, so the
    plan grows by a line for each, without joins or driver loops. `residual` is the largest deviation of the last
    margins from their targets.
    """
    everything = Window.partitionBy(F.lit(0))
    margins = {c: Window.partitionBy(c) for c in targets}
    share = lambda c: F.sum("tokens").over(margins[c]) / F.sum("tokens").over(everything)
    out = cells.where("tokens > 0")
    for c, target in targets.items():
        out = out.withColumn(f"own_{c}", share(c)).withColumn(
            f"first_{c}", F.row_number().over(margins[c].orderBy(*[F.asc_nulls_first(x) for x in targets])) == 1
        )
        if isinstance(target, Mapping):
            given = F.lit(None).cast("double")
            for value, wanted in target.items():
                given = F.when(F.col(c) == value, F.lit(float(wanted))).otherwise(given)
            out = out.withColumn(f"given_{c}", given)
            first = F.col(f"first_{c}")
            listed = F.sum(F.when(first, F.col(f"given_{c}"))).over(everything)
            unlisted = F.sum(F.when(first & F.col(f"given_{c}").isNull(), F.col(f"own_{c}"))).over(everything)
            scaled = F.col(f"given_{c}") / listed * (1 - F.coalesce(unlisted, F.lit(0.0)))
            out = out.withColumn(f"want_{c}", F.coalesce(scaled, F.col(f"own_{c}")))
        else:
            raw = F.pow(F.col(f"own_{c}"), F.lit(float(target)))
            total = F.sum(F.when(F.col(f"first_{c}"), raw)).over(everything)
            out = out.withColumn(f"want_{c}", raw / total)
    out = out.select(*targets, "tokens", *[f"want_{c}" for c in targets], (F.col("tokens") / F.sum("tokens").over(everything)).alias("weight"))
    for n in range(rounds):
        if n and n % ROUNDS == 0:
            out = checkpointed(out)  # a plan of hundreds of windows is too deep for a task
        for c in targets:
            total = F.sum("weight").over(margins[c])
            out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"want_{c}") / total).otherwise(0.0))
    off = [F.abs(F.sum("weight").over(margins[c]) - F.col(f"want_{c}")) for c in targets]
    out = out.withColumn("off", F.greatest(*off) if len(off) > 1 else off[0])
    out = out.withColumn("residual", F.max("off").over(everything))
    return out.select(*targets, "tokens", "weight", "residual")


def sampling_rates(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Raked cells with `rate`, the chance of each of the cell's documents.

    Rates follow weight over tokens, scaled so that the expected sample holds `budget` of all tokens. No document is
    taken twice: where a cell has too few tokens for its weight its rate is one, and the scale is found again for the
    other cells.
    """
    everything = Window.partitionBy(F.lit(0))
    wanted = F.lit(float(budget)) * F.sum("tokens").over(everything)
    out = cells.withColumn("scale", wanted)
    for _ in range(RATE_STEPS):
        full = F.col("weight") * F.col("scale") >= F.col("tokens")
        taken = F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(everything)
        free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(everything)
        out = out.withColumn("scale", F.when(free > 0, (wanted - taken) / free).otherwise(F.col("scale")))
    return out.withColumn("rate", F.least(F.lit(1.0), F.col("weight") * F.col("scale") / F.col("tokens"))).drop("scale")


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone, so a repeated task draws the same."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(
        float(1 << 48)
    )


def mixed_rates(docs: DataFrame, targets: Mapping[str, Target] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """Each row's own columns with mix_topic, mix_tokens, mix_weight, mix_rate, mix_draw, mix_selected.

    Tokens are words between ASCII blanks. A null source or language is a value of its own; rows without words
    carry no weight, belong to no cell and get rate one, as they cannot shift any margin. Repeated rows count and are
    drawn alike. The cells are one partial aggregate over all rows (a hot source is one row per task); they are
    joined by broadcast after a count, or else by shuffle.
    """
    targets = dict(targets or DEFAULT_TARGETS)
    text = whole_text()
    rows = docs.withColumns({"mix_topic": topic_of(text), "mix_tokens": F.regexp_count(text, F.lit(SPACE)).cast("long")})
    named = {c: "mix_topic" if c == "topic" else c for c in targets}
    parts: Sequence[Column] = [F.col(v).cast("string").alias(c) for c, v in named.items()]
    cells = rows.select(*parts, "mix_tokens").groupBy(*targets).agg(F.sum("mix_tokens").alias("tokens"))
    rated = sampling_rates(rake(cells, targets, rounds), budget)
    rated = rated.select(*[F.col(c).alias(f"cell_{c}") for c in targets], F.col("weight").alias("mix_weight"), F.col("rate").alias("mix_rate"))
    same = reduce(lambda a, b: a & b, [F.col(v).cast("string").eqNullSafe(F.col(f"cell_{c}")) for c, v in named.items()])
    out = rows.join(bounded_broadcast(checkpointed(rated)), same, "left").drop(*[f"cell_{c}" for c in targets])
    out = out.withColumns({"mix_rate": F.coalesce("mix_rate", F.lit(1.0)), "mix_draw": draw(F.col("doc_id"))})
    return out.withColumn("mix_selected", F.col("mix_draw") < F.col("mix_rate"))


def sample(docs: DataFrame, targets: Mapping[str, Target] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """The sampled documents with the columns of docs."""
    return mixed_rates(docs, targets, rounds, budget).where("mix_selected").select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    rated = mixed_rates(docs.select("doc_id", "text", "lang", "source"))
    return rated.select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_weight", 7).alias("cell_weight"),
        F.round("mix_rate", 7).alias("probability"),
        F.col("mix_selected").alias("selected"),
    )


def rates_sql(docs: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB's form of op1's rates over a table, view or query named docs (default targets)."""
    targets = DEFAULT_TARGETS
    topic = "CASE " + " ".join(f"WHEN contains(x, '{mark}') THEN '{name}'" for name, mark in TOPICS) + " WHEN regexp_matches(x, '[0-9]') THEN 'figures' ELSE 'prose' END"
    steps = [
        f"mix_rows AS (SELECT *, coalesce(text, '') AS x FROM {docs})",
        f"mix_docs AS (SELECT doc_id, text, lang, source, n_chars, {topic} AS topic, "
        r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n_tokens FROM mix_rows)",
        "mix_cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM mix_docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    wants = []
    for c, target in targets.items():
        steps.append(f"own_{c} AS (SELECT {c} AS v, sum(tokens) / (SELECT sum(tokens) FROM mix_cells) AS own FROM mix_cells GROUP BY {c})")
        if isinstance(target, Mapping):
            given = "CASE v " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in target.items()) + " END"
            steps.append(f"given_{c} AS (SELECT v, own, ({given})::DOUBLE AS given FROM own_{c})")
            steps.append(
                f"want_{c} AS (SELECT v, coalesce(given / sum(given) OVER () * (1 - coalesce(sum(own) FILTER (given IS NULL) OVER (), 0)), own) AS want FROM given_{c})"
            )
        else:
            steps.append(f"want_{c} AS (SELECT v, own ** {float(target)} / sum(own ** {float(target)}) OVER () AS want FROM own_{c})")
        wants.append(f"JOIN want_{c} ON want_{c}.v IS NOT DISTINCT FROM m.{c}")
    columns = ", ".join(f"want_{c}.want AS want_{c}" for c in targets)
    steps.append(f"step0 AS (SELECT m.*, {columns}, tokens / sum(tokens) OVER () AS weight FROM mix_cells m {' '.join(wants)})")
    n = 0
    for _ in range(rounds):
        for c in targets:
            n += 1
            steps.append(f"step{n} AS MATERIALIZED (SELECT * REPLACE (weight * want_{c} / sum(weight) OVER (PARTITION BY {c}) AS weight) FROM step{n - 1})")
    steps.append(f"scale0 AS (SELECT source, lang, topic, tokens, weight, {BUDGET} * sum(tokens) OVER () AS scale FROM step{n})")
    for k in range(RATE_STEPS):
        full = "weight * scale >= tokens"
        steps.append(
            f"scale{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(({BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) FILTER ({full}) OVER (), 0)) "
            f"/ nullif(sum(weight) FILTER (NOT {full}) OVER (), 0), scale) AS scale) FROM scale{k})"
        )
    steps.append(f"rated AS (SELECT source, lang, topic, weight, least(1.0, weight * scale / tokens) AS rate FROM scale{RATE_STEPS})")
    steps.append(
        "mixed AS (SELECT d.*, r.weight, coalesce(r.rate, 1.0) AS rate, "
        "('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < coalesce(r.rate, 1.0) AS selected "
        "FROM mix_docs d LEFT JOIN rated r ON r.source IS NOT DISTINCT FROM d.source AND r.lang IS NOT DISTINCT FROM d.lang AND r.topic = d.topic)"
    )
    return "WITH " + ",\n".join(steps)


OP1_SQL = rates_sql() + """
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 7) AS cell_weight, round(rate, 7) AS probability, selected FROM mixed
"""
