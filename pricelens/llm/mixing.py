"""Mixing to target weights: bounded raking, then sampling by inclusion probabilities.

Documents are counted into cells of source x language x topic. A budget of tokens is dealt to
the values of each dimension in the ratio of their target shares; a value whose share is more
than it has is kept whole, and the others share the rest. Bounded raking then scales the cells
to these sums of each source, then each language, then each topic, where no cell gives more
tokens than it has: the factor of a value is the one at which ``min(tokens, factor * weight)``
adds up to its sum. Rounds go on until the sums settle; ``reached_shares`` tells target and reached
shares, and the largest budget at which each value can have its share. The probability of a
cell is its share of tokens given. A document is in the sample when a hash of it, spread over
0 to 1, is below the probability of its cell.

Only cells and factors move between tasks, both added up per task before. Cells are staged
after each round, so plans stay small and lost executors cost one round at most.

Defined cases: a NULL source or language is a value of its own (``(none)``); a NULL or empty
text has no tokens and no topic word, so topic 0, and probability 1 if its cell has no token;
values absent from given targets get no weight; the shares are scaled to sum to 1; repeated
rows share their decision; an empty table gives an empty result; further columns are carried.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, compact, is_row_count_at_most, table, whole_rows

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
#: Observed shares to this power are the default targets: large groups are thinned.
SMOOTHING = 0.5
#: Expected share of the tokens that the sample keeps.
KEEP = 0.8
#: Cells are broadcast up to this many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_CELLS = 100_000
#: Raking has settled when a round moves at most this share of the budget between cells.
SETTLED = 1e-4
#: Raking that has not settled after so many rounds is an error.
MOST_ROUNDS = 1000
#: Least and largest weight a token in bounded raking, so that no factor runs out of range.
_LEAST, _LARGEST = 1e-30, 1e12


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: Column, topics: int = TOPICS) -> Column:
    """A lexical topic: the hash bin of the longest word, the last in order among equals."""
    words = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}]+")
    longest = F.array_max(
        F.transform(words, lambda w: F.struct(F.length(w).alias("size"), w.alias("word")))
    )["word"]
    bin_ = F.conv(F.substring(F.md5(longest), 1, 4), 16, 10)
    return F.when(longest != "", bin_.cast("long") % topics).otherwise(0).cast("int")


def draw(id_: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the document alone."""
    named = F.concat_ws("|", id_.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double")
    return bits / F.lit(float(2**48))


def features(docs: DataFrame) -> list[Column]:
    text = column("text")
    return [
        F.coalesce(column("source"), F.lit("(none)")).alias("source"),
        F.coalesce(column("lang"), F.lit("(none)")).alias("lang"),
        topic(text).alias("topic"),
        n_tokens(text).alias("tokens"),
        draw(column("doc_id"), text).alias("draw"),
    ]


def default_targets(cells: DataFrame, dimension: str, smoothing: float = SMOOTHING) -> DataFrame:
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    return sums.where("t > 0").select(dimension, F.pow("t", F.lit(smoothing)).alias("share"))


def calibrated_cells(
    spark: SparkSession, weighted: DataFrame, keep: float = KEEP
) -> DataFrame:
    """Cells with ``probability``; the expected tokens of the sample are ``keep`` of all.

    The scale is a fixed point: cells that reach probability 1 leave, the rest share what is
    left of the budget. Each step moves one row of sums, and the set of full cells only grows,
    so the steps end; a cell on the border, full or not by rounding alone, ends them too.
    """
    tokens, weight = F.col("tokens"), F.col("weight")
    scale, before = 0.0, -1
    while True:
        full = weight * F.lit(scale) >= tokens
        row = weighted.where("tokens > 0").agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(full, tokens)).alias("full"),
            F.count(F.when(full, 1)).alias("n_full"),
            F.sum(F.when(~full, weight)).alias("open"),
        ).first()
        if not row["open"] or row["n_full"] <= before:
            break
        before = row["n_full"]
        scale = (keep * row["all"] - (row["full"] or 0)) / row["open"]
    chance = F.least(F.lit(1.0), F.lit(float(scale)) * weight / tokens)
    return area(spark).put(
        "calibrated",
        weighted.withColumn("probability", F.when(tokens > 0, chance).otherwise(F.lit(1.0))),
    )


def _raked_within(cells: DataFrame, name: str) -> DataFrame:
    """``cells`` with weights at which ``least(tokens, weight)`` adds up to ``want_`` of ``name``.

    In the order in which cells stay open, each open cell gives the factor that holds if those
    after it are full; the largest factor that leaves its own cell open is the one that holds.
    """
    tokens, weight = F.col("tokens"), F.col("weight")
    others = [d for d in DIMENSIONS if d != name]
    all_ = Window.partitionBy(name)
    until = all_.orderBy(weight / tokens, *others).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    full = F.sum("tokens").over(all_) - F.sum("tokens").over(until)
    tried = cells.withColumn("try", (F.col(f"want_{name}") - full) / F.sum("weight").over(until))
    holds = F.col("try") * weight < tokens
    factor = F.coalesce(F.max(F.when(holds, F.col("try"))).over(all_), F.max(tokens / weight).over(all_))
    within = F.greatest(tokens * F.lit(_LEAST), F.least(tokens * F.lit(_LARGEST), weight * factor))
    return tried.withColumn("weight", within).drop("try")


def bounded_cells(
    spark: SparkSession,
    counted: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
) -> DataFrame:
    """Cells with ``probability`` by bounded raking, and the target ``share_`` of their values.

    The expected tokens are ``keep`` of all, or all that values with a target have.
    """
    place = area(spark)
    cells = place.put("cells", counted)
    n_cells = cells.count()
    raked = cells.where("tokens > 0")
    for name in DIMENSIONS:
        shares = (targets or {}).get(name)
        shares = default_targets(cells, name) if shares is None else shares
        given = shares.where("share > 0").select(name, F.col("share").cast("double").alias(f"share_{name}"))
        raked = raked.join(given, name)
    raked = place.put("targeted", compact(raked, n_cells))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    most = raked.agg(F.sum("tokens")).first()[0] or 0
    part = min(1.0, keep * total / most) if most else 0.0
    bounded = raked.withColumn("weight", F.col("tokens").cast("double"))
    for name in DIMENSIONS:
        sums = raked.groupBy(name, F.col(f"share_{name}").alias("weight")).agg(F.sum("tokens").alias("tokens"))
        dealt = calibrated_cells(spark, place.put(f"sums_{name}", compact(sums, n_cells)), part)
        wanted = dealt.select(name, (F.col("probability") * F.col("tokens")).alias(f"want_{name}"))
        bounded = bounded.join(wanted, name)
    bounded = place.put("wanted", compact(bounded, n_cells))
    given = F.least("weight", "tokens")
    for turn in count() if part else ():
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"raking has not settled after {MOST_ROUNDS} rounds")
        raked_once = reduce(_raked_within, DIMENSIONS, bounded.withColumn("last", given))
        bounded = place.put(f"round_{turn}", compact(raked_once, n_cells))
        moved = bounded.agg(F.sum(F.abs(given - F.col("last")))).first()[0] or 0.0
        if moved <= SETTLED * part * most:
            break
    told = bounded.select(*DIMENSIONS, "weight", *[f"share_{name}" for name in DIMENSIONS])
    weight = F.coalesce("weight", F.lit(0.0))  # no weight: a value without a target
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), weight / F.col("tokens"))).otherwise(1.0)
    return place.put(
        "bounded", cells.join(told, list(DIMENSIONS), "left").withColumn("probability", chance)
    )


def reached_shares(cells: DataFrame) -> DataFrame:
    """Per dimension and value of ``bounded_cells``: target and reached share of the sample.

    ``largest_keep`` is the share of all tokens up to which the value alone can have its target.
    """
    all_ = Window.partitionBy("dimension")
    parts = [
        cells.where(f"share_{name} IS NOT NULL")
        .groupBy(
            F.lit(name).alias("dimension"),
            F.col(name).cast("string").alias("value"),
            F.col(f"share_{name}").alias("share"),
        )
        .agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("given"))
        for name in DIMENSIONS
    ]
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    target = F.col("share") / F.sum("share").over(all_)
    return reduce(DataFrame.unionByName, parts).select(
        "dimension",
        "value",
        "tokens",
        target.alias("target"),
        F.try_divide("given", F.sum("given").over(all_)).alias("reached"),
        (F.col("tokens") / target / total).alias("largest_keep"),
    )


def _with_probability(docs: DataFrame, cells: DataFrame) -> DataFrame:
    looked_up = cells.select(*DIMENSIONS, "probability")
    if is_row_count_at_most(looked_up, BROADCAST_CELLS):
        looked_up = F.broadcast(looked_up)
    return docs.join(looked_up, list(DIMENSIONS))


def mixture(
    spark: SparkSession,
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
) -> DataFrame:
    """Every document with its cell, tokens, probability and whether the sample has it."""
    told = area(spark).put("features", docs.select(column("doc_id"), *features(docs)))
    counted = told.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = bounded_cells(spark, counted, targets, keep)
    return _with_probability(told, cells).select(
        "doc_id",
        *DIMENSIONS,
        "tokens",
        F.round("probability", 6).alias("probability"),
        (F.col("draw") < F.col("probability")).alias("sampled"),
    )


def sample_mixture(
    spark: SparkSession,
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
) -> DataFrame:
    """The rows of ``docs`` in the sample, with their columns unchanged.

    Rows are written with their features, so that each text is cut into words once: the cells
    are counted from the narrow columns, and the texts are read once more for the sample.
    """
    told = docs.select(whole_rows(docs).alias("whole"), *features(docs))
    rows = area(spark).put("features", told)
    counted = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = bounded_cells(spark, counted, targets, keep)
    return (
        _with_probability(rows, cells).where("draw < probability").select("whole.*")
    )


def op6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, table(spark, folder, "documents"))


def _wanted_sql(name: str) -> str:
    """Tokens that each value is to give: the scale comes from a running sum in filling order."""
    return f"""values_{name} AS (
  SELECT {name}, sum(tokens) AS t, sqrt(sum(tokens)) AS w FROM cells WHERE tokens > 0 GROUP BY {name}),
filling_{name} AS (
  SELECT w / t AS rate, coalesce(sum(t) OVER before, 0) AS full_tokens,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_weight, sum(t) OVER () AS all_tokens
  FROM values_{name}
  WINDOW before AS (ORDER BY w / t DESC, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale_{name} AS (
  SELECT max(({KEEP} * all_tokens - full_tokens) / open_weight) FILTER (
           WHERE ({KEEP} * all_tokens - full_tokens) / open_weight * rate < 1) AS s
  FROM filling_{name}),
wanted_{name} AS (
  SELECT {name}, least(1.0, (SELECT s FROM scale_{name}) * w / t) * t AS want_{name} FROM values_{name})"""


def _raked_sql(inner: str, name: str) -> str:
    others = ", ".join(d for d in DIMENSIONS if d != name)
    return f"""SELECT * EXCLUDE (weight, try, most),
         greatest(tokens * {_LEAST}, least(tokens * {_LARGEST}, weight * coalesce(
           max(try) FILTER (WHERE try * weight < tokens) OVER (PARTITION BY {name}), most))) AS weight
  FROM (
    SELECT *, max(tokens / weight) OVER (PARTITION BY {name}) AS most,
           (want_{name} - sum(tokens) OVER (PARTITION BY {name}) + sum(tokens) OVER until)
             / sum(weight) OVER until AS try
    FROM ({inner})
    WINDOW until AS (PARTITION BY {name} ORDER BY weight / tokens, {others}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


OP6_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
         list_max([lpad(length(w)::VARCHAR, 7, '0') || w
                   FOR w IN regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}]+')]) AS longest,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT
           / 281474976710656.0::DOUBLE AS draw
  FROM documents),
told AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens, draw,
         CASE WHEN longest > '0000001'
              THEN ('0x' || substr(md5(substr(longest, 8)), 1, 4))::INTEGER % {TOPICS}
              ELSE 0 END AS topic
  FROM words),
cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM told GROUP BY ALL),
{", ".join(_wanted_sql(name) for name in DIMENSIONS)},
rounds AS (
  SELECT 0 AS turn, source, lang, topic, tokens, want_source, want_lang, want_topic,
         tokens AS weight, 1e300::DOUBLE AS moved
  FROM cells JOIN wanted_source USING (source) JOIN wanted_lang USING (lang)
       JOIN wanted_topic USING (topic)
  WHERE tokens > 0
  UNION ALL
  SELECT turn + 1, source, lang, topic, tokens, want_source, want_lang, want_topic, weight,
         sum(abs(least(weight, tokens) - last)) OVER ()
  FROM ({reduce(_raked_sql, DIMENSIONS, f"""SELECT *, least(weight, tokens) AS last FROM rounds
    WHERE moved > {SETTLED * KEEP} * (SELECT sum(tokens) FROM cells)""")})),
settled AS (SELECT * FROM rounds WHERE turn = (SELECT max(turn) FROM rounds)),
chances AS (
  SELECT source, lang, topic, CASE WHEN c.tokens > 0 THEN least(1.0, r.weight / c.tokens)
                                   ELSE 1.0 END AS probability
  FROM cells c LEFT JOIN settled r USING (source, lang, topic))
SELECT doc_id, source, lang, topic::INTEGER AS topic, tokens, round(probability, 6) AS probability,
       draw < probability AS sampled
FROM told JOIN chances USING (source, lang, topic)
"""
