"""Spelling variants by pivotal grams: words that are one inserted, deleted or replaced letter apart.

Bigrams have one order over the corpus, rare ones first. The *prefix* of a word is its three
rarest bigrams (with all that tie with the third). Two of them that do not overlap, chosen by
dynamic programming for the least total frequency, are its *pivots*. One edit changes at most
one of two disjoint bigrams, so of two near words the one whose prefix ends earlier in the order
has a pivot that survives in the other word, where it is rare enough to be in the prefix. Pivots
are therefore only looked up among prefixes.

Position limits make that look-up narrow. Let the pivots of a word be ``g`` and, behind it, ``h``.
An edit before ``h`` leaves the word from ``h`` on as it is, any other edit leaves the word up to
the end of ``g``. So ``g`` must be found at the same place after the same beginning, or ``h`` at the
same distance from the end before the same end, in a word of a length that differs by at most
one. The edit lies in the other part of the word, and then one half of that part is unchanged
too. Lookup keys name the bigram, its place, the length, and the two unchanged stretches; what
meets is verified by edit distance.

Each word makes about twelve prefix entries and twelve look-ups, whatever the corpus; pairs are
only made within a key, and a key of very many words is split by the join (adaptive execution).
Runs of ``LONG`` letters and more are no words of a language and repeat their bigrams, so that a
prefix could hold thousands: they are looked up by their unchanged half alone.

Defined cases: a NULL text has no words; a NULL identifier reads as the empty text; words of fewer
than four letters are near to none; ties between forms go to the smaller word in code-point
order; rows that repeat count each; an empty table gives an empty result; other columns do not
matter. Words of any length are compared whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.crc_sql import REMAINDERS, crc32
from pricelens.llm.tables import area, column, compact, table

#: Letters of a bigram, and how many disjoint ones are needed for one edit.
GRAM, PIVOTS = 2, 2
#: Bigrams are counted in this many slots, so the table that goes to the tasks has a fixed size.
#: Bigrams of the first 256 code points have a slot of their own; others may share one, and then
#: count as equally rare, which loses no pair.
SLOTS = 1 << 16
#: Words whose pivots one task chooses.
TASK_WORDS = 100_000
#: Words from this length on are looked up by halves.
LONG = 64
_SHORTEST = GRAM * (PIVOTS - 1) + GRAM
#: Each step doubles the distance; a form has ten times the rows of its word, so few are needed.
MOST_ROUNDS = 64

_LETTERS = "a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- words


def long_runs(text: Column, shortest: int) -> Column:
    """All maximal runs of letters with at least ``shortest`` code points, A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"[{_LETTERS}]{{{shortest},}}"), F.lit(0))


def word_counts(
    docs: DataFrame,
    shortest: int = 7,
    least: int = 2,
    text_column: str = "text",
    id_column: str = "doc_id",
    respelled: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """word, n: words of at least ``shortest`` letters that occur at least ``least`` times.

    ``respelled`` maps (identifier as text, run) to the word that counts; it may not lengthen it.
    """
    id_ = F.coalesce(column(id_column).cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(long_runs(column(text_column), shortest)).alias("run"))
    word = respelled(F.col("id"), F.col("run")) if respelled else F.col("run")
    told = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return told.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- prefixes and pivots


def _slots(word: str) -> np.ndarray:
    codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    return (codes[:-1] * 256 + codes[1:]) % SLOTS


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams per slot over all words of a task."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        found = [_slots(word) for word in batch.column("word").to_pylist()]
        if found:
            counts += np.bincount(np.concatenate(found), minlength=SLOTS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["slot", "n"]
    )


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """Bigrams per slot over all words; at most ``SLOTS`` rows reach the driver."""
    parts = words.select("word").mapInArrow(_slot_counts, "slot int, n long")
    frequency = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in parts.groupBy("slot").agg(F.sum("n")).collect():
        frequency[slot] = n
    return frequency


def disjoint_grams(places: Sequence[int], costs: Sequence[int], picks: int) -> tuple[int, ...]:
    """The ``picks`` places of least total cost whose grams do not overlap.

    ``places`` ascend. A row of the table holds, for each number of leading grams, the best choice
    of so many of them.
    """
    row: list[tuple | None] = [(0, ())] * (len(places) + 1)
    for _ in range(picks):
        following: list[tuple | None] = [None]
        for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
            free = bisect_right(places, place - GRAM, 0, i)
            before = row[free]
            taken = before and (before[0] + cost, (*before[1], place))
            skipped = following[-1]
            following.append(min((x for x in (taken, skipped) if x), default=None))
        row = following
    return row[-1][1] if row[-1] else ()


def _signatures(frequency: np.ndarray):
    rank = np.empty(SLOTS, dtype=np.int64)
    rank[np.lexsort((np.arange(SLOTS), frequency))] = np.arange(SLOTS)
    least = GRAM * (PIVOTS - 1) + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, first, second, ends = [], [], [], []
            for word in batch.column("word").to_pylist():
                if len(word) >= LONG:
                    prefixes.append([])
                    first.append(None)
                    second.append(None)
                    ends.append(None)
                    continue
                slots = _slots(word)
                ranks = rank[slots]
                last = np.partition(ranks, least - 1)[least - 1]
                places = np.flatnonzero(ranks <= last).tolist()
                chosen = disjoint_grams(places, frequency[slots[places]].tolist(), PIVOTS)
                prefixes.append(places)
                first.append(chosen[0])
                second.append(chosen[-1])
                ends.append(int(last))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    batch.column("n"),
                    pa.array(prefixes, pa.list_(pa.int32())),
                    pa.array(first, pa.int32()),
                    pa.array(second, pa.int32()),
                    pa.array(ends, pa.int32()),
                ],
                names=["word", "n", "prefix", "first", "second", "ends"],
            )

    return find


# ---------------------------------------------------------------- look-up


def _keys(side: str, gram_end: Column, length: Column) -> list[Column]:
    """Two keys for a gram: what is unchanged up to it, with either half of the other part.

    ``side`` is ``left`` when the beginning is unchanged, ``right`` when the end is; ``gram_end``
    counts the letters of that unchanged stretch with the gram, ``length`` those of the word that
    is looked up.
    """
    near, far = (F.left, F.right) if side == "left" else (F.right, F.left)
    word, half = F.col("word"), F.floor((length - gram_end) / 2).cast("int")
    beyond = F.greatest(length - F.lit(1) - gram_end - half, F.lit(0))
    return [
        F.xxhash64(F.lit(f"{side} near"), length, gram_end, near(word, gram_end + half)),
        F.xxhash64(F.lit(f"{side} far"), length, gram_end, near(word, gram_end), far(word, beyond)),
    ]


def _keyed(words: DataFrame, ends: Column, keys: list[Column]) -> DataFrame:
    return words.select("word", "n", ends.alias("ends"), F.explode(F.array(*keys)).alias("key"))


def _entries(words: DataFrame) -> DataFrame:
    """Every gram of a prefix, as a pivot of another word would find it."""
    length = F.length("word")
    each = words.where(length < LONG).withColumn("place", F.explode("prefix"))
    keys = [*_keys("left", F.col("place") + GRAM, length), *_keys("right", length - F.col("place"), length)]
    halves = _keyed(words.where(length >= LONG), F.lit(0), _keys("left", F.lit(0), length))
    return _keyed(each, F.col("ends"), keys).unionByName(halves)


def _lookups(words: DataFrame) -> DataFrame:
    """The pivots, for words of the same length, one letter less and one more."""
    own, wanted = F.length("word"), F.col("wanted")
    each = words.withColumn("wanted", F.explode(F.array(own - 1, own, own + 1)))
    keys = [*_keys("left", F.col("first") + GRAM, wanted), *_keys("right", own - F.col("second"), wanted)]
    short = each.where((own < LONG) & (wanted < LONG))
    halves = _keyed(each.where(wanted >= LONG), F.lit(0), _keys("left", F.lit(0), wanted))
    return _keyed(short, F.col("ends"), keys).unionByName(halves)


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """word, other, other_n: all pairs of ``words`` (word, n) one edit apart, both ways."""
    place = area(spark)
    words = place.put("words", words.select("word", "n").where(F.length("word") >= _SHORTEST))
    schema = "word string, n long, prefix array<int>, first int, second int, ends int"
    # Words are few bytes and much work, so they are dealt by number and not by size.
    dealt = words.repartition(max(1, -(-words.count() // TASK_WORDS)), "word")
    signed = place.put("signatures", dealt.mapInArrow(_signatures(gram_frequencies(words)), schema))
    a, b = _lookups(signed).alias("a"), _entries(signed).alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ends") <= F.col("b.ends")))
    near = met.where((F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    here, there = F.struct("a.word", "a.n"), F.struct("b.word", "b.n")
    pairs = near.select(F.least(here, there).alias("x"), F.greatest(here, there).alias("y")).distinct()
    pairs = place.put("pairs", pairs)
    sides = [pairs.select(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("xy", "yx")]
    return sides[0].unionByName(sides[1]).select(
        F.col("p.word").alias("word"), F.col("q.word").alias("other"), F.col("q.n").alias("other_n")
    )


# ---------------------------------------------------------------- forms


def _roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root: the last form of every word that has one; distances double each round."""
    place = area(spark)
    rows = forms.count()
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(MOST_ROUNDS):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = place.put("roots", compact(found.join(ahead, "root", "left"), 2 * rows))
        if found.where("next IS NOT NULL").isEmpty():
            return found.select("word", "root")
        found = found.select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError("forms did not end")


def spelling_variants(spark: SparkSession, words: DataFrame, times: int = 10) -> DataFrame:
    """One row per word of ``words`` (word, n): form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that is at least ``times`` as frequent; its
    root is where following forms ends. ``word`` is unique in ``words``.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    place = area(spark)
    words = place.put("counted", words)
    met = near_words(spark, words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form"))).alias("best"),
    )
    often = -F.col("best.rank") >= F.col("n") * times
    forms = place.put(
        "forms",
        words.join(met, "word", "left").select(
            "word",
            F.when(often, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, -F.col("best.rank")).alias("form_n"),
        ),
    )
    roots = _roots(spark, forms.where("form IS NOT NULL"))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# ---------------------------------------------------------------- query

#: The query's contract deletes a letter of one run in so many.
THINNED = 31


def _thinned(id_: Column, run: Column) -> Column:
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % THINNED == 0, cut).otherwise(run)


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = word_counts(table(spark, folder, "documents"), respelled=_thinned)
    return spelling_variants(spark, words)


OP12_SQL = f"""
WITH RECURSIVE {REMAINDERS},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[{_LETTERS}]+')) AS run
  FROM documents
),
hashed AS (SELECT run, {crc32("id || ':' || run")} AS h FROM runs, remainders),
respelled AS (
  SELECT CASE WHEN h % {THINNED} = 0
              THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2)
              ELSE run END AS word
  FROM hashed
),
words AS (SELECT word, count(*) AS n FROM respelled WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
holes AS (
  SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n
  FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.a || h.b = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.a || h.b = w.word
),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM pairs
),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chains AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
),
ends AS (SELECT c.word, c.last AS root FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
