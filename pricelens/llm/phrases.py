"""Collocations from truncated suffix trees, built apart for groups of word prefixes.

The phrases of a text are the beginnings of its suffixes, cut off after ``max_words`` words and at
the end of their piece. All suffixes of a corpus make one tree, too large for any task, so it is
cut vertically:

1. Each task collapses the suffixes of a block of text into leaves (suffix, total) in tree order
   and writes them by prefix: one row holds all leaves of the block that begin with one word.
2. The leaves of every prefix are counted over the corpus. A prefix with more than ``BUDGET`` of
   them is extended by its next word, and the extended prefixes are dealt into as many parts as
   budgets are needed; a part that is still too large, by one hot pair of words, is extended again.
   The total of a prefix that was extended is summed apart.
3. Parts are grouped, so that a group holds about ``GROUP`` leaves. A task builds the subtrees of
   its group, some parts at a time: leaves are merged in tree order, and the total of a node is
   the sum of the leaf totals below it. Only nodes with ``least`` occurrences leave the task; parts
   of a phrase are at least as frequent as the phrase, so none is missed.

Phrases are then scored by DataFrame operations on those nodes, in exact decimals.

A word that fills a third of the corpus is a prefix that is extended, so no task and no group holds
its subtree, and its rows are only dealt anew, not multiplied; counts of a language are sums. Step 1 cuts long texts at piece ends.

Defined cases: a NULL or empty text has no words; a NULL language is ``und``; equal rows count
each; ties in score and frequency go to the phrase that sorts first by its UTF-8 bytes; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, table
from pricelens.llm.words import mix
from pricelens.sources.area import StagingArea

#: Leaves of a prefix that may be in a task's memory at once, and of a group of prefixes.
BUDGET, GROUP = 1 << 18, 1 << 21
#: Bytes of text that a task collapses at once.
BLOCK_BYTES = 6 << 20
#: Rows ranked apart before the last ranking of a language.
_SALTS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# ``level`` words beyond the prefix are fixed in a part, which is one of the prefix's ``part``s.
_LEAVES = "lang string, prefix string, level int, part long, rests string, totals array<int>, n long"
_NODES = "lang string, phrase string, words int, n long"
_KEY = ["lang", "prefix", "level", "part"]


# ---------------------------------------------------------------- leaves


def collapsed(
    group: np.ndarray, steps: Sequence[np.ndarray], totals: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One place for each different (group, steps), in their order, and the sum of its totals.

    ``steps`` are codes of the words that follow, 0 for none.
    """
    key = group.astype(np.int64)
    for codes in steps:
        # Codes are packed into one number, renumbered before they could overflow.
        width = int(codes.max(initial=0)) + 1
        if int(key.max(initial=0)) + 1 > (1 << 62) // width:
            _, key = np.unique(key, return_inverse=True)
        key = key * width + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    sums = np.add.reduceat(totals[order], new) if len(new) else totals[:0]
    return order[new], sums


def _joined(dictionary: pa.Array, parts: Sequence[np.ndarray]) -> pa.Array:
    """The words of some codes with blanks between them; code 0 is no word."""
    words = pa.concat_arrays([pa.array([""], dictionary.type), dictionary])
    found = words.take(pa.array(parts[0]))
    for codes in parts[1:]:
        longer = pc.binary_join_element_wise(found, words.take(pa.array(codes)), " ")
        found = pc.if_else(pa.array(codes > 0), longer, found)
    return found


def _listed(values: pa.Array, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), values)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts in lower case in blocks that end with a piece, and where each text ends.

    A break follows every text. Only a block of the texts is copied at a time.
    """
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(sizes, sizes[first] + BLOCK_BYTES, side="right")) - 1
        last = max(last, first + 1)
        some = texts.slice(first, last - first).cast(pa.binary())
        data = _LOWER[np.frombuffer(b"\n".join([*some.to_pylist(), b""]), dtype=np.uint8)]
        # Texts before the block end before its first byte, later ones behind its last.
        ends = sizes[1:] - sizes[first] + np.arange(1, len(sizes)) - first
        start = 0
        while start < len(data):
            stop = min(start + 2 * BLOCK_BYTES, len(data))
            breaks = np.flatnonzero(_KIND[data[start:stop]] == _BREAK)
            while not len(breaks):  # a piece longer than a block
                stop = min(stop + BLOCK_BYTES, len(data))
                breaks = np.flatnonzero(_KIND[data[start:stop]] == _BREAK)
            stop = start + int(breaks[-1]) + 1
            yield data[start:stop], ends - start
            start = stop
        first = last


def _block_leaves(
    data: np.ndarray, ends: np.ndarray, langs: np.ndarray, names: pa.Array, depth: int
) -> pa.RecordBatch | None:
    """The leaves of a block, one row for each language and first word."""
    kind = _KIND[data]
    inside = kind == _WORD
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return None
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    codes = coded.indices.to_numpy().astype(np.int64) + 1
    steps = [codes]
    for ahead in range(1, depth):
        following = np.zeros(len(codes), dtype=np.int64)
        same = piece[ahead:] == piece[:-ahead]
        following[: len(same)] = np.where(same, codes[ahead:], 0)
        steps.append(following)
    lang = langs[np.searchsorted(ends, starts, side="right")]
    at, totals = collapsed(lang, steps, np.ones(len(codes), dtype=np.int64))
    lang, first = lang[at], codes[at]
    new = np.flatnonzero(
        np.concatenate([[True], (lang[1:] != lang[:-1]) | (first[1:] != first[:-1])])
    )
    rests = _joined(words, [step[at] for step in steps[1:]])
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(lang[new])),
            words.take(pa.array(first[new] - 1)),
            pa.array(np.zeros(len(new), dtype=np.int32)),
            pa.array(np.zeros(len(new), dtype=np.int64)),
            pc.binary_join(_listed(rests, new), "\n"),
            _listed(pa.array(totals.astype(np.int32)), new),
            pa.array(np.add.reduceat(totals, new)),
        ],
        names=[*_KEY, "rests", "totals", "n"],
    )


def _leaves(depth: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            langs = lang.indices.to_numpy()
            for data, ends in _pieces(batch.column("text")):
                found = _block_leaves(data, ends, langs, lang.dictionary, depth)
                if found is not None:
                    yield found

    return find


# ---------------------------------------------------------------- vertical partitions


def _opened(rests: pa.Array) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """(row of each leaf, different words, codes of each leaf's words by step)."""
    lists = pc.split_pattern(rests, "\n")
    row = pc.list_parent_indices(lists).to_numpy()
    words = pc.split_pattern(lists.flatten(), " ")
    counts = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64) + 1
    if len(coded.dictionary):
        none = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
        if none >= 0:  # a leaf without a further word reads as one empty word
            codes[codes == none + 1] = 0
    begin = np.cumsum(counts) - counts
    steps = []
    for ahead in range(int(counts.max(initial=0))):
        has = counts > ahead
        step = np.zeros(len(counts), dtype=np.int64)
        step[has] = codes[begin[has] + ahead]
        steps.append(step)
    return row, coded.dictionary, steps


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt into ``parts`` by a hash of one more word; leaves without one end before it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, words, steps = _opened(batch.column("rests"))
        totals = batch.column("totals").flatten().to_numpy().astype(np.int64)
        level = batch.column("level").to_numpy()[row]
        parts = batch.column("parts").to_numpy()[row]
        salts = np.array([0, *(zlib.crc32(w.encode()) for w in words.to_pylist())], dtype=np.uint64)
        name = np.zeros(len(row), dtype=np.uint64)
        on = np.ones(len(row), dtype=bool)
        for ahead, step in enumerate(steps):
            fixed = ahead <= level
            name = np.where(fixed, mix(name + salts[step] + np.uint64(1)), name)
            on &= ~fixed | (step > 0)
        on &= level < len(steps)
        part = (name % parts.astype(np.uint64)).astype(np.int64)
        chosen = np.flatnonzero(on)
        if not len(chosen):
            continue
        # By row and part; within both, leaves stay in tree order.
        chosen = chosen[np.lexsort((part[chosen], row[chosen]))]
        row, part, totals = row[chosen], part[chosen], totals[chosen]
        rests = _joined(words, [step[chosen] for step in steps])
        new = np.flatnonzero(
            np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
        )
        at = pa.array(row[new])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").take(at),
                batch.column("prefix").take(at),
                pa.array(level[chosen][new] + np.int32(1)),
                # The old part goes into the new one, so that parts of two parts stay apart.
                pa.array(batch.column("part").to_numpy()[row[new]] * (1 << 24) + part[new]),
                pc.binary_join(_listed(rests, new), "\n"),
                _listed(pa.array(totals.astype(np.int32)), new),
                pa.array(np.add.reduceat(totals, new)),
            ],
            names=[*_KEY, "rests", "totals", "n"],
        )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of extended parts add to the nodes at which their words are fixed."""
    for batch in batches:
        row, words, steps = _opened(batch.column("rests"))
        totals = batch.column("totals").flatten().to_numpy().astype(np.int64)
        level = batch.column("level").to_numpy()
        for fixed in np.unique(level[row]).tolist():
            on = np.flatnonzero(level[row] == fixed)
            for step in steps[:fixed]:
                on = on[step[on] > 0]
            if not len(on) or fixed > len(steps):
                continue
            at, sums = collapsed(row[on], [step[on] for step in steps[:fixed]], totals[on])
            at = on[at]
            names = [batch.column("prefix").take(pa.array(row[at]))]
            if fixed:
                names.append(_joined(words, [step[at] for step in steps[:fixed]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(row[at])),
                    pc.binary_join_element_wise(*names, " ") if fixed else names[0],
                    pa.array(np.full(len(at), fixed + 1, dtype=np.int32)),
                    pa.array(sums),
                ],
                names=["lang", "phrase", "words", "n"],
            )


def _partitioned(
    place: StagingArea, leaves: DataFrame, depth: int, budget: int
) -> tuple[DataFrame, DataFrame | None]:
    """(parts that fit the budget, nodes at which parts were extended)."""
    fitting: DataFrame | None = None
    nodes: DataFrame | None = None
    rows = leaves
    for _ in range(1, depth):
        loads = rows.groupBy(*_KEY).agg(F.sum(F.size("totals")).alias("load"))
        # Parts of a quarter of the budget on average, so that only a hot pair of words exceeds it.
        parts = F.ceil(F.col("load") * 4 / budget).cast("long").alias("parts")
        # Each has more than a budget of leaves; written, so its size is known to the join.
        large = place.put("large", loads.where(F.col("load") > budget).select(*_KEY, parts).coalesce(1))
        if large.isEmpty():
            break
        light = rows.join(large, _KEY, "left_anti").select(*leaves.columns)
        fitting = light if fitting is None else fitting.unionByName(light)
        heavy = rows.join(large, _KEY)
        ends = heavy.select(*leaves.columns).mapInArrow(_ends, _NODES)
        done = ends.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
        nodes = done if nodes is None else nodes.unionByName(done)
        split = heavy.select(*leaves.columns, "parts").mapInArrow(_split, _LEAVES)
        rows = place.put("extended", split)
    return rows if fitting is None else fitting.unionByName(rows), nodes


# ---------------------------------------------------------------- subtrees


def _subtrees(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Nodes with at least ``least`` occurrences of the subtrees of some whole prefixes."""
    rows = rows.combine_chunks()
    lang, prefix, level_, part = (rows.column(c).combine_chunks() for c in _KEY)
    fixed = level_.to_numpy()
    rests, totals = rows.column("rests").combine_chunks(), rows.column("totals").combine_chunks()
    row, words, steps = _opened(rests)
    weights = totals.flatten().to_numpy().astype(np.int64)
    differs = np.zeros(len(rows), dtype=bool)
    for names in (lang, prefix, level_, part):
        codes = names.dictionary_encode().indices.to_numpy()
        differs[1:] |= codes[1:] != codes[:-1]
    tree = np.cumsum(differs)[row]
    at, sums = collapsed(tree, steps, weights)
    tree, row, steps = tree[at], row[at], [step[at] for step in steps]
    new = np.concatenate([[True], tree[1:] != tree[:-1]])
    found = []
    for level in range(len(steps) + 1):
        if level:
            step = steps[level - 1]
            new = new | np.concatenate([[True], step[1:] != step[:-1]])
        begins = np.flatnonzero(new)
        n = np.add.reduceat(sums, begins)
        # Shallower nodes than a part has fixed words are spread over parts.
        kept = (n >= least) & (fixed[row[begins]] <= level)
        if level:
            kept &= steps[level - 1][begins] > 0
        begins, n = begins[kept], n[kept]
        parts = [prefix.take(pa.array(row[begins]))]
        if level:
            parts.append(_joined(words, [step[begins] for step in steps[:level]]))
        depth = np.full(len(begins), level + 1, dtype=np.int32)
        phrase = pc.binary_join_element_wise(*parts, " ") if level else parts[0]
        found.append((lang.take(pa.array(row[begins])), phrase, pa.array(depth), pa.array(n)))
    columns = [pa.concat_arrays(list(c)) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])


def _nodes(least: int, budget: int):
    """Rows come sorted by part; whole parts are taken together up to the budget."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        leaves = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            loads = pc.list_value_length(batch.column("totals")).to_numpy()
            names = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
            cut = 0
            for i, name in enumerate(names):
                if leaves >= budget and name != last:
                    held.append(batch.slice(cut, i - cut))
                    yield _subtrees(pa.Table.from_batches(held), least)
                    held, leaves, cut = [], 0, i
                leaves += int(loads[i])
                last = name
            held.append(batch.slice(cut))
        if held:
            yield _subtrees(pa.Table.from_batches(held), least)

    return find


def phrase_counts(
    spark: SparkSession,
    docs: DataFrame,
    max_words: int = 3,
    least: int = 10,
    lang_column: str = "lang",
    text_column: str = "text",
    budget: int = BUDGET,
    group: int = GROUP,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, languages): (lang, phrase, words, n) of phrases that occur ``least`` times, and
    (lang, n), all words of each language. Both are written tables.
    """
    place = area(spark)
    told = docs.select(
        F.coalesce(column(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"),
    )
    leaves = place.put("leaves", told.mapInArrow(_leaves(max_words), _LEAVES))
    languages = place.put("languages", leaves.groupBy("lang").agg(F.sum("n").alias("n")))
    fitting, extended = _partitioned(place, leaves, max_words, budget)
    load = leaves.agg(F.sum(F.size("totals"))).first()[0] or 0
    grouped = fitting.repartition(max(1, -(-load // group)), *_KEY)
    nodes = grouped.sortWithinPartitions(*_KEY).mapInArrow(_nodes(least, budget), _NODES)
    if extended is not None:
        nodes = nodes.unionByName(extended.where(F.col("n") >= least))
    return place.put("nodes", nodes), languages


# ---------------------------------------------------------------- scores

_EXACT = "decimal(15,0)"  # up to 10**15 words; 10**6 * a * a then has at most 36 digits


def _cuts(phrase: Column, words: Column) -> Column:
    """(k, head, tail) of every way to cut a phrase in two."""
    each = F.split(phrase, " ")

    def cut(k: Column) -> Column:
        parts = F.slice(each, F.lit(1), k), F.slice(each, k + 1, words - k)
        head, tail = (F.array_join(part, " ") for part in parts)
        return F.struct(k.alias("k"), head.alias("head"), tail.alias("tail"))

    return F.transform(F.sequence(F.lit(1), words - 1), cut)


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    max_words: int = 3,
    least: int = 10,
    most: int = 2000,
    contained: int = 50,
    lang_column: str = "lang",
    text_column: str = "text",
    budget: int = BUDGET,
    group: int = GROUP,
) -> DataFrame:
    """The best ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut of least score
    ``floor(10**6 * a * a / (l * r))``, ``n`` all words of the language. Phrases inside a longer
    one with at least ``contained`` per cent of their occurrences are left out.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    place = area(spark)
    nodes, languages = phrase_counts(
        spark, docs, max_words, least, lang_column, text_column, budget, group
    )
    candidates = nodes.where("words > 1").withColumnRenamed("n", "a")
    # Only candidates that no longer one contains are scored.
    parts = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    inner = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * contained)
    )
    cuts = kept.select("lang", "phrase", "a", F.explode(_cuts(F.col("phrase"), F.col("words"))).alias("cut"))
    sides = [nodes.select("lang", F.col("phrase").alias(f"{s}_part"), F.col("n").alias(s)) for s in "lr"]
    placed = (
        cuts.select("lang", "phrase", "a", "cut.k", F.col("cut.head").alias("l_part"), F.col("cut.tail").alias("r_part"))
        .join(sides[0], ["lang", "l_part"])
        .join(sides[1], ["lang", "r_part"])
    )
    a, l_, r = (F.col(c).cast(_EXACT) for c in "alr")
    exact = placed.withColumns({"up": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "down": l_ * r})
    best = exact.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut")
    )
    scored = place.put("scored", best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    apart = Window.partitionBy("lang", "salt").orderBy(*order)
    ahead = salted.withColumn("rank", F.row_number().over(apart)).where(F.col("rank") <= most)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (
        ranked.where(F.col("rank") <= most)
        .join(languages, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(spark, table(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, 4) AS t(m))
),
f AS (SELECT lang, m, phrase, count(*) AS n FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m > 1 AND n >= 10),
covered AS (
  SELECT c.lang, c.phrase, max(x.a) AS longer
  FROM candidates c JOIN
       (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_ FROM candidates WHERE m = 3) x
       ON x.lang = c.lang AND x.inner_ = c.phrase
  GROUP BY c.lang, c.phrase
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k,
         array_to_string(c.w[1 : k], ' ') AS head, array_to_string(c.w[k + 1 : c.m], ' ') AS tail
  FROM candidates c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase, range(1, 3) AS t(k)
  WHERE k < c.m AND (v.longer IS NULL OR 100 * v.longer < 50 * c.a)
),
scores AS (
  SELECT u.*, x.n AS l, y.n AS r,
         (1000000::HUGEINT * u.a * u.a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scores)
  WHERE cut = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT r.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
