"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles, each weighted by its count times the inverse
document frequency. Frequencies are counted over all documents in ``2 ** SLOT_BITS`` hashed
slots, a table of fixed size. Improved consistent weighted sampling draws, for each of the
hash functions, one shingle with its quantised weight, such that two texts draw the same with
a probability equal to their weighted Jaccard similarity. Draws are banded; texts that share
a band are candidates; a link needs a weighted Jaccard similarity of ``THRESHOLD`` or more,
computed from the whole texts.

Equal texts (but for case) are one text throughout, and copies are added up per task before a
shuffle. A bucket does not emit its pairs. First every member is verified against one leader,
the member that meets the most others. Components of these links then settle most buckets: one
that lies in a single component has nothing left to find. Members outside the leader's
component get a second leader in the same way. In what is still open, all pairs of different
components are verified inside tasks, bucket block by bucket block, and only the links found
leave a task. No bucket is capped.

Defined cases: a NULL text counts as empty; texts without a word link to nothing, copies
included; a text of fewer than five words is one shingle; NULL identifiers are the largest in
a class; of rows that repeat the smallest identifier and the text one is kept; an empty table
gives an empty result; further columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.blocks import gathered, meetings_of, paired_blocks
from pricelens.llm.components import components
from pricelens.llm.tables import area, column, compact, rows_that_stay, table
from pricelens.llm.words import mix, shingles, text_blocks
from pricelens.sources.area import StagingArea

WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8, 1 - (1 - 0.8 ** ROWS) ** BANDS = 99.7 % of the pairs share a band.
BANDS, ROWS = 8, 3
#: Slots of the document frequency table (8 bytes each).
SLOT_BITS = 18
#: Members of an open bucket that meet in one task at a time; larger buckets are split in blocks.
BLOCK = 256
_COLUMNS = 4096
#: Inverse document frequencies count with this power. Shingles of a large group of copies are
#: frequent by themselves; undamped, the words in which its copies differ would outweigh them.
IDF_POWER = 0.25
_SEED = 0x5DEECE66D


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 of the lower-case text."""
    return F.unhex(F.substring(F.sha2(F.lower(F.coalesce(text, F.lit(""))), 256), 1, 32))


# ---------------------------------------------------------------- weights


def _distinct(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their counts, and where each text's begin."""
    n = np.diff(begins)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], counts, np.searchsorted(of[at], np.arange(len(n) + 1))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per slot and documents with words, over all rows of ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                hashes, begins = shingles(data, offsets, WORDS)
                n = np.diff(begins)
                of = np.repeat(np.arange(len(n)), n)
                pairs = np.unique((of << SLOT_BITS) | _slots(hashes))
                seen += np.bincount(pairs & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
                docs += int((n > 0).sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], docs), pa.int64())],
            names=["slot", "n"],
        )

    counted = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most 2 ** SLOT_BITS + 1 rows
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    found = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    found[slot[slot >= 0]] = n[slot >= 0]
    return found, int(n[slot < 0].sum())


def inverse_frequencies(frequencies: np.ndarray, docs: int) -> np.ndarray:
    idf = np.log1p(max(docs, 1) / np.maximum(frequencies, 1))
    return (idf**IDF_POWER).astype(np.float32)


def weighted_shingles(
    data: np.ndarray, offsets: np.ndarray, idf: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block, their TF-IDF weights, and where texts begin."""
    hashes, counts, begins = _distinct(*shingles(data, offsets, WORDS))
    return hashes, counts.astype(np.float32) * idf[_slots(hashes)], begins


# ---------------------------------------------------------------- sampling


def _exponentials() -> np.ndarray:
    """Quantiles of the exponential distribution for 16 random bits."""
    return (-np.log1p(-(np.arange(65536) + 0.5) / 65536)).astype(np.float32)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples of each text that has shingles: 64-bit names of (shingle, quantised weight).

    For each shingle ``r`` and ``c`` are Gamma(2, 1), a sum of two exponentials, and ``beta`` is
    uniform, all from hashes of the shingle; the weight is quantised to ``exp(r (t - beta))``
    and the shingle with the least ``c / exp(r (t - beta + 1))`` is the sample.
    """
    table_ = _exponentials()
    texts = np.flatnonzero(np.diff(begins))
    starts, sizes = begins[texts], np.diff(begins)[texts]
    log_weight = np.log(weights)
    out = np.zeros((len(texts), n), dtype=np.uint64)
    for k in range(n):
        random = mix(hashes + np.uint64((_SEED * (2 * k + 1)) & (2**64 - 1)))
        four = table_[random.view(np.uint16).reshape(-1, 4)]
        r = four[:, 0] + four[:, 1]
        beta = (mix(random) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        cost = np.log(four[:, 2] + four[:, 3]) - r * (t - beta + np.float32(1.0))
        least = np.minimum.reduceat(cost, starts)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, starts)]
        out[:, k] = mix(hashes[first] ^ mix(t[first].astype(np.int64).view(np.uint64)))
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One 64-bit name per band; names of different bands differ."""
    bands = np.zeros((len(samples), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        name = np.full(len(samples), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            name = mix(name + samples[:, band * ROWS + row])
        bands[:, band] = name
    return bands.view(np.int64)


def _signatures(idf: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands: list = [None] * batch.num_rows
            for first, _, data, offsets in text_blocks(batch.column("text")):
                hashes, weights, begins = weighted_shingles(data, offsets, idf)
                if not len(hashes):
                    continue
                found = band_hashes(weighted_samples(hashes, weights, begins, BANDS * ROWS))
                for i, row in zip(np.flatnonzero(np.diff(begins)), found, strict=True):
                    bands[first + i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "key", "bands"],
            )

    return sign


# ---------------------------------------------------------------- verification


Weighted = tuple[np.ndarray, np.ndarray]


def _weighted_texts(texts: pa.Array, idf: np.ndarray) -> list[Weighted]:
    """Sorted distinct shingles and weights of each text."""
    found = []
    for _, _, data, offsets in text_blocks(texts):
        hashes, weights, begins = weighted_shingles(data, offsets, idf)
        weights = weights.astype(np.float64)
        cuts = zip(begins[:-1], begins[1:], strict=True)
        found += [(hashes[a:b], weights[a:b]) for a, b in cuts]
    return found


def weighted_jaccard(a: Weighted, b: Weighted) -> float:
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _verified_pairs(idf: np.ndarray):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = _weighted_texts(batch.column("text"), idf)
            # Rows of one leader come together, so each is read a few times at most.
            names = batch.column("leader").to_pylist()
            at = {name: i for i, name in enumerate(names)}
            leaders = _weighted_texts(batch.column("leader_text").take(pa.array(at.values())), idf)
            of = dict(zip(at, leaders, strict=True))
            near = [
                weighted_jaccard(member, of[name]) >= THRESHOLD
                for member, name in zip(members, names, strict=True)
            ]
            pairs = zip(batch.column("key").to_pylist(), names, near, strict=True)
            yield _links([(member, leader) for member, leader, is_near in pairs if is_near])

    return verify


def _links(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in links], pa.binary()) for i in range(2)], names=["a", "b"]
    )


def star_links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) among ``pairs`` (key, leader). A leader's rows are split over tasks by size."""
    with_member = pairs.join(texts, "key")
    leaders = texts.select(F.col("key").alias("leader"), F.col("text").alias("leader_text"))
    return (
        with_member.join(leaders, "leader")
        .select("leader", "leader_text", "key", "text")
        .mapInArrow(_verified_pairs(idf), "a binary, b binary")
    )


def _shared_weight(texts: list[Weighted], idf: np.ndarray) -> np.ndarray:
    """For each pair of texts the weight of what they share, as products of matrices.

    A shingle that occurs ``n`` times is ``n`` features, its first to its n-th occurrence, of
    the same weight each; then the lesser of two counts is the number of features in common.
    """
    names, rows = [], []
    for row, (hashes, weights) in enumerate(texts):
        counts = np.rint(weights / idf[_slots(hashes)]).astype(np.int64)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        level = (np.arange(len(first)) - first).astype(np.uint64)
        repeated = np.repeat(hashes, counts)
        names.append(np.column_stack([repeated, level]))
        rows.append(np.full(len(level), row))
    table_, row = np.concatenate(names), np.concatenate(rows)
    order = np.lexsort((row, table_[:, 1], table_[:, 0]))
    table_, row = table_[order], row[order]
    new = np.ones(len(table_), dtype=bool)
    new[1:] = (table_[1:] != table_[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    feature = np.cumsum(new) - 1
    often = np.diff(np.append(at, len(table_))) > 1  # others are in one text only
    kept = often[feature]
    feature, row = (np.cumsum(often) - 1)[feature[kept]], row[kept]
    root = np.sqrt(idf[_slots(table_[at[often], 0])])
    shared = np.zeros((len(texts), len(texts)), dtype=np.float32)
    for low in range(0, len(root), _COLUMNS):
        part = slice(*np.searchsorted(feature, [low, low + _COLUMNS]))
        dense = np.zeros((len(texts), _COLUMNS), dtype=np.float32)
        dense[row[part], feature[part] - low] = root[feature[part]]
        shared += dense @ dense.T
    return shared


def meeting_links(rows: pa.Table, idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links between different components in the rows of a meeting, as many as join them."""
    texts = _weighted_texts(rows.column("text").combine_chunks(), idf)
    total = np.array([w.sum() for _, w in texts])
    shared = _shared_weight(texts, idf)
    ratio = shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-9)
    component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    side, keys = rows.column("side").to_numpy(), rows.column("key")
    # The products are single precision: what is near the threshold is computed again.
    wanted = (ratio >= THRESHOLD - 1e-3) & (component[:, None] != component[None, :])
    if rows.column("sides")[0].as_py() == 2:
        wanted &= side[:, None] != side[None, :]
    links, parent = [], list(range(component.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(wanted)), strict=True):
        a, b = root(component[i]), root(component[j])
        if a != b and weighted_jaccard(texts[i], texts[j]) >= THRESHOLD:
            links.append((keys[i].as_py(), keys[j].as_py()))
            parent[a] = b
    return links


def _block_links(idf: np.ndarray):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []
        for ended, rows in meetings_of(batches):
            if rows is not None:
                links += meeting_links(rows, idf)
            if ended:
                yield _links(links)
                links = []

    return compare


def open_links(members: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links between components inside ``members`` (bucket, key, component, outside)."""
    meetings = paired_blocks(members, ["key", "component"], BLOCK).join(texts, "key")
    return gathered(meetings).mapInArrow(_block_links(idf), "a binary, b binary")


# ---------------------------------------------------------------- classes


def _led(place: StagingArea, members: DataFrame, rows: int) -> DataFrame:
    """Pairs (key, leader) of buckets with more than one member; ``members`` has ``degree``.

    The leaders are written, here and below: a join to an aggregate of its own rows shares
    their shuffle, and then a large bucket could not be split over tasks.
    """
    best = members.groupBy("bucket").agg(
        F.max(F.struct("degree", "key")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    led = members.join(place.put("leaders", compact(best.where("n > 1"), rows)), "bucket")
    return led.select("key", F.col("best.key").alias("leader")).where("key <> leader").distinct()


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, id, key, class_key) of every row; rows of one class share ``class_key``."""
    place = area(spark)
    told = docs.select(
        column("doc_id").alias("id"),
        text_key(column("text")).alias("key"),
        F.lower(F.coalesce(column("text"), F.lit(""))).alias("text"),
    )
    frequencies, n_docs = document_frequencies(told.select("text"))
    idf = inverse_frequencies(frequencies, n_docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = told.mapInArrow(_signatures(idf), f"id {id_type}, key binary, bands array<bigint>")
    signed = place.put("signatures", signed.withColumn("row", F.monotonically_increasing_id()))

    distinct = signed.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    members = place.put("members", distinct.select("key", F.explode("bands").alias("bucket")))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = place.put("sizes", compact(sizes.where("n > 1"), members.count()))
    shared = members.join(sizes, "bucket")
    degrees = shared.groupBy("key").agg(F.sum("n").alias("degree"))
    shared = place.put("shared", shared.drop("n").join(degrees, "key"))
    rows = shared.count()

    candidates = shared.select("key").distinct()
    texts = told.groupBy("key").agg(F.first("text").alias("text")).join(candidates, "key", "left_semi")
    texts = place.put("texts", texts)

    links = place.put("star_links", star_links(_led(place, shared, rows), texts, idf))
    for round_ in range(2):
        found = components(spark, links)
        members = shared.join(found, F.col("key") == F.col("node"), "left").select(
            "bucket", "key", "degree", F.coalesce("component", "key").alias("component")
        )
        led = members.groupBy("bucket").agg(
            F.max(F.struct("degree", "key", "component")).alias("best"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        led = place.put("led", compact(led.where("least <> most"), rows))
        still = place.put(
            f"open_{round_}",
            compact(
                members.join(led, "bucket").select(
                    "bucket", "key", "degree", "component",
                    (F.col("component") != F.col("best.component")).alias("outside"),
                ),
                rows,
            ),
        )
        more = (
            star_links(_led(place, still.where("outside"), rows), texts, idf)
            if round_ == 0
            else open_links(still, texts, idf)
        )
        links = place.put(f"links_{round_}", links.unionByName(more))
    found = components(spark, links)
    classes = signed.join(found, F.col("key") == F.col("node"), "left")
    wordless = F.concat(F.col("key"), F.encode(F.col("row").cast("string"), "UTF-8"))
    return place.put(
        "classes",
        classes.select(
            "row",
            "id",
            "key",
            F.when(F.col("bands").isNull(), wordless)
            .otherwise(F.coalesce("component", "key"))
            .alias("class_key"),
        ),
    )


def _first_of_class(classes: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row", "key"))
    return classes.groupBy("class_key").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (its smallest doc_id), class_size, kept."""
    classes = near_classes(spark, docs)
    best = area(spark).put("best", compact(_first_of_class(classes), classes.count()))
    return classes.join(best, "class_key").select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("class_id"),
        F.col("size").alias("class_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per class, with their columns unchanged."""
    classes = near_classes(spark, docs)
    best = _first_of_class(classes)
    winners = best.select("best.key", "best.id").distinct()
    # Texts without a word are classes of their own, so all of their rows stay.
    names = classes.where(F.length("class_key") <= 16).groupBy("key", "id").count()
    repeated = area(spark).put("repeated", names.where("count > 1").select("key", "id"))
    keys = {"key": text_key(column("text"))}
    return rows_that_stay(docs, column("doc_id"), keys, winners, repeated)


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark, table(spark, folder, "documents"))
