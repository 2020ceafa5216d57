"""Suffix-array dedup: repeated byte strings by longest-previous-factor arrays.

A byte is repeated when a string of ``length`` bytes that covers it starts at another place
too, in the same text or another. A suffix begins such a string exactly when its longest
previous factor (the longest match with a suffix that starts earlier) or its longest next
factor has ``length`` bytes. In suffix order these come from the neighbours: with equal
prefixes put in text order, the previous smaller position of a suffix is its predecessor as
long as they share ``length`` bytes, and the next smaller one lies beyond the run, so the
longest previous factor reaches ``length`` for all but the first of a run. ``keep="first"``
removes what has a previous factor, later copies; ``keep="none"`` removes the first as well.

The suffix array is built in buckets, none of which is the corpus:

1. Each string of ``length`` bytes is named by its anchor, the place of its least window hash.
   Equal strings have equal anchors at equal offsets. Anchors whose window occurs once in the
   corpus are dropped; what is left is a small part of all suffixes.
2. The remaining suffixes are taken in steps of up to ``STEP`` neighbouring starts. Those share
   a core, the bytes that all of their strings contain; its 128-bit hash is the bucket. A row is
   the core's hash and the few bytes before and after it, so suffixes are never written out.
3. Equal rows are added up before their shuffle: copies, however many, become one entry. The
   entries of a bucket are sorted into suffix order, and neighbours give the factors. A bucket
   of more than ``DEEP`` entries is first split by its suffixes' own bytes.

A text with copies is one text until the end, where all rows (or all but the first) are
removed whole if they have ``length`` bytes.

Defined cases: a NULL text counts as empty; a text shorter than ``length`` loses nothing; text
order is by smallest identifier (NULL last), then by digest and position; rows that repeat a
text are copies, so of rows that repeat identifier and text too one is the first; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, compact, table
from pricelens.llm.words import mix, text_blocks, word_hashes

LENGTH, STEP, DEEP = 400, 32, 20_000
#: Words of a passage that documents share; 51 words of prose have about 316 bytes.
PASSAGE = 51
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PLACE_BITS = 24
_POWERS_STEP = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- hashes of substrings


class Substrings:
    """Hashes of any substrings of a block: differences of position-weighted sums."""

    def __init__(self, data: np.ndarray, bases: int = 2) -> None:
        n, values = len(data), data.astype(np.uint64) + np.uint64(1)
        self._sums, self._down = [], []
        for base in _BASES[:bases]:
            if base not in _powers or len(_powers[base][0]) <= n:
                size = (n // _POWERS_STEP + 1) * _POWERS_STEP
                up = np.full(size, base, dtype=np.uint64)
                down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
                up[0] = down[0] = 1
                _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
            up, down = _powers[base]
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * up[:n], out=sums[1:])
            self._sums.append(sums)
            self._down.append(down)

    def windows(self, width: int) -> np.ndarray:
        """The first hash of every window."""
        sums = self._sums[0]
        found = (sums[width:] - sums[:-width]) * self._down[0][: len(sums) - width]
        return mix(found)

    def named(self, starts: np.ndarray, stops: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each substring, mixed with ``salt``."""
        return [
            mix(mix((sums[stops] - sums[starts]) * down[starts]) + salt.astype(np.uint64))
            for sums, down in zip(self._sums, self._down, strict=True)
        ]


def _anchor_width(length: int) -> int:
    return min(64, (length + 1) // 2)


def anchors(
    data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """Runs (text, anchor, first start, last start) of the strings of a block.

    The anchor of the string at ``s`` is the window of least hash inside it, the leftmost among
    equals. Neighbouring strings with the same anchor are a run. Places are in the block.
    """
    width = _anchor_width(length)
    reach = length - width + 1
    starts = [
        np.arange(a, b - length + 1)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        if b - a >= length
    ]
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 4
    best = np.empty(len(hashes) - reach + 1, dtype=np.int64)
    # The top bits of a hash and the place in one number: the least is the leftmost least.
    # Places wrap in pieces that overlap by a reach, so texts of any size pass.
    piece = (1 << _PLACE_BITS) - reach
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    for low in range(0, len(best), piece):
        part = hashes[low : low + piece + reach - 1]
        packed = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        padding = np.full(-len(part) % reach, 2**64 - 1, dtype=np.uint64)
        rows = np.concatenate([packed, padding]).reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - reach + 1
        least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
        best[low : low + n] = (least & mask).astype(np.int64) + low
    start = np.concatenate(starts)
    anchor = best[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(start)) - 1]
    text = np.searchsorted(offsets, start[at], side="right") - 1
    return text, anchor[at], start[at], last


def _repeated_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Substrings as a binary array, gathered in one go."""
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    places = np.concatenate([[0], ends]).astype(np.int32)
    buffers = [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[index].tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


# ---------------------------------------------------------------- 1. candidate anchors


def _anchor_rows(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            # Copies in a task are passed over: anchors of one text are counted once anyway.
            keys = batch.column("key").to_pylist()
            fresh = [key not in seen and not seen.add(key) for key in keys]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for first, _, data, offsets in text_blocks(batch.column("text")):
                if len(data) < length:
                    continue
                hashes = Substrings(data, 1).windows(_anchor_width(length))
                text, anchor, _, _ = anchors(data, offsets, hashes, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[anchor].view(np.int64)),
                        batch.column("key").take(pa.array(first + text)),
                        pa.array((anchor - offsets[text]).astype(np.int64)),
                    ],
                    names=["window", "key", "place"],
                )

    return find


# ---------------------------------------------------------------- 2. suffix rows

_ROW = (
    "b1 long, b2 long, c1 long, c2 long, before binary, after binary,"
    " low int, high int, key binary, at long"
)


def _suffix_rows(length: int, step: int):
    core = length - step + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for first, end, data, offsets in text_blocks(batch.column("text")):
                sub = Substrings(data)
                text, anchor, one, last = anchors(data, offsets, sub.windows(_anchor_width(length)), length)
                marked = [
                    offsets[i - first] + np.array(places[i].as_py(), dtype=np.int64)
                    for i in range(first, end)
                ]
                kept = np.isin(anchor, np.concatenate(marked))
                text, anchor, one, last = text[kept], anchor[kept], one[kept], last[kept]
                near, far = anchor - last, anchor - one  # from anchor back to string starts
                n = far // step - near // step + 1
                row = np.repeat(np.arange(len(n)), n)
                block = near[row] // step + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                low = np.maximum(near[row] - block * step, 0)
                high = np.minimum(far[row] - block * step, step - 1)
                at = anchor[row] - block * step  # where the core begins
                salt = mix(block.astype(np.uint64) + np.uint64(1))
                b1, b2 = sub.named(at, at + core, salt)
                shape = salt + (low * 1000 + high).astype(np.uint64)
                c1, c2 = sub.named(at - high, at - low + length, shape)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(x.view(np.int64)) for x in (b1, b2, c1, c2)],
                        _repeated_bytes(data, at - high, high),
                        _repeated_bytes(data, at + core, step - 1 - low),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                        batch.column("key").take(pa.array(first + text[row])),
                        pa.array((at - offsets[text[row]]).astype(np.int64)),
                    ],
                    names=[part.split()[0] for part in _ROW.split(", ")],
                )

    return find


# ---------------------------------------------------------------- 3. suffix order and factors


def suffix_factors(
    bucket: np.ndarray,
    shift: np.ndarray,
    bytes_: np.ndarray,
    order: np.ndarray,
    length: int,
    step: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factors, at most ``length``, of the suffixes of some buckets.

    A suffix is ``shift`` bytes, the core of its bucket, and the rest; ``bytes_`` holds those
    around the core. ``order`` is the place in the corpus.
    """
    padded = np.zeros((len(bytes_), -(-bytes_.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : bytes_.shape[1]] = bytes_
    numbers = padded.view(">u8")
    array = np.lexsort((order, *numbers.T[::-1], shift, bucket))
    same = (bucket[array][1:] == bucket[array][:-1]) & (shift[array][1:] == shift[array][:-1])
    differs = bytes_[array][1:] != bytes_[array][:-1]
    equal = np.where(differs.any(axis=1), differs.argmax(axis=1), bytes_.shape[1])
    core = length - step + 1
    common = np.where(equal < shift[array][1:], equal, equal + core) * same
    lcp = np.concatenate([[0], common, [0]])
    previous, following = np.zeros(len(array), dtype=np.int64), np.zeros(len(array), dtype=np.int64)
    # Equal strings are in text order, so the smaller position is before, the larger one after.
    previous[array] = np.where(lcp[:-1] >= length, length, 0)
    following[array] = np.where(lcp[1:] >= length, length, 0)
    return previous, following


def _around(before: pa.Array, after: pa.Array, step: int) -> np.ndarray:
    """The bytes before and after each core, side by side, aligned to the core."""
    rows = np.zeros((len(before), 2 * (step - 1)), dtype=np.uint8)
    for part, is_before in ((before, True), (after, False)):
        part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
        ends = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1]
        sizes = np.diff(ends)
        row = np.repeat(np.arange(len(part)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = inside + (step - 1 - sizes[row] if is_before else step - 1)
        if len(row):
            data = np.frombuffer(part.buffers()[2], dtype=np.uint8)
            rows[row, where] = data[ends[0] : ends[-1]]
    return rows


def repeated_ranges(entries: pa.Table, length: int, step: int) -> pa.RecordBatch:
    """Ranges (c1, c2, low, high, leads) of the entries of whole buckets that are repeated.

    ``leads`` says whether the entry's first occurrence is the first of the corpus.
    """
    low, high = entries.column("low").to_numpy(), entries.column("high").to_numpy()
    n = entries.column("n").to_numpy()
    size = high - low + 1
    row = np.repeat(np.arange(len(low)), size)
    shift = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    around = _around(entries.column("before"), entries.column("after"), step)
    # A view of every slice of ``step - 1`` bytes; only the chosen ones are copied.
    slices = np.lib.stride_tricks.sliding_window_view(around, step - 1, axis=1)
    bytes_ = slices[row, step - 1 - shift]
    b1, b2 = entries.column("b1").to_numpy(), entries.column("b2").to_numpy()
    new = np.ones(len(b1), dtype=bool)
    new[1:] = (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
    bucket = np.cumsum(new)
    firsts = entries.column("first").to_pylist()
    by_text = sorted(
        range(len(firsts)),
        key=lambda i: (firsts[i]["unknown"], firsts[i]["id"] or 0, firsts[i]["key"], firsts[i]["at"])
        if not firsts[i]["unknown"]
        else (True, 0, firsts[i]["key"], firsts[i]["at"]),
    )
    rank = np.empty(len(firsts), dtype=np.int64)
    rank[by_text] = np.arange(len(firsts))
    previous, following = suffix_factors(bucket[row], shift, bytes_, rank[row], length, step)
    leads = previous < length
    found = (np.maximum(previous, following) >= length) | (n[row] > 1)
    # Neighbouring starts of an entry with equal findings are one range.
    state = np.where(found, 1 + leads, 0)
    begin = np.ones(len(row), dtype=bool)
    begin[1:] = (row[1:] != row[:-1]) | (state[1:] != state[:-1])
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(row)) - 1
    kept = state[at] > 0
    at, stop = at[kept], stop[kept]
    return pa.RecordBatch.from_arrays(
        [
            entries.column("c1").combine_chunks().take(pa.array(row[at])),
            entries.column("c2").combine_chunks().take(pa.array(row[at])),
            pa.array(shift[at].astype(np.int32)),
            pa.array(shift[stop].astype(np.int32)),
            pa.array(leads[at]),
            entries.column("first").combine_chunks().field("key").take(pa.array(row[at])),
            entries.column("first").combine_chunks().field("at").take(pa.array(row[at])),
        ],
        names=["c1", "c2", "from", "to", "leads", "first_key", "first_at"],
    )


def _ranges(length: int, step: int):
    """Entries come sorted by bucket; each call handles the whole buckets that it has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            b1, b2 = batch.column("b1").to_numpy(), batch.column("b2").to_numpy()
            inner = np.flatnonzero((b1 != b1[-1]) | (b2 != b2[-1]))
            cut = int(inner[-1]) + 1 if len(inner) else 0
            if not cut:
                # One bucket so far; it may have ended the batch before.
                if held and (
                    held[-1].column("b1")[-1].as_py() != b1[0]
                    or held[-1].column("b2")[-1].as_py() != b2[0]
                ):
                    yield repeated_ranges(pa.Table.from_batches(held), length, step)
                    held = []
                held.append(batch)
                continue
            yield repeated_ranges(pa.Table.from_batches([*held, batch.slice(0, cut)]), length, step)
            held = [batch.slice(cut)]
        if held:
            yield repeated_ranges(pa.Table.from_batches(held), length, step)

    return find


def _deepened(entries: DataFrame, hot: DataFrame, step: int) -> DataFrame:
    """Splits each entry of the hot buckets into its single suffixes, named by their bytes."""
    deep = entries.join(hot, ["b1", "b2"], "left_semi")
    each = deep.withColumn("shift", F.explode(F.sequence("low", "high")))
    before = F.expr("substring(before, length(before) - shift + 1, shift)")
    after = F.expr(f"substring(after, 1, {step - 1} - shift)")
    return each.select(
        F.xxhash64("b1", "b2", "shift", before, after).alias("b1"),
        F.xxhash64("b2", after, before, "shift", "b1").alias("b2"),
        "c1", "c2", before.alias("before"), after.alias("after"),
        F.col("shift").alias("low"), F.col("shift").alias("high"), "n", "first",
    )


def _pooled(deep: DataFrame) -> DataFrame:
    """The suffixes of hot buckets that occur again, with their first occurrence."""
    pools = deep.groupBy("b1", "b2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return deep.select("b1", "b2", "c1", "c2", F.col("low").alias("from"), F.col("high").alias("to")).join(
        pools.where("n > 1").select(
            "b1", "b2", F.lit(True).alias("leads"),
            F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"),
        ),
        ["b1", "b2"],
    ).drop("b1", "b2")


# ---------------------------------------------------------------- spans


def _key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def repeated_spans(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, deep: int = DEEP
) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans (key, start, stop, is_first) of repeated bytes, by distinct text.

    ``texts`` (key, text) holds the texts that may have spans, each once. Copies of whole texts
    are not in the spans. Both are written tables.
    """
    place = area(spark)
    step = min(STEP, max(2, length // 4))
    told = docs.select(
        column("doc_id").alias("id"), F.coalesce(column("text"), F.lit("")).alias("text")
    ).withColumn("key", _key(F.col("text")))
    long_ = told.where(F.octet_length("text") >= length)
    found = place.put(
        "anchors",
        long_.select("key", "text").mapInArrow(
            _anchor_rows(length), "window long, key binary, place long"
        ),
    )
    occurrence = F.xxhash64("key", "place")
    twice = (
        found.groupBy("window")
        .agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"))
        .where("a <> b")
        .select("window")
    )
    twice = place.put("windows", twice)  # written: a window of very many texts can be split
    marks = (
        found.join(twice, "window", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("place").alias("places"))
    )
    unknown = F.min("id").isNull().alias("unknown")
    distinct = long_.groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("id"), unknown)
    texts = place.put("texts", distinct.join(marks, "key"))
    schema = _ROW
    suffixes = place.put(
        "suffixes",
        texts.select("key", "text", "places").mapInArrow(_suffix_rows(length, step), schema),
    )
    order = texts.select("key", "unknown", "id")
    first = F.min(F.struct("unknown", "id", "key", "at")).alias("first")
    entries = place.put(
        "entries",
        suffixes.join(order, "key")
        .groupBy("c1", "c2")
        .agg(
            *[F.first(c).alias(c) for c in ("b1", "b2", "before", "after", "low", "high")],
            F.count(F.lit(1)).alias("n"),
            first,
        ),
    )
    hot = place.put(
        "hot",
        compact(
            entries.groupBy("b1", "b2").count().where(F.col("count") > deep).select("b1", "b2"),
            entries.count(),
        ),
    )
    plain = entries if hot.isEmpty() else entries.join(hot, ["b1", "b2"], "left_anti")
    out = "c1 long, c2 long, from int, to int, leads boolean, first_key binary, first_at long"
    ranges = (
        plain.repartition("b1", "b2")
        .sortWithinPartitions("b1", "b2")
        .mapInArrow(_ranges(length, step), out)
    )
    if not hot.isEmpty():
        ranges = ranges.unionByName(_pooled(_deepened(entries, hot, step)))
    spans = (
        suffixes.select("c1", "c2", "key", "at")
        .join(ranges, ["c1", "c2"])
        .select(
            "key",
            (F.col("at") - F.col("to")).alias("start"),
            (F.col("at") - F.col("from") + length).alias("stop"),
            (
                F.col("leads")
                & (F.col("key") == F.col("first_key"))
                & (F.col("at") == F.col("first_at"))
            ).alias("is_first"),
        )
    )
    return place.put("spans", spans), texts.select("key", "text")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans cover; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = [batch.column(i) for i in range(3)]
        for key, text, spans in zip(*columns, strict=True):
            data = text.as_py().encode()
            flat = spans.values
            starts, stops = merged(flat.field("start").to_numpy(), flat.field("stop").to_numpy())
            edges = np.concatenate([[0], np.column_stack([starts, stops]).ravel(), [len(data)]])
            kept = b"".join(data[a:b] for a, b in edges.reshape(-1, 2))
            runs = [{"start": int(a), "stop": int(b)} for a, b in zip(starts, stops, strict=True)]
            rows.append((key.as_py(), runs, kept, hashlib.sha256(kept).hexdigest()))
        key, runs, kept, digest = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key, pa.binary()),
                pa.array(runs, run),
                pa.array(kept, pa.binary()),
                pa.array(digest, pa.string()),
            ],
            names=["key", "spans", "kept", "kept_sha256"],
        )


def without_repeats(
    spark: SparkSession,
    docs: DataFrame,
    length: int = LENGTH,
    keep: str = "first",
    with_bytes: bool = True,
    deep: int = DEEP,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans removed, kept_sha256 and, if asked, kept bytes.

    ``keep`` is ``first`` (later copies go) or ``none`` (every copy goes).
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    place = area(spark)
    spans, texts = repeated_spans(spark, docs, length, deep)
    gone = spans if keep == "none" else spans.where(~F.col("is_first"))
    listed = gone.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    schema = (
        "key binary, spans array<struct<start: bigint, stop: bigint>>, kept binary, kept_sha256 string"
    )
    cut = texts.join(listed, "key").select("key", "text", "spans").mapInArrow(_cut_texts, schema)
    cut = place.put("cut", cut if with_bytes else cut.drop("kept"))

    text = F.coalesce(column("text"), F.lit(""))
    digest = F.sha2(text, 256)
    rows = docs.select(
        column("doc_id"),
        F.unhex(F.substring(digest, 1, 32)).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        digest.alias("digest"),
        *([F.encode(text, "UTF-8").alias("whole")] if with_bytes else []),
    )
    if keep == "first":
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = place.put("rows", rows)
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key")
    if keep == "first":
        best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
        copies = copies.agg(F.count(F.lit(1)).alias("copies"), best.alias("best"))
        is_copy = (F.col("copies") > 1) & (F.col("row") != F.col("best.row"))
    else:
        copies = copies.agg(F.count(F.lit(1)).alias("copies"))
        is_copy = F.col("copies") > 1
    fates = copies.where("copies > 1").join(cut, "key", "full")
    whole_run = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    is_copy = F.coalesce(is_copy, F.lit(False))
    columns = [
        "doc_id",
        "n_bytes",
        F.when(is_copy, whole_run)
        .when(F.col("spans").isNotNull(), F.col("spans"))
        .otherwise(F.expr("array()").cast("array<struct<start: bigint, stop: bigint>>"))
        .alias("spans"),
        F.when(is_copy, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept_sha256", "digest"))
        .alias("kept_sha256"),
    ]
    if with_bytes:
        kept = F.when(is_copy, F.encode(F.lit(""), "UTF-8")).otherwise(F.coalesce("kept", "whole"))
        columns.append(kept.alias("kept"))
    return rows.join(place.put("fates", fates), "key", "left").select(*columns)


# ---------------------------------------------------------------- passages in words


def _passage_rows(words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch.column("text")):
                hashes, firsts = word_hashes(data, offsets)
                if len(hashes) < words:
                    continue
                windows = Substrings(hashes, 1).windows(_anchor_width(words))
                text, anchor, _, _ = anchors(hashes, firsts, windows, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows[anchor].view(np.int64)),
                        batch.column("doc_id").take(pa.array(first + text)),
                    ],
                    names=["window", "doc_id"],
                )

    return find


def shared_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """Identifiers of the documents that share a passage of ``words`` words with another one.

    Step 1 above with words in place of bytes: the passage is named by its anchor, the half of it
    with the least hash. Every shared passage is found; what is found are at least half as many
    words in a row that two documents have. Words are runs of letters and digits, so that passages
    may differ in blanks and punctuation. Rows that repeat an identifier are one document here, and
    rows without one are not told.
    """
    told = docs.select(column("doc_id").alias("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"))
    known = told.where(F.col("doc_id").isNotNull())
    kind = known.schema["doc_id"].dataType.simpleString()
    found = known.mapInArrow(_passage_rows(words), f"window long, doc_id {kind}")
    several = (
        found.groupBy("window")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .where("a <> b")
        .select("window")
    )
    return found.join(several, "window", "left_semi").select("doc_id").distinct()


def op2_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cut = without_repeats(spark, docs, keep="none", with_bytes=False)
    passages = area(spark).put("passages", shared_passages(docs)).withColumn("shares_passage", F.lit(True))
    sizes = F.transform("spans", lambda s: s["stop"] - s["start"])
    return cut.join(passages, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
        F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"),
    )
