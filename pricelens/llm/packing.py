"""Best-fit packing with a swap-based local search.

Documents are tokenised once, in a pass over whole texts. A document is its ids and a closing
id 0; a longer one than a sequence is cut into full pieces, of which the first may be shorter.
Only lengths matter to the packing, and there are at most ``size`` of them, so the plan is made
on the *histogram* of lengths: a bin is a pattern of lengths with a multiplicity. Best-fit
decreasing places all pieces of one length at a time; the local search then takes underfull
patterns and exchanges one piece for one, two for one, or moves a piece, whenever that raises
the sum of squared fills, until nothing does; bins that run empty are gone. The plan's size is
bounded by the number of lengths, not of documents: the histogram is all that reaches the
driver, and the plan all that tasks are sent.

Pieces find their place by rank: the n-th piece of a length takes the n-th slot of that length.
Ranks are counted in the chunks in which the pieces were written and shifted by the counts of
earlier chunks, so a length that a third of all pieces share is never sorted in one task.

Defined cases: a NULL or empty text is the closing id alone; every row is packed, repeated rows
and NULL ids too; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, table

SEQUENCE = 2048
END = 0
#: The local search begins with groups of equal bins of which there are at most this many in
#: all, and goes on with groups smaller by a factor; its result is final at groups of one.
FEW_BINS = 2048
FINER = 4
TOKENIZER = "byte_bpe_50k"

_encoders: dict[tuple[str, str, bool], Callable[[str], list[int]]] = {}


def encoder(ranks_path: str, json_path: str, added: bool = False) -> Callable[[str], list[int]]:
    """Text to ids, by a rank file; one encoder per worker process.

    The rank file and the JSON file hold one vocabulary and give equal ids; the former is
    several times faster. Its regular expression gives up on runs of about a million blanks:
    such a text goes to the tokenizer of the JSON file, which has no such limit. With ``added``,
    the tokens that the JSON file adds get their ids, as its tokenizer does by default; without,
    their names are text like any other.
    """
    if (ranks_path, json_path, added) not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if added:
            with open(json_path, encoding="utf-8") as told:
                special = {t["content"]: t["id"] for t in json.load(told)["added_tokens"]}
        fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all") if added else fast.encode_ordinary(text)
            except BaseException as error:
                # The regular expression gave up; no class of a panic can be imported.
                if type(error).__name__ != "PanicException" and "regex" not in str(error):
                    raise
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(json_path)
            plain.encode_special_tokens = not added
            return plain.encode(text, add_special_tokens=False).ids

        _encoders[ranks_path, json_path, added] = encode
    return _encoders[ranks_path, json_path, added]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = n % size or size
    starts = [0, *range(first, n, size)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def token_pieces(
    docs: DataFrame,
    size: int = SEQUENCE,
    tokenizer: str | None = None,
    with_ids: bool = False,
    added: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of every document.

    ``tokenizer`` is the path of the vocabulary without the ending of its two files; ``added``
    says whether its added tokens, such as ``<|endoftext|>``, are ids of their own in a text.
    """
    stem = tokenizer or public_tokenizers.path(TOKENIZER)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(f"{stem}.tiktoken", f"{stem}.json", added)
        for batch in batches:
            rows: list[tuple] = []
            held: list[bytes] = []
            for i, text in enumerate(batch.column("text")):
                ids = np.array(encode(text.as_py()) + [END], dtype="<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        held.append(part)
            if rows:
                i, k, start, length, crc = map(list, zip(*rows, strict=True))
                arrays = [
                    batch.column("doc_id").take(pa.array(i)),
                    pa.array(k, pa.int32()),
                    *[pa.array(v, pa.int64()) for v in (start, length, crc)],
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    told = docs.select(column("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"))
    return told.mapInArrow(pieces, schema + ", ids binary" * with_ids)


Pattern = tuple[int, ...]


def best_fit_decreasing(histogram: dict[int, int], size: int) -> Counter[Pattern]:
    """Patterns (lengths in descending order) with multiplicities, all pieces placed."""
    open_: dict[int, Counter[Pattern]] = defaultdict(Counter)  # by room left
    rooms: list[int] = []
    done: Counter[Pattern] = Counter()

    def put(pattern: Pattern, room: int, times: int) -> None:
        if not room:
            done[pattern] += times
            return
        if not open_[room]:
            insort(rooms, room)
        open_[room][pattern] += times

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = size // length  # new bins, filled with this length alone
                full, over = divmod(left, fit)
                if full:
                    put((length,) * fit, size - fit * length, full)
                if over:
                    put((length,) * over, size - over * length, 1)
                break
            room = rooms[at]
            pattern, have = next(iter(open_[room].items()))
            times = min(have, left)
            if times == have:
                del open_[room][pattern]
                if not open_[room]:
                    del rooms[at]
            else:
                open_[room][pattern] -= times
            put((*pattern, length), room - length, times)
            left -= times
    for patterns in open_.values():
        done.update(patterns)
    return done


def _exchange(low: Pattern, high: Pattern, size: int) -> tuple[Pattern, Pattern] | None:
    """The best move from ``low`` to ``high``, the fuller bin, that raises the squared fill.

    Moving ``d`` more tokens into the fuller of two bins raises the sum of squares by
    ``2 d (high - low + d)``, so the largest ``d`` that fits is best.
    """
    room = size - sum(high)
    best, found = 0, None
    highs = sorted(set(high))
    for a in sorted({*low}, reverse=True):
        if best < a <= room:  # move a piece
            best, found = a, ((a,), ())
        at = bisect_left(highs, a - room)  # one for one: the smallest b that makes a fit
        if at < len(highs) and a - highs[at] > best:
            best, found = a - highs[at], ((a,), (highs[at],))
    ones = sorted(low)
    for i, a in enumerate(ones):  # two pieces of low for one of high
        for c in ones[i + 1 :]:
            at = bisect_left(highs, a + c - room)
            if at < len(highs) and a + c - highs[at] > best:
                best, found = a + c - highs[at], ((a, c), (highs[at],))
            if best < a + c <= room:
                best, found = a + c, ((a, c), ())
    mates = sorted(high)
    lows = sorted(set(low))
    for i, b in enumerate(mates):  # two pieces of high for one of low
        for c in mates[i + 1 :]:
            at = bisect_left(lows, b + c + room + 1) - 1
            if at >= 0 and lows[at] - b - c > best:
                best, found = lows[at] - b - c, ((lows[at],), (b, c))
    if not found:
        return None
    out, back = Counter(found[0]), Counter(found[1])

    def swapped(pattern: Pattern, give: Counter, take: Counter) -> Pattern:
        return tuple(sorted((Counter(pattern) - give + take).elements(), reverse=True))

    return swapped(low, out, back), swapped(high, back, out)


class _Underfull:
    """The underfull patterns, and for each the largest piece and pair of pieces below any length.

    ``ones[x, i]`` is the largest piece of pattern ``i`` that is shorter than ``x``, ``twos`` the
    same for two of its pieces together; by these all partners of a pattern are found at once.
    """

    _NONE = -(1 << 14)

    def __init__(self, size: int) -> None:
        self.size = size
        self.times: Counter[Pattern] = Counter()
        self.at: dict[Pattern, int] = {}
        self.patterns: list[Pattern | None] = []
        self.free: list[int] = []
        self.fill = np.full(64, -1, np.int32)
        self.ones, self.twos = (np.full((size + 2, 64), self._NONE, np.int16) for _ in range(2))

    def add(self, pattern: Pattern, times: int) -> None:
        self.times[pattern] += times
        if pattern in self.at:
            return
        if not self.free:
            n = len(self.patterns)
            if n == len(self.fill):
                self.fill = np.concatenate([self.fill, np.full(n, -1, np.int32)])
                blank = np.full((self.size + 2, n), self._NONE, np.int16)
                self.ones = np.concatenate([self.ones, blank], axis=1)
                self.twos = np.concatenate([self.twos, blank], axis=1)
            self.patterns.append(None)
            self.free.append(n)
        i = self.free.pop()
        self.at[pattern], self.patterns[i], self.fill[i] = i, pattern, sum(pattern)
        for table, lengths in zip((self.ones, self.twos), _gives(pattern), strict=True):
            below = np.full(self.size + 2, self._NONE, np.int16)
            below[lengths + 1] = lengths
            table[:, i] = np.maximum.accumulate(below)

    def drop(self, pattern: Pattern, times: int) -> None:
        self.times[pattern] -= times
        if not self.times[pattern]:
            del self.times[pattern]
            i = self.at.pop(pattern)
            self.patterns[i] = None
            self.fill[i] = -1
            self.free.append(i)

    def partner(self, pattern: Pattern) -> Pattern | None:
        """The fullest pattern with which ``pattern`` has something to exchange."""
        n = len(self.patterns)
        fill = self.fill[:n]
        own, (one, two) = sum(pattern), _gives(pattern)
        room = self.size - fill
        # Pieces out of ``pattern`` into a fuller bin, for less that comes back.
        ones, twos = self.ones[:, :n], self.twos[:, :n]
        least = np.minimum(one[:, None] - ones[one], one[:, None] - twos[one]).min(axis=0)
        if len(two):
            least = np.minimum(least, (two[:, None] - ones[two]).min(axis=0))
        gives = (fill >= own) & ((least <= room) | (one[0] <= room))
        # Pieces out of an emptier bin into ``pattern``.
        left = self.size - own
        one, two = np.append(one, 0), two
        to = one + left + 1
        takes = ((ones[to] > one[:, None]) | (twos[to] > one[:, None])).any(axis=0)
        if len(two):
            takes |= (ones[two + left + 1] > two[:, None]).any(axis=0)
        found = gives | ((fill >= 0) & (fill < own) & takes)
        if self.times[pattern] < 2:
            found[self.at[pattern]] = False
        best = int(np.argmax(np.where(found, fill, -1)))
        return self.patterns[best] if found[best] else None


@lru_cache(1 << 14)
def _gives(pattern: Pattern) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of single pieces and of two pieces together, ascending."""
    found = Counter(pattern)
    twos = {a + b for a, b in combinations(found, 2)} | {2 * a for a, n in found.items() if n > 1}
    return tuple(np.array(sorted(lengths), dtype=np.int64) for lengths in (found, twos))


def local_search(bins: Counter[Pattern], size: int) -> Counter[Pattern]:
    """Exchanges pieces between underfull bins until none raises the squared fill.

    Equal bins are exchanged in large groups first and in ever smaller ones after, at last one by
    one, so that the number of exchanges grows with the logarithm of the number of bins.
    """
    group = 1
    while bins.total() > FEW_BINS * group:
        group *= FINER
    while True:
        groups = Counter({p: times // group for p, times in bins.items() if times >= group})
        rest = Counter({p: times % group for p, times in bins.items()})
        bins = +rest
        for pattern, times in _searched(groups, size).items():
            bins[pattern] += times * group
        if group == 1:
            return bins
        group //= FINER


def _searched(bins: Counter[Pattern], size: int) -> Counter[Pattern]:
    """The bins after all exchanges that raise the squared fill.

    The emptiest bin goes first and meets the fullest with which it has something to exchange. A
    bin that has none is settled: it meets only bins that arise later, when these are tried.
    Every exchange raises the squared fill, so the search ends: when all bins are settled, or
    when they are as few as their tokens allow.
    """
    n_bins = bins.total()
    fewest = -(-sum(sum(p) * times for p, times in bins.items()) // size)
    full: Counter[Pattern] = Counter()
    under = _Underfull(size)
    unsettled: list[tuple[int, Pattern]] = []

    def put(pattern: Pattern, times: int) -> None:
        if sum(pattern) == size:
            full[pattern] += times
            return
        if under.times[pattern] < 2:  # new, or now able to exchange with its like
            heappush(unsettled, (sum(pattern), pattern))
        under.add(pattern, times)

    for pattern in sorted(bins):
        put(pattern, bins[pattern])
    while unsettled and n_bins > fewest:
        fill, pattern = heappop(unsettled)
        other = under.partner(pattern) if under.times[pattern] else None
        if not other:
            continue
        low, high = (other, pattern) if sum(other) < fill else (pattern, other)
        made = _exchange(low, high, size)
        times = under.times[low] // 2 if high == low else min(under.times[low], under.times[high])
        for old in (low, high):
            under.drop(old, times)
        if under.times[pattern]:
            heappush(unsettled, (fill, pattern))
        for new in made:
            if new:
                put(new, times)
            else:
                n_bins -= times
    return full + under.times


def plan_slots(bins: Counter[Pattern]) -> np.ndarray:
    """Rows (length, first rank, bins, first sequence, offset), ordered by length and rank."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern in sorted(bins, reverse=True):
        times, offset = bins[pattern], 0
        for length in pattern:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` (written, with their ``chunk``) and the rank of each among its length."""
    inside = Window.partitionBy("chunk", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("chunk")
    shift = (
        pieces.groupBy("length", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "chunk", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    )
    return (
        pieces.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shift, ["chunk", "length"])
        .withColumn("rank", F.col("earlier") + F.col("inside"))
        .drop("earlier", "inside")
    )


def pack(
    spark: SparkSession,
    docs: DataFrame,
    size: int = SEQUENCE,
    tokenizer: str | None = None,
    with_ids: bool = False,
    added: bool = False,
) -> DataFrame:
    """Every piece with the sequence it is in and its offset there; with its ids if asked for."""
    made = token_pieces(docs, size, tokenizer, with_ids, added)
    chunked = made.withColumn("chunk", F.spark_partition_id())
    pieces = area(spark).put("pieces", chunked)
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    bins = best_fit_decreasing({r["length"]: r["count"] for r in counted}, size)
    slots = plan_slots(local_search(bins, size))
    names = [c for c in pieces.columns if c != "chunk"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Length and rank as one ascending number; a slot covers the ranks from its first on.
        shift = np.int64(1) << 50
        firsts = slots[:, 0] * shift + slots[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = batch.column("length").to_numpy() * shift + rank
            slot = slots[np.searchsorted(firsts, key, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in names],
                    pa.array(slot[:, 3] + rank - slot[:, 1], pa.int64()),
                    pa.array(slot[:, 4], pa.int64()),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    out = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked(pieces).drop("chunk").mapInArrow(placed, out)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark, table(spark, folder, "documents"), added=True)
