"""Problem 7: items of varying length in containers of fixed capacity.

Items are known by their length alone, so the search runs on the histogram of lengths, which never
has more entries than the capacity, whatever the number of items. A first-fit-decreasing pass writes
the bins as patterns with a multiplicity; a swap-based local search then moves one item, exchanges
one for one or two for one between underfull bins wherever that raises the sum of squared fills,
until bins empty or no exchange helps. All underfull bins are searched, in blocks that the executors
treat in parallel, then the bins left over by the blocks together. Items are dealt to the bins' places by their rank within a
length, found by salted counts, so no length may grow too large for a task.

An item over the capacity is cut into full pieces and a rest; no other item is cut. NULL and empty
lists of ids have no piece. Equal lengths are dealt in order of hash and id. An empty table gives
no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import materialize

CAPACITY = 2048
RANK_BUCKETS = 64
#: Pieces that one rank bucket may hold before there are more buckets.
BUCKET_ROWS = 100_000
#: Underfull bins of one block of the local search; all blocks are searched, each by one task.
SEARCH_BINS = 300

Pattern = tuple[tuple[int, int], ...]


def first_fit_decreasing(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Bins as patterns ``((length, count), ...)`` with multiplicities, longest items first."""
    left = {n: c for n, c in hist.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        room, pattern = capacity, []
        hi = len(lengths)
        while hi:
            i = bisect_right(lengths, room, 0, hi) - 1
            if i < 0:
                break
            n = lengths[i]
            k = min(left[n], room // n)
            pattern.append((n, k))
            room -= n * k
            hi = i
        times = min(left[n] // k for n, k in pattern)
        out.append((tuple(pattern), times))
        for n, k in pattern:
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)
    return out


def local_search(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and swaps; returns the bins that are not empty.

    Bins are treated from the least filled; its items are moved to, or exchanged one for one or two
    for one with, the bin where the gap closes best, so that the least filled bin drains.
    """
    bins = [sorted(b, reverse=True) for b in bins if b]
    fill = [sum(b) for b in bins]
    while True:
        changed = False
        order = sorted(range(len(bins)), key=fill.__getitem__)
        gaps = [i for i in order if bins[i] and fill[i] < capacity]
        for a in order:
            if not bins[a] or fill[a] == capacity:
                continue
            for b in reversed(gaps):
                room = capacity - fill[b]
                if b == a or not bins[a] or not bins[b] or room <= 0 or fill[b] < fill[a]:
                    continue
                best = (0, None, None)
                for x in set(bins[a]):
                    if x <= room and x > best[0]:
                        best = (x, (x,), ())
                if best[0] < room:
                    own, other = sorted(set(bins[a])), sorted(set(bins[b]))
                    pairs = [(x, (x,)) for x in own]
                    pairs += [(x + y, (x, y)) for i, x in enumerate(own) for y in own[i:] if x != y or bins[a].count(x) > 1]
                    for y in other:
                        for total, xs in pairs:
                            gain = total - y
                            if best[0] < gain <= room:
                                best = (gain, xs, (y,))
                if best[1]:
                    gain, xs, ys = best
                    for x in xs:
                        bins[a].remove(x)
                        bins[b].append(x)
                    for y in ys:
                        bins[b].remove(y)
                        bins[a].append(y)
                    fill[a] -= gain
                    fill[b] += gain
                    changed = True
        keep = [i for i in range(len(bins)) if bins[i]]
        bins, fill = [bins[i] for i in keep], [fill[i] for i in keep]
        if not changed or len(bins) == -(-sum(fill) // capacity):
            break
    return bins


def _search(bins: list[list[int]], capacity: int) -> Counter[Pattern]:
    return Counter(tuple(sorted(Counter(b).items(), reverse=True)) for b in local_search(bins, capacity))


def _deal(loose: list[tuple[Pattern, int]]) -> list[list[list[int]]]:
    """Bins in blocks, dealt in turn from the least filled, so that every block has bins of all fills and patterns."""
    loose = sorted(loose, key=lambda p: sum(n * k for n, k in p[0]))
    blocks = max(1, -(-sum(times for _, times in loose) // SEARCH_BINS))
    out, at = [[] for _ in range(blocks)], 0
    for pattern, times in loose:
        one = [n for n, k in pattern for _ in range(k)]
        for i in range(times):
            out[(at + i) % blocks].append(list(one))
        at += times
    return out


def _parallel_search(spark, blocks: list[list[list[int]]], capacity: int) -> Counter[Pattern]:
    """The blocks searched by the executors; bins travel as lists of lengths, a few kilobytes a block."""

    def run(batches):
        for pdf in batches:
            rows = [(json.dumps(list(_search(json.loads(b), capacity).items())),) for b in pdf["block"]]
            yield pd.DataFrame(rows, columns=["found"])

    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(blocks)], "i int, block string").repartition(len(blocks), "i")
    found: Counter[Pattern] = Counter()
    for r in df.mapInPandas(run, "found string").collect():
        for pattern, times in json.loads(r["found"]):
            found[tuple((n, k) for n, k in pattern)] += times
    return found


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY, spark=None) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold exactly ``hist``; with a session, blocks are searched by its executors.

    Bins that are still underfull after their block are few, as a block ends with its gaps gathered in
    the bins that it drained; they are dealt anew and searched until that saves no bin.
    """
    full, loose = [], []

    def sort(patterns) -> int:
        nonlocal loose
        loose = []
        for pattern, times in patterns:
            (full if sum(n * k for n, k in pattern) == capacity else loose).append((pattern, times))
        return sum(times for _, times in loose)

    left = sort(first_fit_decreasing(hist, capacity))
    while left:
        blocks = _deal(loose)
        if spark is not None and len(blocks) > 1:
            found = _parallel_search(spark, blocks, capacity)
        else:
            found = sum((_search(b, capacity) for b in blocks), Counter())
        saved = left - sum(found.values())
        now = sort(sorted(found.items(), reverse=True))
        if len(blocks) == 1 or not saved or now >= left:
            break
        left = now
    return full + loose


def pieces(items: DataFrame, item_id: str, ids: str, capacity: int = CAPACITY) -> DataFrame:
    """``item_id, piece_no, start, length``: items cut only where they exceed the capacity."""
    n = items.select(F.col(item_id).alias("item_id"), F.size(ids).alias("n")).where("n > 0")
    cut = n.select("item_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return cut.select("item_id", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("length"))


def pack(items: DataFrame, item_id: str = "ord", ids: str = "token_ids", capacity: int = CAPACITY) -> DataFrame:
    """``item_id, piece_no, start, length, chunk_id, place``; ``place`` is the offset in the chunk."""
    p = pieces(items, item_id, ids, capacity)
    p = p.withColumn("h", F.xxhash64("item_id", "piece_no"))
    p = materialize(p, "pieces")
    hist = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # No bucket of a length grows with the input: full pieces all have one length.
    buckets = max(RANK_BUCKETS, -(-max(hist.values(), default=0) // BUCKET_ROWS))
    p = p.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("h", "item_id", "piece_no")
    ranked = p.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)

    base, used, rows = 0, Counter(), []
    for pattern, times in pack_histogram(hist, capacity, items.sparkSession):
        place = 0
        for n, k in pattern:
            rows.append((n, used[n], k, base, place))
            used[n] += k * times
            place += n * k
        base += times
    rows.sort()
    shift = 1 << 44
    starts = np.array([n * shift + r for n, r, *_ in rows], dtype=np.int64)
    info = np.array([(r, k, b, q) for _, r, k, b, q in rows], dtype=np.int64).reshape(-1, 4)
    plan = items.sparkSession.sparkContext.broadcast((starts, info))

    @F.pandas_udf("chunk_id long, place int")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, info = plan.value
        n, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        at = info[np.searchsorted(starts, n * shift + r, side="right") - 1] if len(n) else info[:0]
        i = r - at[:, 0]
        return pd.DataFrame({"chunk_id": at[:, 2] + i // at[:, 1], "place": (at[:, 3] + i % at[:, 1] * n).astype(np.int32)})

    out = ranked.select("item_id", "piece_no", "start", "length", locate("length", "rank").alias("at"))
    return out.select("item_id", "piece_no", F.col("start").cast("int").alias("start"), "length", "at.chunk_id", "at.place")


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``chunks, ids, least_chunks, fill``: how near the packing comes to the bound of total length."""
    per = packed.groupBy("chunk_id").agg(F.sum("length").alias("filled"))
    total = per.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("filled"), F.lit(0)).alias("ids"), F.max("filled").alias("fullest"))
    return total.select("chunks", "ids", F.ceil(F.col("ids") / capacity).alias("least_chunks"), F.round(F.col("ids") / (F.col("chunks") * capacity), 6).alias("fill"), "fullest")


def fill_chunks(items: DataFrame, packed: DataFrame, item_id: str = "ord", ids: str = "token_ids", capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """``chunk_id, token_ids, n_pad``: the ids themselves; a chunk gathers at most ``capacity`` of them."""
    part = packed.join(items.select(F.col(item_id).alias("item_id"), F.col(ids).alias("ids")), "item_id")
    part = part.select("chunk_id", F.struct("place", F.slice("ids", F.col("start") + 1, F.col("length")).alias("x")).alias("s"))
    merged = part.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"])).alias("token_ids"))
    n_pad = F.lit(capacity) - F.size("token_ids")
    return merged.select("chunk_id", F.concat("token_ids", F.array_repeat(F.lit(pad), n_pad)).alias("token_ids"), n_pad.alias("n_pad"))
