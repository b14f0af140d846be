"""Problem 1: splits that keep related repositories together.

Two repositories are related if they share the owner or were staged from the same root, also through
others. Components are found over owners only (a root links all its owners to the smallest one), so
the graph is far smaller than the rows. Components are bundled by identical size and label profile
(the tenths of a component's rows that each split holds today). A min-cost flow sends every bundle's
rows to the splits' quotas: rows that leave their split cost one each, rows over a quota cost more.
The flow is rounded to whole components, components larger than a tenth of a quota first, and the
members of a bundle are told apart by a seeded hash.

NULL and blank repositories have no group and no row. Rows without a split count for size but
carry no label. No rows give an empty result. Repeated rows count as rows. Ties between components
break by hash, then by name.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import canonical_repository, canonical_split
from siltstone.operators.components import connected_components
from siltstone.session import checkpoint

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
RANK_BUCKETS = 256
#: Components that one rank bucket may hold before there are more buckets.
BUCKET_ROWS = 100_000
#: Cost of a row over its quota, in tenths of a moved row.
OVER_QUOTA_COST = 40
TENTHS = 10


def _owner(repo):
    return F.when(F.instr(repo, "/") > 0, F.substring_index(repo, "/", 1)).otherwise(F.concat(F.lit("\x01"), repo))


def related_groups(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """``repository, component``: each canonical repository of ``rows`` with its group's smallest owner.

    ``rows`` needs ``repository``; ``staged`` needs ``repo`` and ``root``.
    """
    repos = rows.select(canonical_repository(F.col("repository")).alias("repository")).where("repository <> ''").distinct()
    repos = repos.withColumn("owner", _owner(F.col("repository")))
    roots = (
        staged.select(canonical_repository(F.col("repo")).alias("repo"), F.regexp_replace(F.trim("root"), "/+$", "").alias("root"))
        .where("repo <> '' AND root <> ''")
        .select("root", _owner(F.col("repo")).alias("owner"))
        .distinct()
    )
    least = roots.groupBy("root").agg(F.min("owner").alias("v"), F.max("owner").alias("w")).where("v <> w")
    links = roots.join(least, "root").select(F.col("owner").alias("u"), "v").where("u <> v")
    comp = connected_components(links)
    return repos.join(comp.withColumnRenamed("node", "owner"), "owner", "left").select("repository", F.coalesce("component", "owner").alias("component"))


def group_profiles(files: DataFrame, repos: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repositories with their component and rows by split, and the same summed by component."""
    rows = files.select("repository", "split", F.lit(1).alias("f")).unionByName(repos.select("repository", "split", F.lit(0).alias("f")))
    counted = (
        rows.select(canonical_repository(F.col("repository")).alias("repository"), canonical_split(F.col("split")).alias("split"), "f")
        .where("repository <> ''")
        .groupBy("repository")
        .agg(
            F.sum("f").alias("n_rows"),
            *(F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in RATIOS),
            F.collect_set("split").alias("splits"),
        )
    )
    counted = checkpoint(counted.join(related_groups(counted.select("repository"), staged), "repository"))
    groups = counted.groupBy("component").agg(
        F.sum("n_rows").alias("n_rows"),
        *(F.sum(f"n_{s}").alias(f"n_{s}") for s in RATIOS),
        F.array_distinct(F.flatten(F.collect_set("splits"))).alias("splits"),
    )
    return counted, groups


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a maximum flow of least cost.

    Successive shortest paths with queue-based Bellman-Ford on the residual graph.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    while True:
        dist, via, queue, queued = [None] * n, [-1] * n, deque([source]), {source}
        dist[source] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if cap[e] > 0 and (dist[to[e]] is None or dist[a] + cost[e] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        push, b = None, sink
        while b != source:
            push = cap[via[b]] if push is None else min(push, cap[via[b]])
            b = to[via[b] ^ 1]
        b = sink
        while b != source:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]


def transport(supply: list[int], costs: list[tuple[int, ...]], quota: list[int], over: int) -> list[list[int]]:
    """Min-cost flow of ``supply[i]`` to few sinks; a unit costs ``costs[i][s]``, and ``over`` more beyond ``quota[s]``.

    Successive shortest paths: every source starts in its cheapest sink, and while a sink is overfull
    the cheapest chain of reassignments to one below its quota is taken, as long as that costs less
    than ``over``. Sources hang in one heap for each ordered pair of sinks, so a step looks at sinks
    alone and the flow stays fast for any number of sources.
    """
    k = range(len(quota))
    flow = [[0] * len(quota) for _ in supply]
    load = [0] * len(quota)
    heaps: dict[tuple[int, int], list[tuple[int, int]]] = {(s, t): [] for s in k for t in k if s != t}

    def put(i: int, s: int) -> None:
        for t in k:
            if t != s:
                heapq.heappush(heaps[s, t], (costs[i][t] - costs[i][s], i))

    for i, n in enumerate(supply):
        s = min(k, key=lambda s: (costs[i][s], load[s] - quota[s]))
        flow[i][s] = n
        load[s] += n
        if n:
            put(i, s)

    def top(s: int, t: int) -> tuple[int, int] | None:
        h = heaps[s, t]
        while h and not flow[h[0][1]][s]:
            heapq.heappop(h)
        return h[0] if h else None

    while full := [s for s in k if load[s] > quota[s]]:
        best = None
        for s in full:
            dist: dict[int, tuple[int, list[tuple[int, int, int]]]] = {s: (0, [])}
            for _ in k:
                for u in list(dist):
                    for t in k:
                        if t != u and (e := top(u, t)) and (t not in dist or dist[u][0] + e[0] < dist[t][0]) and all(t != x for x, _, _ in dist[u][1]):
                            dist[t] = (dist[u][0] + e[0], [*dist[u][1], (u, t, e[1])])
            for t, (d, path) in dist.items():
                if load[t] < quota[t] and d < over and (best is None or d < best[0]):
                    best = (d, path, s, t)
        if best is None:
            return flow
        _, path, s, t = best
        n = min(load[s] - quota[s], quota[t] - load[t], *(flow[i][u] for u, _, i in path))
        for u, v, i in path:
            fresh = not flow[i][v]
            flow[i][u] -= n
            flow[i][v] += n
            if fresh:
                put(i, v)
        load[s] -= n
        load[t] += n
    return flow


def _shares(label: str) -> dict[str, int]:
    """Tenths of rows by split of a label profile such as ``train:7,test:3``; a bare name has all."""
    parts = (p.partition(":") for p in label.split(",") if p)
    return {name: int(tenths) if tenths else TENTHS for name, _, tenths in parts}


def allocate(bundles: list[tuple[int, str, int]], ratios: dict[str, float]) -> dict[tuple[int, str], dict[str, int]]:
    """Components of each bundle ``(size, label profile, count)`` for each split.

    Components of more than a tenth of the smallest quota are few; they are placed whole, largest
    first, where most room is left. The flow then deals all other bundles to the quotas that remain
    and is rounded to whole components from the largest down, each remainder going to the split that
    is furthest below its quota.
    """
    names = list(ratios)
    total = sum(s * c for s, _, c in bundles)
    scale = sum(ratios.values())
    if scale <= 0:
        raise ValueError("the ratios must have a positive sum")
    quota = [int(total * ratios[s] / scale) for s in names]
    quota[0] += total - sum(quota)
    large = max(1, min(q for q, s in zip(quota, names, strict=True) if ratios[s] > 0) // 10)
    order = sorted(bundles, key=lambda b: (-b[0], b[1]))
    room, out = list(quota), {}
    rest = []
    for size, label, count in order:
        out[size, label] = dict.fromkeys(names, 0)
        if size <= large or count * size > total:
            rest.append((size, label, count))
            continue
        for _ in range(count):
            i = max(range(len(names)), key=lambda i: (room[i], _shares(label).get(names[i], 0)))
            out[size, label][names[i]] += 1
            room[i] -= size
    costs = [tuple(TENTHS - sh.get(s, 0) if sh else 0 for s in names) for sh in (_shares(b[1]) for b in rest)]
    flow = transport([s * c for s, _, c in rest], costs, [max(0, r) for r in room], OVER_QUOTA_COST)
    left = []
    for (size, label, count), f in zip(rest, flow, strict=True):
        given = [min(count, x // max(1, size)) for x in f]
        n = count - sum(given)
        for i, g in enumerate(given):
            out[size, label][names[i]] = g
            room[i] -= g * size
        left.append((size, label, n))
    for size, label, n in left:
        for _ in range(n if size else min(n, 1)):
            i = max(range(len(names)), key=lambda i: (room[i], ratios[names[i]]))
            out[size, label][names[i]] += 1 if size else n
            room[i] -= size
    return out


def assign_groups(files: DataFrame, repos: DataFrame, staged: DataFrame, ratios: dict[str, float] | None = None, seed: int = 20241) -> DataFrame:
    """``repository, component, split, splits, n_rows``: the allocation; ``splits`` are those the group carries today."""
    ratios = ratios or RATIOS
    members, groups = group_profiles(files, repos, staged)
    tenths = [(s, F.floor(F.col(f"n_{s}") * TENTHS / F.greatest(F.col("n_rows"), F.lit(1)) + 0.5).cast("int")) for s in RATIOS]
    label = F.concat_ws(",", *(F.when(t > 0, F.concat(F.lit(f"{s}:"), t)) for s, t in tenths))
    # Distinct sizes number at most about sqrt(2 x rows) and profiles of tenths are few, so the bundles sent to the driver are.
    g = groups.select("component", F.col("n_rows").alias("size"), label.alias("label"), "splits", F.xxhash64(F.lit(seed), "component").alias("h"))
    g = checkpoint(g)
    bundles = [(r[0], r[1], r[2]) for r in g.groupBy("size", "label").count().collect()]
    buckets = max(RANK_BUCKETS, -(-max((b[2] for b in bundles), default=0) // BUCKET_ROWS))
    g = g.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = g.groupBy("size", "label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("size", "label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    ranked = g.join(before, ["size", "label", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("size", "label", "bucket").orderBy("h", "component")) - 1
    )
    limits, names = [], list(ratios)
    for (sz, lab), given in allocate(bundles, ratios).items():
        cum = 0
        for s in names:
            if given[s]:
                limits.append((sz, lab, cum, cum + given[s], s))
            cum += given[s]
    spark = files.sparkSession
    cuts = spark.createDataFrame(limits, "size long, label string, lo long, hi long, split string")
    placed = ranked.join(cuts, ["size", "label"]).where("rank >= lo AND rank < hi").select("component", "split", "splits")
    return members.select("repository", "component", "n_rows").join(placed, "component").select("repository", "component", "split", "splits", "n_rows")


def assign_splits(files: DataFrame, repos: DataFrame, staged: DataFrame, ratios: dict[str, float] | None = None, seed: int = 20241) -> DataFrame:
    """``repository, component, split``: every related group whole in one split, rows near the ratios."""
    return assign_groups(files, repos, staged, ratios, seed).select("repository", "component", "split")


def leaking_repositories(files: DataFrame, repos: DataFrame, staged: DataFrame) -> DataFrame:
    """``repository``: those whose group carries more than one split today, so that the allocation must move rows of it."""
    return assign_groups(files, repos, staged).where(F.size("splits") > 1).select("repository")


def split_report(files: DataFrame, repos: DataFrame, staged: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """``split, repositories, groups, n_rows, share, wanted`` of :func:`assign_splits`: the realised proportions of rows."""
    ratios = ratios or RATIOS
    a = assign_groups(files, repos, staged, ratios)
    per = a.groupBy("split").agg(F.count(F.lit(1)).alias("repositories"), F.count_distinct("component").alias("groups"), F.sum("n_rows").alias("n_rows"))
    wanted = F.create_map(*(F.lit(x) for s, q in ratios.items() for x in (s, q / sum(ratios.values()))))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # of a handful of splits
    return per.select("split", "repositories", "groups", "n_rows", F.round(F.col("n_rows") / total, 6).alias("share"), wanted[F.col("split")].alias("wanted"))
