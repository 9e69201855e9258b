"""Filling containers of fixed capacity with items (problem 8).

Karmarkar-Karp differencing over many ways: runs of items, largest first, begin as partial
partitions with a window for each item; the two with the largest imbalance are merged so that
the fullest windows of one meet the emptiest of the other, until one partition is left, whose
windows are nearly equal. Its number of windows begins at what the items need at least and
rises whenever the capacity is exceeded.

Where only a few items fit into a window, nearly equal isn't near enough to leave no room. So
before the number of windows rises, fewer items are differenced, the largest ones, and the
smaller ones then go where they fit best; in the end only items of over half the capacity are
differenced, which have a window each. Thus there are never more windows than by best fit of
all items, largest first.

Items are spread over blocks by a hash, each block of about ``block`` items packed in one
task, so no block grows with the data. An item over the capacity, and no other, is split: into
parts of exactly the capacity, which fill a container each, and a rest that is packed. Items
of size zero take no room and join the first container of their block; null sizes count as
zero.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Shares of the items that are differenced at a number of windows, one after another.
SHARES = (1.0, 0.8, 0.6, 0.4, 0.2, 0.0)
#: Times that the number of windows rises at most between the least and that of best fit.
RISES = 8


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """(loads, members) of ``k`` windows by multiway differencing of positive ``sizes``."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []  # inner nodes of the trees of merged windows, numbered after the items
    n, nodes = len(sizes), len(sizes)
    order = np.argsort(-sizes, kind="stable")
    # a partial partition: its filled windows, fullest first, and the trees of what is in them
    run = max(1, k // 8)
    parts = {t: (sizes[order[i : i + run]], order[i : i + run]) for t, i in enumerate(range(0, n, run))}

    def imbalance(loads: np.ndarray) -> int:
        return int(loads[0]) - (int(loads[-1]) if len(loads) == k else 0)

    heap = [(-imbalance(loads), t) for t, (loads, _) in parts.items()]
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        a, b = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        if len(a[0]) < len(b[0]):
            a, b = b, a
        shared = max(0, len(a[0]) + len(b[0]) - k)
        keep = len(a[0]) - shared
        loads, trees = np.concatenate([a[0], b[0][shared:]]), np.concatenate([a[1], b[1][shared:]])
        if shared:  # the emptiest windows of one meet the fullest of the other
            loads[keep : keep + shared] += b[0][:shared][::-1]
            left.append(a[1][keep:])
            right.append(b[1][:shared][::-1])
            trees[keep : keep + shared] = np.arange(nodes, nodes + shared)
            nodes += shared
        sort = np.argsort(-loads, kind="stable")
        parts[stamp] = (loads[sort], trees[sort])
        heapq.heappush(heap, (-imbalance(parts[stamp][0]), stamp))
        stamp += 1
    if not parts:
        return np.zeros(0, np.int64), []
    loads, trees = next(iter(parts.values()))
    # the window of each tree goes down to its items, the last merged first
    window = np.full(nodes, -1)
    window[trees] = np.arange(len(trees))
    top = nodes
    for a, b in zip(reversed(left), reversed(right)):
        of = window[top - len(a) : top]
        window[a], window[b] = of, of
        top -= len(a)
    members: list[list[int]] = [[] for _ in range(len(trees))]
    for i, w in enumerate(window[:n].tolist()):
        members[w].append(i)
    return loads, members


def best_fit(rooms: list[int], sizes: list[int], capacity: int = 0) -> tuple[list[int], list[int]]:
    """(window of each of ``sizes``, rooms left): each goes into the window it fits best.

    ``sizes`` are in falling order. Where there is no room the window is -1 or, with a
    ``capacity``, a new one.
    """
    free = sorted((room, k) for k, room in enumerate(rooms))
    out, count = [], len(rooms)
    for size in sizes:
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            room, k = free.pop(at)
        elif capacity:
            room, k = capacity, count
            count += 1
        else:
            out.append(-1)
            continue
        out.append(k)
        if room > size:
            bisect.insort(free, (room - size, k))
    left = [0] * count
    for room, k in free:
        left[k] = room
    return out, left


def pack(sizes: np.ndarray, capacity: int) -> tuple[list[list[int]], float]:
    """(windows, share): windows as lists of item numbers, for items of up to ``capacity``, and the share of the items that was differenced.

    Items of size zero join the first window.
    """
    empty = np.flatnonzero(sizes == 0).tolist()
    some = np.flatnonzero(sizes > 0)
    some = some[np.argsort(-sizes[some], kind="stable")]
    if not len(some):
        return [empty] if empty else [], 1.0
    windows, share = _packed(sizes[some], capacity)
    windows = [some[w].tolist() for w in windows]
    windows[0] += empty
    return windows, share


def _packed(s: np.ndarray, capacity: int) -> tuple[list[list[int]], float]:
    """The same for positive sizes in falling order."""
    n, big = len(s), int((s * 2 > capacity).sum())
    least = max(math.ceil(int(s.sum()) / capacity), big)
    most = max(best_fit([], s.tolist(), capacity)[0]) + 1
    step = max(1, math.ceil((most - least) / RISES))
    for k in [*range(least, most, step), most]:
        for m in sorted({max(big, int(share * n)) for share in SHARES}, reverse=True):
            loads, members = difference(s[:m], k)
            if m and loads[0] > capacity:
                continue
            members += [[] for _ in range(k - len(members))]
            place, _ = best_fit([capacity - int(s[w].sum()) for w in members], s[m:].tolist())
            if -1 not in place:
                for i, w in enumerate(place, m):
                    members[w].append(i)
                return [w for w in members if w], m / n
    raise AssertionError("best fit fits")


def with_containers(items: DataFrame, key: str, size: str, capacity: str, kind: str, block: int = BLOCK) -> DataFrame:
    """(kind, container, key, part, begin, size): where each part of each item is.

    ``items`` has a row per item and kind of container: ``key`` names the item, ``size`` is its
    size, ``capacity`` that of its kind of container. ``container`` is unique within a kind.
    ``begin`` is the offset of the part in its item.
    """
    sized = items.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(capacity).cast("long").alias("capacity")).distinct()
    count = F.floor(F.col("size") / F.col("capacity")) + F.when((F.col("size") % F.col("capacity") > 0) | (F.col("size") == 0), 1).otherwise(0)
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    parts = parts.withColumn("begin", F.col("part") * F.col("capacity")).withColumn("size", F.least(F.col("size") - F.col("begin"), F.col("capacity")))
    whole = F.col("size") == F.col("capacity")
    full = parts.where(whole).select("kind", F.concat(F.col("key").cast("string"), F.lit("#"), F.col("part").cast("string")).alias("container"), "key", "part", "begin", "size")
    n = parts.where(~whole).groupBy("kind").agg(F.greatest(F.lit(1), F.round(F.count("*") / block)).cast("long").alias("blocks"))
    rest = parts.where(~whole).join(F.broadcast(n), "kind").withColumn("block", F.pmod(F.xxhash64("key", "part"), F.col("blocks")))
    key_type = dict(sized.dtypes)["key"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("key", "ascending"), ("part", "ascending")])
        windows, _ = pack(group.column("size").to_numpy(), int(group.column("capacity")[0].as_py()))
        take = [i for w in windows for i in w]
        names = [f"b{group.column('block')[0].as_py()}-{k}" for k, w in enumerate(windows) for _ in w]
        out = group.select(["kind", "key", "part", "begin", "size"]).take(pa.array(take, pa.int64()))
        return out.add_column(1, "container", pa.array(names, pa.string())).combine_chunks()

    packed = rest.select("kind", "block", "key", "part", "begin", "size", "capacity").groupBy("kind", "block").applyInArrow(run, f"kind string, container string, key {key_type}, part int, begin long, size long")
    return packed.unionByName(full.select("kind", "container", "key", "part", "begin", "size"))
