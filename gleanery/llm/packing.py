"""Filling containers of fixed capacity: best fit, then local search that empties underfull containers.

Rows are numbered and spread over blocks by a hash of their number, so a block has a bounded expected number of items
whatever the keys, and every block is packed on its own. Inside a block, documents are exchanged one for one, two for
one or moved so that the sum of squared fills grows: weight goes from the emptiest containers to fuller ones until they
are empty or no exchange helps. The emptiest containers of all blocks are then searched once more together, block after
block of them, so what remains is about one underfull container for hundreds of blocks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

#: Expected items of a block.
BLOCK_ITEMS = 20_000
#: Containers of a block that the second search takes: its emptiest ones, and how many of them it takes at once.
TAIL, TAILS_AT_ONCE = 6, 500
#: Limits that one call packs for; more raise an error, none is left out.
MOST_LIMITS = 1_000


def pack(sizes: list[int], capacity: int, tries: int = 64, begun: list[int] | None = None) -> list[int]:
    """Container number of each item (0 <= size <= capacity); containers are numbered from 0 without gaps.

    ``begun`` gives containers to start the search from instead of the best fit.
    """
    if begun is not None:
        bins = [[] for _ in range(max(begun, default=-1) + 1)]
        for i, b in enumerate(begun):
            bins[b].append(i)
        free = [capacity - sum(sizes[i] for i in members) for members in bins]
        _improve(bins, free, sizes, capacity, tries)
        return _numbered(bins, len(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    gaps: list[tuple[int, int]] = []  # (free room, container), only containers with room
    bins: list[list[int]] = []
    free: list[int] = []
    for i in order:
        s = sizes[i]
        k = bisect_left(gaps, (s, -1))
        if k < len(gaps):
            room, b = gaps.pop(k)
        elif s == 0 and bins:
            room, b = 0, len(bins) - 1
        else:
            room, b = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] = room - s
        if free[b] and not (s == 0 and room == 0):
            insort(gaps, (free[b], b))
    _improve(bins, free, sizes, capacity, tries)
    return _numbered(bins, len(sizes))


def _numbered(bins: list[list[int]], items: int) -> list[int]:
    at = [0] * items
    n = 0
    for members in bins:
        if members:
            for i in members:
                at[i] = n
            n += 1
    return at


def _improve(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int, tries: int) -> None:
    """Local search by increasing squared fill, emptiest container first.

    ``tries`` bounds the containers looked at for one item's exchange, nearest in free room first; it limits the
    search effort, not the items.
    """
    least = -(-sum(sizes) // capacity)
    stuck: set[int] = set()
    used = sum(1 for m in bins if m)
    while used > least:
        open_bins = [b for b in range(len(bins)) if bins[b] and free[b] and b not in stuck]
        if not open_bins:
            break
        a = max(open_bins, key=lambda b: (free[b], b))
        if _drain(a, bins, free, sizes, capacity, tries):
            used -= 1
        else:
            stuck.add(a)


def _drain(a: int, bins: list[list[int]], free: list[int], sizes: list[int], capacity: int, tries: int) -> bool:
    """Moves weight out of container a; True once it is empty."""
    improved = True
    while bins[a] and improved:
        improved = False
        others = sorted((free[b], b) for b in range(len(bins)) if b != a and bins[b] and free[b])
        if not others:
            return False
        for i in sorted(bins[a], key=lambda i: -sizes[i]):
            s = sizes[i]
            k = bisect_left(others, (s, -1))
            if k < len(others):  # move: the tightest container that has room
                room, b = others.pop(k)
                bins[a].remove(i)
                bins[b].append(i)
                free[a] += s
                free[b] -= s
                if free[b]:
                    insort(others, (free[b], b))
                improved = True
                continue
            best = None  # (weight moved, container, what comes back)
            for room, b in others[-tries:]:
                if capacity - free[b] < capacity - free[a] - s:
                    continue
                small = sorted((sizes[j], j) for j in bins[b] if sizes[j] < s)
                p = bisect_left(small, (s - room, -1))
                if p < len(small):  # one for one: the smallest that leaves room for i
                    gain = s - small[p][0]
                    if best is None or gain > best[0]:
                        best = (gain, b, [small[p][1]])
                lo, hi = 0, len(small) - 1  # two for one
                while lo < hi:
                    two = small[lo][0] + small[hi][0]
                    if two < s - room:
                        lo += 1
                    elif two >= s:
                        hi -= 1
                    else:
                        if best is None or s - two > best[0]:
                            best = (s - two, b, [small[lo][1], small[hi][1]])
                        hi -= 1
            if best is not None and best[0] > 0:
                gain, b, back = best
                bins[a].remove(i)
                bins[b].append(i)
                for j in back:
                    bins[b].remove(j)
                    bins[a].append(j)
                free[a] += gain
                free[b] -= gain
                improved = True
                break
    return not bins[a]


_PACKED = "limit_name string, capacity int, item_id long, part_no int, start_token int, n_tokens int, container_id string, tail boolean, block int"
_ROW = ["limit_name", "capacity", "item_id", "part_no", "start_token", "n_tokens"]


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "item_id", "part_no", "row_no"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    at = np.asarray(pack(pdf["n_tokens"].tolist(), capacity), dtype=np.int64)
    name, block = pdf["limit_name"].iloc[0], int(pdf["block"].iloc[0])
    out = pdf[_ROW].copy()
    out["container_id"] = [f"{name}/{block}/{k}" for k in at]
    fills = np.bincount(at, weights=pdf["n_tokens"])
    open_ = [k for k in np.argsort(fills, kind="stable")[:TAIL] if fills[k] < capacity]
    out["tail"], out["block"] = np.isin(at, open_), block
    return out


def _searched(pdf: pd.DataFrame) -> pd.DataFrame:
    """The emptiest containers of many blocks: the search goes on over all of them."""
    pdf = pdf.sort_values(["container_id", "n_tokens", "item_id", "part_no"], kind="stable").reset_index(drop=True)
    codes, ids = pd.factorize(pdf["container_id"])
    at = pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]), begun=codes.tolist())
    out = pdf[_ROW].copy()
    out["container_id"] = [f"{ids[0]}+{k}" for k in at]
    return out


def fill_containers(items: DataFrame, capacities: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per packed part of an item, for every capacity.

    ``items`` has ``item_id long`` and ``n_tokens int`` (null counts as 0); ``capacities`` has ``limit_name`` and
    ``capacity``, a fixed configuration of at most MOST_LIMITS rows (ValueError beyond). An item above the capacity
    is split into full parts and a rest (``part_no``, ``start_token``); no other item is split and none is lost,
    items of size 0 included. Repeated item ids are items of their own. No capacities or no items: no rows.
    """
    numbered = items.select("item_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int").alias("size"), F.monotonically_increasing_id().alias("row_no"))
    sized = cut(numbered)  # measured and numbered once
    blocks = max(1, -(-sized.count() // block_items))
    caps = capacities.where(F.col("capacity") > 0).select("limit_name", F.col("capacity").cast("int").alias("capacity"))
    # every item goes to every capacity: an expansion by the fixed number of limits, kept as an array to avoid a cross join
    limits = [(r["limit_name"], r["capacity"]) for r in caps.distinct().orderBy("limit_name", "capacity").limit(MOST_LIMITS + 1).collect()]
    if len(limits) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} capacities")
    if not limits:
        limits = [("none", -1)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(c).cast("int").alias("capacity")) for k, c in limits])).alias("c")
    wide = sized.select("item_id", "size", "row_no", each).select("item_id", "size", "row_no", "c.*").where(F.col("capacity") > 0)
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)
    parts = wide.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part_no")).select(
        "limit_name",
        "capacity",
        "item_id",
        "part_no",
        (F.col("part_no") * F.col("capacity")).alias("start_token"),
        F.least(F.col("capacity"), F.col("size") - F.col("part_no") * F.col("capacity")).alias("n_tokens"),
        "row_no",
        F.pmod(F.xxhash64("row_no", F.lit(7)), F.lit(blocks)).cast("int").alias("block"),
    )
    full = parts.where(F.col("n_tokens") == F.col("capacity"))
    full = full.select(*_ROW, F.concat_ws("/", "limit_name", "capacity", F.lit("full"), "row_no", "part_no").alias("container_id"))
    rest = parts.where(F.col("n_tokens") < F.col("capacity"))
    packed = rest.groupBy("limit_name", "capacity", "block").applyInPandas(_packed, _PACKED)
    if blocks == 1:
        return full.unionByName(packed.select(*_ROW, "container_id"))
    packed = cut(packed)
    tails = packed.where("tail").withColumn("at_once", F.floor(F.col("block") / TAILS_AT_ONCE))
    searched = tails.groupBy("limit_name", "capacity", "at_once").applyInPandas(_searched, ", ".join(_PACKED.split(", ")[:7]))
    return full.unionByName(packed.where("not tail").select(*_ROW, "container_id")).unionByName(searched)
