"""Documents into containers of fixed capacity by bound-certified repacking (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlery.llm.encode import VOCABULARY, token_counts

CAPACITY = 2_048
#: Containers' worth of tokens that one group packs at a time; the number of groups follows from the tokens.
GROUP_CONTAINERS = 64
#: Groups that exchange what lies in their containers with space left become one group in the next round.
MERGED = 32
#: Containers that a group gives away for each one that it uses beyond its bound.
GIVEN = 8
#: Containers that a certified group gives: its remainder and the next emptiest ones, which take documents of other groups.
SPARED = 2
ITEM = "doc_id long, known boolean, piece int, token_start long, n_tokens long"
PLACED = f"{ITEM}, grp long, bin long, free long, kept boolean, bound long, bins long"


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing of these sizes needs (1 to capacity each)."""
    return counted_bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def counted_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same of so many items of each size, by two families of dual feasible functions.

    The first counts sizes above capacity - e as whole containers and drops those under e, for every e; the second
    rounds sizes up to multiples of capacity / k.
    """
    if not counts.any():
        return 0
    weight = counts * np.arange(capacity + 1)
    many, heavy = np.cumsum(counts), np.cumsum(weight)
    best = -(-int(heavy[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    large = many[-1] - many[capacity - e]
    middle = heavy[capacity - e] - heavy[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    x = np.arange(capacity + 1)
    for k in range(2, 33):
        exact = (x * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, x * k, ((k + 1) * x // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of sizes given in decreasing order: the container of each, and the space left in each container.

    A bit per amount of free space says whether a container with that much exists, so the tightest one is found by
    shifting, not by searching.
    """
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, left, placed = 0, [], np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = free_bins[free].pop()
            if not free_bins[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(left)
            left.append(capacity)
        placed[i] = b
        left[b] = rest = free - size
        if rest:
            free_bins[rest].append(b)
            mask |= 1 << rest
    return placed, np.array(left, np.int64)


def _pack(last: bool, capacity: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = items["n_tokens"].to_numpy()
        placed, left = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        items["grp"], items["bin"], items["free"] = key[0], placed, left[placed]
        # a group gives what lies in its emptiest containers to the next round: of a certified group only those around
        # its remainder, of others more, the farther they are from their bound
        gap = len(left) - bound
        give = 0 if last else min(int((left > capacity // 64).sum()), max(SPARED, GIVEN * gap))
        given = np.zeros(len(left), bool)
        given[np.argsort(-left, kind="stable")[:give]] = True
        items["kept"] = ~given[placed]
        items["bound"], items["bins"] = bound, len(left)
        return items[[c.split()[0] for c in PLACED.split(", ")]]

    return run


def pack_items(items: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Items of up to ``capacity`` tokens into containers: the items' columns, round, grp, bin, free, bound and bins.

    Each group is packed by best fit decreasing and its number of containers certified against its lower bound. Groups
    with gaps exchange: what lies in their emptiest containers is packed again together with that of other groups, a
    fixed number of which merge, until nothing is given away. Each round is cut off by a checkpoint in the shared folder.
    """
    salt = F.pmod(F.xxhash64("doc_id", "known", "piece"), F.lit(groups))
    columns = [c.split()[0] for c in ITEM.split(", ")]
    todo, level, done = items.withColumn("g", salt), 0, None
    while True:
        last = groups == 1
        packed = todo.groupBy("g").applyInPandas(_pack(last, capacity), PLACED).checkpoint()
        kept = packed.where("kept").withColumn("round", F.lit(level))
        done = kept if done is None else done.unionByName(kept)
        if last or packed.where("not kept").isEmpty():
            return done.drop("kept")
        groups, level = -(-groups // MERGED), level + 1
        todo = packed.where("not kept").select(*columns, F.pmod(F.floor(F.col("grp") / F.lit(MERGED)), F.lit(groups)).alias("g"))


def pack_documents(documents: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, container, free, bound, bins, least, containers: every document, assigned.

    A document longer than a container is split into full containers and a rest; every other one stays whole. Documents
    without tokens (null, empty) take no space and have a null container. free is the space left in the container;
    bound and bins are the certificate of the group that packed it: the containers any packing of the group's documents
    needs, and those it used; least and containers are the same of all documents together. A null doc_id is kept; a
    repeated one is told apart by nothing but its piece and packed as often as it is.
    """
    sizes = token_counts(documents, path)
    starts = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    known = F.col("doc_id").isNotNull()
    pieces = sizes.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), known.alias("known"), F.posexplode(starts).alias("piece", "token_start"), F.col("n_tokens").alias("whole"))
    pieces = pieces.select("doc_id", "known", "piece", "token_start", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("token_start")).alias("n_tokens"))
    pieces = pieces.checkpoint()
    filled = pieces.where("n_tokens > 0")
    # at most a row for each size: the bound of all documents together
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in filled.groupBy("n_tokens").agg(F.count("*")).collect():
        counts[size] = n
    groups = max(1, -(-int((counts * np.arange(capacity + 1)).sum()) // (GROUP_CONTAINERS * capacity)))
    packed = pack_items(filled, groups, capacity)
    used = packed.select(F.count_distinct("round", "grp", "bin")).first()[0]
    container = F.concat_ws("-", F.col("round"), F.col("grp"), F.col("bin"))
    columns = [F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "piece", "token_start", "n_tokens"]
    none = [F.lit(None).cast(t).alias(n) for n, t in (("container", "string"), ("free", "long"), ("bound", "long"), ("bins", "long"))]
    both = packed.select(*columns, container.alias("container"), "free", "bound", "bins").unionByName(pieces.where("n_tokens = 0").select(*columns, *none))
    return both.withColumns({"least": F.lit(counted_bound(counts, capacity)).cast("long"), "containers": F.lit(used).cast("long")})


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the least that the total of tokens needs, and the share of space left empty."""
    used = packed.where("container is not null").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity)
    return used.select("containers", least.alias("least"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("empty_share"))
