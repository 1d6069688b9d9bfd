"""Filling fixed-capacity containers with items: linear grouping, few-size configurations, best fit for the rest.

Items are dealt into shards by a hash of their row number, so that null and repeated ids are spread like others, and each
shard is packed by itself: a task holds the sizes of one shard (16 bytes an item) and nothing grows with the collection.
Row numbers are written once, as a task that is run again need not give the same.  Within a shard of n items

1. items above a third of the capacity are *large*: sorted by size, cut into groups of equal cardinality, and rounded
   up to the largest size of their group;
2. the few sizes that remain are packed by configurations (how many items of each group fill one container): the linear
   program over all configurations is solved by column generation, pricing by a knapsack over the capacity, and its
   solution is rounded down;
3. the actual items take the places of their group, largest first, and what rounding down left over is placed by best
   fit, opening containers as needed;
4. the small items go where they leave the least space, largest first.

A shard wastes at most the few containers that rounding leaves, whatever its size.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.durable import durable

SHARD_ITEMS = 50_000


def best_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Configurations and how often to use each, so that their number is least: the linear program's solution.

    Revised simplex with column generation.  ``sizes`` are distinct and at most ``capacity``.  After ``rounds`` columns
    the best solution so far is taken and a warning logged: any of them gives valid packings, if not the fullest.
    """
    m = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.asarray(demand, float)
    for _ in range(rounds):
        price = np.linalg.solve(columns.T, np.ones(m))
        value, configuration = _knapsack(sizes, price, demand, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(columns, np.asarray(configuration, float))
        used = np.linalg.solve(columns, need)
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        columns[:, int(np.argmin(ratios))] = configuration
    else:
        logging.getLogger(__name__).warning("configurations of %d sizes: not the best after %d rounds", m, rounds)
    used = np.linalg.solve(columns, need)
    return [([int(round(c)) for c in columns[:, j]], max(0.0, float(used[j]))) for j in range(m)]


def _knapsack(sizes: list[int], price: np.ndarray, demand: list[int], capacity: int) -> tuple[float, list[int]]:
    """The configuration of greatest worth: a bounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, np.ndarray]] = []
    for j, s in enumerate(sizes):
        if price[j] <= 1e-12:
            continue
        for _ in range(min(capacity // s, demand[j])):
            better = best[:-s] + price[j]
            take = np.zeros(capacity + 1, bool)
            take[s:] = better > best[s:] + 1e-12
            if not take.any():
                break
            best[s:] = np.where(take[s:], better, best[s:])
            taken.append((j, take))
    configuration, room = [0] * len(sizes), capacity
    for j, take in reversed(taken):
        if take[room]:
            configuration[j] += 1
            room -= sizes[j]
    return float(best[capacity]), configuration


class _Rooms:
    """Open containers by their free space, for best fit in a few machine operations."""

    def __init__(self, capacity: int):
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0

    def put(self, container: int, space: int) -> None:
        self.by_space[space].append(container)
        self.present |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        """The fullest container with ``size`` to spare, and its space."""
        fitting = self.present >> size
        if not fitting:
            return None
        space = size + (fitting & -fitting).bit_length() - 1
        container = self.by_space[space].pop()
        if not self.by_space[space]:
            self.present &= ~(1 << space)
        return container, space


def pack_sizes(sizes: np.ndarray, capacity: int, groups: int = 60, large_part: int = 3) -> np.ndarray:
    """The container of each item, numbered from 0.  Sizes lie between 1 and ``capacity``."""
    n = len(sizes)
    where = np.full(n, -1, np.int64)
    rooms = _Rooms(capacity)
    opened = 0
    order = np.argsort(-sizes, kind="stable")
    n_large = int((sizes > capacity // large_part).sum())
    large, left = order[:n_large], []
    if n_large:
        per_group = math.ceil(n_large / groups)
        rounded: dict[int, list[int]] = {}  # groups of one rounded size are one group
        for at in range(0, n_large, per_group):
            rounded.setdefault(int(sizes[large[at]]), []).extend(large[at : at + per_group].tolist())
        kinds = list(rounded)
        waiting = [rounded[s][::-1] for s in kinds]
        demand = [len(w) for w in waiting]
        plan = best_configurations(kinds, demand, capacity)
        for configuration, times in sorted(plan, key=lambda p: -p[1]):
            for _ in range(int(times + 1e-6)):
                space, filled = capacity, False
                for j, count in enumerate(configuration):
                    for _ in range(count):
                        if waiting[j]:
                            item = waiting[j].pop()
                            where[item] = opened
                            space -= int(sizes[item])
                            filled = True
                if filled:
                    rooms.put(opened, space)
                    opened += 1
        left = sorted((i for w in waiting for i in w), key=lambda i: -int(sizes[i]))
    for item in [*left, *order[n_large:].tolist()]:
        size = int(sizes[item])
        found = rooms.take(size)
        if found is None:
            found = (opened, capacity)
            opened += 1
        where[item] = found[0]
        rooms.put(found[0], found[1] - size)
    return where


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        shard, tokens = whole["shard"].to_numpy(), whole["n_tokens"].combine_chunks().fill_null(0).to_numpy()
        doc = whole["doc_id"].combine_chunks()
        order = np.lexsort((doc.fill_null(-(1 << 63)).to_numpy(), tokens, shard))
        shard, doc, tokens = shard[order], doc.take(pa.array(order)), tokens[order]
        edges = np.r_[0, np.nonzero(np.diff(shard))[0] + 1, len(shard)]
        for a, b in zip(edges, edges[1:]):
            yield _pack_shard(int(shard[a]), doc[a:b], tokens[a:b], capacity)

    return run


def _pack_shard(shard: int, doc: pa.Array, tokens: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Pieces with their containers.  Only documents longer than a container are cut: full containers and a rest."""
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    fits = rest > 0
    where = np.full(len(doc), -1, np.int64)
    where[fits] = pack_sizes(rest[fits], capacity)
    n_shared = int(where.max()) + 1 if len(where) else 0
    cut = np.nonzero(full)[0]
    of_full = np.repeat(cut, full[cut])
    piece = np.arange(len(of_full)) - np.repeat(np.cumsum(full[cut]) - full[cut], full[cut])
    owner = np.r_[np.nonzero(fits | (full == 0))[0], of_full]
    n_rest = len(owner) - len(of_full)
    container = np.r_[where[owner[:n_rest]], n_shared + np.arange(len(of_full))]
    return pa.RecordBatch.from_arrays(
        [
            doc.take(pa.array(owner)),
            pa.array(tokens[owner]),
            pa.array(np.r_[full[owner[:n_rest]], piece], pa.int32()),
            pa.array((full + fits)[owner], pa.int32()),
            pa.array(np.full(len(owner), shard), pa.int32()),
            pa.array(container, mask=container < 0),
            pa.array(np.r_[rest[owner[:n_rest]], np.full(len(of_full), capacity)]),
        ],
        names=["doc_id", "n_tokens", "piece", "n_pieces", "shard", "container", "piece_tokens"],
    )


def pack(counts: DataFrame, capacity: int = 1024, shard_items: int = SHARD_ITEMS, n_items: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, piece, n_pieces, shard, container, piece_tokens): where each piece of a document lies.

    ``counts`` holds doc_id and n_tokens; ``n_items``, the number of its rows, saves counting them, which matters where
    the tokens are still to be counted.  A container is named by (shard, container).  A document of more than
    ``capacity`` tokens is cut into full containers and a rest (the last piece), no other is cut.  Documents without
    tokens (or a null number of them) have 0 pieces and no container, in one row.  Repeated and null ids are packed as
    separate documents.  An empty table
    gives an empty result.  With more than one shard, a document's shard depends on the place of its row in ``counts``.
    """
    n_items = counts.count() if n_items is None else n_items
    shards = max(1, math.ceil(n_items / shard_items))
    if shards == 1:
        dealt = counts.select("doc_id", "n_tokens", F.lit(0).alias("shard")).coalesce(1)
    else:
        row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
        dealt = durable(counts.select("doc_id", "n_tokens", row.alias("shard"))).repartitionById(shards, "shard")  # a task for each shard
    schema = "doc_id BIGINT, n_tokens BIGINT, piece INT, n_pieces INT, shard INT, container BIGINT, piece_tokens BIGINT"
    return dealt.mapInArrow(_packed(capacity), schema)


def packing_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row that tells whether a packing (the result of ``pack``) is valid and full.

    Rows with an id of their own are told apart by it; null and repeated ids are summed up together.
    """
    loads = packed.where("container IS NOT NULL").groupBy("shard", "container").agg(F.sum("piece_tokens").alias("load"))
    filled = loads.agg(F.count(F.lit(1)).alias("n_containers"), F.count_if(F.col("load") > capacity).alias("n_overfull"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"))
    whole = packed.where("piece = 0 OR piece IS NULL")
    # one row for each piece: every document has a piece 0 and as many as it names
    pieces = packed.agg(
        F.count_if(F.col("piece") == 0).alias("n_documents"),
        F.count_if((F.col("n_tokens") <= capacity) & (F.col("n_pieces") > 1)).alias("n_cut_needlessly"),
        F.coalesce(F.sum("piece_tokens"), F.lit(0)).alias("packed_tokens"),
    )
    documents = whole.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("document_tokens"))
    least = F.ceil(F.col("tokens") / F.lit(capacity))
    return filled.crossJoin(F.broadcast(pieces)).crossJoin(F.broadcast(documents)).select(  # three tables of one row
        "n_documents",
        "n_overfull",
        "n_cut_needlessly",
        ((F.col("packed_tokens") == F.col("tokens")) & (F.col("document_tokens") == F.col("tokens"))).alias("complete"),
        (F.col("n_containers") <= F.lit(1.01) * least + 1).alias("full"),
    )
