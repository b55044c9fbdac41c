"""Problem 9: filling fixed-capacity containers by mixture-controlled packing.

Token counts are made in one pass and written to the shared checkpoint folder, so no
text is shuffled. Items are spread over packing groups of about ``GROUP_ROWS``
rows by a hash of the row, whatever their source, so that no source makes a group hot.
Inside a group a deficit round-robin over the source queues fills one window after the
other to the corpus-wide token proportions; what a source lacks or exceeds
is carried to the next window, and over the groups by a running sum per source.
The items of a window go, longest first, to the fullest container that
still has room; containers stay open for later windows of their group.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokenizer import token_counts
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Rows of a packing group, about.
GROUP_ROWS = 40_000
#: Containers' worth of tokens in a window.
WINDOW = 64


class Containers:
    """Best fit: the fullest open container with room, found by a bit mask of free sizes."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.made = capacity, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = self.free[room]
            container = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
        else:
            room, container = self.capacity, self.made
            self.made += 1
        room -= size
        self.free[room].append(container)
        self.mask |= 1 << room
        return container


def round_robin(queues: dict, shares: dict, deficits: dict, window: float) -> Iterator[list]:
    """Windows of items (size, payload), drawn from the source queues by deficit round-robin."""
    active = {s: deque(q) for s, q in queues.items() if q}
    owed = {s: deficits.get(s, 0.0) for s in active}
    while active:
        total = sum(shares[s] for s in active)
        quantum = {s: window * shares[s] / total for s in active}
        wait = min(max(0.0, q[0][0] - owed[s] - quantum[s]) / quantum[s] for s, q in active.items())
        drawn = []
        for s in list(active):
            queue, credit = active[s], owed[s] + quantum[s] * (1 + wait) + 1e-6
            while queue and queue[0][0] <= credit:
                credit -= queue[0][0]
                drawn.append(queue.popleft())
            owed[s] = credit
            if not queue:
                del active[s]
        yield drawn


def pack_group(items: pd.DataFrame, mix: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Containers of one group. items: key, source, n_tokens; mix: mix_source, share, deficit."""
    shares, deficits = {}, {}
    for source, share, deficit in zip(mix["mix_source"], mix["share"], mix["deficit"]):
        source = source if isinstance(source, str) else None
        shares[source], deficits[source] = max(float(share), 1e-12), float(deficit)
    boxes, rows, queues = Containers(capacity), [], {}
    items = items.sort_values(["n_tokens", "key"], ascending=[False, True], kind="stable")
    for key, source, n in zip(items["key"].tolist(), items["source"].tolist(), items["n_tokens"].tolist()):
        piece = start = 0
        while n - start > capacity:
            rows.append((boxes.put(capacity), key, piece, start, capacity))
            piece, start = piece + 1, start + capacity
        queues.setdefault(source if isinstance(source, str) else None, []).append((n - start, key, piece, start))
    for source in queues:
        shares.setdefault(source, 1e-12)
        # long items first: the short ones of the last windows fill the gaps that are left
        queues[source].sort(key=lambda x: (-x[0], x[1] is None, x[1]))
    for drawn in round_robin(queues, shares, deficits, float(WINDOW * capacity)):
        for n, key, piece, start in sorted(drawn, key=lambda x: -x[0]):
            rows.append((boxes.put(n), key, piece, start, n))
    return pd.DataFrame(rows, columns=["seq", "key", "piece", "token_from", "n_tokens"])


def pack(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    *,
    capacity: int = 2048,
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
) -> DataFrame:
    """(container_id, key, piece, token_from, n_tokens): every container with its texts.

    A text longer than ``capacity`` is split into full containers and a rest; no other
    text is split. Null and empty texts have 0 tokens and stand in some container, so that
    every row comes out. Null sources form one queue. Repeated rows are packed
    each on its own. An empty table has no container.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = token_counts(df, [key, source], text, tokenizer, folder).select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), "n_tokens").checkpoint()
    groups = max(1, round(counts.count() / GROUP_ROWS))
    counts = counts.withColumn("grp", F.pmod(F.xxhash64("key", "source", "n_tokens"), F.lit(groups)))
    parts = counts.groupBy("grp", "source").agg(F.sum("n_tokens").cast("double").alias("have"))
    # sums over sources and over groups; both are small tables beside the items
    shares = parts.groupBy("source").agg(F.sum("have").alias("tokens"))
    total = shares.agg(F.greatest(F.sum("tokens"), F.lit(1.0)).alias("total"))
    sizes = parts.groupBy("grp").agg(F.sum("have").alias("size"))
    mix = parts.join(shares.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).join(sizes, "grp").crossJoin(F.broadcast(total))  # one row
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("tokens") / F.col("total")
    lack = share * F.col("size") - F.col("have")
    mix = mix.select(F.col("grp").alias("mix_grp"), F.col("source").alias("mix_source"), share.alias("share"), F.coalesce(F.sum(lack).over(before), F.lit(0.0)).alias("deficit"))

    def run(key_, items: pd.DataFrame, mix_: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(items, mix_, capacity)
        out["container_id"] = (int(key_[0]) << 32) + out["seq"]
        return out[["container_id", "key", "piece", "token_from", "n_tokens"]]

    kind = counts.schema["key"].dataType.simpleString()
    packed = counts.groupBy("grp").cogroup(mix.groupBy("mix_grp")).applyInPandas(run, f"container_id bigint, key {kind}, piece int, token_from int, n_tokens int")
    return packed.withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used (null without containers)."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("utilisation"), F.max("used").alias("fullest"))
