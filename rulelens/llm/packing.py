"""Variable-capacity best-fit packing: documents into sequences of several permitted lengths at the least cost."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITIES = (2048, 4096, 8192, 16384)
ATTENTION = 32768.0  # a sequence of this length costs as much again for attention as for the rest
GROUP_BYTES = 32 << 20  # contents of the documents that are packed together


def cost(capacity: int, attention: float = ATTENTION) -> float:
    """Work for one sequence: linear in its length, and quadratic for attention."""
    return capacity * (1 + capacity / attention)


def fit(lengths: list[int], capacities: tuple[int, ...], opening: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the given order: each length's bin and offset there, and each bin's contents.

    A length goes to the open bin that it leaves least room in; without one, a bin opens with the least-cost size that holds it
    among those of at least ``opening``.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    where, offset, used, size = [], [], [], []
    for n in lengths:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            bin_ = len(used)
            left = min((c for c in capacities if c >= max(n, min(opening, capacities[-1]))), key=cost)
            used.append(0)
            size.append(left)
        where.append(bin_)
        offset.append(used[bin_])
        used[bin_] += n
        if left > n:
            insort(room, (left - n, bin_))
    return where, offset, used


def downsize(used: list[int], capacities: tuple[int, ...]) -> list[int]:
    """The smallest permitted length for each bin's contents."""
    return [capacities[bisect_left(capacities, u)] for u in used]


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bins, offsets and downsized capacities of the cheapest packing over all opening sizes; longest first."""
    best = None
    for opening in capacities:
        where, offset, used = fit(lengths, capacities, opening)
        final = downsize(used, capacities)
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, where, offset, final
    return best[1:]


PACKED = "doc_id long, piece int, start long, length int, bin long, capacity int, offset int"


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every document's UTF-8 bytes and one end mark, placed in sequences of the permitted lengths.

    Returns doc_id, piece, start (in the document), length, bin, capacity, offset (in the bin). A document longer than the
    largest length is cut into pieces of it, so nothing is lost. Pieces are dealt by hash to groups of about ``group_bytes``,
    each packed by itself in one task, so the tasks' size is bounded and their number grows with the input.

    Null or empty text: a piece of the end mark alone. Null doc_id and repeated rows: each row its own pieces. Ties of length
    go by doc_id. Other columns are ignored. An empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_bytes))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset, final = best_fit(pdf["length"].tolist(), capacities)
        pdf["bin"] = [int(pdf["group"].iloc[0]) << 32 | w for w in where]
        pdf["capacity"], pdf["offset"] = [final[w] for w in where], offset
        return pdf.drop(columns="group")

    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {most} as int)")))).withColumn("start", F.col("piece").cast("long") * most)
    pieces = pieces.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(most)).cast("int")).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(groups)))
    return pieces.drop("n").groupBy("group").applyInPandas(place, PACKED)
