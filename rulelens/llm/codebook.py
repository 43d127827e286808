"""Vector codes from learned codebooks, with Drake and Hamerly's adaptive bounds that are kept from round to round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import beside, by_batch, emptied, fresh, saved
from rulelens.llm.vectors import length, matrix, whole

PARTS, ENTRIES, ROUNDS = 4, 256, 4
FIRST, LEAST = 16, 4  # bounds kept for a part at first, and at least
ALL = np.iinfo(np.uint16).max  # depth of a row that had to look at all entries
SLACK = 1e-6  # by which rounding could shift a distance, relative to it; bounds are moved to the safe side by as much
DEEP_SHARE = 0.001  # share of the parts that used their lists which may have reached past the lists' next length


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` from every entry, as 64-bit whole numbers."""
    if _reach(x, entries) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([paired(x, np.broadcast_to(e, x.shape)) for e in entries], axis=1)


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """No sum of a product's terms is larger."""
    top = max((int(np.abs(z.astype(np.int64)).max(initial=0)) for z in (x, y)), default=0)
    return 4 * top * top * max(x.shape[-1], 1)


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from rows."""
    if _reach(x, y) >= 1 << 63:
        raise ValueError("a squared distance may not fit in 64 bits")
    gap = x.astype(np.int64) - y.astype(np.int64)
    return (gap * gap).sum(axis=-1)


def low(squares: np.ndarray) -> np.ndarray:
    """Distances, rounded to the safe side of a lower bound."""
    return (np.sqrt(squares.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def nearest(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From all entries: each row's list of its ``b`` closest (ties: lower index first), their lower bounds, one outer bound for
    all entries that are not listed, and the squared distance of the closest."""
    all_, k = squared(x, entries), len(entries)
    if all_.max(initial=0) < 1 << 54:  # distance and entry as one number: only the least few are put in order
        keys = all_ * 256 + np.arange(k)
        if b + 1 < k:
            keys = np.partition(keys, b, axis=1)[:, : b + 1]
        keys = np.sort(keys, axis=1)
        order, sorted_ = keys % 256, keys // 256
    else:
        order = np.argsort(all_, axis=1, kind="stable")[:, : b + 1]
        sorted_ = np.take_along_axis(all_, order, axis=1)
    listed = np.zeros((len(x), b), dtype=np.uint8)  # a place whose bound is infinite is unused
    bounds = np.full((len(x), b), np.inf, dtype=np.float32)
    have = min(b, k)
    listed[:, :have], bounds[:, :have] = order[:, :have], low(sorted_[:, :have])
    outer = low(sorted_[:, b]) if k > b else np.full(len(x), np.inf, dtype=np.float32)
    return listed, bounds, outer, sorted_[:, 0]


def step(x: np.ndarray, entries: np.ndarray, drift: np.ndarray, listed: np.ndarray, bounds: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assigns rows again after the entries moved by at most ``drift``; returns lists, bounds, outer bounds, squared distances of the
    closest entries, and how deep each row had to look in its list (``ALL``: at all entries).

    A listed entry's bound falls by its own drift, the outer one by the largest. The distance from the entry assigned so far is
    taken exactly; an entry whose bound is not above it could be as close, and is then measured exactly, in whole numbers. Where
    the outer bound is not above it, all entries are measured.
    """
    n, had = listed.shape
    used = np.isfinite(bounds)
    move = drift[listed]
    bounds = np.nextafter(((bounds - move) * np.where(bounds > move, 1 - SLACK, 1 + SLACK)).astype(np.float32), np.float32(-np.inf))
    outer = np.nextafter(((outer - drift.max(initial=0.0)) * np.where(outer > drift.max(initial=0.0), 1 - SLACK, 1 + SLACK)).astype(np.float32), np.float32(-np.inf))
    best = paired(x, entries[listed[:, 0]])
    bounds[:, 0] = low(best)
    bounds[~used] = np.inf
    reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    doubt = (bounds <= reach[:, None]) & used
    doubt[:, 0] = False
    every = outer <= reach
    deep = np.where(doubt.any(axis=1), had - np.argmax(doubt[:, ::-1], axis=1), 1)
    deep[every] = ALL
    row, place = np.nonzero(doubt & ~every[:, None])
    if len(row):
        which = listed[row, place]
        exact = paired(x[row], entries[which])
        bounds[row, place] = low(exact)
        order = np.lexsort((which, exact, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]  # the closest of each row's doubtful entries
        r, z, e = row[first], place[first], exact[first]
        closer = (e < best[r]) | ((e == best[r]) & (listed[r, z] < listed[r, 0]))
        r, z, e = r[closer], z[closer], e[closer]
        listed[r, z], listed[r, 0] = listed[r, 0], listed[r, z]
        bounds[r, z], bounds[r, 0] = bounds[r, 0], bounds[r, z]
        best[r] = e
    if b < had:
        outer = np.minimum(outer, bounds[:, b:].min(axis=1, initial=np.inf))  # what leaves a list falls under the outer bound
        listed, bounds = listed[:, :b].copy(), bounds[:, :b].copy()
    elif b > had:
        listed = np.pad(listed, ((0, 0), (0, b - had)))
        bounds = np.pad(bounds, ((0, 0), (0, b - had)), constant_values=np.inf)
    order = np.argsort(bounds[:, 1:], axis=1, kind="stable") + 1  # the rest of a list in order of its bounds
    listed[:, 1:], bounds[:, 1:] = np.take_along_axis(listed, order, axis=1), np.take_along_axis(bounds, order, axis=1)
    if every.any():
        listed[every], bounds[every], outer[every], best[every] = nearest(x[every], entries, b)
    return listed, bounds, outer, best, deep


STATE = "row long, vec_id long, `{0}` {1}, data binary, codes binary, errors binary, lists binary, bounds binary, outers binary, deep binary"


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def assign(rows: DataFrame, d: int, books: np.ndarray, b: int, label: str, before: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """Every part's closest entry, with its list and bounds for the next round, as a written table.

    ``books``: entries by part; ``before``: those of the round before and the length of the lists in ``rows``; none at first.
    """
    width, parts = d // PARTS, len(books)
    drift = None if before is None else np.sqrt(((books - before[0]).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLACK)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("data"), d).reshape(n, parts, width)
            lists, bounds = np.empty((n, parts, b), np.uint8), np.empty((n, parts, b), np.float32)
            outers, errors, deep = np.empty((n, parts), np.float32), np.empty((n, parts), np.int64), np.zeros((n, parts), np.uint16)
            if before is not None:
                had = before[1]
                old = [np.frombuffer(b"".join(batch.column(c).to_pylist()), k).reshape(n, parts, -1) for c, k in (("lists", np.uint8), ("bounds", np.float32), ("outers", np.float32))]
            for p in range(parts):
                if before is None:
                    lists[:, p], bounds[:, p], outers[:, p], errors[:, p] = nearest(x[:, p], books[p], b)
                    continue
                got = step(x[:, p], books[p], drift[p], old[0][:, p, :had].copy(), old[1][:, p, :had].copy(), old[2][:, p, 0].copy(), b)
                lists[:, p], bounds[:, p], outers[:, p], errors[:, p], deep[:, p] = got
            codes = lists[:, :, 0].copy()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "vec_id", label, "data")], _packed(codes), _packed(errors), _packed(lists), _packed(bounds), _packed(outers), _packed(deep)],
                ["row", "vec_id", label, "data", "codes", "errors", "lists", "bounds", "outers", "deep"],
            )

    kind = rows.schema[label].dataType.simpleString()
    return saved(by_batch(rows, build, STATE.format(label, kind)), "codes")


def updated(state: DataFrame, d: int, books: np.ndarray) -> np.ndarray:
    """The entries after a round: the floor of the mean of their parts; those that nothing chose stay.

    A task sums what it has read to one row for each entry; Spark adds the tasks' sums up.
    """
    parts, k, width = books.shape

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(parts * k * width, dtype=np.int64), np.zeros(parts * k, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("data"), d).reshape(n, parts, width).astype(np.int64)
            entry = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts) + np.arange(parts) * k
            counts += np.bincount(entry.ravel(), minlength=parts * k)
            order = np.argsort(entry.ravel(), kind="stable")
            cuts = np.flatnonzero(np.diff(entry.ravel()[order], prepend=-1))
            sums.reshape(-1, width)[entry.ravel()[order][cuts]] += np.add.reduceat(x.reshape(-1, width)[order], cuts, axis=0)
        met = np.flatnonzero(counts)
        place = (met[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[place]), pa.array(np.repeat(counts[met], width))], ["place", "total", "n"])

    added = by_batch(state.select("data", "codes"), build, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.reshape(-1).copy()
    out[added["place"].to_numpy()] = added["total"].to_numpy() // added["n"].to_numpy()  # rounds down
    return out.reshape(books.shape)


def depths(state: DataFrame) -> np.ndarray:
    """How many parts looked how deep in their lists; the last number is of those that had to look at all entries."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(ENTRIES + 2, dtype=np.int64)
        for batch in batches:
            met += np.bincount(np.minimum(np.frombuffer(b"".join(batch.column("deep").to_pylist()), np.uint16), ENTRIES + 1), minlength=ENTRIES + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENTRIES + 2)), pa.array(met)], ["deep", "n"])

    found = by_batch(state.select("deep"), build, "deep long, n long").groupBy("deep").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ENTRIES + 2, dtype=np.int64)
    out[found["deep"].to_numpy()] = found["n"].to_numpy()
    return out


def adapted(b: int, met: np.ndarray) -> int:
    """The lists' next length: as short as nearly all parts that made do with their lists allow, and never longer than before."""
    total = int(met.sum())
    return next((i for i in range(min(LEAST, b), b) if met[i + 1 :].sum() <= DEEP_SHARE * total), b)


def first_entries(rows: DataFrame, d: int, parts: int) -> np.ndarray:
    """The parts of the ``ENTRIES`` rows of smallest vec_id; equal ids in order of their components, null ids last."""
    firsts = rows.orderBy(F.asc_nulls_last("vec_id"), "data").limit(ENTRIES).select("data").toArrow()["data"]
    return matrix(firsts, d).astype(np.int64).reshape(-1, parts, d // parts).transpose(1, 0, 2).copy()


def train(rows: DataFrame, d: int, label: str, rounds: int = ROUNDS, first: int = FIRST) -> tuple[np.ndarray, DataFrame, list[int]]:
    """The final codebooks, the table of codes by them, and the lengths that the lists had."""
    books, b, before, lengths = first_entries(rows, d, PARTS), first, None, []
    state = assign(rows, d, books, b, label)
    emptied(rows)
    for _ in range(rounds):
        lengths.append(b)
        moved = updated(state, d, books)
        was = b
        if before is not None:
            b = adapted(b, depths(state)[:-1])
        before, books = books, moved
        state, old = assign(state, d, books, b, label, (before, was)), state
        emptied(old)
    return books, state, [*lengths, b]


def encode(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector.

    Components become floor(1024 * x); vectors are cut in four equal parts. Each part position has a codebook that starts as the
    parts of the 256 smallest vec_ids and is moved to the floor of its parts' means four times; then parts are assigned again.
    Each part keeps its b closest entries with lower bounds and one outer bound in a written table; b shrinks to what a round needed,
    and a round's table is emptied once the next one is written.
    Where a bound leaves a doubt, whole-number distances decide, so codes are exact.

    Vectors that are null or hold null or non-finite components give no row. Shorter vectors are filled with zeros to the longest
    one's length, and all to a multiple of four. Ties: lower entry. Null vec_id: takes part, last in order. Repeated rows each have
    their row; of equal ids the lesser components come first. Null labels are one label. An empty table gives no rows. Extra columns
    are ignored. Components of 2^21 or more in absolute value, or so large that a squared distance leaves 64 bits, are an error.
    """
    d = max(1, -(-length(vectors, vector) // PARTS)) * PARTS
    rows = whole(vectors, d, (label,), vector)
    if rows.isEmpty():
        return rows.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    books, state, _ = train(rows, d, label)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            error = np.frombuffer(b"".join(b.column("errors").to_pylist()), np.int64).reshape(b.num_rows, PARTS).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column(label), pa.array([c.hex() for c in b.column("codes").to_pylist()], pa.string()), pa.array(error)], ["vec_id", label, "code", "error"])

    kind = rows.schema[label].dataType.simpleString()
    coded = by_batch(state.select("vec_id", label, "codes", "errors"), build, f"vec_id long, `{label}` {kind}, code string, error long")
    group, total = fresh(coded, "of_label", "label_error")
    sums = saved(coded.groupBy(label).agg(F.sum("error").alias(total)).withColumnRenamed(label, group), "label-errors")
    return beside(coded, sums, F.col(label).eqNullSafe(F.col(group))).select("vec_id", "code", "error", F.col(total).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Codebook ``i`` from the assignment to codebook ``i - 1``."""
    return f"""
     a{i} AS MATERIALIZED (SELECT row, p, any_value(x) AS x, min(struct_pack(e := e, j := j)) AS a FROM (SELECT v.row, v.p, v.x, c.j, list_inner_product(v.x, v.x) + list_inner_product(c.c, c.c) - 2 * list_inner_product(v.x, c.c) AS e FROM v JOIN c{i - 1} c USING (p)) q GROUP BY row, p),
     m{i} AS (SELECT p, j, list(m ORDER BY k) AS m FROM (SELECT p, a.j AS j, k, floor(sum(y) / count(*)) AS m FROM (SELECT p, a, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS k FROM a{i}) q GROUP BY p, a.j, k) q GROUP BY p, j),
     c{i} AS MATERIALIZED (SELECT p, j, coalesce(m, c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (p, j)),"""


ENCODE_SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     v AS MATERIALIZED (SELECT row, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM k, (SELECT unnest(range(4)) AS p) s),
     c0 AS MATERIALIZED (SELECT p, row - 1 AS j, x AS c FROM v WHERE row <= 256),{"".join(_round_sql(i) for i in range(1, ROUNDS + 1))}
     z AS (SELECT row, p, min(struct_pack(e := e, j := j)) AS a FROM (SELECT v.row, v.p, c.j, list_inner_product(v.x, v.x) + list_inner_product(c.c, c.c) - 2 * list_inner_product(v.x, c.c) AS e FROM v JOIN c{ROUNDS} c USING (p)) q GROUP BY row, p),
     r AS (SELECT row, string_agg(lower(printf('%02x', a.j::INT)), '' ORDER BY p) AS code, sum(a.e)::BIGINT AS error FROM z GROUP BY row),
     h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, j, k)) AS h FROM (SELECT p, j, unnest(c) AS y, unnest(range(1, len(c) + 1)) AS k FROM c{ROUNDS}) q)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN r USING (row), h
"""
