"""Ranked lexical search by dense blocks: document impacts times item weights as exact whole numbers in float64 products."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rulelens.llm.common import by_batch, saved

TOP = 50
GROUP_PAIRS = 500_000  # (item, term) pairs of the items that go through the documents together; bounds what is broadcast
TILE_ITEMS, TILE_PAIRS = 64, 1 << 16  # items of a tile, and their terms with repeats
DOCS, ENTRIES = 512, 1 << 20  # documents of a tile, and their entries
CHUNK = 4096  # terms of one product
SLICES = 64  # parts in which an item's hits are ranked first

# An impact is at most 10^6 and a weight less than 1000 * ln(2^64) < 44,362, so each partial sum of a product stays below 2^53.
assert CHUNK * 44_362 * 10**6 < 1 << 53

# Letters A-Z become a-z; all other ASCII characters but letters and digits part terms; bytes from 128 on belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text, with repeats; a null text has none."""
    return (text or b"").translate(FOLD).split()


def texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each, as a written table; rows of equal item_id are one item."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in texts(b)]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(owner)), pa.array([x for f in found for x in f], pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return saved(by_batch(items.select("item_id", "text"), build, f"item_id {kind}, term binary").distinct(), "item-terms")


class Tile:
    """Some items with their compact vocabulary: its numbers in the group's vocabulary, and the items' places in it."""

    def __init__(self, items: list, members: list[np.ndarray]):
        self.items = items
        self.slots = np.unique(np.concatenate(members))
        self.slot = np.concatenate([np.searchsorted(self.slots, m) for m in members])
        self.item = np.repeat(np.arange(len(items)), [len(m) for m in members])

    def weights(self, w: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Dense weights of the terms lo to hi of the tile, a column an item."""
        inside = (self.slot >= lo) & (self.slot < hi)
        out = np.zeros((hi - lo, len(self.items)))
        out[self.slot[inside] - lo, self.item[inside]] = w[self.slots[self.slot[inside]]]
        return out


def tiles(pairs: pa.Table) -> tuple[dict[bytes, int], list[Tile]]:
    """The vocabulary of a group of items, and its tiles. A tile ends at ``TILE_ITEMS`` items or ``TILE_PAIRS`` of their terms."""
    pairs = pairs.sort_by([("item_id", "ascending"), ("term", "ascending")])
    vocabulary: dict[bytes, int] = {}
    numbers = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in pairs["term"].to_pylist()], dtype=np.int64)
    ids = pairs["item_id"].to_pylist()
    cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    out, held, members, size = [], [], [], 0
    for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
        if held and (len(held) == TILE_ITEMS or size + hi - lo > TILE_PAIRS):
            out.append(Tile(held, members))
            held, members, size = [], [], 0
        held.append(ids[lo])
        members.append(numbers[lo:hi])
        size += hi - lo
    return vocabulary, out + ([Tile(held, members)] if held else [])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms in the document with their occurrences, as a written table.

    Documents without terms have no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number, other = known.get, len(known)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                found = terms(text)
                if not found:
                    continue
                which, times = np.unique(np.fromiter(map(number, found, repeat(other)), np.uint32, len(found)), return_counts=True)
                have = slice(None, -1) if which[-1] == other else slice(None)
                for column, value in zip(rows, (doc_id, len(found), which[have].tobytes(), times[have].astype(np.uint32).tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(by_batch(rows, build, "doc_id long, n long, terms binary, times binary"), "term-counts")


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; a task sends one row for each term that it has met."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.uint32), minlength=size)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "df"])

    found = by_batch(counts.select("terms"), build, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


class Best:
    """The best ``top`` documents of each item of a tile so far: highest score first, then smallest doc_id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores`` has a row a document. A document that ties with an item's last one is weighed by its id, never passed over."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        doc, null = np.concatenate([self.doc, doc[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - first[item[order]]
        kept = order[place < self.top]
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m)"""
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def hits(counts: DataFrame, tiled: list[Tile], w: np.ndarray, n_docs: int, n_terms: int, top: int, kind: T.DataType) -> DataFrame:
    """Each task's best documents of every item (item_id, doc_id, score)."""
    shared = counts.sparkSession.sparkContext.broadcast((tiled, w))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiled, w = shared.value
        best = [Best(len(t.items), top) for t in tiled]

        def score(rows: list[tuple]) -> None:
            null = np.array([r[0] is None for r in rows])
            doc = np.array([r[0] or 0 for r in rows], dtype=np.int64)
            found = [np.frombuffer(r[2], np.uint32).astype(np.int64) for r in rows]
            row, which = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)
            m = np.array([100 - 50 + 50 * r[1] * n_docs // n_terms for r in rows], dtype=np.int64)  # whole numbers without a limit
            impact = impacts(np.frombuffer(b"".join(r[3] for r in rows), np.uint32).astype(np.int64), m[row]).astype(np.float64)
            place = np.empty(len(w), dtype=np.int64)
            for tile, held in zip(tiled, best):
                place.fill(-1)
                place[tile.slots] = np.arange(len(tile.slots))
                at = place[which]
                total = np.zeros((len(rows), len(tile.items)), dtype=np.int64)
                for lo in range(0, len(tile.slots), CHUNK):
                    hi = min(lo + CHUNK, len(tile.slots))
                    inside = np.flatnonzero((at >= lo) & (at < hi))
                    dense = np.zeros((len(rows), hi - lo))
                    dense[row[inside], at[inside] - lo] = impact[inside]
                    total += (dense @ tile.weights(w, lo, hi)).astype(np.int64)
                held.add(total, doc, null)

        rows, entries = [], 0
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "times")]):
                if r[2]:
                    rows.append(r)
                    entries += len(r[2]) // 4
                if len(rows) == DOCS or entries > ENTRIES:
                    score(rows)
                    rows, entries = [], 0
        if rows:
            score(rows)
        for tile, held in zip(tiled, best):
            yield pa.RecordBatch.from_arrays([pa.array([tile.items[i] for i in held.item], arrow_kind), pa.array(held.doc, mask=held.null), pa.array(held.score)], ["item_id", "doc_id", "score"])

    arrow_kind = to_arrow_schema(T.StructType([T.StructField("item_id", kind)])).field(0).type
    return by_batch(counts, build, f"item_id {kind.simpleString()}, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each item with their rank, taken in slices first so that no task gets all of a task's answers."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    some = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` highest-scoring documents with a score above 0, among all ``docs``.

    Whole texts are counted once against the items' vocabulary; then each tile of documents, a dense block of impacts, is
    multiplied with each tile of items, a dense block of weights over the tile's compact vocabulary. Impacts and weights are
    whole numbers whose partial sums stay below 2^53, so the products are exact in float64; they are added up as 64-bit whole
    numbers. Items with more than ``GROUP_PAIRS`` terms in all go through the documents in several groups.

    Null and empty texts: no terms, so neither counted nor found; such items give no rows. Very long texts are counted whole.
    Ties: smaller doc_id first, null ids last. Repeated rows of ``docs`` are documents of their own; rows of ``items`` with equal
    item_id (null ids too) are one item with all their terms. Empty tables give no rows. Extra columns are ignored.
    """
    kind = items.schema["item_id"].dataType
    pairs = item_terms(items)
    groups = max(1, -(-pairs.count() // GROUP_PAIRS))
    out = None
    for g in range(groups):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()
        vocabulary, tiled = tiles(mine)
        counts = counted(docs, vocabulary)
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        df = frequencies(counts, len(vocabulary))
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.float64)
        found = hits(counts, tiled, w, n_docs, n_terms or 1, top, kind)
        out = found if out is None else out.union(found)
    return ranked(out, top)


SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS words FROM t WHERE len(t) > 0),
     i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     d AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM t),
     c AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
     f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
     w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
     p AS (SELECT c.doc_id, c.term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS impact FROM c, s),
     r AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id),
     o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
