"""Locally consistent parsing: phrases cut by deterministic coin tossing, named level by level, and signatures of the names.

Where phrases begin depends on a few symbols around, never on the offset, so two texts that share a string share the names of
all phrases inside it but for a few at its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import by_batch

LEVELS = (2, 3)  # levels whose phrases sign a text: some 8 and 25 bytes long
KEEP = 64  # least names of a signature
GROUP = 1 << 18  # bytes of texts that are parsed side by side
NONE = np.uint64(1 << 32)  # fills a signature that has fewer names
ONE = np.uint64(1)
FOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # odd multipliers of a common mixer


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * FOLD + b * MIX
    x ^= x >> np.uint64(31)
    x *= MIX
    return x ^ (x >> np.uint64(29))


def _toss_table() -> np.ndarray:
    """For a byte and the one before it: twice the place of their lowest differing bit, and its value."""
    x = np.arange(1 << 16)
    before, now = x >> 8, x & 255
    differ = before ^ now
    place = np.bitwise_count((differ & -differ) - (differ > 0)).astype(np.int64)
    return (2 * place + (now >> place & 1)).astype(np.uint8)


TOSS = _toss_table()


def _before(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The label before each; at a start its own complement."""
    out = np.empty_like(labels)
    out[1:] = labels[:-1]
    out[starts] = ~labels[starts]
    return out


def colours(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three colours, 1 to 3, for sequences without equal neighbours, so that neighbours differ.

    Tossing the lowest differing bit takes 64 bits to 7, and three more rounds take those to six labels. Then all symbols of
    one label, which are never neighbours, are recoloured at once. A colour depends on five symbols before and three after.
    """
    if symbols.dtype != np.uint8:
        x = symbols ^ _before(symbols, starts)
        place = np.bitwise_count((x & (~x + ONE)) - ONE)
        symbols = place * np.uint8(2) + ((symbols >> place.astype(np.uint64)) & ONE).astype(np.uint8)
    for _ in range(3):
        symbols = TOSS[_before(symbols, starts).astype(np.uint16) << np.uint16(8) | symbols]
    first, last = np.zeros(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
    first[starts], last[starts[1:] - 1], last[-1] = True, True, True
    out = symbols + np.uint8(1)
    for c in (4, 5, 6):
        at = np.flatnonzero(out == c)
        a, b = np.where(first[at], 0, out[at - 1]), np.where(last[at], 0, out[np.minimum(at + 1, len(out) - 1)])
        out[at] = np.where((a != 1) & (b != 1), 1, np.where((a != 2) & (b != 2), 2, 3))
    return out


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]  # of FOLD and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(FOLD), -1, 1 << 64))
        for i, base in enumerate((FOLD, inverse)):
            steps = np.full(2 * n, base)
            steps[0] = ONE
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level of sequences side by side: names of phrases, and where each sequence starts among them.

    A run of one symbol becomes one symbol that knows its length. Phrases begin at local peaks of the colours, two to four
    symbols apart. A phrase's name is a polynomial of its symbols, taken from running sums, and its size.
    """
    head = np.empty(len(names), dtype=bool)
    head[1:] = names[1:] != names[:-1]
    head[starts] = True
    at = np.flatnonzero(head)
    starts = np.searchsorted(at, starts)
    symbols, run = names[at], np.diff(at, append=len(names))
    colour = colours(symbols, starts)
    peak = np.ones(len(at), dtype=bool)
    peak[1:] = colour[1:] > colour[:-1]
    rise = peak.copy()
    rise[starts] = True
    fall = np.ones(len(at), dtype=bool)
    fall[:-1] = colour[:-1] > colour[1:]
    fall[starts[1:] - 1] = True
    peak = rise & fall
    peak[starts] = True
    value = symbols.astype(np.uint64) + ONE
    long = run > 1
    value[long] = _name(value[long], run[long].astype(np.uint64))
    power, inverse = _powers(len(value) + 1)
    sums = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * power[: len(value)], out=sums[1:])
    begin = np.flatnonzero(peak)
    end = np.append(begin[1:], len(value))
    return _name((sums[end] - sums[begin]) * inverse[begin], (end - begin).astype(np.uint64)), np.searchsorted(begin, starts)


def _sign(texts: list[bytes], keep: int, levels: tuple[int, ...]) -> np.ndarray:
    out = np.full((len(texts), keep), NONE)
    size = np.array([len(t) for t in texts])
    full = np.flatnonzero(size)
    if not len(full):
        return out
    names, starts = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(size) - size)[full]
    found = []
    for level in range(1, max(levels) + 1):
        names, starts = phrases(names, starts)
        if level in levels:
            of = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(starts, append=len(names)))
            found.append(of << np.uint64(48) | _name(names, np.full(1, level, np.uint64)) >> np.uint64(16))
    each = np.sort(np.concatenate(found))  # a text's names together, equal ones beside each other
    place = np.arange(len(each))
    first = np.maximum.accumulate(np.where(np.append(True, each[1:] != each[:-1]), place, 0))
    of = each >> np.uint64(48)
    codes = np.unique(of << np.uint64(32) | _name(each << np.uint64(16), (place - first).astype(np.uint64)) >> np.uint64(32))
    of = (codes >> np.uint64(32)).astype(np.int64)
    rank = np.arange(len(codes)) - np.searchsorted(of, np.arange(len(full)))[of]
    least = rank < keep
    out[full[of[least]], rank[least]] = codes[least] & (NONE - ONE)
    return out


def signatures(texts: list[str], keep: int = KEEP, levels: tuple[int, ...] = LEVELS) -> np.ndarray:
    """A row a text: the least 32-bit hashes of its phrase names in order, filled with ``NONE`` if they are fewer.

    A name counts as often as it occurs: its second occurrence is hashed apart from its first, and so on.
    """
    out, group, size = [np.zeros((0, keep), dtype=np.uint64)], [], 0
    for text in texts:
        group.append(text.encode())
        size += len(group[-1])
        if size > GROUP or len(group) == 1 << 15:
            out.append(_sign(group, keep, levels))
            group, size = [], 0
    if group:
        out.append(_sign(group, keep, levels))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of two tables of signatures the estimated share of common names: of the least names of both together,
    those that both have. 1 for two empty texts."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both < NONE
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, axis=1)
    common = ((real & ~new) & (rank <= a.shape[1])).sum(axis=1)
    among = np.minimum(rank[:, -1], a.shape[1])
    return np.where(among == 0, 1.0, common / np.maximum(among, 1))


def text_of(codes: np.ndarray) -> str:
    return codes[codes < NONE].astype(">u4").tobytes().hex()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_of(c) for c in signatures([t or "" for t in b.column("text").to_pylist()])], pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: the signature's names in hexadecimal.

    Null and empty text: the empty fingerprint. Null doc_id and repeated rows: row by row. Extra columns are ignored. An empty
    table gives no rows. Texts are parsed whole, whatever their length.
    """
    return by_batch(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _fingerprint_batches, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in COMPARED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting = None  # the last row, its text and its signature, until its successor comes
    for b in batches:
        if not b.num_rows:
            continue
        ids, parts, extra = (b.column(c).to_pylist() for c in ("doc_id", "part", "extra"))
        texts = [t or "" for t in b.column("text").to_pylist()]
        mine = signatures(texts)
        if waiting is not None:
            ids, parts, extra, texts, mine = [waiting[0], *ids], [waiting[1], *parts], [waiting[2], *extra], [waiting[3], *texts], np.concatenate([waiting[4], mine])
        waiting = ids[-1], parts[-1], extra[-1], texts[-1], mine[-1:]
        at = np.array([i for i in range(len(ids) - 1) if parts[i] == parts[i + 1] and not extra[i]], dtype=np.int64)
        new = [edited(texts[i], texts[i + 1]) for i in at]
        changed = signatures(new)
        arrays = [
            [ids[i] for i in at], [len(texts[i]) for i in at], [hashlib.sha256(t.encode()).hexdigest() for t in new], [text_of(mine[i]) for i in at], [text_of(c) for c in changed],
            likeness(mine[at], changed), likeness(mine[at], mine[at + 1]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(arrays, types)], names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending doc_id.

    Ids are cut at their quantiles in as many ranges as shuffle partitions. A range is sorted and streamed through one task, and
    ends with the first document of the next, so that texts move once and none is held but two.

    The last document's next is the first. Null text: empty. Null doc_id: after all others. Equal ids: in order of their texts.
    Extra columns are ignored. An empty table gives no rows; a single document is its own next.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda c: c > F.col("at"))))
    heads = {r["part"]: r["at"] for r in rows.groupBy("part").agg(F.max("at").alias("at")).collect()}  # a row a range
    order = sorted(heads)
    before = [(p, heads[p], order[i - 1]) for i, p in enumerate(order)]  # the first range's head also ends the last range
    few = spark.createDataFrame(before, "of int, head long, into int") if before else spark.createDataFrame([], "of int, head long, into int")
    ends = rows.join(F.broadcast(few), (F.col("part") == F.col("of")) & (F.col("at") == F.col("head"))).select("doc_id", "text", "at", F.col("into").alias("part"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("extra", F.lit(False)).unionByName(ends).repartitionByRange("part").sortWithinPartitions("part", "extra", F.desc("at"), "text")
    return by_batch(dealt.select("doc_id", "text", "part", "extra"), _compare_batches, COMPARED)
