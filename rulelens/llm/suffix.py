"""Buckets of sampled suffixes, refined by names of later offsets: removes every long byte string that occurs anywhere else.

Sorting all suffixes of a corpus would move every byte many times over. Here only sampled suffixes are sorted: in every window
of ``LENGTH`` bytes the q-gram with the least hash is its anchor, so equal windows have equal anchors at equal places. Suffixes
at anchors start in the bucket of their q-gram. Buckets are refined by sorting on the identifiers of the q-grams at later
offsets (and earlier ones, for the part of a window before its anchor): an identifier of 2d bytes is made from those of d bytes
at i and i + d. Identifiers are hashes of bytes, not numbers of sorted buckets that are written back for the next round, so this
is a variant of bucket-pointer refinement, not the method itself; equality rests on 128 bits of hashes. What shares its whole surroundings with another suffix is
repeated; what shares not even the part common to all its windows is not; the rest goes on with a finer range of windows, down
to single ones. The sort is distributed and streamed: no bucket, however large, lies in one task, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import by_batch, fresh, runs, saved, saved_by, text_bytes, tidy

LENGTH = 200  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
LEVELS = (256, 32, 4, 1)  # windows of a node, from all of an anchor down to one
CHUNK = 1 << 18  # windows of a text that are hashed at a time

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers of a common mixer
PLACE = np.uint64((1 << 20) - 1)
BYTES = np.random.default_rng(200).integers(0, 1 << 64, 256, dtype=np.uint64)  # a name for every byte


def name_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names one after the other."""
    x = a * MIX1 + b * MIX2
    x ^= x >> np.uint64(29)
    x *= MIX1
    x ^= x >> np.uint64(32)
    return x


def grams(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The name of the ``gram`` bytes at every offset, by doubling."""
    names, d = BYTES[data], 1
    while d < gram:
        names = name_of(names[:-d], names[d:])
        d *= 2
    return names


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``length`` bytes: their offsets, and the first and last window that each stands for."""
    width, found = length - gram + 1, []
    for base in range(0, len(data) - length + 1, CHUNK):
        names = grams(data[base : base + CHUNK + length - 1], gram)
        least = (names & ~PLACE) | np.arange(len(names), dtype=np.uint64)  # ties go to the first
        n, d = len(names) - width + 1, 1
        while d * 2 <= width:
            least = np.minimum(least[:-d], least[d:])
            d *= 2
        least = np.minimum(least[:n], least[width - d : width - d + n])
        found.append((least & PLACE).astype(np.int64) + base)
    at = np.concatenate(found)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def names_between(names: np.ndarray, start: np.ndarray, stop: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A name for each string [start, stop) of at least ``gram`` bytes, from the names of the q-grams that cover it."""
    out = name_of((stop - start).astype(np.uint64), names[start])
    for step in range(gram, int((stop - start).max(initial=0)), gram):
        more = start + step < stop
        out = np.where(more, name_of(out, names[np.minimum(start + step, stop - gram)]), out)
    return out


def nodes(data: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Nodes of ``size`` windows that the windows lo..hi of each anchor fall in.

    A window is told by the anchor's offset in it. Returns the index of the anchor, the node's own windows lo..hi, the name of
    the bytes that all windows of the node share, and the name of the bytes that its own windows cover together.
    """
    each = hi // size - lo // size + 1
    of = np.repeat(np.arange(len(lo)), each)
    node = np.repeat(lo // size, each) + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    names, at = grams(data, gram), offsets[of]
    first, last = node * size, np.minimum(node * size + size - 1, length - gram)
    a, b = np.maximum(first, lo[of]), np.minimum(last, hi[of])
    salt = name_of(names[at], node.astype(np.uint64) * np.uint64(512) + np.uint64(size))
    shared = name_of(salt, names_between(names, at - first, at - last + length, gram))
    covered = name_of(a.astype(np.uint64) * np.uint64(512) + b.astype(np.uint64), names_between(names, at - b, at - a + length, gram))
    return of, a, b, shared, covered


ROWS = "text_id binary, at int, lo short, hi short, open boolean, shared long, covered long"


def _rows(size: int, length: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("items").to_pylist() if "items" in b.schema.names else [None] * b.num_rows
            parts = []
            for i, (raw, given) in enumerate(zip(b.column("data").to_pylist(), items)):
                data = np.frombuffer(raw, np.uint8)
                if given is None:
                    at, start, stop = anchors(data, length)
                    lo, hi, wanted = at - stop, at - start, np.ones(len(at), dtype=bool)
                else:
                    at, lo, hi, wanted = (np.array([g[c] for g in given], dtype=k) for c, k in (("at", np.int64), ("lo", np.int64), ("hi", np.int64), ("open", bool)))
                of, a, z, shared, covered = nodes(data, at, lo, hi, size, length)
                parts.append((np.full(len(of), i), at[of], a, z, wanted[of], shared.view(np.int64), covered.view(np.int64)))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                ids = b.column("text_id").take(pa.array(columns[0]))
                kinds = [pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], ["text_id", "at", "lo", "hi", "open", "shared", "covered"])

    return build


def texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """text_id and data of every distinct text of at least ``length`` bytes, written once and dealt by text_id."""
    data = text_bytes()
    rows = docs.select(text_id().alias("text_id"), data.alias("data")).where(F.octet_length("data") >= length)
    return saved_by(rows.groupBy("text_id").agg(F.first("data").alias("data")), "text_id", "texts")


def text_id():
    """128 bits that equal texts share."""
    return F.unhex(F.substring(F.sha2(text_bytes(), 256), 1, 32))


def repeated_windows(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, first, last): runs of window starts whose ``length`` bytes occur somewhere else too, in any distinct text."""
    spark, found, rows = table.sparkSession, [], table
    for size in LEVELS:
        made = saved(by_batch(rows, _rows(size, length), ROWS), f"nodes-{size}")
        told = saved(runs(made, ["shared"], ["covered"], ["text_id", "at"]).where("many or split or edge"), f"windows-{size}")
        tidy(spark)
        span = (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last")
        found.append(told.where("many and open").select("text_id", *span))
        if size > 1:  # a text's own nodes, as many as it has windows
            items = told.where("split or edge").groupBy("text_id").agg(F.collect_list(F.struct("at", "lo", "hi", F.expr("open and not many").alias("open"))).alias("items"))
            rows = items.join(table, "text_id")
        else:  # equal windows at both sides of a task's edge
            ends = told.where("edge")
            across = ends.groupBy("shared", "covered").count().where("count > 1").select("shared", "covered")
            found.append(ends.where("open and not many").join(across, ["shared", "covered"], "left_semi").select("text_id", *span))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [from, to) of the bytes that windows starting at first..last cover."""
    order = np.argsort(first, kind="stable")
    start, stop = first[order], np.maximum.accumulate(last[order] + length)
    head = np.r_[True, start[1:] > stop[:-1]]
    return np.stack([start[head], stop[np.r_[np.flatnonzero(head)[1:] - 1, len(stop) - 1]]], axis=1)


def cut(data: bytes, spans: list) -> bytes:
    """``data`` without the bytes of ``spans``."""
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, spans, n_removed, kept_sha256) of the distinct texts that lose bytes, as a written table.

    A text that two rows have is repeated as a whole.
    """
    table = texts(docs, length)
    tidy(docs.sparkSession)
    windows = repeated_windows(table, length).groupBy("text_id").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    copied = docs.where(F.octet_length(text_bytes()) >= length).groupBy(text_id().alias("text_id")).count().where("count > 1").select("text_id", F.lit(True).alias("copied"))
    given = table.join(windows, "text_id", "left").join(copied, "text_id", "left").where("windows is not null or copied")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, removed, kept = [], [], []
            for data, windows_, copied_ in zip(b.column("data").to_pylist(), b.column("windows").to_pylist(), b.column("copied").to_pylist()):
                if copied_:
                    runs_ = [[0, len(data)]]
                else:
                    runs_ = _spans(np.array([w["first"] for w in windows_], dtype=np.int64), np.array([w["last"] for w in windows_], dtype=np.int64), length).tolist()
                spans.append(runs_)
                removed.append(sum(hi - lo for lo, hi in runs_))
                kept.append(hashlib.sha256(cut(data, runs_)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("text_id"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["text_id", "spans", "n_removed", "kept_sha256"])

    return saved(by_batch(given.select("text_id", "data", "windows", "copied"), build, "text_id binary, spans array<array<long>>, n_removed long, kept_sha256 string"), "removals")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same text or another; strings are
    judged on the input and never cross texts. Null text: empty. Null doc_id and repeated rows: judged by their texts like any
    others, so a repeated row's text is repeated. Extra columns are ignored. An empty table gives no rows.
    """
    out = removals(docs, length)
    data = text_bytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    return rows.join(out, "text_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts, and n_chars counted again if there is one.

    Bytes left of a character that was cut through are dropped. A null text stays null. All other columns stay.
    """
    key, spans = fresh(docs, "text_id", "spans")
    few = removals(docs, length).select(F.col("text_id").alias(key), F.col("spans").alias(spans))
    joined, columns = docs.withColumn(key, text_id()).join(few, key, "left"), docs.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if s is None else cut(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(b.column("text").to_pylist(), b.column(spans).to_pylist())]
            arrays = [pa.array(new, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = by_batch(joined.select(*columns, spans), build, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
