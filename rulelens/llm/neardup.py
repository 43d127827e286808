"""MinHash near-duplicates by fast similarity sketches, banding and exact verification on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from rulelens.llm.common import by_batch, by_group, fresh, runs, saved, tidy
from rulelens.llm.graph import components

WORDS = 5
BINS, ROWS = 192, 6  # 32 bands: a link of similarity 0.85 is missed with a chance of 3e-7
SURE = 5.0  # standard errors below the threshold from which a sketch rules a pair out
BLOCK = 1024  # documents of a bucket that are compared with as many
SETTLED = 0.05  # share of open documents that a round of stars must join for another round
VOCABULARY = 300_000  # words whose hashes a worker keeps

# Odd multipliers of common 64-bit mixers.
STEP, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.iinfo(np.uint64).max
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return z ^ (z >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, kept as they come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text; of all its words if they are fewer."""
    found = (text or "").encode().translate(LOWER).split()  # splits at bytes 9 to 13 and 32
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    words = min(words, len(h))
    n = len(h) - words + 1
    out = h[:n] + np.uint64(words)
    for i in range(1, words):
        out = out * FOLD + h[i : i + n]
    return np.unique(mix(out))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch: in round r every item falls in a bin by hash r, in round bins + j all fall in bin j.

    A bin keeps its least value, earlier rounds first, so every bin is filled after at most two rounds a bin, and mostly
    after a few.
    """
    out, r, at_once = np.full(bins, EMPTY), 0, max(1, 2048 // len(items))
    while (out == EMPTY).any():
        rounds = np.arange(r, min(r + at_once, 2 * bins), dtype=np.uint64)[:, None]
        h = mix(items + STEP * (rounds + np.uint64(1)))
        where = np.where(rounds < bins, h % np.uint64(bins), rounds - np.uint64(bins)).astype(np.int64)
        np.minimum.at(out, where.ravel(), ((h >> np.uint64(12)) | (rounds << np.uint64(52))).ravel())
        r += at_once
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a sketch."""
    grid = coordinates.reshape(-1, rows)
    key = np.arange(len(grid), dtype=np.uint64) * STEP
    for column in grid.T:
        key = mix(key * FOLD + column)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for b in batches:
        sets = [shingles(t, hashes) for t in b.column("text").to_pylist()]
        sketches = [sketch(s) if len(s) else None for s in sets]
        arrays = [
            b.column("doc_id"), b.column("rid"), b.column("tid"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([None if k is None else bands(k) for k in sketches], pa.list_(pa.int64())), pa.array([None if k is None else mix(k).astype(np.uint8).tobytes() for k in sketches], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rid", "tid", "node", "n", "bands", "bytes"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rid (finds the text again), tid (hash of the text), node (128-bit hash of the shingle set; null for none), n, bands, sketch bytes."""
    return by_batch(_with_rid(docs), _sign, "doc_id long, rid long, tid long, node binary, n long, bands array<long>, bytes binary")


def _with_rid(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), F.xxhash64("text").alias("tid"), "text")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for b in batches:
        sets = [shingles(t, hashes).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "items"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.selectExpr("node as a", "items as x"), "a")
    return by_batch(left.join(sets.selectExpr("node as b", "items as y"), "b").select("a", "b", "x", "y"), check, "a binary, b binary")


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the buckets whose documents have different labels yet, with their labels. Labels only merge, so that a bucket which
    is settled once need not be looked at again."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    rows = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def _star_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each open document with its buckets' centres, drawn by hash: never more pairs than rows. In the first turn the buckets of a
    family share a centre, which joins most of it with few pairs; later each bucket has its own, so that many are tried at once."""
    drawn = F.xxhash64("node", F.lit(turn)) if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn))
    centres = rows.groupBy("bucket").agg(F.min(F.struct(drawn, F.col("node").alias("centre"), F.col("n").alias("m"), F.col("label").alias("other"))).alias("c"))
    pairs = rows.join(centres.select("bucket", "c.centre", "c.m", "c.other"), "bucket").where("label <> other").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _likely(rows: dict[str, list], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one block pair with different labels, whose sketches do not rule out the threshold, and that share no
    earlier band."""
    numbers: dict[bytes, int] = {}
    label = np.array([numbers.setdefault(x, len(numbers)) for x in rows["label"]])
    if len(numbers) < 2:
        return
    side, n, band = np.array(rows["side"]), np.array(rows["n"]), rows["band"][0]
    codes = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(len(n), -1)
    keys = np.array(rows["bands"])
    share = percent / 100
    least = (share - SURE * (share * (1 - share) / codes.shape[1]) ** 0.5) * codes.shape[1]
    alone = rows["p"][0] == rows["q"][0]
    left, right = (np.arange(len(n)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for i in left:
        j = right[right > i] if alone else right
        j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
        if len(j):
            j = j[(codes[j] == codes[i]).sum(axis=1) >= least]
        if len(j) and band:
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        for k in j:
            yield int(i), int(k)


def _block_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between documents with different labels that share a bucket, at most a tree of them for each pair of blocks.

    A bucket is cut in blocks of about ``BLOCK`` documents; every two blocks meet in one task of bounded size. First sketches
    tell which documents have a likely partner there; only those bring their whole sets, which decide.
    """
    counts = rows.groupBy("bucket").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("blocks"))
    dealt = rows.join(counts, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("yours", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", "band", F.least("mine", "yours").alias("p"), F.greatest("mine", "yours").alias("q"), F.when(F.col("mine") > F.col("yours"), 1).otherwise(0).alias("side"), "node", "label", "n")
    dealt = dealt.join(nodes.select("node", "bands", "bytes"), "node")
    dealt = dealt.select("bucket", "band", "p", "q", "side", "node", "label", "n", "bands", "bytes")

    def partners(rows: dict[str, list]) -> list[tuple]:
        wanted = sorted({i for pair in _likely(rows, percent) for i in pair})
        return [tuple(c[i] for c in rows.values()) for i in wanted]

    def decide(rows: dict[str, list]) -> list[tuple]:
        items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        root, out = {x: x for x in rows["label"]}, []

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in _likely(rows, percent):
            x, y = find(rows["label"][i]), find(rows["label"][j])
            if x != y and linked(items[i], items[j], percent):
                root[x] = y
                out.append((rows["node"][i], rows["node"][j]))
        return out

    by, order = ["bucket", "band", "p", "q"], ["side", "node"]
    likely = saved(by_group(dealt, by, order, partners, dealt.schema), "likely")
    pairs = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return by_group(likely.join(sets, "node").select(*dealt.columns, "items"), by, order, decide, pairs)


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, tid, n, label and component_id of every row; rows of a group share the label, rows without words have none.

    Equal sets are one node, so copies never meet each other. Bands give buckets; rounds of stars join the bulk of every group
    with no more checks than rows; then each bucket that still holds different labels is searched wholly, in blocks. Every link
    counts only after a check on whole sets, so groups are exact but for links that no band shares (a chance of 3e-7 each).
    """
    spark = docs.sparkSession
    signed = saved(signatures(docs), "signatures")
    nodes = saved(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("lo"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "nodes")
    each = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = F.col("many") | F.col("edge")  # a bucket that ends a task's rows may go on in the next
    rows = saved(runs(each.select("bucket", "band", "node", "n"), ["bucket"], ["band"], ["node"]).where(shared).drop("many", "split", "edge"), "buckets")
    tidy(spark)
    wanted = rows.select("node").distinct().join(nodes.select("node", "rid"), "node").select("rid").distinct()
    again = by_batch(_with_rid(docs).join(wanted, "rid", "left_semi"), _sets, "node binary, items binary")
    sets = saved(again.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
    tidy(spark)

    links, labels, turn, still = None, None, 0, rows
    while True:
        still = saved(_open(still, labels), "open") if turn else _open(rows, None)
        waiting = still.agg(F.countDistinct("label")).first()[0]
        if not waiting:
            break
        new = saved(_verify(_star_pairs(still, percent, turn), sets, percent), "star-links")
        links = new if links is None else links.union(new)
        joined, turn = new.count(), turn + 1
        if joined:
            labels = components(links)
        if joined <= SETTLED * waiting:
            break
    still = saved(_open(still, labels), "open")
    last = saved(_block_links(still, nodes, sets, percent), "block-links")
    labels = components(last if links is None else links.union(last))

    smallest = nodes.select("node", "lo").join(labels, "node").groupBy("label").agg(F.min("lo").alias("component"))
    grouped = labels.join(smallest, "label").select("node", "label", "component")
    own = nodes.select("node", "lo").join(grouped, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("component", "lo").alias("component"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return signed.select("doc_id", "tid", "n", "node").join(own, "node", "left").select("doc_id", "tid", "n", "label", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: components of the links 100 * both >= percent * either.

    Null, empty and blank texts: no shingles, linked with nothing, component_id = doc_id. Null doc_id: takes part, and is null
    in a component only if all its ids are. Repeated rows: equal ids are all kept. Extra columns are ignored. An empty table
    gives no rows. Very long texts are shingled whole.
    """
    out = groups(docs, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (a null one last), then of the least text hash.

    Rows without words are linked with nothing and all stay, with their columns as they are.
    """
    key, tid, copies = fresh(docs, "key", "tid", "copies")
    rows = groups(docs, percent)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tid"))
    first = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.tid").alias("tid"))
    counted = rows.where("label is not null").groupBy("doc_id", "tid").agg(F.count("*").alias("n"))
    first = first.join(counted, first["doc_id"].eqNullSafe(counted["doc_id"]) & (first["tid"] == counted["tid"])).select(first["doc_id"], first["tid"], "n")
    blank = rows.where("label is null").select("doc_id", "tid").distinct().withColumn("n", F.lit(1).cast("long"))
    stay = first.union(blank).select(F.col("doc_id").alias(key), F.col("tid").alias(tid), F.col("n").alias(copies))
    kept = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(tid)))
    twice = kept.where(F.col(copies) > 1).dropDuplicates([key, tid])  # rows repeated as a whole
    return kept.where(F.col(copies) == 1).union(twice).drop(key, tid, copies)


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
     r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.c = p.a),
     m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
