"""Token ids in binary blocks, and a minimal perfect hash index from document keys to their place in them."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import BATCH_BYTES, by_batch, saved

BLOCK_BYTES = 1 << 18  # ids of a block, unless one document alone has more
KEYS_PER_BUCKET = 50_000
GAMMA = 2.0  # slots of a level for each key that is left
LEVELS = 48
CACHE = 400_000  # words whose ids a worker keeps, twice: those met since the last change, and those before


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _visible_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Ids, as bytes, of words with what parts them from the word before: a space, or a line end kept as first character.

    None for a word that begins or ends with white space, or is empty: its ids depend on what is around it.
    """

    VISIBLE = _visible_bytes()

    def __init__(self, tokenizer, code: str, lead: str):
        super().__init__()
        self.tokenizer, self.code, self.lead = tokenizer, code, lead
        self.older: dict[str, bytes | None] = {}
        self.tokenize, self.shown = tokenizer.model.tokenize, lead.translate(self.VISIBLE)
        self.marks = {m: self.pack(tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,\n"}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def ids(self, lead: str, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0250":  # one piece: straight to the model
            piece = lead + word if word.isascii() else (lead + word).encode().decode("latin-1")
            return self.pack([t.id for t in self.tokenize(piece.translate(self.VISIBLE))])
        return self.pack(self.tokenizer.encode(lead + word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHE:  # words that are still met come back from the older ones
            self.older = dict(self)
            self.clear()
        if (value := self.older.get(word)) is not None:
            self[word] = value
            return value
        if word.isascii() and word.isalpha():  # most words: all their characters are visible as they are
            value = self[word] = array(self.code, [t.id for t in self.tokenize(self.shown + word)]).tobytes()
            return value
        bare = word[1:] if word[:1] == "\n" else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            value = None
        elif len(bare) > 1 and bare[-1] in ".," and bare[-2].isalpha():  # a letter and a full stop are always cut apart
            value = self[word[:-1]] + self.marks[bare[-1]]
        elif bare is word:
            value = self.ids(self.lead, word)
        else:
            value = self.marks["\n"] + self.ids("", bare)
        self[word] = value
        return value


class Encoder:
    """Ids of whole texts, as bytes. Words that single spaces or line ends part are encoded once and kept.

    The byte-level pre-tokeniser always cuts before a lone space and around a lone line end between visible characters, so a
    text's ids are its words' ids one after the other. A text with other white space at such a place is encoded whole, and
    so is one that holds an added token (such as an end-of-text mark), which has its own id wherever it stands.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        self.kind = "<u4" if self.wide else "<u2"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.later = Words(self.tokenizer, self.code, ""), Words(self.tokenizer, self.code, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        words = text.replace("\n", " \n").split(" ")
        try:
            return b"".join([self.first[words[0]], *map(self.later.__getitem__, words[1:])])
        except TypeError:  # a word without ids of its own
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of every whole text in ascending doc_id order, as a written table of blocks.

    A row is a block: shard (its file), block (its place there), width (bytes of an id), payload (raw little-endian ids of
    documents one after the other), doc_ids and lengths. A document is never split; one longer than a block has its own.
    Null text: the end id alone. Null doc_id: first. Repeated doc_ids: each its own record, in order of a text hash. Ranges are cut
    by doc_id, text hash and place in the input, so that no task gets all null or repeated ids.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = 4 if encode.wide else 2
        end = np.array([end_id], dtype=encode.kind).tobytes()
        held: list[bytes] = []
        ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(h) // width for h in held]
            arrays = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "block", "width", "payload", "doc_ids", "lengths"])

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                data = encode.encode(text.as_py() or "")
                if held and size + len(data) > block_bytes:
                    yield flush()
                    held, ids, size, block = [], [], 0, block + 1
                held.append(data + end)
                ids.append(doc_id)
                size += len(data) + width
        if held:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) tid", "monotonically_increasing_id() place", "text")
    ordered = rows.repartitionByRange("doc_id", "tid", "place").sortWithinPartitions("doc_id", "tid", "place").select("doc_id", "text")
    return saved(by_batch(ordered, build, "shard int, block int, width int, payload binary, doc_ids array<long>, lengths array<long>"), "token-blocks")


def records(blocks: DataFrame) -> DataFrame:
    """(doc_id, shard, block, place, n_tokens): where each document's ids lie, in ids from the block's start."""
    each = blocks.select("shard", "block", F.expr("posexplode(arrays_zip(doc_ids, lengths)) as (i, r)"), "lengths")
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(F.col("r.doc_ids").alias("doc_id"), "shard", "block", before.alias("place"), F.col("r.lengths").alias("n_tokens"))


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of splitmix, with a seed."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """A minimal perfect hash of distinct keys: sizes of its levels, their bits, and each key's number.

    A key alone in its slot of a level is settled there; those that meet go on to the next. Numbers are ranks of set bits.
    """
    left, sizes, bits, number, done = np.arange(len(keys)), [], [], np.zeros(len(keys), dtype=np.int64), 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = int(len(left) * GAMMA) // 8 * 8 + 8
        slot = (_mix(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        settled = alone[slot]
        rank = np.cumsum(alone) - 1
        number[left[settled]] = done + rank[slot[settled]]
        done += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        left = left[~settled]
    return sizes, b"".join(b.tobytes() for b in bits), number


def find(sizes: list[int], bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Each key's number; -1 where no level settles it. Keys never indexed may get any number: compare the fingerprint."""
    packed, number, open_, done, at = np.frombuffer(bits, dtype=np.uint8), np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        set_ = np.unpackbits(packed[at : at + size // 8])
        slot = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = set_[slot] == 1
        number[open_[hit]] = done + (np.cumsum(set_, dtype=np.int64) - 1)[slot[hit]]
        open_, done, at = open_[~hit], done + int(set_.sum()), at + size // 8
    return number


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n))


def _keys(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["doc_id"].to_numpy(dtype=np.int64).view(np.uint64)


INDEX = "bucket long, n long, sizes array<int>, bits binary, fingerprints binary, shards binary, blocks binary, places binary, lengths binary, copies binary"


def _index_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(pdf)
    sizes, bits, number = build_hash(keys)
    order = np.argsort(number)
    column = lambda name, kind: pdf[name].to_numpy()[order].astype(kind).tobytes()
    prints = (_mix(keys, 99) >> np.uint64(32)).astype("<u4")[order].tobytes()
    return pd.DataFrame([{
        "bucket": pdf["bucket"].iloc[0], "n": len(pdf), "sizes": sizes, "bits": bits, "fingerprints": prints,
        "shards": column("shard", "<i4"), "blocks": column("block", "<i4"), "places": column("place", "<i8"), "lengths": column("n_tokens", "<i8"), "copies": column("copies", "<i4"),
    }])


def build_index(blocks: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """The index of all documents as a written table: a row for each bucket of about ``keys_per_bucket`` keys.

    Keys are dealt by hash, so buckets are even whatever the ids. Repeated doc_ids are one key for the first record and its
    number of copies; null doc_ids lie in the blocks but have no key.
    """
    keyed = records(blocks).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "block", "place", "n_tokens")).alias("r"), F.count("*").cast("int").alias("copies"))
    keyed = keyed.select("doc_id", "r.*", "copies")
    n = blocks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    buckets = max(1, -(-n // keys_per_bucket))
    built = keyed.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_index_bucket, INDEX)
    return saved(built.withColumn("buckets", F.lit(buckets)), "token-index")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """For each row of ``keys`` (doc_id): the record that the index gives, if the stored fingerprint agrees.

    Keys meet their bucket by a join on its number; a bucket's keys are searched in bounded batches beside its one row.
    """
    buckets = (index.select("buckets").first() or [1])[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for _, part in pdf.groupby("bucket", sort=False):
                first, keys_ = part.iloc[0], np.concatenate(list(part["keys"]))
                number = find(list(first["sizes"]), first["bits"], keys_.view(np.uint64))
                inside = (number >= 0) & (number < first["n"])
                at = np.where(inside, number, 0)
                prints = np.frombuffer(first["fingerprints"], dtype="<u4")
                found = inside & (prints[at] == (_mix(keys_.view(np.uint64), 99) >> np.uint64(32)).astype("<u4"))
                column = lambda name, kind: np.frombuffer(first[name], dtype=kind)[at[found]]  # noqa: E731,B023
                arrays = [keys_[found], column("shards", "<i4"), column("blocks", "<i4"), column("places", "<i8"), column("lengths", "<i8"), column("copies", "<i4")]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["doc_id", "shard", "block", "place", "n_tokens", "copies"])

    # keys come in four rows a bucket, so that a bucket's row is not repeated for each key
    asked = keys.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("bucket", _bucket(buckets))
    asked = asked.groupBy("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("part")).agg(F.collect_list("doc_id").alias("keys"))
    joined = asked.join(index.drop("buckets"), "bucket")
    return by_batch(joined, search, "doc_id long, shard int, block int, place long, n_tokens long, copies int")


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for shard, block, width, payload, doc_ids, lengths in zip(*[b.column(c).to_pylist() for c in ("shard", "block", "width", "payload", "doc_ids", "lengths")]):
            ids, at = np.frombuffer(payload, dtype="<u4" if width == 4 else "<u2"), 0
            for doc_id, n in zip(doc_ids, lengths):
                for column, value in zip(out, (shard, block, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), doc_id)):
                    column.append(value)
                at += n
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["shard", "block", "place", "read_tokens", "ids_crc32", "stored_id"])


def read_records(blocks: DataFrame) -> DataFrame:
    """(shard, block, place, read_tokens, ids_crc32, stored_id) of every record in the payload, from the raw ids of the files."""
    return by_batch(blocks.select("shard", "block", "width", "payload", "doc_ids", "lengths"), _crc_batches, "shard int, block int, place long, read_tokens long, ids_crc32 long, stored_id long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, through written blocks and the index over them.

    ``start`` counts the ids of all documents before it. A row each for all documents: those that the index finds by their key,
    and the stored records that have no key of their own (null doc_ids, and all but the first record of a repeated one). Null
    and empty texts: the end id alone. Very long texts are encoded whole, in a block of their own. An empty table gives no rows.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    blocks = write_blocks(docs, vocabulary, end_id)
    index = build_index(blocks)
    sums = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    total, starts = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in sums.groupBy("shard").agg(F.sum("n").alias("n")).collect()):  # a row for each file
        starts.append((shard, total))
        total += n
    starts = spark.createDataFrame(starts, "shard int, shard_start long")
    inside = sums.selectExpr("shard", "block", "sum(n) over (partition by shard order by block) - n as block_start").join(F.broadcast(starts), "shard")
    keyed = lookup(index, docs.select("doc_id")).select("doc_id", "shard", "block", "place")
    found = read_records(blocks).join(keyed, ["shard", "block", "place"], "left").join(inside, ["shard", "block"])
    return found.select(F.coalesce("doc_id", "stored_id").alias("doc_id"), (F.col("shard_start") + F.col("block_start") + F.col("place")).alias("start"), F.col("read_tokens").alias("n_tokens"), "ids_crc32", "shard", "block", "place")
