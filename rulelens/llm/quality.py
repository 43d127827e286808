"""Quality by attention-based multiple-instance learning: a document is a bag of passages, only documents have labels.

Every passage is encoded, gated attention weighs the passages, and the weighted sum of their codes gives the score. All weights
are learned together from the labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulelens.llm.common import by_batch, unit

WORDS = 64  # of a passage
CODE, GATE = 16, 8  # sizes of a passage's code and of the attention's layers
SAMPLE = 1000  # labelled documents, in expectation, that each label may add to the fitting sample
STEPS, RATE, DECAY = 200, 0.02, 1e-4

# Classes of bytes that passages are described by; what is in none is a symbol.
CLASSES = (b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|", b"'\"()-:;", bytes(range(128, 256)))
SYMBOL = len(CLASSES)
CLASS = np.full(256, SYMBOL, dtype=np.int64)
for _i, _members in enumerate(CLASSES):
    CLASS[list(_members)] = _i
FEATURES = 6 + SYMBOL + 1
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\r\x0b\x0c\n")] = True


def passages(text: str | None) -> np.ndarray:
    """Features of each run of ``WORDS`` words: bytes by class, lengths of words, and how words repeat. At least one row."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES))
    data, n = np.frombuffer(raw, np.uint8), -(-len(words) // WORDS)
    blank = BLANK[data]
    word = np.cumsum(np.r_[not blank[0], blank[:-1] & ~blank[1:]]) - 1  # blanks go with the word before
    at = np.maximum(word, 0) // WORDS
    counts = np.bincount(at * (SYMBOL + 1) + CLASS[data], minlength=n * (SYMBOL + 1)).reshape(n, -1).astype(float)
    h = np.fromiter(map(hash, words), np.int64, len(words))
    same = np.zeros((2, n * WORDS))
    same[0, 1 : len(h)] = h[1:] == h[:-1]
    same[1, 2 : len(h)] = h[2:] == h[:-2]
    grid = np.arange(n * WORDS) - (1 << 62)  # what is missing is like nothing else
    grid[: len(h)] = h
    grid = np.sort(grid.reshape(n, WORDS), axis=1)
    size = np.full(n, WORDS)
    size[-1] = len(words) - (n - 1) * WORDS
    again = (grid[:, 1:] == grid[:, :-1]).sum(axis=1)
    letters = counts.sum(axis=1) - counts[:, 0] - counts[:, 1]
    return np.column_stack([np.log(size) / np.log(WORDS), again / size, same[0].reshape(n, -1).sum(axis=1) / size, same[1].reshape(n, -1).sum(axis=1) / size, letters / size / 10, counts[:, 1] / size, counts / counts.sum(axis=1, keepdims=True)])


class Attention:
    """Gated attention over the passages of many bags at once; ``starts`` are the bags' first rows."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.w = {"E": normal(len(mean), CODE), "e": np.zeros(CODE), "V": normal(CODE, GATE), "U": normal(CODE, GATE), "a": normal(GATE, 1)[:, 0], "c": normal(CODE, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, x = self.w, np.clip((rows - self.mean) / self.scale, -8, 8)
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (t * s) @ w["a"]
        weight = np.exp(raw - np.maximum.reduceat(raw, starts)[of])
        weight /= np.add.reduceat(weight, starts)[of]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "of": of, "h": h, "t": t, "s": s, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, sure: np.ndarray) -> dict[str, np.ndarray]:
        w, of, h, weight = self.w, f["of"], f["h"], f["weight"]
        d = (f["score"] - y) * sure  # of the score's logit
        dz = d[:, None] * w["c"]
        pull = (dz[of] * (h - f["z"][of])).sum(axis=1) * weight  # of the raw attention
        gate = pull[:, None] * w["a"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = weight[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - h**2)
        return {"E": f["x"].T @ de, "e": de.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (f["t"] * f["s"]).T @ pull, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, rows: np.ndarray, starts: np.ndarray, y: np.ndarray, sure: np.ndarray) -> "Attention":
        """Adam over the whole sample."""
        sure = sure / sure.sum()
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            g = self.gradient(self.forward(rows, starts), y, sure)
            for k in self.w:
                slope = g[k] + DECAY * self.w[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                self.w[k] = self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [passages(t).astype("<f4").tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("sure"), pa.array(rows, pa.binary())], ["y", "sure", "rows"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """The model learned from a sample of labelled documents outside the held-out third; None if a label is missing.

    The sample is drawn by a hash of doc_id with one rate a label, so its expected size is at most two times ``sample`` however
    many labels there are; documents then count in inverse proportion to their rate. Only the sample's passages reach the
    driver. Null labels are left out; of different labels for one id the larger counts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rate = F.when(F.col("y") == 1, min(1.0, sample / counts[1.0])).otherwise(min(1.0, sample / counts[0.0]))
    drawn = known.withColumn("rate", rate).where(unit("doc_id", seed=3) < F.col("rate")).select(F.col("doc_id").alias("of"), "y", (1 / F.col("rate")).alias("sure"))
    drawn = F.broadcast(drawn)  # at most the sample
    got = by_batch(docs.select("doc_id", "text").join(drawn, F.col("doc_id").cast("long") == F.col("of")).select("y", "sure", "text"), _encode_batches, "y double, sure double, rows binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["rows"])))  # the same sums whatever the order of tasks
    bags = [np.frombuffer(r["rows"], "<f4").reshape(-1, FEATURES).astype(float) for r in got]
    if len({r["y"] for r in got}) < 2:
        return None
    rows, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
    return Attention(rows.mean(axis=0), rows.std(axis=0) + 0.01).fit(rows, starts, np.array([r["y"] for r in got]), np.array([r["sure"] for r in got]))


def score_texts(model: Attention | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    bags = [passages(t) for t in texts]
    return model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))["score"]


def scored(docs: DataFrame, model: Attention | None, name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from its text alone; 0.5 without a model.

    Null and empty texts: the score of one passage without words. Null doc_id, ties and repeated rows: row by row, equal texts
    alike. Extra columns pass through. An empty table gives no rows. Every passage of a text counts, however long it is.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(model, b.column("text").to_pylist()), pa.float64())], [*b.schema.names, name])

    return by_batch(docs, build, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = scored(docs.selectExpr("cast(doc_id as long) doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
