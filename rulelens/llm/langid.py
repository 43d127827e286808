"""Language of every word by a linear-chain conditional random field, and of documents by their words.

Emissions come from affixes, character n-grams and learned lexicons; transitions are learned too. Marginals are exact, by
forward-backward over whole texts; text may switch between languages at any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import by_batch, unit
from rulelens.llm.quality import held_out

TABLE = 1 << 17  # hashed weights of affixes and n-grams
SAMPLE = 600  # documents, in expectation, of the fitting sample, shared alike by the languages
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9  # a word of a language's lexicon: seen so often, and so mostly there
SPAN, SEQUENCE = 24, 96  # words of a code-switched stretch at most, and of a training sequence
STEPS, RATE, DECAY = 50, 0.1, 1e-4
CHUNK = 256  # words of a text that one step of forward-backward moves along with all other chunks
BATCH = 3 << 20  # bytes of text at a time
CACHE = 400_000  # words whose emissions a worker keeps

FOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # odd multipliers of a common mixer


def letters(token: str) -> str:
    """A token's letters in lower case, with all else taken out."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the weight table of all words' features, where each word's begin, and a hash of each whole word.

    A word is written between two marks. Features are its n-grams of two to four bytes, those at a mark thereby being affixes,
    and prefixes and suffixes of five bytes.
    """
    marked = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(data))  # bytes from here to the word's end
    code, grams, keep = data.copy(), [], []
    for n in range(2, 5):
        code = code[:-1] * np.uint64(257) + data[n - 1 :] if len(code) > 1 else code[:0]
        grams.append(_mix(code * FOLD + np.uint64(n)) % np.uint64(TABLE))
        keep.append(left[: len(code)] >= n)
    of = np.repeat(np.arange(len(words)), size)
    place = [g[k].astype(np.int64) for g, k in zip(grams, keep)]
    owner = [of[: len(g)][k] for g, k in zip(grams, keep)]
    five = np.lib.stride_tricks.sliding_window_view(data, 5) @ (np.uint64(257) ** np.arange(5, dtype=np.uint64)) if len(data) >= 5 else data[:0]
    for salt, at in ((5, start), (6, start + size - 5)):
        has = size >= 6
        place.append((_mix(five[at[has]] * FOLD + np.uint64(salt)) % np.uint64(TABLE)).astype(np.int64))
        owner.append(np.flatnonzero(has))
    place, owner = np.concatenate(place), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    whole = _mix(np.add.reduceat(_mix(data * FOLD + (np.arange(len(data)) - np.repeat(start, size)).astype(np.uint64)), start)) if len(words) else data[:0]
    return place[order], np.searchsorted(owner[order], np.arange(len(words))), whole


class Model:
    """Weights of a chain over ``labels``."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, language: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon, self.language = labels, lexicon, language  # sorted word hashes, and each one's label
        self.weights = {"grams": np.zeros((TABLE, n)), "lexicon": np.zeros((n + 1, n)), "moves": np.zeros((n, n)), "start": np.zeros(n)}

    def known(self, whole: np.ndarray) -> np.ndarray:
        """The label whose lexicon has each word, or the number of labels."""
        if not len(self.lexicon):
            return np.full(len(whole), len(self.labels))
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, self.language[at], len(self.labels))

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        place, start, whole = features(words)
        return np.add.reduceat(self.weights["grams"][place], start) + self.weights["lexicon"][self.known(whole)]


def marginals(emit: np.ndarray, size: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side: emission factors (chains, steps, labels), the longest chains first.

    ``size`` are the chains' lengths; at each step only those still going move. ``first`` is what comes into each chain's first
    word, ``last`` what comes back from behind its last. Returns the labels' marginals, the forward and the backward messages,
    each scaled to sum 1.
    """
    going = np.searchsorted(-size, -np.arange(emit.shape[1]), side="left")
    ahead, back = np.ones_like(emit), np.ones_like(emit)
    a = first
    for t, k in enumerate(going):
        a = (a[:k] if t == 0 else a[:k] @ moves) * emit[:k, t]
        a /= a.sum(axis=1, keepdims=True)
        ahead[:k, t] = a
    b = last.copy()
    for t in range(emit.shape[1] - 1, -1, -1):
        k = going[t]
        back[:k, t] = b[:k]
        c = (emit[:k, t] * b[:k]) @ moves.T
        b[:k] = c / c.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=2, keepdims=True), ahead, back


def transfer(emit: np.ndarray, size: np.ndarray, moves: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each chain, longest first, how a message that comes into it leaves it: (chains, labels, labels).

    The message has yet to move to the chain's first word, unless the chain ``opens`` a text.
    """
    going = np.searchsorted(-size, -np.arange(emit.shape[1]), side="left")
    out = np.where(opens[:, None, None], np.eye(len(moves)), moves) * emit[:, 0, None, :]
    for t, k in enumerate(going):
        if t:
            out[:k] = (out[:k] @ moves) * emit[:k, t, None, :]
        out[:k] /= out[:k].sum(axis=(1, 2), keepdims=True)
    return out


def factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True)) + 1e-30


def chain_marginals(scores: np.ndarray, ends: np.ndarray, moves: np.ndarray, start: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Exact marginals of many texts' words, one text after the other; text i ends before ``ends[i]``.

    Texts are cut in chunks that advance side by side. A chunk's whole effect is a small matrix, so messages pass from chunk to
    chunk of a long text without going through its words; then all chunks run at once between the messages at their ends.
    """
    n, begins = len(moves), np.r_[0, ends[:-1]]
    each = -(-(ends - begins) // chunk)
    total = int(each.sum())
    text = np.repeat(np.arange(len(ends)), each)
    number = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    lo = begins[text] + number * chunk
    size = np.minimum(ends[text] - lo, chunk)
    order = np.argsort(-size, kind="stable")
    at = lo[order][:, None] + np.minimum(np.arange(size.max()), size[order][:, None] - 1)
    emit = factors(scores[at].astype(np.float64))
    come, back = np.tile(start, (total, 1)), np.ones((total, n))
    many = each[text[order]] > 1
    if many.any():  # messages between the chunks of long texts
        maps = np.empty((total, n, n))
        maps[order[many]] = transfer(emit[many], size[order[many]], moves, number[order[many]] == 0)
        inner = np.flatnonzero(number > 0)
        for i in inner:
            m = come[i - 1] @ maps[i - 1]
            come[i] = m / m.sum()
        for i in inner[::-1]:
            m = maps[i] @ back[i]
            back[i - 1] = m / m.sum()
        come[inner] = come[inner] @ moves
    gamma = marginals(emit, size[order], moves, come[order], back[order])[0]
    real = np.arange(emit.shape[1]) < size[order][:, None]
    out = np.empty(scores.shape)
    out[at[real]] = gamma[real]
    return out


def train(texts: list[list[str]], labels: list[str], steps: int = STEPS) -> Model:
    """A model from texts (lists of words) of one label each.

    Stretches of different texts are set behind each other, in the order of a fixed shuffle, so that switches can be learned.
    """
    names = sorted(set(labels))
    y_of = np.array([names.index(x) for x in labels])
    words = sorted({w for t in texts for w in t})
    index = {w: i for i, w in enumerate(words)}
    place, start, whole = features(words)
    ids = [np.array([index[w] for w in t]) for t in texts]
    counts = np.zeros((len(words), len(names)))
    for x, y in zip(ids, y_of):
        np.add.at(counts[:, y], x, 1)
    lexical = (counts.max(axis=1) >= LEXICON_COUNT) & (counts.max(axis=1) >= LEXICON_SHARE * counts.sum(axis=1))
    order = np.argsort(whole[lexical])
    model = Model(names, whole[lexical][order], counts[lexical].argmax(axis=1)[order])

    rng, stretches = np.random.default_rng(5), []
    for x, y in zip(ids, y_of):
        at = 0
        while at < len(x):
            n = int(rng.integers(1, SPAN + 1))
            stretches.append((x[at : at + n], y))
            at += n
    rng.shuffle(stretches)
    line = np.concatenate([s for s, _ in stretches])
    truth = np.concatenate([np.full(len(s), y) for s, y in stretches])
    if len(line) < SEQUENCE:
        line, truth = np.resize(line, SEQUENCE), np.resize(truth, SEQUENCE)
    rows = len(line) // SEQUENCE
    line, truth = line[: rows * SEQUENCE].reshape(rows, -1), truth[: rows * SEQUENCE].reshape(rows, -1)
    gold = np.eye(len(names))[truth]
    gold_moves = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
    owner, known = np.repeat(np.arange(len(words)), np.diff(np.r_[start, len(place)])), model.known(whole)
    w, first, second = model.weights, {}, {}
    for step in range(1, steps + 1):
        scores = (np.add.reduceat(w["grams"][place], start) + w["lexicon"][known])[line]
        moves, begin = np.exp(w["moves"]), np.exp(w["start"])
        emit = factors(scores)
        gamma, ahead, back = marginals(emit, np.full(rows, SEQUENCE), moves, np.tile(begin, (rows, 1)), np.ones((rows, len(names))))
        pair = ahead[:, :-1, :, None] * moves * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        miss = (gold - gamma).reshape(-1, len(names))
        per_word = np.stack([np.bincount(line.ravel(), miss[:, k], len(words)) for k in range(len(names))], axis=1)
        slope = {
            "grams": np.stack([np.bincount(place, per_word[owner, k], TABLE) for k in range(len(names))], axis=1),
            "lexicon": np.stack([np.bincount(known, per_word[:, k], len(names) + 1) for k in range(len(names))], axis=1),
            "moves": gold_moves - pair.sum(axis=(0, 1)), "start": (gold[:, 0] - gamma[:, 0]).sum(axis=0),
        }
        for k, g in slope.items():
            g = g / line.size - DECAY * w[k]
            first[k] = 0.9 * first.get(k, 0) + 0.1 * g
            second[k] = 0.999 * second.get(k, 0) + 0.001 * g**2
            w[k] += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w["grams"] = w["grams"].astype(np.float32)
    return model


class Tagger:
    """Emissions of tokens, kept as they come, and documents' languages from their words' marginals."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)
        self.lettered = np.zeros(1024, bool)

    def _learn(self, tokens: list[str]) -> None:
        words = [letters(t) for t in tokens]
        n, need = len(self.rows), len(self.rows) + len(tokens)
        while need > len(self.table):
            self.table, self.lettered = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        self.table[n:need] = 0
        has = np.array([bool(w) for w in words])
        self.lettered[n:need] = has
        if has.any():
            self.table[n + np.flatnonzero(has)] = self.model.emissions([w for w in words if w])
        self.rows.update(zip(tokens, range(n, need)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: the label with the highest mean marginal over the words that have letters, and that mean."""
        model, tokens = self.model, [(t or "").split() for t in texts]
        if len(self.rows) > CACHE:
            self.rows = {}
        new = {w for t in tokens for w in t}.difference(self.rows)
        if new:
            self._learn(sorted(new))
        ids = [np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t)) for t in tokens]
        ids = [i[self.lettered[i]] for i in ids]  # what has no letters is no word
        size = np.array([len(i) for i in ids])
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        ends = np.cumsum(size[full])
        gamma = chain_marginals(self.table[np.concatenate([ids[i] for i in full])], ends, np.exp(model.weights["moves"]), np.exp(model.weights["start"]))
        mean = np.add.reduceat(gamma.astype(float), np.r_[0, ends[:-1]]) / size[full][:, None]
        for i, m in zip(full, mean):
            out[i] = model.labels[int(m.argmax())], float(min(1.0, m.max()))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model learned from a hash-drawn sample of labelled documents outside the held-out third; None without any.

    Each language gets the same expected share of the sample, so its size is bounded by the parameter, whatever the corpus.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, sample / len(counts) / n)).otherwise(rate)
    got = sorted((r["lang"], r["text"]) for r in known.where(unit("doc_id", seed=2) < rate).select("lang", "text").collect())
    got = [(lang, [w for w in map(letters, text.split()) if w]) for lang, text in got]
    got = [(lang, words) for lang, words in got if words]
    return train([w for _, w in got], [lang for lang, _ in got]) if got else None


def tagged(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone.

    Null, empty and letterless texts, and all texts without a model: ``und`` with score 0. Null doc_id, ties and repeated rows:
    row by row, equal texts alike. Other columns are ignored. An empty table gives no rows. Long texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            texts, found, part, size = b.column("text").to_pylist(), [], [], 0
            for t in [*texts, None]:
                part.append(t)
                size += len(t or "")
                if size > BATCH:
                    found += tagger.predict(part) if tagger else [("und", 0.0)] * len(part)
                    part, size = [], 0
            found += tagger.predict(part) if tagger else [("und", 0.0)] * len(part)
            found = found[: len(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return by_batch(docs.selectExpr("cast(doc_id as long) doc_id", "text"), build, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    return tagged(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
