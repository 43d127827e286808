"""The training-data operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulelens.llm import fingerprints, graph, langid, media, mixing, neardup, packing, quality, sharding, suffix, tokenindex
from rulelens.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, y int, of int, rate string, text_id int, spans int, copies int, label int"
SHARED = " ".join(f"shared{i}" for i in range(60))


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(n))


ODD = [
    (None, None), (1, ""), (2, "  \t\n "), (3, words(3, 80)), (3, words(3, 80)), (4, words(4, 3000)), (5, "é" * 300), (6, "Ünï 12, x"), (7, words(7, 60) + " " + SHARED),
    (8, SHARED + " " + words(8, 60)), (9, words(9, 200)), (10, words(9, 199) + " new"), (None, words(11, 40)), (12, "one two"), (13, "ONE two"), (14, "\u4e2d\u6587 \U0001f600" * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", len(t or ""), 0.5, "k", 1, 1, "r", 1, 1, 1, 1) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def data(t):
    return (t or "").encode()


def test_media_round_trip(odd, none):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.media_digest(odd).collect()}
    for i, t in ODD:
        p = data(t) + b" " * (max(192, -(-len(data(t)) // 192) * 192) - len(data(t)))
        r = got[i, hashlib.sha256(p).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data(t)), len(p), zlib.crc32(p[-16:])) and " 0 of " in r["feature"] and " 0 skipped" in r["feature"]
    assert media.media_digest(none).count() == 0


def test_media_damage():
    stream = media.encode(b"x" * 1000)
    whole = media.parse(stream)
    assert whole["frames"] == 6 and whole["samples"] == 6 * 1152 and whole["rate"] == 32000 and whole["bad"] == 0 and whole["table"][:2] == ("Info", 6)
    at = int(whole["offsets"][2])
    assert media.parse(stream[:at] + b"junk\xff\xfb" + stream[at:])["skipped"] == 6
    assert media.parse(stream[: at + 10] + b"\x55" + stream[at + 11 :])["bad"] == 1
    assert media.parse(b"no audio here")["frames"] == 0 and media.parse(b"")["rate"] == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes, n = rng.integers(1, 7, rng.integers(1, 4)), 3
        scores, moves, start = rng.normal(size=(sizes.sum(), n)), np.exp(rng.normal(size=(n, n))), np.exp(rng.normal(size=n))
        got, at = langid.chain_marginals(scores, np.cumsum(sizes), moves, start, chunk=int(rng.integers(1, 4))), 0
        for s in sizes:
            total = np.zeros((s, n))
            for y in itertools.product(range(n), repeat=int(s)):
                p = start[y[0]] * np.prod([np.exp(scores[at + t, y[t]]) for t in range(s)]) * np.prod([moves[y[t - 1], y[t]] for t in range(1, s)])
                for t in range(s):
                    total[t, y[t]] += p
            assert np.allclose(got[at : at + s], total / total.sum(axis=1, keepdims=True))
            at += s


def test_languages_held_out(spark, tables, odd, none):
    rows = langid.identify(tables.documents).join(tables.documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    got = {r["doc_id"]: r for r in langid.identify(odd).collect() if r["doc_id"] is not None}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[1]["score"] == 0 and got[9]["lang_pred"] == "en"
    assert langid.identify(none).count() == 0


def test_quality_held_out(spark, tables, odd, none):
    rows = quality.predict_quality(tables.documents, tables.labels).join(tables.labels, "doc_id").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.9
    out = quality.predict_quality(odd, tables.labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.predict_quality(none, tables.labels).count() == 0


def test_quality_gradient():
    rng = np.random.default_rng(1)
    rows, starts, y, sure = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0, 1]), np.ones(3)
    model = quality.Attention(rows.mean(axis=0), rows.std(axis=0))
    loss = lambda: -sum(np.where(y == 1, np.log(s := model.forward(rows, starts)["score"]), np.log(1 - s)))
    slope = model.gradient(model.forward(rows, starts), y, sure)
    for k, w in model.w.items():
        at = (0,) * w.ndim
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(slope[k][at], abs=1e-4)
        w[at] += 1e-6


def test_shards_are_even_runs(odd, none):
    rows = sharding.shards(odd, n_shards=4).collect()
    assert len(rows) == len(ODD) and sum(r["size"] for r in rows) == sum(len(data(t)) + 16 for _, t in ODD)
    for s, slots in itertools.groupby(sorted((r["shard"], r["slot"]) for r in rows), key=lambda x: x[0]):
        assert [x[1] for x in slots] == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shards(none).count() == 0


def test_packing_loses_nothing(odd, none):
    rows = packing.pack(odd, (64, 256, 1024), group_bytes=4096).collect()
    assert sum(r["length"] for r in rows) == sum(len(data(t)) + 1 for _, t in ODD)
    for _, bin_ in itertools.groupby(sorted(rows, key=lambda r: (r["bin"], r["offset"])), key=lambda r: r["bin"]):
        at = 0
        for r in bin_:
            assert r["offset"] == at
            at += r["length"]
        assert at <= r["capacity"] and all(c < at for c in (64, 256, 1024) if c < r["capacity"])
    assert packing.pack(none).count() == 0


def test_best_fit_against_search():
    lengths, sizes = [9, 7, 6, 4, 3, 2, 1], (8, 16)
    least = min(sum(map(packing.cost, packing.downsize([u for u in used if u], sizes))) for used in (np.bincount(p, lengths, 7).astype(int) for p in itertools.product(range(4), repeat=7)) if max(used) <= 16)
    assert sum(map(packing.cost, packing.best_fit(lengths, sizes)[2])) <= 1.2 * least


def brute_groups(rows, percent=85):
    hashes = neardup.Hashes()
    sets = [neardup.shingles(t, hashes) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a]) and len(sets[b]) and neardup.linked(sets[a], sets[b], percent):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    return root, [len(s) for s in sets]


def test_near_duplicates_against_brute_force(spark, odd, none):
    family = [(100 + i, " ".join(w if (j * 7 + i) % 97 else f"edit{i}" for j, w in enumerate(words(1, 300).split()))) for i in range(30)]
    rows = ODD + family
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root, sizes = brute_groups(rows)
    want = collections.Counter()
    for (i, _), r, n in zip(rows, root, sizes):
        ids = [x for (x, _), q in zip(rows, root) if q == r and x is not None]
        want[i, n, i if not n else min(ids, default=None)] += 1
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == want
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(odd).collect()
    assert collections.Counter(r["doc_id"] for r in kept)[3] == 1 and 10 not in {r["doc_id"] for r in kept} and {1, 2, 9, 12} <= {r["doc_id"] for r in kept}


def test_sketch_fills_every_bin():
    for n in (1, 2, 50, 5000):
        k = neardup.sketch(np.arange(n, dtype=np.uint64) * neardup.STEP)
        assert len(k) == neardup.BINS and (k != neardup.EMPTY).all()
    a, b = np.arange(1000, dtype=np.uint64) * neardup.STEP, np.arange(100, 1100, dtype=np.uint64) * neardup.STEP
    assert abs((neardup.sketch(a) == neardup.sketch(b)).mean() - 900 / 1100) < 0.12


def test_components_of_a_long_chain(spark):
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")).collect()
    assert {r["label"] for r in got if r["node"] <= 200} == {0} and {r["label"] for r in got if r["node"] >= 500} == {500}


def test_mixing_draws_and_order(odd, none):
    mixed, added = mixing.replicate(odd)
    rows = mixed.collect()
    assert set(odd.columns) | set(added) == set(mixed.columns)
    per = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(r[added[1]] * collections.Counter(ODD)[r["doc_id"], r["text"]] == per[r["doc_id"], r["text"]] for r in rows)
    assert mixing.replicate(none)[0].count() == 0


def test_fingerprints(odd, none):
    rows = fingerprints.compare_neighbours(odd).collect()
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = collections.Counter()
    for i, (doc_id, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want[doc_id, len(t), hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert fingerprints.compare_neighbours(none).count() == 0 and fingerprints.fingerprints(none).count() == 0


def test_shared_strings_share_phrases():
    middle = words(50, 400)
    a, b = fingerprints.signatures([words(51, 30) + middle, "x" + words(52, 31) + middle])
    assert fingerprints.likeness(a[None], b[None])[0] > 0.6
    assert fingerprints.likeness(*fingerprints.signatures([middle, words(53, 400)])[:, None])[0] < 0.2
    alone = [fingerprints.signatures([t])[0] for t in ("aaaa", "", middle)]
    assert (np.stack(alone) == fingerprints.signatures(["aaaa", "", middle])).all()


def test_tokens_by_index(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    many = ODD + [(None, words(i, 5)) for i in range(40)] + [(4, words(i, 6)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in many], "doc_id long, text string, shard string").repartition(6)
    got = sorted(tokenindex.token_records(docs, vocabulary()).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(itertools.accumulate([0, *(r["n_tokens"] for r in got[:-1])]))
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in many), key=lambda i: (i is not None, i or 0))
    want = collections.Counter()
    for doc_id, t in many:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tokenindex.token_records(none, vocabulary()).count() == 0
    index = tokenindex.build_index(tokenindex.write_blocks(odd, vocabulary()))
    assert tokenindex.lookup(index, spark.createDataFrame([(99,), (4,)], "doc_id long")).select("doc_id").collect() == [(4,)]


def test_words_come_back_from_the_older_ones(monkeypatch):
    monkeypatch.setattr(tokenindex, "CACHE", 20)
    encoder, text = tokenindex.Encoder(vocabulary()), words(60, 300)
    for t in (text, text[::-1], text):
        assert np.frombuffer(encoder.encode(t), encoder.kind).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.later) <= 20


def test_minimal_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    sizes, bits, number = tokenindex.build_hash(keys)
    assert sorted(number) == list(range(len(keys))) and (tokenindex.find(sizes, bits, keys) == number).all()


def test_words_have_the_texts_ids():
    encoder, rng = tokenindex.Encoder(vocabulary()), np.random.default_rng(3)
    letters = list("ab c \n\t\r'.,é\xa0日本1 2#<|>s\x85\x1c İßſ")
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 12)))
        assert np.frombuffer(encoder.encode(t), encoder.kind).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_added_tokens_keep_their_id(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "x\n<|endoftext|>\n\ny", "<|endoftext|><|endoftext|> z.", "a <|endoftext| > b", "plain words, none"]
    got, at = {r["doc_id"]: r for r in tokenindex.token_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary()).collect()}, 0
    for i, t in enumerate(texts):
        ids = fresh.encode(t, add_special_tokens=False).ids + [2]
        assert (50256 in ids) == ("<|endoftext|>" in t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def brute_cut(texts, length=200):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, odd, none):
    base = words(70, 120)
    rows = ODD + [(200 + i, words(71 + i, 20) + base[i * 5 : 400 + i * 9] + words(90 + i, 15)) for i in range(12)] + [(300, "ab" * 400), (301, "q" * 199)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter((i, len(data(t)), *found) for (i, t), found in zip(rows, brute_cut([data(t) for _, t in rows])))
    assert suffix.repeated_bytes(none).count() == 0
    left = {r["doc_id"]: r for r in suffix.without_repeats(odd).collect() if r["doc_id"] in (7, 8, 9, 14)}
    assert SHARED[5:-5] not in left[7]["text"] and left[7]["n_chars"] == len(left[7]["text"]) and left[9]["key"] == "k"


def test_pipeline_keeps_what_it_should(spark):
    folder = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "repeats", "mix", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, folder)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert len(bad & kept) <= 1 and len(kept) > 0.8 * (docs.count() - len(bad))
    assert good.columns == docs.columns == corpus_pipeline.mix(spark, good, folder).columns
    out = corpus_pipeline.pack(spark, good, folder)
    assert out.agg(F.sum("length")).first()[0] == good.agg(F.sum(F.octet_length("text") + 1)).first()[0]
