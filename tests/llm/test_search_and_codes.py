"""Lexical search, vector codes and exact vector search against brute force, with odd rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulelens.llm import balltree, codebook, lexical

DOCS = "doc_id long, text string, item_id int, score double, rank int, term string, n long"
ITEMS = "item_id int, text string, doc_id long, score double"
VECTORS = "vec_id long, embedding array<double>, label int, code string, row long, data string, cell int, shard string, rank int"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    counted = [(i, collections.Counter(split(t)), len(split(t))) for i, t in docs]
    have = [c for c in counted if c[2]]
    n_docs, n_terms = len(have), sum(c[2] for c in have)
    df = collections.Counter(t for c in have for t in c[1])
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in have:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def words(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 500)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    docs = [(int(i), words(rng, int(rng.integers(1, 80)))) for i in range(700)]
    docs += [(None, "w1 w2 rare"), (None, "w1 w2 rare"), (7, "w3 W4,w5;É é x"), (7, "w3 W4,w5;É é x"), (900, None), (901, ""), (902, " .;\n\t"), (903, words(rng, 40_000)), (904, "\x00w1\x7fw2\x1cw3"), (905, "日本 rare É")]
    items = [(i, words(rng, 20)) for i in range(90)] + [(3, "w400 rare"), (None, "É w4 W4"), (200, None), (201, " - "), (202, "absent words"), (203, " ".join(f"w{i}" for i in range(500)))]
    return docs, items


def found(spark, docs, items, top=10):
    docs = spark.createDataFrame([(i, t, 1, 0.5, 1, "x", 1) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 5, 0.5) for i, t in items], ITEMS)
    return lexical.search(docs.repartition(5), items, top)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lexical_search_equals_brute_force(spark, corpus):
    got = found(spark, *corpus)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert rows(got) == brute_search(*corpus, 10)


def test_lexical_search_in_small_tiles(spark, corpus, monkeypatch):
    """Several groups of items, tiles, chunks of terms and blocks of documents give the same rows."""
    for name, value in (("GROUP_PAIRS", 300), ("TILE_ITEMS", 7), ("TILE_PAIRS", 90), ("CHUNK", 16), ("DOCS", 23), ("SLICES", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert rows(found(spark, *corpus)) == brute_search(*corpus, 10)


def test_lexical_search_ties_and_empty_tables(spark):
    docs = [(i, "same text here") for i in range(300)][::-1] + [(None, "same text here")] * 3 + [(500, "other")]
    got = rows(found(spark, docs, [(1, "same"), (2, "text same same")], 50))
    assert got == brute_search(docs, [(1, "same"), (2, "text same same")], 50) and {r[2] for r in got} == set(range(50))
    assert rows(found(spark, docs[-4:], [(1, "same")], 50)) == brute_search(docs[-4:], [(1, "same")], 50)
    assert found(spark, [], [(1, "a")]).count() == 0 == found(spark, docs, []).count() == found(spark, [], []).count()


def test_partial_sums_stay_exact():
    """The heaviest chunk there can be: every weight and impact at its limit."""
    product = np.full((1, lexical.CHUNK), 1e6) @ np.full((lexical.CHUNK, 1), 44_362.0)
    assert int(product[0, 0]) == lexical.CHUNK * 44_362 * 10**6 < 2**53
    assert lexical.impacts(np.array([1, 10**6]), np.array([50, 50])).tolist() == [500_000, 999_999] and math.floor(1000 * math.log(2.0**64)) < 44_362


def odd_vectors(seed=0, n=900, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    plain = [(int(i), (centres[rng.integers(30)] + 0.1 * rng.normal(size=d)).round(3).tolist(), int(rng.integers(4))) for i in range(n)]
    hot = [(int(2000 + i), [0.25] * d, None if i % 2 else 1) for i in range(n // 2)]
    odd = [(100, plain[5][1], 1), (100, plain[100][1], 1), (None, plain[6][1], None), (None, [0.0] * d, 2), (5000, None, 1), (5001, [float("nan")] * d, 1), (5002, [1.0] * (d - 1) + [None], 1),
           (5100, [float("inf")] * d, 1), (5200, [], 3), (5300, [1.0, -1.0], 3), (5400, [-0.0005] * d, 3), (None, None, None)]
    return plain + hot + odd


def kept(vectors, d):
    out = []
    for i, v, label in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(1024 * y) for y in v]
            out.append((i, tuple(x + [0] * (d - len(x))), label))
    return out


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 1, "s", 1) for i, v, label in vectors], VECTORS)


def brute_codes(vectors, d, entries=256, rounds=4):
    got = sorted(kept(vectors, d), key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<i4").tobytes()))
    x = np.array([r[1] for r in got], dtype=np.int64).reshape(len(got), 4, d // 4)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = far.argmin(axis=2)
        if turn < rounds:
            for p in range(4):
                for j in set(code[:, p].tolist()):
                    books[p, j] = x[code[:, p] == j, p].sum(axis=0) // (code[:, p] == j).sum()
    error = far.min(axis=2).sum(axis=1)
    by_label = collections.Counter()
    for r, e in zip(got, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], bytes(c.astype(np.uint8)).hex(), int(e), by_label[r[2]], digest) for r, c, e in zip(got, code, error)), key=str)


@pytest.mark.parametrize("first, seed", [(32, 0), (4, 1), (256, 2), (1, 3)])
def test_vector_codes_equal_brute_force(spark, monkeypatch, first, seed):
    monkeypatch.setattr(codebook, "FIRST", first)
    monkeypatch.setattr(codebook.train, "__defaults__", (codebook.ROUNDS, first))
    vectors = odd_vectors(seed)
    got = codebook.encode(vector_table(spark, vectors).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows(got) == brute_codes(vectors, 8)


def test_vector_codes_of_few_and_no_vectors(spark):
    few = [(3, [0.5, 0.25, 1.0], 1), (3, [0.5, 0.25, 1.0], None), (None, [2.0], 1), (1, [-3.0, 0.0, 0.1, 0.2, 0.3], 1)]
    assert rows(codebook.encode(vector_table(spark, few))) == brute_codes(few, 8)
    assert codebook.encode(vector_table(spark, [])).count() == 0 == codebook.encode(vector_table(spark, [(1, None, 2)])).count()


def test_bounds_hold_in_every_round():
    """A list's bounds never exceed the true distances, and the outer bound none of the entries outside the list."""
    rng = np.random.default_rng(3)
    x, books = rng.integers(-900, 900, (400, 6)), rng.integers(-900, 900, (64, 6))
    listed, bounds, outer, best = codebook.nearest(x, books, 12)
    for turn, b in enumerate((12, 6, 6, 20, 20, 9)):
        moved = books + rng.integers(-60 if turn % 2 else -5, 5, books.shape)
        drift = np.sqrt(((moved - books) ** 2).sum(axis=1)) * (1 + codebook.SLACK)
        listed, bounds, outer, best, deep = codebook.step(x, moved, drift, listed.copy(), bounds.copy(), outer.copy(), b)
        books = moved
        far = np.sqrt(codebook.squared(x, books))
        assert (listed[:, 0] == far.argmin(axis=1)).all() and (best == codebook.squared(x, books).min(axis=1)).all()
        for i in range(len(x)):
            inside = listed[i][np.isfinite(bounds[i])]
            assert len(set(inside.tolist())) == len(inside)
            assert (bounds[i][np.isfinite(bounds[i])] <= far[i, inside] + 1e-9).all()
            assert (outer[i] <= np.delete(far[i], inside) + 1e-9).all()
    assert codebook.adapted(32, np.bincount([1] * 900 + [7] * 100, minlength=257)) == 7
    assert codebook.adapted(32, np.bincount([1] * 900, minlength=257)) == codebook.LEAST and codebook.adapted(5, np.bincount([9] * 9, minlength=257)) == 5


def brute_top(vectors, d, asked, top):
    got, out = kept(vectors, d), []
    for a, (i, x, _) in enumerate(got):
        if asked(i):
            scored = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y, _) in enumerate(got) if a != b)
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, leaf", [(4096, 128), (60, 8), (25, 2)])
def test_exact_topk_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "LEAF", leaf)
    vectors = odd_vectors(4)
    got = balltree.search(vector_table(spark, vectors).repartition(3), F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows(got) == brute_top(vectors, 8, lambda i: i is not None and i % 100 == 0, 10)


def test_kth_score_from_trees_with_few_rows():
    """Trees that yield fewer rows than wanted must not raise the k-th score that later trees start from."""

    def beside(scores):
        tree = balltree._tree_row(1, np.int32)(pd.DataFrame({"shard": 0, "data": [np.int32(s).tobytes() for s in scores], "known": True, "vec_id": scores}))
        query = {"qids": np.int64([7]), "query_ids": np.int64([1]), "known": np.array([True]), "queries": np.int32([1]), "least": np.int64([balltree.OPEN])}
        return pa.RecordBatch.from_pylist(tree.to_dict("records")[:1]).to_pylist()[0] | {k: v.tobytes() for k, v in query.items()}

    batches = [pa.RecordBatch.from_pylist([beside(s)]) for s in ([100, 90], [80, 70], [95, 85])]
    out = [r["score"] for b in balltree._searched(1, 3, np.int32)(iter(batches)) for r in b.to_pylist()]
    assert sorted(out)[::-1][:3] == [100, 95, 90]


def test_exact_topk_of_few_and_no_vectors(spark):
    few = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [-1.0], 1), (None, [3.0], 1)]
    search = lambda rows_: balltree.search(vector_table(spark, rows_), F.col("vec_id").isNull() | (F.col("vec_id") % 100 == 0))
    assert rows(search(few)) == brute_top(few, 2, lambda i: True, 10)
    assert search([(100, [1.0], 1)]).count() == 0 == search([]).count() == search([(100, None, 1)]).count()


def test_exact_topk_of_large_ids_and_wide_components(spark, monkeypatch):
    """A null id beside ids that doubles do not hold, and components of more than 21 bits before the comma."""
    monkeypatch.setattr(balltree, "SHARD", 60)
    rng = np.random.default_rng(2)
    vectors = [(2**60 + i, rng.normal(size=8).tolist(), 1) for i in range(200)] + [(None, [1.0] * 8, 1)]
    vectors += [(-100, [3e6] * 8, 1), (9, [1e7] + [0.0] * 7, 1), (10, [2e6, -3e6] + [0.5] * 6, 1)]
    got = balltree.search(vector_table(spark, vectors).repartition(3), F.col("vec_id") % 100 == 0)
    assert rows(got) == brute_top(vectors, 8, lambda i: i is not None and i % 100 == 0, 10)


def test_wide_components_stay_exact():
    q, x = np.array([[2**27 + 1, 3]], dtype=np.int32), np.array([[2**27 - 1, 5], [-(2**27), 7]], dtype=np.int32)
    assert balltree.exact(q, x).tolist() == [[(2**27 + 1) * (2**27 - 1) + 15, -(2**27 + 1) * 2**27 + 21]]
    with pytest.raises(ValueError):
        balltree.exact(np.full((1, 4), 2**31 - 1), np.full((1, 4), 2**31 - 1))
    assert codebook.squared(q, x)[0, 0] == 4 + 4


def test_a_tree_visits_few_leaves(monkeypatch):
    """With a shared k-th score, balls that cannot reach it are not measured."""
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.normal(size=(64, 16)), 64, axis=0) * 1000 + rng.normal(size=(4096, 16)) * 20).astype(np.int32)
    centres, radii, order, cuts = balltree.build_tree(x)
    tree = {"centres": centres, "radii": radii, "cuts": cuts, "x": x[order], "rank": order}
    measured, exact = [], balltree.exact
    monkeypatch.setattr(balltree, "exact", lambda q, rows_: measured.append(len(q) * len(rows_)) or exact(q, rows_))
    held = balltree.probe(tree, x[:40], np.full(40, balltree.OPEN), 11)
    assert (held.score == -np.sort(-exact(x[:40], x), axis=1)[:, :11]).all() and sum(measured) < 0.3 * 40 * len(x)
    first = sum(measured)
    measured.clear()
    balltree.probe(tree, x[:40], held.score[:, -1], 11)
    assert sum(measured) <= first


def test_queries_meet_trees_without_broadcast_joins(spark, monkeypatch):
    """Written tables of vectors are few bytes as files if vectors repeat: no join may take one for a small table. Queries go in groups."""
    monkeypatch.setattr(balltree, "SHARD", 60)
    plans, saved = [], balltree.saved
    monkeypatch.setattr(balltree, "saved", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or saved(df, label))
    vectors = odd_vectors(6)
    want = brute_top(vectors, 8, lambda i: i is not None and i % 100 == 0, 10)
    for size in (balltree.QUERY_BYTES, 200):
        monkeypatch.setattr(balltree, "QUERY_BYTES", size)
        assert rows(balltree.search(vector_table(spark, vectors).repartition(3), F.col("vec_id") % 100 == 0)) == want
    beside = [p for label, p in plans if "hits" in label]
    assert len(beside) >= 5 and not any("BroadcastHashJoin" in p for p in beside)


def test_a_tree_that_leaves_nothing_out_is_few_products(monkeypatch):
    """Queries whose leaves come in different orders share products, and no row is held twice."""
    rng = np.random.default_rng(8)
    x, q = rng.integers(-500, 500, (2048, 32)).astype(np.int32), rng.integers(-500, 500, (50, 32)).astype(np.int32)
    centres, radii, order, cuts = balltree.build_tree(x, 32)
    tree = {"centres": centres, "radii": radii, "cuts": cuts, "x": x[order], "rank": order}
    calls, exact = [], balltree.exact
    monkeypatch.setattr(balltree, "exact", lambda q, rows_: calls.append(1) or exact(q, rows_))
    held = balltree.probe(tree, q, np.full(50, balltree.OPEN), 11)
    assert (held.score == -np.sort(-exact(q, x), axis=1)[:, :11]).all() and all(len(set(r)) == 11 for r in held.rank.tolist())
    assert len(calls) <= 64 + 6
