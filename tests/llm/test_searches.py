"""Hard negatives and ranked search against brute-force versions, on odd rows, ties, repeats and empty tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import bag_search, negatives

from .conftest import odd_rows, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# ------------------------------------------------------------- hard negatives

def brute_negatives(rows, every=50, positives=5, per=3):
    kept = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, label, tuple(math.floor(256 * x) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        own = sorted((-dot(a[2], r[2]), r[0]) for r in kept if r != a and r[1] == a[1])[:positives]
        other = sorted((-dot(a[2], r[2]), r[0]) for r in kept if r[1] != a[1])
        for s, i in own:
            for rank, (t, j) in enumerate([x for x in other if 50 * -s <= 100 * -x[0] <= 95 * -s][:per], 1):
                out.append((a[0], i, rank, j, -s, -t))
    return sorted(out)


def vectors(n, dims, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (6, dims))
    return [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + rng.normal(0, spread / 3, dims)).tolist()) for i in range(n)]


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("dims,block,chunk", [(64, 2048, 4096), (7, 2, 16), (20, 3, 40)])
def test_negatives_against_brute_force(spark, dims, block, chunk):
    rows = vectors(300, dims, dims)
    rows += [(1000, 1, rows[50][2]), (1050, 1, rows[50][2]), (1100, 2, rows[50][2])]  # ties
    rows += rows[:40]  # repeats are one row
    rows += [(100, 3, rows[9][2])]  # a second row of an anchor's id
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 50 == 0, block_rows=block, chunk_rows=chunk)
    want = brute_negatives(rows)
    assert len(want) > 30
    assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.4, 0.3]), (3, None, [0.5, 0.5]), (4, 2, None), (5, 2, [0.4, None]), (6, 2, [nan, 0.4]),
            (7, 2, [inf, 0.4]), (None, 2, [0.4, 0.4]), (8, 2, []), (9, 2, [0.4]), (10, 2, [0.4, 0.3, -900.0]), (-50, 2, [-0.5, -0.25]), (50, 7, [0.1, 0.1])]
    df = spark.createDataFrame(rows, VECTORS)
    for d in (df, df.select("*", *[F.lit(1).alias(c) for c in ("id", "no", "anchor", "score", "b", "packed")])):
        assert sorted(map(tuple, negatives.mine(d, F.col("vec_id") % 50 == 0).collect())) == brute_negatives(rows) != []
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("top", [1, 3, 200, 40_000, 1 << 24])
def test_table_scores_are_inner_products(top):
    rng = np.random.default_rng(top)
    values = rng.integers(-top, top + 1, (150, 24))
    planes = int(max(values.max(), -1 - values.min())).bit_length() + 1
    packed = negatives.planes_of(values, planes)
    assert packed.shape == (150, planes, 3)
    assert (negatives.values_of(packed) == values).all()
    assert (negatives.scores(values[:70], packed) == values[:70] @ values.T).all()


# ------------------------------------------------------------- ranked search

def brute_search(docs, items, k=50):
    docs = [(i, words(t, TERM, True)) for i, t in docs]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t, TERM, True))
    n_docs, n_all = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, ts in terms.items():
        found = []
        for i, c, n in docs:
            m = 50 + (50 * n * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["École", "漢字", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(1, 30)))) for i in range(n)]
    docs += [(n + i, docs[7][1].replace(" ", "-") if i % 2 else docs[7][1].upper()) for i in range(120)]  # one bag, more than k copies
    return docs, [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 12)))) for i in range(25)]


@pytest.mark.parametrize("block,chunk,k", [(256, 4096, 50), (4, 30, 50), (7, 64, 3)])
def test_search_against_brute_force(spark, block, chunk, k):
    docs, items = corpus(block)
    got = bag_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"),
                            k=k, block_items=block, chunk_classes=chunk)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search(docs, items, k)
    assert len(want) > 20 * k / 2
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_search_on_odd_rows(spark, odd, clash, none):
    texts = [(i, t) for i, t, *_ in odd_rows()]
    items = [(1, "One alpha BETA w17"), (1, "the"), (2, None), (None, "idiot 漢字かな"), (3, "  !! "), (4, "unseen"), (5, texts[5][1]), (6, "123 endoftext École")]
    schema = "item_id long, text string"
    asked = spark.createDataFrame(items, schema)
    want = brute_search(texts, items)
    assert {x[0] for x in want} == {1, None, 5, 6}
    for d, q in ((odd, asked), (clash, asked.select("*", *[F.lit(0).alias(c) for c in ("h", "w", "n", "doc_id", "m", "score")]))):
        assert sorted(map(tuple, bag_search.search(d, q).collect()), key=repr) == want
    assert bag_search.search(none, asked).count() == 0
    assert bag_search.search(odd, spark.createDataFrame([], schema)).count() == 0


def test_bags_of_one_class_are_scored_once(spark):
    """Copies and documents that differ outside the vocabulary only are one class."""
    docs = spark.createDataFrame([(i, f"apple pear zz{i}") for i in range(50)] + [(99, "pear pear apple")], "doc_id long, text string")
    words_of = bag_search._terms(spark.createDataFrame([(1, "apple pear")], "item_id long, text string"))
    from tablelens.llm.words import bitmap

    got = bag_search.bags(docs, bitmap(words_of.select("h"), "h", bag_search.FILTER_BITS)).groupBy("n", "terms", "tfs").count().collect()
    assert sorted(r["count"] for r in got) == [1, 50]
