"""Brute-force versions of the text operators, on odd rows, clashing columns and empty tables."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, langid, line_dedup, lm_score, minhash, quality, substring, toxicity
from tablelens.llm.registry import vocabulary_path

from .conftest import ALNUM, LINE, odd_rows, remainder, words


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def brute_lines(rows, k=3):
    docs = {(i, t) for i, t, *_ in rows if t is not None}
    rank = lambda i: (i is None, i or 0)
    first, places = {}, defaultdict(list)
    for i, t in docs:
        lines = [x.strip(" \t\x0b\x0c\r") for x in t.split("\n")]
        lines = [x for x in lines if x]
        for p in range(len(lines) - k + 1):
            w, at = tuple(lines[p:p + k]), (*rank(i), p)
            first[w] = min(first.get(w, at), at)
            places[i, t].append((w, at, p))
    out = []
    for i, t, *_ in rows:
        gone = {p + d for w, at, p in places.get((i, t), []) if at > first[w] for d in range(k)}
        kept, n = [], 0
        for x in (t or "").split("\n"):
            if x.strip(" \t\x0b\x0c\r"):
                n += 1
                if n - 1 in gone:
                    continue
            kept.append(x)
        out.append((i, None if t is None else "\n".join(kept), n, len(gone)))
    return sorted(out, key=repr)


def test_line_dedup(odd, clash, none):
    want = brute_lines(odd_rows())
    assert any(x[3] for x in want)
    for df in (odd, clash):
        out = line_dedup.dedup_lines(df)
        assert out.columns[: len(df.columns)] == df.columns
        assert rows_of(out, "doc_id", "text", "lines_total", "lines_removed") == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_one_id(spark):
    """Texts of one id, null ids above all, keep a header they share once; rows of one id and text are one document."""
    head = "one\ntwo\nthree"
    rows = [(i, f"{head}\n{x}") for i, some in ((None, "abc"), (7, "def")) for x in some]
    out = line_dedup.dedup_lines(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)).collect()
    whole = {(r.doc_id, r.text) for r in out if r.lines_removed == 0}
    assert len(whole) == 1 and whole <= set(rows) and next(iter(whole))[0] == 7
    assert all(r.text in "abcdef" and r.lines_removed == 3 for r in out if (r.doc_id, r.text) not in whole)
    nulls = line_dedup.dedup_lines(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert sorted(r.lines_removed for r in nulls) == [0, 3, 3]


def brute_substring(rows, k=20):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            key, at = tuple(w[p:p + k]), (*rank(i), p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p:p + k])] < (*rank(i), p) for q in range(p, p + k)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(odd, clash, none):
    want = brute_substring(odd_rows())
    for df in (odd, clash):
        assert rows_of(substring.repeated_spans(df), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring.repeated_spans(none).count() == 0


def test_substring_dedup_of_a_hot_minimiser(spark, odd, none, monkeypatch):
    """No bucket gets more of one minimiser than the bound, however many distinct strings lie under it."""
    monkeypatch.setattr(substring, "HOT_BYTES", 0)
    assert rows_of(substring.repeated_spans(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(odd_rows())
    assert substring.repeated_spans(none).count() == 0
    limit = 5000
    monkeypatch.setattr(substring, "HOT_BYTES", limit)
    common = LINE.split()[:19]
    # every text holds the common words, each between other words, and half of the texts are there twice
    texts = [" ".join([*(f"a{i}x{j}" for j in range(12)), *common, *(f"b{i}x{j}" for j in range(12))]) for i in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[::2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substring.repeated_spans(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
    strings = spark.createDataFrame([(g, bytes(100)) for g in (1, 2) for _ in range(10 if g == 1 else 100)], "g long, packed binary")
    few, hot = substring._by_bytes(strings)
    assert {r.g for r in few.collect()} == {1} and {r.g for r in hot.collect()} == {2}


def test_substring_dedup_of_one_word(spark):
    df = spark.createDataFrame([(1, "a " * 50), (2, "b " * 19), (3, "a " * 20 + "c")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.repeated_spans(df).collect()}
    assert got == {1: 49, 2: 0, 3: 20}


def sets(t, k):
    w = words(t, fold=True)
    return {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(rows, k, num=80, den=100):
    docs = sorted({(i, t) for i, t, *_ in rows}, key=repr)
    s = [sets(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and den * both >= num * (len(s[a]) + len(s[b]) - both):
            parent[root(a)] = root(b)
    low = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    comp = {d: low.get(root(x)) for x, d in enumerate(docs)}
    return sorted([(i, len(sets(t, k)), comp[i, t], i == comp[i, t]) for i, t, *_ in rows], key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(odd, clash, none, k):
    want = brute_near(odd_rows(), k)
    for df in (odd, clash):
        assert rows_of(minhash.near_duplicates(df, shingle=k), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_edited_copies(spark):
    """Copies of one base with random edits: most are near the base only, so the base has to be found as their centre."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        mine = list(base)
        for p in rng.choice(300, int(rng.integers(2, 14)), replace=False):
            mine[p] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(mine)))
    rows += [(2000 + i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.near_duplicates(df, shingle=4), "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, 4)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 150)], "a long, b long")
    got = {r.c: r.comp for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 150, 200)}}


def brute_contaminated(rows, items, k=13):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM, True)
        m = min(k, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[p:p + m])].add(i)
    sizes = {len(x) for x in wins}
    out = []
    for i, t, *_ in rows:
        w = words(t, ALNUM, True)
        hit, found = set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if ids := wins.get(tuple(w[p:p + m])):
                    hit |= set(range(p, p + m))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, odd, clash, none):
    items = [(1, LINE), (2, "one"), (3, None), (4, ""), (5, LINE), (6, "Kappa, LAMBDA mu"), (7, "école ſ"), (8, "never seen anywhere"), (9, "w1 w2 w3 w4 w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(odd_rows(), items)
    assert any(x[4] for x in want)
    for df in (odd, clash):
        out = decontaminate.decontaminate(df, bench).withColumn("items", F.sort_array("items"))
        assert rows_of(out, "doc_id", "n_words", "n_hit", "items", "contaminated") == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert rows_of(decontaminate.decontaminate(odd, bench.limit(0)), "n_hit")[-1] == (0,)


def test_bpe(odd, clash, none, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    for df in (odd, clash, small):
        out = bpe.decode(bpe.encode(df, vocabulary_path()), vocabulary_path())
        assert [c for c in df.columns if c not in ("ids", "n_tokens")] == out.columns[: len(df.columns) - ("ids" in df.columns)]
        for r in out.collect():
            e = lib.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == e and r.n_tokens == len(e)
            assert r.decoded == lib.decode(e, skip_special_tokens=False)
        both = bpe.encode_decode(df, vocabulary_path())
        assert both.columns == out.columns and rows_of(both, "ids", "n_tokens", "decoded") == rows_of(out, "ids", "n_tokens", "decoded")
    assert bpe.encode(none, vocabulary_path()).count() == 0


def test_bpe_words_against_the_library():
    import random

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), "rb") as f:
        model = bpe.Bpe(f.read())
    rnd = random.Random(2)
    parts = "the of international strengthen anti photo aaa ### éà 漢字 9 's ll".split()
    texts = ["".join(rnd.choice(parts)[: rnd.randint(1, 8)] for _ in range(rnd.randint(1, 7))) for _ in range(4000)] + ["ab" * k for k in range(1, 120)]
    for t, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_bpe_takes_words_of_a_batch_together(monkeypatch):
    import random

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), "rb") as f:
        model = bpe.Bpe(f.read())
    alone = []
    for name in ("propose", "merge"):
        monkeypatch.setattr(bpe.Bpe, name, lambda self, k, name=name, f=getattr(bpe.Bpe, name): alone.append((name, k)) or f(self, k))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abeinorsté漢한 '9#\x00") for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(rnd.choice("abeinorst") for _ in range(n)) for n in range(1, bpe.LONG + 1)]
    for batch in (texts, texts[:0], [""], texts):
        for t, ids in zip(batch, model.encode(batch)):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert not alone
    longer = ["".join(rnd.choice("abeinorst") for _ in range(n)) for n in range(bpe.LONG + 1, bpe.LONG + 40)] + ["漢" * 90, "the" * 2000]
    for t, ids in zip(longer, model.encode(longer + texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert {k for _, k in alone} == {t.encode().decode("latin-1") + bpe.END for t in longer}


def test_bpe_table():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 5, 4000):
        codes = np.unique(rnd.integers(0, 1 << 36, n))
        table = bpe.Table(codes, np.arange(len(codes)))
        assert table.get(codes).tolist() == list(range(len(codes)))
        assert (table.get(np.setdiff1d(rnd.integers(0, 1 << 36, 9000), codes)) == -1).all()


def brute_measures(t):
    t = t or ""
    w = words(t)
    wins = Counter(tuple(w[p:p + 8]) for p in range(len(w) - 7))
    cover = {q for p in range(len(w) - 7) if wins[tuple(w[p:p + 8])] > 1 for q in range(p, p + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality(odd, clash, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted([(i, *brute_measures(t)) for i, t, *_ in odd_rows()], key=repr)
    for df in (odd, clash):
        assert rows_of(quality.features(df), "doc_id", *cols) == want
        plain = quality.cascade(df)  # every rule from the text
        measured = quality.cascade(quality.features(df), quality.measured_rules())
        kept = lambda x: rows_of(x.select("doc_id", F.col("rejected_by").isNull().alias("ok")), "doc_id", "ok")
        assert kept(plain) == kept(measured)
    assert quality.cascade(none).count() == 0


def test_quality_order_is_by_rejections_per_work(spark):
    df = spark.range(100)
    r = [quality.Rule("dear", F.col("id") < 50, F.lit(100)), quality.Rule("cheap", F.col("id") < 20, F.lit(1)), quality.Rule("useless", F.lit(False), F.lit(1))]
    assert [s["rule"] for s in quality.plan_order(df, r)] == ["cheap", "dear", "useless"]
    got = quality.cascade(df, r).groupBy("rejected_by").count().collect()
    assert {x.rejected_by: x["count"] for x in got} == {"cheap": 20, "dear": 30, None: 50}


def test_quality_costs_are_measured_on_a_sample_of_fixed_size(spark):
    df = spark.range(0, 60_000, 1, 40).withColumn("text", F.repeat(F.lit("word and Word "), 40))
    for parts in (1, 40):
        assert 1700 < quality.sampled(df.coalesce(parts)).count() < 2300
    few = quality.sampled(df)
    slow = F.length(F.regexp_replace(F.repeat("text", 60), r"(\p{Lu})(\p{Ll}+)", "$2$1")) > 0
    stats = quality.plan_order(few, [quality.Rule("slow", slow), quality.Rule("quick", F.col("id") >= 0)])
    assert [s["rule"] for s in stats] == ["quick", "slow"] and stats[0]["rejects"] == stats[1]["rejects"] == 1.0
    assert stats[1]["work"] > stats[0]["work"]


def test_lm_score(small, odd, clash, none):
    import math

    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    out = lm_score.score(small, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    got = {r.doc_id: r for r in out.collect()}
    toks = {i: [*words(t, fold=True), "\n"] for i, t in rows}
    held = {i for i in toks if remainder(i, 10) == 0}
    c = Counter(x for i, t in toks.items() if i not in held for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (i not in held, len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel_tol=1e-9)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert all(r.score < 0 for r in got.values())
    assert lm_score.score(odd, F.col("doc_id") > 3).count() == odd.count()
    assert lm_score.score(none, F.lit(True)).count() == 0
    key = lambda df: sorted(((r.doc_id, r.n_tokens, r.trained, round(r.score, 6)) for r in df.collect()), key=repr)
    assert key(lm_score.score(clash, F.col("doc_id") > 3)) == key(lm_score.score(odd, F.col("doc_id") > 3))


def test_lm_rows_without_an_id_are_not_held_out(spark, odd, tmp_path):
    from tablelens.llm.registry import QUERIES

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op1_lm_score"](spark, str(tmp_path)).select("doc_id", "held_out").distinct().collect()
    assert {r.doc_id: r.held_out for r in got} == {i: i is not None and remainder(i, 10) == 0 for i, *_ in odd_rows()}


def test_lm_probabilities_sum_to_one(spark):
    """Over all one-word texts of the vocabulary plus one unknown word per class."""
    vocab = ["aa", "ab", "ba", "bb."]
    train = [(i, " ".join(vocab[(i + j) % 4] for j in range(i % 5))) for i in range(200)]
    unseen = {}
    for x in range(2000):
        w = f"{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}zz{x}" + "." * (x % 2)
        unseen.setdefault(int(lm_score._classes(_words(w))[0]), w)
    extra = [(1000 + k, w) for k, w in enumerate([*vocab, *unseen.values()])]
    df = spark.createDataFrame(train + extra + [(5000, None)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm_score.score(df, F.col("doc_id") < 1000).collect()}
    # each score is P(word) * P(end | word); P(end | word) is found as a two-token text is to its first token
    assert set(unseen) == set(range(1, lm_score.CLASSES))
    assert all(s < 0 for s in out.values()) and sum(10 ** out[i] for i, _ in extra) + 10 ** out[5000] <= 1 + 1e-6


def _words(w):
    from tablelens.llm.words import Words, blank_table, folded

    b = np.frombuffer(w.encode(), np.uint8)
    return Words(b, np.array([0, len(b)]), folded(blank_table()))


def test_language_id(spark, small, odd, clash, none):
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = langid.learn(small.filter(rest != 2))
    held = langid.label(small, model).filter(rest == 2)
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    for df in (odd, clash):
        got = {(r.doc_id, r.text): r for r in langid.label(df, model).collect()}
        assert got[1, None].lang_pred == "und" and got[14, "!!! 123 ..."].lang_pred == "und" and got[2, ""].score == 0
        assert got[15, "漢字かな"].lang_pred in model.langs
        assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.label(none, model).count() == 0
    assert langid.label(odd, langid.learn(none)).filter("lang_pred <> 'und'").count() == 0


def test_language_spans(spark, small):
    model = langid.learn(small)
    pick = {r.lang: r.text for r in small.filter("length(text) between 400 and 3000").collect()}
    a, b = sorted(pick)[:2]
    first, second = " ".join(pick[a].split()[:60]), " ".join(pick[b].split()[:60])
    r = langid.label(spark.createDataFrame([(1, f"{first} {second}")], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == [a, b] and abs(r.spans[0].end - len(langid_words(first))) <= 4


def langid_words(t):
    import re

    return re.findall(r"[a-zA-Z\x80-\U0010ffff]+", t)


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    counts = np.array([4, 0, 1, 6, 3])
    s = rng.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
    path = langid.viterbi(s, counts, 2.0)
    at = 0
    for n in counts.tolist():
        if n:
            worth = lambda p: sum(s[at + t, x] for t, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
            assert worth(path[at:at + n].tolist()) == pytest.approx(max(map(worth, product(range(3), repeat=n))), abs=1e-4)
        at += n


def test_toxicity(spark, odd, clash, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = toxicity.learn(docs, labels.filter(rest != 2))
    assert {"idiot", "moron"} <= set(model.names)
    held = toxicity.score(docs, model).join(labels, "doc_id").filter(rest == 2).selectExpr("toxic", "score >= 0.3 as p").groupBy("toxic", "p").count().collect()
    n = {(r.toxic, r.p): r["count"] for r in held}
    assert n[1, True] >= 0.8 * (n[1, True] + n[1, False]) and n.get((0, True), 0) <= 0.02 * n[0, False]
    for df in (odd, clash):
        got = {(r.doc_id, r.text): r.score for r in toxicity.score(df, model).collect()}
        assert got[1, None] == got[2, ""] < 0.3 <= got[16, "idiot " * 5 + "<|endoftext|>"]
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.learn(none, labels)
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_toxicity_terms_of_all_labels(spark):
    """The lexicon isn't limited to the fitted sample, nor to a number of terms, and copies of a text count once."""
    bad = [f"{x}{y}zzq" for x in "bdfg" for y in "aei"]
    copied = " ".join(f"q{i:04d}x" for i in range(900))
    texts = ([(f"plain words number {i} and {i % 13} more of them", 0) for i in range(300)]
             + [(f"plain words number {i} with {bad[i % 12]} and {i % 13} more", 1) for i in range(300, 396)] + [(copied, 1)] * 40)
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    # a document that is there twice, and one of two labels, count once
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(300, texts[300][0])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(300, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_rows=150)
    assert set(bad) <= set(model.names) and not any(x.startswith("q0") for x in model.names)
    assert len(model.names) == len(model.terms) == len(model.weights) - toxicity.PATTERNS - 2
    new = spark.createDataFrame([(i, f"other plain words {x} here") for i, x in enumerate([*bad, "and"])], "doc_id long, text string")
    got = [r.score for r in toxicity.score(new, model).orderBy("doc_id").collect()]
    assert min(got[:-1]) >= 0.3 > got[-1]
    several = toxicity._distinct_texts(docs.selectExpr("doc_id _id", "text _text"), labels.selectExpr("doc_id _id", "cast(toxic as double) _y").groupBy("_id").agg(F.max("_y").alias("_y")))
    assert several.agg(F.sum("_share")).first()[0] == len({t for t, _ in texts})


def test_label_model_finds_accuracies_and_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    weak = np.where(rng.random(4000) < 0.6, y, ~y).astype(int)
    other = np.where(rng.random(4000) < 0.8, y, ~y).astype(int)
    q, v = toxicity.label_model(np.column_stack([good, good, weak, other]), np.where(rng.random(4000) < 0.8, y, ~y))
    assert v[0]["toxic_if_toxic"] > v[2]["toxic_if_toxic"] and v[0]["voice"] < 0.6 < v[3]["voice"]
    assert ((q > 0.5) == y).mean() > 0.88


def test_near_duplicates_finds_planted_pairs_just_above_the_threshold(spark):
    """Recall on pairs of similarity 0.80 to 0.85, the hardest ones: a fresh text each, some words replaced."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, pairs = [], []
    while len(pairs) < 600:
        base = [word() for _ in range(rng.randrange(120, 400))]
        copy = list(base)
        for i in rng.sample(range(len(base)), max(1, len(base) // 47 + rng.randrange(-1, 2))):
            copy[i] = word()
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, copy))
        share = len(a & b) / len(a | b)
        if 0.80 <= share < 0.85:
            pairs.append((len(rows), share))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    found = sum(got[i] == got[i + 1] for i, _ in pairs)
    assert sum(share < 0.82 for _, share in pairs) > 100
    assert found == len(pairs), f"{found} of {len(pairs)}"
    assert len(set(got.values())) == len(pairs)
