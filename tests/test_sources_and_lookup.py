"""Sources, catalog, fuzzy lookup, KNN and vectors against brute force."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import lookup, retrieval
from tablelens.operators.knn import impute_knn
from tablelens.sources import catalog as cat
from tablelens.sources import files
from tablelens.sources.xlsx_writer import write_xlsx


def _tmp():
    return tempfile.mkdtemp(prefix="tablelens-src-")


def test_csv_errors(spark):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, "/nonexistent/x.csv")
    d = _tmp()
    open(f"{d}/empty.csv", "w").close()
    with pytest.raises(files.SourceError):
        files.read_csv(spark, f"{d}/empty.csv")
    with pytest.raises(files.SourceError):
        files.load(spark, f"{d}/data.txt")


def test_csv_latin1_and_na_tokens(spark):
    d = _tmp()
    with open(f"{d}/l1.csv", "wb") as fh:
        fh.write("name,qty,flag\nCafé,1,True\nNA,n/a,False\nÜber,3,\n".encode("latin-1"))
    assert [e for e, _ in files._by_encoding(spark, f"{d}/l1.csv")] == ["ISO-8859-1"]
    rows = files.read_csv(spark, f"{d}/l1.csv").collect()
    assert [r["name"] for r in rows] == ["Café", None, "Über"]
    assert [r["qty"] for r in rows] == [1, None, 3]
    assert [r["flag"] for r in rows] == [True, False, None]


def test_xlsx_round_trip(spark):
    d = _tmp()
    src = spark.createDataFrame([(1, "a&b", 2.5), (2, "<x>", None), (3, "c", 4.0)], "k long, s string, v double")
    write_xlsx(src.coalesce(1), d)
    out = files.load(spark, f"{d}/" + os.listdir(d)[0])
    assert dict(out.dtypes) == {"k": "bigint", "s": "string", "v": "double"}
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a&b", 2.5), (2, "<x>", None), (3, "c", 4.0)]


def test_catalog_append_if_absent(spark):
    c0 = cat.record_datasets(cat.empty_catalog(spark),
                             spark.createDataFrame([("b.csv", 5, 2, ""), ("a.csv", 3, 1, "")],
                                                   "file_name string, rows long, columns int, description string"))
    c1 = cat.record_datasets(c0, spark.createDataFrame([("a.csv", 9, 9, ""), ("c.xlsx", 1, 1, "sales")],
                                                       "file_name string, rows long, columns int, description string"))
    got = {r["file_name"]: (r["dataset_id"], r["rows"]) for r in c1.collect()}
    assert got == {"a.csv": (1, 3), "b.csv": (2, 5), "c.xlsx": (3, 1)}
    assert cat.recall(c1, description="SAL").first()["file_name"] == "c.xlsx"
    assert cat.recall(c1, file_name="%").count() == 0  # wildcard is literal
    assert cat.listing(c1, 2).filter("is_current").first()["name"] == "b"


def _partial(a, b):
    def lev(x, y):
        prev = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            cur = [i]
            for j, cy in enumerate(y, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (cx != cy)))
            prev = cur
        return prev[-1]
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 0.0
    return round(100 * (1 - min(lev(s, t[i:i + len(s)]) for i in range(len(t) - len(s) + 1)) / len(s)), 2)


def test_fuzzy_lookup_matches_brute_force(spark):
    names = ["sales_2023.csv", "customers.xlsx", "inventory.csv", "abc.csv", "stock levels.csv", "xyz"]
    terms = ["sales", "custmer", "inventry", "ab", "zz", "stock", "q", "levels", "xy"]
    nd = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, name_order int")
    td = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r["term"]: (r["name"], r["method"]) for r in lookup.fuzzy_lookup(td, nd).collect()}
    for t in terms:
        clean = [os.path.splitext(n)[0].lower() for n in names]
        exp = None
        for n, c in zip(names, clean):
            if t in c or c in t:
                exp = (n, "contains")
                break
        if exp is None:
            best, score = None, 60.0
            for n, c in zip(names, clean):
                s = _partial(t, c)
                if s > score:
                    best, score = n, s
            exp = (best, "fuzzy" if best else None)
        assert got[t] == exp, t


def _knn_brute(rows, k):
    X = np.array([[np.nan if v is None else float(v) for v in r] for r in rows])
    n, f = X.shape
    out = X.copy()
    keys = X[:, 0]
    for i in range(n):
        for j in range(f):
            if not np.isnan(X[i, j]):
                continue
            cands = []
            for o in range(n):
                if np.isnan(X[o, j]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[o])
                c = both.sum()
                d2 = ((X[i, both] - X[o, both]) ** 2).sum() * f / c if c else math.inf
                cands.append((d2, keys[o], X[o, j]))
            cands.sort()
            top = cands[:k]
            out[i, j] = np.nanmean(X[:, j]) if top[0][0] == math.inf else np.mean([v for _, _, v in top])
    return out


def test_knn_matches_brute_force_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a = None if i % 4 == 0 else float(rng.integers(0, 20))
        b = None if i % 5 == 1 else float(rng.normal())
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "k long, a double, b double")
    exp = _knn_brute(rows, 3)
    for block_rows in (1000, 7):  # one block, then several broadcast blocks
        got = impute_knn(df.repartition(5), "k", k=3, block_rows=block_rows).orderBy("k").collect()
        arr = np.array([[r["k"], r["a"], r["b"]] for r in got], dtype=float)
        np.testing.assert_allclose(arr, exp, rtol=1e-12, atol=1e-12)


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(5)
    V = rng.normal(size=(40, 6))
    Q = rng.normal(size=(3, 6))
    vd = spark.createDataFrame([(i, V[i].tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    qd = spark.createDataFrame([(i, Q[i].tolist()) for i in range(3)], "qid long, qvec array<double>")
    got = retrieval.top_k(vd.repartition(4), qd, k=4).collect()
    S = (Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (V / np.linalg.norm(V, axis=1, keepdims=True)).T
    for q in range(3):
        exp = list(np.argsort(-S[q], kind="stable")[:4])
        assert [r["vec_id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == exp


def test_fuzzy_lookup_random_strings_exact(spark):
    import random
    rnd = random.Random(7)
    alpha = "abcde"

    def word(lo, hi):
        return "".join(rnd.choice(alpha) for _ in range(rnd.randint(lo, hi)))
    names = sorted({word(1, 12) for _ in range(60)})
    terms = sorted({word(1, 12) for _ in range(80)})
    nd = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, name_order int")
    td = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r["term"]: (r["name"], r["method"]) for r in lookup.fuzzy_lookup(td, nd).collect()}
    for t in terms:
        exp = None
        for n in names:
            if t in n or n in t:
                exp = (n, "contains")
                break
        if exp is None:
            best, score = None, 60.0
            for n in names:
                s = _partial(t, n)
                if s > score:
                    best, score = n, s
            exp = (best, "fuzzy" if best else None)
        assert got[t] == exp, (t, got[t], exp)


@pytest.mark.parametrize("threshold,alpha,lo,hi", [(60.0, "ab", 1, 6), (60.0, "abc", 1, 4), (60.0, "ab", 4, 14), (45.0, "abcd", 1, 7), (80.0, "abc", 1, 9)])
def test_fuzzy_lookup_of_short_strings_exact(spark, threshold, alpha, lo, hi):
    """Few characters and repeated bigrams: every way of finding candidates."""
    import random
    rnd = random.Random(hi)
    word = lambda: "".join(rnd.choice(alpha) for _ in range(rnd.randint(lo, hi)))
    names, terms = sorted({word() for _ in range(25)}), sorted({word() for _ in range(40)} | {"z", "zz", "zzz", alpha[0]})
    got = {r["term"]: (r["name"], r["method"]) for r in lookup.fuzzy_lookup(
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, name_order int"), threshold=threshold).collect()}
    for t in terms:
        exp = next(((n, "contains") for n in names if t in n or n in t), None)
        if exp is None:
            score, _, best = max(((_partial(t, n), -i, n) for i, n in enumerate(names)), default=(0, 0, None))
            exp = (best, "fuzzy") if score > threshold else (None, None)
        assert got[t] == exp, t


def test_fuzzy_lookup_of_one_character_keeps_one_name_per_character(spark):
    """Single characters meet one row per character, not all names that have it."""
    names = spark.range(5000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("n"), F.col("id").alias("o"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("nl"))
    terms = spark.createDataFrame([("a", "a"), ("7", "7")], "t string, tl string")
    assert sorted((r["t"], r["n"]) for r in lookup._candidates(terms, names, 60.0).collect()) == [("7", "a7"), ("a", "a0")]


def test_knn_falls_back_to_mean_without_common_features(spark):
    rows = [(1, None, 1.0), (2, 5.0, None), (3, 7.0, None), (4, None, 3.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = {r["k"]: (r["a"], r["b"]) for r in impute_knn(df, "k", k=2, columns=["a", "b"]).collect()}
    # receivers 1 and 4 share no present feature with the donors of a -> mean of a
    assert out[1][0] == 6.0 and out[4][0] == 6.0
    # donors 2 and 3 for b: the only rows with b share nothing with them -> mean of b
    assert out[2][1] == 2.0 and out[3][1] == 2.0


def test_catalog_refresh_updates_counts(spark):
    schema = "file_name string, rows long, columns int, description string"
    c0 = cat.record_datasets(cat.empty_catalog(spark), spark.createDataFrame([("a.csv", 3, 1, "")], schema))
    c1 = cat.record_datasets(c0, spark.createDataFrame([("a.csv", 9, 4, "")], schema), refresh=True)
    r = c1.first()
    assert (r["dataset_id"], r["rows"], r["columns"]) == (1, 9, 4)
    assert cat.dataset_id_of(c1, "a.csv").first()["dataset_id"] == 1


def test_handle_missing_dispatch(spark):
    from tablelens.operators import cleaning
    df = spark.createDataFrame([(1, None, "x"), (2, 4.0, None), (3, 6.0, "y")], "k long, v double, s string")
    const = cleaning.handle_missing(df, "constant", fill_value=0.0).orderBy("k").collect()
    assert [r["v"] for r in const] == [0.0, 4.0, 6.0]
    knn = cleaning.handle_missing(df, "knn", key="k", k=1).orderBy("k").collect()
    assert knn[0]["v"] == 4.0  # nearest by key distance
    assert cleaning.handle_missing(df, "unknown").count() == 3


def test_workbooks_are_written_by_spark_and_read_in_bounded_steps(spark, monkeypatch):
    import tracemalloc
    import zipfile

    d = tempfile.mkdtemp()
    df = spark.range(30).select("id", F.concat(F.lit("é & <b> "), F.col("id").cast("string")).alias("name"), (F.col("id") / 4).alias("v")).repartition(3)
    for _ in range(2):  # a rerun replaces
        write_xlsx(df, f"{d}/books.xlsx")
    names = sorted(os.listdir(f"{d}/books.xlsx"))
    assert names == [f"part-0000{i}.xlsx" for i in range(3)] and all(zipfile.ZipFile(f"{d}/books.xlsx/{n}").testzip() is None for n in names)
    monkeypatch.setattr(files, "EXCEL_BATCH", 4)
    got = files.load(spark, f"{d}/books.xlsx")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(i, f"é & <b> {i}", i / 4) for i in range(30)]
    # a sheet's tree is never held whole
    import pandas as pd
    from tablelens.sources.xlsx_writer import workbook_bytes
    book = workbook_bytes(pd.DataFrame({"a": range(30_000), "b": ["x" * 50] * 30_000}))
    tracemalloc.start()
    assert sum(1 for _ in files.iter_xlsx(book)) == 30_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6, peak


def test_a_partition_of_any_size_becomes_workbooks_of_bounded_size(spark, monkeypatch):
    import tracemalloc

    from tablelens.sources import xlsx_writer

    d = f"{tempfile.mkdtemp()}/books.xlsx"
    n = 2 * xlsx_writer.BOOK_ROWS + 5
    one = spark.range(n).select("id", F.concat(F.lit("n "), F.col("id").cast("string")).alias("name")).coalesce(1)
    write_xlsx(one, d)
    assert sorted(os.listdir(d)) == [f"part-0000{i}.xlsx" for i in range(3)]
    got = files.load(spark, d)
    assert got.count() == n and got.exceptAll(one).isEmpty()
    write_xlsx(one.limit(7), d)  # fewer than before: the others go
    assert os.listdir(d) == ["part-00000.xlsx"] and files.load(spark, d).count() == 7
    # the sheet is compressed as rows come
    tracemalloc.start()
    book = xlsx_writer.Workbook(["a", "b"])
    for i in range(30_000):
        book.add([i, "x" * 500])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6, peak
    assert sum(1 for _ in files.iter_xlsx(book.close())) == 30_001


def test_workbooks_reach_python_in_chunks(spark, monkeypatch):
    import io
    import tracemalloc
    import zipfile

    d = f"{tempfile.mkdtemp()}/books.xlsx"
    df = spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("name")).repartition(3)
    write_xlsx(df, d)
    monkeypatch.setattr(files, "CHUNK", 700)
    cut = files._chunks(spark.read.format("binaryFile").load(d))
    assert cut.agg(F.max(F.length("chunk"))).first()[0] == 700 and cut.filter("last").count() == 3 < cut.count()
    assert files.load(spark, d).exceptAll(df).isEmpty() and files.load(spark, d).count() == 300
    # shared strings are read from a file
    n = 30_000
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(write_one(df))) as old, zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            if "sheet1" not in name:
                new.writestr(name, old.read(name))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{'é' * 200}{i}</t></si>" for i in range(n)) + "</sst>")
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(
            f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{n - 1 - i}</v></c></row>' for i in range(n)) + "</sheetData></worksheet>")
    tracemalloc.start()
    assert all(row == [f"{'é' * 200}{n - 1 - i}"] for i, row in enumerate(files.iter_xlsx(buf.getvalue())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6, peak


def write_one(df) -> bytes:
    from tablelens.sources.xlsx_writer import workbook_bytes

    return workbook_bytes(df.limit(1).toPandas())


@pytest.mark.parametrize("key, folder", [("load_by_suffix", "load-xlsx-*/part.xlsx"), ("scan_xlsx", "xlsx-part-*")])
def test_queries_write_workbooks_with_every_core(spark, key, folder):
    import glob

    from tablelens.plans.registry import QUERIES
    from tablelens.session import checkpoint_root

    books = lambda: set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/{folder}/*.xlsx"))
    before = books()
    out = QUERIES[key](spark, "/root/testdata/sf0.001")
    assert len(books() - before) == max(4 if key == "scan_xlsx" else 2, spark.sparkContext.defaultParallelism)
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert out.count() == (2 * n + 1 if key == "load_by_suffix" else n)
