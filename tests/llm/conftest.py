import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=WORD, fold=False):
    text = text or ""
    return re.findall(pattern, text.translate(UP) if fold else text)


def remainder(i, k):
    return None if i is None else zlib.crc32(str(i).encode()) % k


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators could mistake for their own.
CLASH = ["row", "n_words", "score", "key", "c", "spans", "text_hash", "ids", "rule", "h", "_id"]
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def odd_rows():
    """Null ids and texts, empty, blank, very long, repeated and near rows, non-ASCII and control characters."""
    long = " ".join(f"w{i % 7001}" for i in range(60_000))
    block = "\n".join([LINE, LINE.upper(), LINE[::-1]])
    near = LINE * 3
    return [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", "en"), (4, "one", "en"), (5, long, "en"), (None, long, None),
        (6, block, "en"), (7, block + "\nand one more line", "en"), (8, block + "\n" + block, "en"), (None, None, None), (9, "the " * 500, "en"),
        (10, near, "fr"), (11, near + " tail", "fr"), (12, near, None), (13, "«ünï» ÉCOLE ſ İstanbul \x1c\x85\u2003x 漢字 Σσς", "fr"),
        (14, "!!! 123 ...", "en"), (15, "漢字かな", None), (16, "idiot " * 5 + "<|endoftext|>", "en"), (-3, near, "de"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, g, "src", None if t is None else len(t)) for i, t, g in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clash(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("z").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
