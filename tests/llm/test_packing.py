"""Packing: pieces against the tokenizers library, cuts against a plain dynamic programme."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tablelens.llm import packing
from tablelens.llm.registry import QUERIES, byte_vocabulary_path

from .conftest import SF, odd_rows


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(byte_vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    return lib


@pytest.fixture(scope="module")
def encoder():
    with open(byte_vocabulary_path(), "rb") as f:
        return packing.Encoder(f.read())


def padding(n, size=1024):
    return 0 if n & (n - 1) == 0 else size - n


def checked(pieces, texts, lib, size=1024):
    """Every id in exactly one piece, sequences gapless; (padding, tokens) in all."""
    want = sorted(tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts)
    docs, sequences = defaultdict(dict), defaultdict(dict)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        assert p.offset not in sequences[p.sequence_id]
        sequences[p.sequence_id][p.offset] = p.length
        docs[p.doc_id].setdefault(p.start, []).append((ids, p.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset in sorted(s):
            assert offset == at
            at += s[offset]
        assert at <= size
    totals = [sum(s.values()) for s in sequences.values()]
    assert sum(totals) == sum(map(len, want))
    return docs, want, sum(padding(n, size) for n in totals), sum(totals)


def test_whole_table(spark, lib):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    found, want, pad, tokens = checked(packing.pack(docs.repartition(3), byte_vocabulary_path()).collect(), [r.text for r in rows], lib)
    got = []
    for parts in found.values():
        ids = []
        for start in sorted(parts):
            ((x, n),) = parts[start]
            assert start == len(ids)
            ids += x
        assert n == len(ids)
        got.append(tuple(ids))
    assert sorted(got) == want
    assert pad < 0.01 * tokens


def test_odd_rows(spark, odd, clash, none, lib):
    texts = [t for _, t, *_ in odd_rows()]
    for df in (odd, clash):
        pieces = packing.pack(df, byte_vocabulary_path()).collect()
        found, want, _, _ = checked(pieces, texts, lib)
        assert [x for x, _ in found[1][0]] == [[0]] and len(found[4][0]) == 2  # null text; repeated rows are documents of their own
        assert sum(len(v) for v in found[None].values()) >= 2
        assert 50256 in np.frombuffer(next(p.ids for p in pieces if p.doc_id == 16 and p.start == 0), "<u4")
    assert packing.pack(none, byte_vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, byte_vocabulary_path(), size=1000)


def test_query(spark, lib):
    import zlib

    out = QUERIES["op11_packing"](spark, SF)
    assert dict(out.dtypes) == {**dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    for r in out.collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_encoder_equals_the_library_on_every_character(lib, encoder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 1 << 15):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}'s {chr(c)}.\n" for c in points[i : i + (1 << 15)]]
        for t, e in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert encoder(t).tolist() == e.ids


def test_long_text_in_parts(lib, encoder, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["a", "é", " ", "  ", "\n", "　", "\xa0", "word", "7", "!", "'s", "漢", "<|endoftext|>"]) for _ in range(400))
        assert encoder(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_other_vocabularies(lib):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        enc = packing.Encoder(f.read())
    other = Tokenizer.from_file(path)
    other.no_truncation()
    assert not enc.splits and enc("Some text, here!").tolist() == other.encode("Some text, here!", add_special_tokens=False).ids


def plain_cost(pos, cost, size):
    f = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                f[j] = min(f[j], f[i] + padding(n, size) + cost[j])
    return f[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 32, 64])
    pos, cost = [0], [0.0]
    for _ in range(rng.randrange(1, 60)):
        pos.append(pos[-1] + rng.randrange(1, rng.choice([4, 8, size + 1])))
        cost.append(float(rng.choice([0, 2, 6])))
    cuts = packing.best_cuts(np.array(pos), np.array(cost), size)
    chosen = [0, *cuts]
    assert chosen[-1] == len(pos) - 1 and all(pos[b] - pos[a] <= size for a, b in zip(chosen, chosen[1:], strict=False))
    got = sum(padding(pos[b] - pos[a], size) + cost[b] for a, b in zip(chosen, chosen[1:], strict=False))
    assert got == pytest.approx(plain_cost(pos, cost, size))


def test_cuts_fall_at_sentences(spark, encoder):
    """Windows end at sentences or documents, but for sentences longer than LONG and a stream's end."""
    df = spark.createDataFrame([(i, "It was so. " * 700 + "Then it ended.") for i in range(40)], "doc_id long, text string").coalesce(1)
    ends = {}
    for p in packing.pack(df, byte_vocabulary_path()).collect():
        ends.setdefault(p.doc_id, set()).add(p.start)
    for i, starts in ends.items():
        if i < 39:
            ids = encoder("It was so. " * 700 + "Then it ended.")
            assert starts <= {0, *encoder.sentence_ends(ids).tolist(), len(ids)}
