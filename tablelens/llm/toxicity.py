"""Toxicity by weak supervision.

1. On all labelled documents a lexicon is mined: every word and word beginning whose
   documents are labelled toxic almost always, equal texts counted once (so copies of a
   document don't bring in its other words).
2. Voters: the lexicon is dealt over lexicon voters (toxic if one of their terms
   occurs, else no opinion); pattern voters look at shouting, exclamation runs and
   symbols; one voter says clean where no term occurs.
3. A generative label model (each voter's chance of each vote given the class,
   by EM started from the labels) estimates how accurate the voters are; voters
   whose votes go together beyond the class share one voice, by their
   correlation given the class.  Its posterior is the label of each document.
4. A logistic classifier over lexicon terms and patterns is fitted to the posteriors.
   Terms that cover the fitted documents have weights of their own (each next one that of
   most toxic documents, which count half as much with each term they have), the others
   share the weights of having a term and of how many there are.

The label model and the classifier are fitted on no more than ``SAMPLE_ROWS`` labelled
documents, those whose id hashes lowest; the sample's votes and the lexicon are gathered
on the driver.  Scoring reads every document's whole text, and nothing else of it.

Null and empty texts score what a text without any term scores.  A document with
several labels counts as toxic if one says so, so does a text of several documents
in the lexicon's counts; null labels count for nothing.
Without labelled documents, or with one class only, every text scores that
class's share (0 without labels).  Where no term passes (fewer than ``MIN_DOCS`` toxic texts, say),
patterns alone decide, and texts without any score about the toxic share of the labels.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelens.llm.langid import letter_table
from tablelens.llm.words import U64, Words, _byte_values, i64, mix, powers, take_bytes, text_slices, tidy
from tablelens.session import ship_package

#: Labelled documents that the label model and the classifier are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Voters that the terms are dealt over.
LEXICON_VOTERS = 24
#: A term needs as many toxic texts and such a share of toxic ones among its texts; for a weight of its own, such a worth of documents without other terms.
MIN_DOCS, MIN_PRECISION, MIN_NEW = 5, 0.9, 1.5
PREFIXES = (4, 5, 6)  # bytes
PATTERNS = 4


def _terms(w: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, end, hash) of every word and of its first bytes."""
    out = [(np.arange(len(w.starts)), w.ends, w.hashes())]
    if len(w.starts) == 0:
        return out
    values, p = _byte_values(w.table.tobytes(), 0), powers(max(PREFIXES), 0)
    size = w.ends - w.starts
    h = np.zeros(len(w.starts), U64)
    last = len(w.data) - 1
    for i in range(max(PREFIXES)):
        h = h + values[w.data[np.minimum(w.starts + i, last)]] * p[i]
        if i + 1 in PREFIXES:
            x = np.flatnonzero(size > i + 1)
            out.append((x, w.starts[x] + i + 1, mix(h[x] ^ U64(0xA5A5 + i))))
    return out


def _patterns(w: Words) -> np.ndarray:
    """Per text: shares of upper-case letters, exclamation marks and symbols in its bytes, and long repeats of one byte."""
    n = len(w.offs) - 1
    doc = np.repeat(np.arange(n), np.diff(w.offs))
    size = np.maximum(np.diff(w.offs), 1)
    upper = (w.data >= 0x41) & (w.data <= 0x5A)
    bang = w.data == 0x21
    sign = np.isin(w.data, np.frombuffer(b"#*$%&|<>@", np.uint8))
    triple = np.zeros(len(w.data), bool)
    triple[2:] = (w.data[2:] == w.data[1:-1]) & (w.data[1:-1] == w.data[:-2])
    return np.stack([np.bincount(doc, x, n) / size for x in (upper, bang, sign, triple)], 1)


@dataclass
class ToxicityModel:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # sorted hashes
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(PATTERNS + 1))  # terms, patterns, any term, how often
    bias: float = 0.0
    share: float | None = 0.0  # the score of every text, if nothing could be learned
    voters: list[dict] = field(default_factory=list)


def _hits(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every occurrence of a term."""
    docs, which = [], []
    if len(terms):
        small = np.zeros(1 << 20, bool)
        small[terms & U64(0xFFFFF)] = True
        doc = w.doc_of()
        for word, _, h in _terms(w):
            x = np.flatnonzero(small[h & U64(0xFFFFF)])
            at = np.minimum(np.searchsorted(terms, h[x]), len(terms) - 1)
            x, at = x[terms[at] == h[x]], at[terms[at] == h[x]]
            docs.append(doc[word[x]])
            which.append(at)
    return (np.concatenate(docs), np.concatenate(which)) if docs else (np.zeros(0, int), np.zeros(0, int))


def _features(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms present as (text, term) pairs, and per text: patterns, any term, log of occurrences per 100 words."""
    n = len(w.offs) - 1
    doc, which = _hits(w, terms)
    pair = np.unique(doc.astype(np.int64) * max(len(terms), 1) + which)
    often = np.bincount(doc, minlength=n) / np.maximum(w.counts, 1)
    dense = np.column_stack([_patterns(w), np.log1p(100 * often)])
    return pair // max(len(terms), 1), pair % max(len(terms), 1), dense


def _distinct_texts(src: DataFrame, marks: DataFrame) -> DataFrame:
    """(_text, _y, _share) of labelled rows: one document for each distinct text, toxic if one of the text's
    documents is; its rows have shares that add up to 1."""
    src = src.filter(F.col("_text").isNotNull()).withColumn("_d", F.md5(F.col("_text").cast("binary")))
    one = (src.select("_id", "_d").join(marks, "_id").groupBy("_id", "_d").agg(F.max("_y").alias("_y"), F.count(F.lit(1)).alias("m"))
           .groupBy("_d").agg(F.max("_y").alias("_y"), F.min(F.struct("_id", "m")).alias("x"))
           .select("x._id", "_d", "_y", (1 / F.col("x.m")).alias("_share")))
    return src.join(one, ["_id", "_d"]).select("_text", "_y", "_share")


def _mine(src: DataFrame, marks: DataFrame, table) -> tuple[np.ndarray, list[str]]:
    """Hashes (sorted) and names of all terms that pass."""
    @tidy
    def run(batches):
        for rows, w in text_slices(batches, "_text", table):
            y, share, doc = rows.column("_y").to_numpy(), rows.column("_share").to_numpy(), w.doc_of()
            for word, _, h in _terms(w):
                # each term once a document
                order = np.lexsort((h, doc[word]))
                d, hh = doc[word][order], h[order]
                once = order[np.append(True, (d[1:] != d[:-1]) | (hh[1:] != hh[:-1]))] if len(order) else order
                u, inv = np.unique(h[once], return_inverse=True)
                d = doc[word[once]]
                yield pa.RecordBatch.from_arrays([i64(u), *[pa.array(np.bincount(inv, x[d], len(u)), pa.float64()) for x in (share, y * share)]], ["h", "n", "pos"])

    counts = (_distinct_texts(src, marks).mapInArrow(run, "h long, n double, pos double").groupBy("h")
              .agg(F.round(F.sum("n"), 3).alias("n"), F.round(F.sum("pos"), 3).alias("pos")))
    best = counts.filter((F.col("pos") >= MIN_DOCS) & (F.col("pos") >= MIN_PRECISION * (F.col("n") + 0.5))).select("h").toArrow()
    terms = np.sort(best["h"].to_numpy().view(U64))
    if len(terms) == 0:
        return terms, []

    @tidy
    def name(batches):
        # a name is sought once in a task
        seen = np.zeros(len(terms), bool)
        for _, w in text_slices(batches, "_text", table):
            for word, end, h in _terms(w):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                x = np.flatnonzero((terms[at] == h) & ~seen[at])
                u, first = np.unique(at[x], return_index=True)
                x = x[first]
                seen[u] = True
                yield pa.RecordBatch.from_arrays([pa.array(u), take_bytes(w.data, w.starts[word[x]], end[x])], ["at", "term"])

    got = src.select("_text").mapInArrow(name, "at long, term binary").groupBy("at").agg(F.min("term").alias("term")).orderBy("at").collect()
    return terms, [bytes(r.term).decode("utf-8", "replace") for r in got]


def _cover(doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Terms (sorted) from (document, term) pairs: always the one of most documents, a document counting half as much with each term it has."""
    order = np.argsort(term, kind="stable")
    ids, first = np.unique(term[order], return_index=True)
    docs = np.split(doc[order], first[1:]) if len(ids) else []
    worth, chosen = np.ones(int(doc.max()) + 1 if len(doc) else 0), []
    # a value only falls, so a term that still leads with its value of now is the best
    heap = [(-float(len(d)), i) for i, d in enumerate(docs)]
    heapq.heapify(heap)
    while heap:
        i = heapq.heappop(heap)[1]
        now = float(worth[docs[i]].sum())
        if now < MIN_NEW:
            continue
        if heap and (-now, i) > heap[0]:
            heapq.heappush(heap, (-now, i))
            continue
        chosen.append(i)
        worth[docs[i]] /= 2
    return ids[np.sort(np.array(chosen, np.int64))]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, list[dict]]:
    """Posterior of class 1 for each row of votes (-1 clean, 0 none, 1 toxic), from class-conditional vote
    tables and voices weighted by correlation.  The share of class 1 is that of ``start``, the labels: votes that
    tell nothing leave every posterior there."""
    q = np.clip(start.astype(float), 0.02, 0.98)
    share = np.clip(start.mean(), 1e-3, 1 - 1e-3)
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        p1 = (np.einsum("n,nmv->mv", q, onehot) + 0.1) / (q.sum() + 0.3)
        p0 = (np.einsum("n,nmv->mv", 1 - q, onehot) + 0.1) / ((1 - q).sum() + 0.3)
        ratio = np.log(p1 / p0)
        # what voters share beyond the class: correlation of their votes' residuals
        seen = ratio[np.arange(m), votes + 1]
        expect = q[:, None] * (p1 * ratio).sum(1) + (1 - q)[:, None] * (p0 * ratio).sum(1)
        r = seen - expect
        sd = np.sqrt((r * r).mean(0)) + 1e-9
        corr = np.clip((r / sd).T @ (r / sd) / max(n, 1), 0, 1)
        voice = 1 / np.maximum(1, np.where(corr > 0.1, corr, 0).sum(1))
        q = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + seen @ voice, -30, 30)))
    return q, [{"toxic_if_toxic": float(a), "toxic_if_clean": float(b), "voice": float(v)} for a, b, v in zip(p1[:, 2], p0[:, 2], voice)]


def fit_linear(doc: np.ndarray, term: np.ndarray, terms: int, dense: np.ndarray, q: np.ndarray, rounds: int = 300,
               l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; features are (row, term) pairs and dense columns."""
    x1 = np.column_stack([dense, np.ones(len(dense))])
    n = len(x1)
    step = 4 / max((np.einsum("ij,ij->i", x1, x1) + np.bincount(doc, minlength=n)).mean(), 1e-9) / 4
    w = v = np.zeros(terms + x1.shape[1])
    pull = np.full(len(w), l2)
    pull[-1] = 0
    for t in range(rounds):
        ahead = v + t / (t + 3) * (v - w)
        z = np.bincount(doc, ahead[term], n) + x1 @ ahead[terms:]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        g = np.concatenate([np.bincount(term, r[doc], terms), x1.T @ r]) / n + pull * ahead
        w, v = v, ahead - step * g
    return v[:-1], float(v[-1])


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    ship_package(docs.sparkSession)
    table = letter_table()
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    marks = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    # the sample is bounded, so it may be broadcast
    sample = src.join(F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)), "_id").select("_text", "_y")
    terms, names = _mine(src, marks, table)

    @tidy
    def votes_of(batches):
        for rows, w in text_slices(batches, "_text", table):
            doc, which, dense = _features(w, terms)
            per = np.bincount(doc, minlength=len(w.offs) - 1)
            yield pa.RecordBatch.from_arrays([rows.column("_y"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(which.astype(np.int32))),
                                              pa.array(dense.tolist(), pa.list_(pa.float64()))], ["y", "terms", "dense"])

    got = sample.mapInArrow(votes_of, "y double, terms array<int>, dense array<double>").toArrow()  # at most sample_rows rows
    y = got["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(share=float(y.mean()) if len(y) else 0.0)
    dense = np.array(got["dense"].to_pylist())
    lists = got["terms"].combine_chunks()
    which, per = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(y)), per)
    some = per > 0
    deal = np.random.default_rng(0).permutation(len(terms)) % LEXICON_VOTERS
    lexicon = np.zeros((len(y), min(LEXICON_VOTERS, len(terms))), int)
    lexicon[doc, deal[which]] = 1
    shout = (dense[:, :PATTERNS] > np.quantile(dense[:, :PATTERNS], 0.95, axis=0)).astype(int)
    votes = np.column_stack([lexicon, shout, -(~some).astype(int) if len(terms) else np.zeros(len(y), int)])
    q, voters = label_model(votes, y)
    chosen = _cover(doc[y[doc] > 0], which[y[doc] > 0])
    own = np.isin(which, chosen)
    w, bias = fit_linear(doc[own], np.searchsorted(chosen, which[own]), len(chosen), np.column_stack([dense, some]), q)
    weights = np.zeros(len(terms) + dense.shape[1] + 1)
    weights[chosen], weights[len(terms):] = w[:len(chosen)], w[len(chosen):]
    return ToxicityModel(terms, names, weights, bias, None, voters)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", score: str = "score", terms: str = "toxic_terms") -> DataFrame:
    """``docs`` with a score (0 to 1) and the lexicon terms found, replacing columns of these names."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    table = letter_table()
    keep = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in (score, terms)])

    @tidy
    def run(batches):
        m = sent.value
        names = np.array(m.names, object)
        k = len(m.terms)
        for rows, w in text_slices(batches, text, table):
            n = len(w.offs) - 1
            doc, which, dense = _features(w, m.terms)
            per = np.bincount(doc, minlength=n)
            if m.share is not None:
                p = np.full(n, m.share)
            else:
                z = m.bias + np.bincount(doc, m.weights[which], n) + dense @ m.weights[k:-1] + m.weights[-1] * (per > 0)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(list(names[which]), pa.string()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p), found], [*rows.schema.names, score, terms])

    return keep.mapInArrow(run, StructType([*keep.schema.fields, *StructType.fromDDL(f"`{score}` double, `{terms}` array<string>").fields]))
