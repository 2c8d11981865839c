"""Language ID: script ranges narrow the candidates of each word, a Viterbi path with a switching
penalty labels the words, and runs of one label are the spans of a mixed-language text.

Learning counts, for each language, hashed byte trigrams of its words (marks at
word ends) and the scripts of its words, over all learning texts.  The model has
2**GRAM_BITS scores per learned language, whatever the texts.

A word is a run of letters: a-z (A-Z folded) and non-ASCII characters.  Its score
for a language is the sum of its trigrams' log probabilities; languages whose
learning texts don't use the word's script fall out, unless none does.  A text's
language is the one with most letter bytes on its path (ties: the smallest name),
its score that share.

Null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing was learned.  Repeated rows are labelled each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelens.llm.words import Words, buffers, folded, lists, slices, text_slices
from tablelens.session import ship_package

GRAM_BITS = 16
#: Text whose words are labelled in lockstep; a longer document is a step of its own.
STEP_BYTES = 4 << 20
#: Share of a language's words that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.001


def letter_table() -> np.ndarray:
    t = np.full(256, -1, np.int16)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        t[lo:hi] = np.arange(lo, hi)
    return folded(t)


def _scripts() -> np.ndarray:
    """Script range by a character's first UTF-8 byte; 0: Latin, and bytes that begin no letter."""
    s = np.zeros(256, np.int8)
    for k, (lo, hi) in enumerate(((0xCD, 0xCF), (0xD0, 0xD3), (0xD4, 0xD5), (0xD6, 0xD7), (0xD8, 0xDB), (0xDC, 0xDF), (0xE0, 0xE0),
                                  (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED)), 1):
        s[lo:hi + 1] = k  # Greek, Cyrillic, Armenian, Hebrew, Arabic, Syriac and on, Indic and Thai, kana, Han, Hangul
    return s


N_SCRIPTS = 11


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram of each letter byte with its neighbours in the word; where each word's begin."""
    at = np.flatnonzero((w.table >= 0)[w.data])
    begin = np.searchsorted(at, w.starts)
    b = w.table[w.data[at]].astype(np.uint32)
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    before[begin] = 0
    after[begin[1:] - 1] = 0
    if len(after):
        after[-1] = 0
    g = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    return g >> np.uint32(32 - GRAM_BITS), begin


def _word_scripts(w: Words) -> np.ndarray:
    if len(w.starts) == 0:
        return np.zeros(0, np.int8)
    return np.maximum.reduceat(np.where((w.table >= 0)[w.data], _scripts()[w.data], np.int8(0)), w.starts)


@dataclass
class LangModel:
    langs: list[str]
    scores: np.ndarray  # gram x language, log probabilities
    scripts: np.ndarray  # script x language, may a word of the script be of the language


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> LangModel:
    """Counts over all rows with a text and a language."""
    ship_package(docs.sparkSession)
    table = letter_table()
    size = 1 << GRAM_BITS

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, w in text_slices(batches, "_text", table):
            g, begin = _grams(w)
            doc_g = np.repeat(w.doc_of(), np.diff(np.append(begin, len(g))))
            script, doc = _word_scripts(w), w.doc_of()
            names = rows.column("_lang").to_pylist()
            for name in set(names):
                mine = np.array([x == name for x in names])
                n = np.bincount(g[mine[doc_g]], minlength=size + N_SCRIPTS)
                n[size:] += np.bincount(script[mine[doc]], minlength=N_SCRIPTS)
                sums[name] = sums.get(name, 0) + n
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "g", "n"])

    src = docs.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).dropna()
    got = src.mapInArrow(run, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()  # at most (size + scripts) rows a language
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((size + N_SCRIPTS, len(langs)))
    if langs:
        counts[got["g"].to_numpy(), np.searchsorted(np.array(langs, object), np.array(got["lang"].to_pylist(), object))] = got["n"].to_numpy()
    grams, scripts = counts[:size], counts[size:]
    p = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * size))
    return LangModel(langs, (p - p.max(1, keepdims=True) if langs else p).astype(np.float32),
                     scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0)))


def _emissions(w: Words, m: LangModel) -> tuple[np.ndarray, np.ndarray]:
    """Word x language scores (best: 0), letter bytes per word."""
    g, begin = _grams(w)
    n = np.diff(np.append(begin, len(g)))
    if len(n) == 0:
        return np.zeros((0, len(m.langs)), np.float32), n
    s = np.add.reduceat(m.scores[g], begin, axis=0)
    may = m.scripts[_word_scripts(w)]
    s = np.where(may | ~may.any(1, keepdims=True), s, -1e4)
    return s - s.max(1, keepdims=True), n


def viterbi(s: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best path of each text (counts: words per text, s: their scores in order), all texts in lockstep."""
    path = np.zeros(len(s), np.int16)
    if len(s) == 0:
        return path
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    step = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
    by = np.argsort(step * len(counts) + np.repeat(rank, counts))  # words by step, longest texts first
    s = s[by]
    steps = int(counts.max())
    live = len(counts) - np.searchsorted(counts[order][::-1], np.arange(steps), "right")  # texts with a word at each step
    at = np.append(0, np.cumsum(live))
    switch, source = np.zeros(s.shape, bool), np.zeros(len(s), np.int16)
    last = np.zeros(len(counts), np.int16)  # best label of each text's last word
    v = s[: live[0]]
    for t in range(1, steps):
        ended, n = v[live[t]:], live[t]
        if len(ended):
            last[n:n + len(ended)] = ended.argmax(1)
        v = v[:n]
        best = v.argmax(1)
        jump = (v[np.arange(n), best] - np.float32(penalty))[:, None]
        switch[at[t]:at[t + 1]] = jump > v
        source[at[t]:at[t + 1]] = best
        v = np.maximum(v, jump) + s[at[t]:at[t + 1]]
    last[:len(v)] = v.argmax(1)
    state = np.zeros(0, np.int16)
    out = np.zeros(len(s), np.int16)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        state = np.append(state, last[len(state):n])
        out[at[t]:at[t + 1]] = state
        if t:
            jumped = switch[at[t]:at[t + 1]][np.arange(n), state]
            state = np.where(jumped, source[at[t]:at[t + 1]], state)
    path[by] = out
    return path


def label(docs: DataFrame, model: LangModel, *, text: str = "text", penalty: float = 12.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (start and end word, lang), replacing columns of these names."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    table = letter_table()
    new = ["lang_pred", "score", "spans"]
    keep = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new])

    def run(batches):
        m = sent.value
        names = np.array(m.langs, object)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j, data, offs in slices(*buffers(column), STEP_BYTES):
                parts = [Words(d, o, table) for _, _, d, o in slices(data, offs)]
                counts = np.concatenate([w.counts for w in parts])
                n = len(counts)
                rows = batch.slice(i, j - i)
                pred, score = np.full(n, "und", object), np.zeros(n)
                start, end, lang, per = [], [], [], np.zeros(n, np.int64)
                if m.langs:
                    each = [_emissions(w, m) for w in parts]
                    s, letters = np.concatenate([e for e, _ in each]), np.concatenate([x for _, x in each])
                    path, doc = viterbi(s, counts, penalty), np.repeat(np.arange(n), counts)
                    weight = np.bincount(doc * len(names) + path, letters, n * len(names)).reshape(n, -1)
                    some = weight.sum(1) > 0
                    # bytes of non-ASCII signs look like letters here: texts without an ASCII letter are looked at again
                    plain = np.bincount(np.repeat(np.arange(n), np.diff(offs)), (table[data] >= 0x61) & (data < 0x80), n) > 0
                    for x in np.flatnonzero(some & ~plain).tolist():
                        some[x] = any(map(str.isalpha, column[i + x].as_py()))
                    pred[some] = names[weight[some].argmax(1)]
                    score[some] = weight[some].max(1) / weight[some].sum(1)
                    first = np.repeat(np.cumsum(counts) - counts, counts)
                    change = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])) & some[doc]) if len(path) else np.zeros(0, int)
                    till = np.zeros(0, np.int64)
                    if len(change):
                        nxt = np.append(change[1:], len(path))
                        till = np.minimum(nxt, (first + np.repeat(counts, counts))[change])
                    start, end, lang = change - first[change], till - first[change], names[path[change]]
                    per = np.bincount(doc[change], minlength=n)
                spans = pa.StructArray.from_arrays([pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(end, np.int32)), pa.array(list(lang), pa.string())], ["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(score), lists(spans, per)], [*rows.schema.names, *new])

    fields = ", ".join(["lang_pred string", "score double", "spans array<struct<start:int,end:int,lang:string>>"])
    return keep.mapInArrow(run, StructType([*keep.schema.fields, *StructType.fromDDL(fields).fields]))
