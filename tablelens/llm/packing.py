"""Packing of token sequences: order-preserving dynamic programming over sentence boundaries.

The token streams of the documents, each ended by one separator id, lie one after
another in the order in which Spark reads them.  Windows of at most ``size`` tokens cut
that stream; a window is padded to ``size`` unless its length is a power of two.  Cuts may
fall at a document's end (free), at a sentence's end (``SENTENCE`` tokens) and, in sentences
of more than ``LONG`` tokens, at every ``STRIDE``-th of their tokens (``MIDDLE``).  The dynamic
programme finds the cuts that minimise padding plus these penalties: with f(t) the cost of
cutting at t, f(t) = penalty(t) + min over the last ``size`` tokens s of f(s) + padding(t - s).
As padding falls by one for each token, the minimum of f(s) + s over a window that slides
along is all that is needed: a monotone queue hands it over in constant time.  Power-of-two
windows are extra transitions between cuts that lie that far apart.  Of equal costs, fewer windows win.

One map over the texts and no shuffle: each partition is packed as a stream of its own, in blocks
of ``BLOCK`` tokens (a longer document is a block of its own); what lies behind a block's
best cut moves on to the next block, so blocks leave no seam.  At a partition's end, cuts
that leave powers of two are also offered (``MIDDLE``), so that its last windows need no padding.

Results for odd input: a null or empty text is a document of the separator alone.  Rows are
documents of their own, repeated or not, null ids too.  Columns other than id and text
are not read.  An empty table gives no pieces.  A text of any length is encoded whole, in
parts cut before blanks, where no token can reach across.
"""

from __future__ import annotations

import json
import re
import threading
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import ship_package

SIZE = 1024
SEPARATOR = 0
#: Penalties in tokens of padding, and which sentences are long.
SENTENCE, MIDDLE, LONG, STRIDE = 6, 12, 64, 32
#: Tokens of one run of the dynamic programme.
BLOCK = 1 << 18
#: Characters that the encoder gets at once.
PART_CHARS = 1 << 16
#: Windows are counted below this share of a token of cost.
_TIE = 2.0**-20

#: The pre-tokeniser pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes that print as themselves, the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    The file's vocabulary in rank order gives the same ids by tiktoken, several times as fast;
    files of any other kind are left to the tokenizers library itself."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and not spec.get("normalizer") and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "normalized", "single_word"))
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        chars = _byte_of_char()
        self.bytes_of: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(map(chars.__getitem__, token)) if plain and token not in special else token.encode()
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        if plain:
            import tiktoken

            ranks = {b: i for i, b in self.bytes_of.items() if b.decode("utf-8", "replace") not in special}
            enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.part = lambda t: enc.encode_to_numpy(t, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_str(raw.decode())
            lib.no_truncation()
            lib.no_padding()
            self.part = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32)
        self.splits = plain
        n = max(self.bytes_of) + 1
        self.closes, self.opens = np.zeros(n, bool), np.zeros(n, bool)  # tokens that may end a sentence, or follow its end
        for i, b in self.bytes_of.items():
            self.closes[i] = bool(re.search(rb"[.!?\n][\"')\]]*$", b))
            self.opens[i] = b[:1] in (b" ", b"\n")
            if b.endswith(b"\n"):
                self.opens[i] = self.closes[i] = True

    def __call__(self, text: str) -> np.ndarray:
        if not self.splits or len(text) <= PART_CHARS:
            return self.part(text) if text else np.zeros(0, np.uint32)
        out, at = [], 0
        while at < len(text):
            m = None if len(text) - at <= PART_CHARS else re.compile(r"(?<=[!-~]) ").search(text, at + PART_CHARS)
            end = m.start() if m else len(text)
            out.append(self.part(text[at:end]))
            at = end
        return np.concatenate(out)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions behind which a sentence ends: after . ! ? before a blank, after a line break."""
        if len(ids) < 2:
            return np.zeros(0, np.int64)
        newline = self.closes & self.opens
        return np.flatnonzero(self.closes[ids[:-1]] & (self.opens[ids[1:]] | newline[ids[:-1]])) + 1


def best_cuts(pos: np.ndarray, cost: np.ndarray, size: int = SIZE, last: bool = True) -> list[int]:
    """Indices of the cuts (the first position left out) that cost least.

    ``pos``: ascending candidate positions, the first is the start, neighbours at most ``size``
    apart; ``cost``: their penalties.  ``last``: the final position is a cut; otherwise the
    cheapest one within ``size`` tokens of it ends the windows."""
    n = len(pos)
    pairs: dict[int, list[int]] = {}
    for k in range((size - 1).bit_length()):
        j = np.searchsorted(pos, pos + (1 << k))
        ok = np.flatnonzero(j < n)
        ok = ok[pos[j[ok]] == pos[ok] + (1 << k)]
        for a, b in zip(ok.tolist(), j[ok].tolist(), strict=True):
            pairs.setdefault(b, []).append(a)
    p, c = pos.tolist(), (cost + _TIE).tolist()
    f, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])  # candidates by rising f + position, the first is within reach
    g = [0.0] * n
    g[0] = f[0] + p[0]
    for j in range(1, n):
        at = p[j]
        while p[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        best = g[i] + size - at
        for a in pairs.get(j, ()):
            if f[a] <= best:
                best, i = f[a], a
        f[j] = best = best + c[j]
        back[j] = i
        g[j] = best = best + at
        while queue and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        j = min((j for j in range(1, n) if p[j] >= p[-1] - size), key=lambda j: (f[j], -j))
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def _candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions to cut at, from 0 on, and their penalties."""
    ends = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(ends)
    step = min(STRIDE, size)
    long = np.flatnonzero(gaps > min(LONG, size))
    parts = (gaps[long] - 1) // step
    middle = np.repeat(ends[long], parts) + step * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1)
    if last:  # what is left behind a boundary near the end, as powers of two
        near = ends[ends >= ends[-1] - size][:-1]
        rest = ends[-1] - near
        bits = [(near + ((rest >> k) << k)) for k in range(size.bit_length())]
        middle = np.concatenate([middle, *bits])
    pos = np.unique(np.concatenate([ends, middle]))
    cost = np.full(len(pos), float(MIDDLE))
    cost[np.searchsorted(pos, ends)] = SENTENCE
    cost[np.searchsorted(pos, doc_ends)] = 0
    return pos, cost


class Packer:
    """Packs one stream of documents; ``add`` and ``close`` give the pieces that are decided."""

    def __init__(self, encoder: Encoder, size: int, separator: int):
        self.encoder, self.size, self.separator = encoder, size, separator
        self.docs: list[list] = []  # id, tokens in all, tokens given away, the tokens left, their sentence ends
        self.tokens, self.windows = 0, 0

    def add(self, key, text: str):
        ids = np.append(self.encoder(text), np.uint32(self.separator)).astype("<u4")
        self.docs.append([key, len(ids), 0, ids, self.encoder.sentence_ends(ids[:-1])])
        self.tokens += len(ids)
        return self._decide(False) if self.tokens >= max(BLOCK, 4 * self.size) else ()

    def close(self):
        return self._decide(True) if self.docs else ()

    def _decide(self, last: bool):
        lengths = np.array([len(d[3]) for d in self.docs])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        stream = np.concatenate([d[3] for d in self.docs])
        sentences = np.concatenate([d[4] + s for d, s in zip(self.docs, starts.tolist(), strict=True)])
        pos, cost = _candidates(ends, sentences, self.size, last)
        cuts = pos[best_cuts(pos, cost, self.size, last)]
        done = int(cuts[-1])
        edges = np.unique(np.concatenate([[0], cuts, starts[starts < done]]))  # pieces begin where a window or a document does
        first, end = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, first, "right") - 1
        window = np.searchsorted(cuts, first, "right")
        begin = np.append(0, cuts)[window]
        given = np.array([d[2] for d in self.docs])
        out = {"id": [self.docs[d][0] for d in doc.tolist()], "start": given[doc] + first - starts[doc], "length": end - first,
               "doc_tokens": np.array([d[1] for d in self.docs])[doc], "sequence": self.windows + window, "offset": first - begin,
               "edges": edges, "ids": stream[:done]}
        self.windows += len(cuts)
        rest = []
        for d, s, e in zip(self.docs, starts.tolist(), ends.tolist(), strict=True):
            if e > done:
                cut = max(done - s, 0)
                rest.append([d[0], d[1], d[2] + cut, d[3][cut:].copy(), d[4][d[4] > cut] - cut])
        self.docs, self.tokens = rest, len(stream) - done
        return (out,)


_ENCODERS: dict[int, Encoder] = {}
_LOCK = threading.Lock()


def _encoder(sent) -> Encoder:
    with _LOCK:
        if sent.value["key"] not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[sent.value["key"]] = Encoder(sent.value["raw"])
        return _ENCODERS[sent.value["key"]]


def pack(df: DataFrame, path: str, *, size: int = SIZE, separator: int = SEPARATOR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the id, ``start`` and ``length`` (long, in tokens of its document),
    ``doc_tokens`` (long), ``sequence_id`` and ``offset`` (long) and the piece's ``ids``
    (binary: little-endian unsigned 32-bit integers).  ``sequence_id`` is the partition's number times
    2**33 plus the window's number in it."""
    if size < 1 or size & (size - 1):
        raise ValueError("size is a power of two")
    with open(path, "rb") as f:
        raw = f.read()
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast({"key": hash(raw), "raw": raw})
    src = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    key = src.schema["id"]
    schema = T.StructType([T.StructField(id, key.dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")],
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        packer, base = Packer(_encoder(sent), size, separator), TaskContext.get().partitionId() << 33

        def rows(found, kind):
            for x in found:
                offs = pa.array((4 * x["edges"]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(x["length"]), [None, offs.buffers()[1], pa.py_buffer(np.ascontiguousarray(x["ids"]))])
                yield pa.RecordBatch.from_arrays([pa.array(x["id"], kind), *[pa.array(np.asarray(x[c], np.int64)) for c in ("start", "length", "doc_tokens")],
                                                  pa.array(base + x["sequence"].astype(np.int64)), pa.array(x["offset"].astype(np.int64)), ids], schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for k, t in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    yield from rows(packer.add(k, t.as_py()), kind)
        if kind is not None:
            yield from rows(packer.close(), kind)

    return src.mapInArrow(run, schema)
