"""BPE encoding and decoding with a public vocabulary file, by speculation and verification.

The file's rules are: NFC, lower case, words by a pattern (runs of letters, one
digit, runs of other non-blanks, English contractions), bytes as characters, a
mark on the last character of a word, merges by rank.  Each distinct word of a
batch is proposed as greedy longest matches.  A sequence of tokens is what the
merges would give exactly if every token is its own encoding and no two
neighbours would have merged across their border at some rank; that border test
runs over all distinct neighbour pairs of the batch at once in numpy.  Only words
with a failing pair are merged exactly.  Proposing and merging too go through all
words of a batch at once, a token or a merge of each word at a time; words of over
``LONG`` bytes are taken one by one, and merged with a heap.

Words are remembered per Python worker up to a bound; texts are never cut.  The
strings of the file's special tokens in a text become those tokens, as in the
library that the file is for.  Decoding joins token strings by a space, since the
file has no decoder.

Null and empty texts give no ids; no ids (or null) decode to the empty text.
All columns stay; columns named like the new ones are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablelens.llm.words import give_back, ranges
from tablelens.session import ship_package

#: Distinct words, and blank-separated pieces, whose ids a Python worker remembers.
WORDS_KEPT = 150_000
#: Text that one step encodes.
STEP_CHARS = 2 << 20
#: Bytes of a word that is proposed and merged by itself.
LONG = 100
#: Rank of a pair that never merges.
NONE = 1 << 30
#: Blank: what Unicode calls white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
BLANKS = regex.compile(r"[\t-\r \x85\p{Z}]+")
CONTROL = regex.compile(r"[\x1c-\x1f]")  # str.split() splits at these, the pattern doesn't
END = "\u0100\u0101"  # stands for the word-end mark in keys, which else hold bytes only


def _byte_chars() -> dict[str, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Table:
    """Integers from 0 on by distinct codes from 0 on, looked up many at a time: open addressing, half full at most."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.codes, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slots(codes), np.arange(len(codes))
        while len(left):
            slots, first = np.unique(at[left], return_index=True)
            free = self.codes[slots] < 0
            slots, placed = slots[free], left[first[free]]
            self.codes[slots], self.values[slots] = codes[placed], values[placed]
            left = np.setdiff1d(left, placed)
            at[left] = at[left] + 1 & len(self.codes) - 1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Values; -1 for other codes."""
        at = self._slots(codes)
        found = self.codes[at]
        hit = found == codes
        out = np.where(hit, self.values[at], -1).astype(np.int64)
        left = np.flatnonzero(~hit & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.codes) - 1
            found = self.codes[at[left]]
            hit = found == codes[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Bpe:
    """A vocabulary file's model.  Keys are byte strings as Latin-1 text, with END after a word's last byte."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        chars = _byte_chars()
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.text = [""] * size
        for s, i in vocab.items():
            self.text[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.text[i] = s
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        def key(s: str) -> str:
            end = s.endswith(mark) and len(s) > len(mark)
            return "".join(map(chars.__getitem__, s[: -len(mark)] if end else s)) + END * end

        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.formed = np.full(size, -1)  # rank of the merge that makes a token; -1: a single symbol
        self.rank: dict[int, int] = {}  # of a pair of neighbours, as left << 20 | right
        self.made: list[int] = []  # by rank
        twice = set()
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 20 | y] = r
            self.made.append(z)
            if self.formed[z] >= 0:
                twice.add(z)
            else:
                self.left[z], self.right[z], self.formed[z] = x, y, r
        self.made_by = np.array(self.made, np.int64)
        self.ranks = Table(np.array(list(self.rank), np.int64), np.array(list(self.rank.values()), np.int64))
        made = np.flatnonzero(self.formed >= 0)
        made = made[np.argsort(self.formed[made])]
        sound = np.ones(size, bool)  # tokens that are their own encoding
        sound[list(twice)] = False
        sound[made] &= ~self.clash(self.left[made], self.right[made], self.formed[made])
        for z in made.tolist():
            sound[z] &= sound[self.left[z]] and sound[self.right[z]]
        self.keys = {}
        self.single = {}
        for s, i in vocab.items():
            k = key(s)
            if self.formed[i] < 0:
                self.single[k] = i
            if sound[i]:
                self.keys[k] = i
        lengths: dict[str, set[int]] = {}
        for k in self.keys:
            for start in {k[:1], k[:2], k[:3]}:
                lengths.setdefault(start, set()).add(len(k))
        self.lengths = {start: sorted(x, reverse=True) for start, x in lengths.items()}  # of keys by their first characters
        # symbols of a word: its bytes, 256 more for the last one
        self.symbol = np.array([self.single.get(chr(b) + e, -1) for e in ("", END) for b in range(256)])
        children: dict[int, int] = {}  # of the tree of keys: by node << 9 | symbol
        tokens = [-1]  # by node
        for k, i in self.keys.items():
            end = k.endswith(END)
            path = list(k.removesuffix(END).encode("latin-1"))
            path[-1] += 256 * end
            node = 0
            for c in path:
                node = children.setdefault(node << 9 | c, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = i
        self.children = Table(np.array(list(children), np.int64), np.array(list(children.values()), np.int64))
        self.token = np.array(tokens)
        self.kept: dict[str, bytes] = {}  # ids of words
        self.pieces: dict[str, bytes] = {}  # ids of blank-separated pieces

    def clash(self, a: np.ndarray, b: np.ndarray, limit) -> np.ndarray:
        """Would the neighbours have merged across their border before rank ``limit``?  Unwinds both tokens,
        the later formed part first; of equal ranks the left place goes first."""
        a, b = a.copy(), b.copy()
        gone_a = np.broadcast_to(np.asarray(limit, np.int64), a.shape).copy()  # rank at which the part is merged away
        gone_b = gone_a.copy()
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            code = x.astype(np.int64) << 20 | y
            r = self.ranks.get(code)
            hit = (r >= 0) & (r < gone_a[live]) & ((r < gone_b[live]) | ((r == gone_b[live]) & (gone_b[live] != np.asarray(np.broadcast_to(limit, a.shape))[live])))
            out[live[hit]] = True
            fx, fy = self.formed[x], self.formed[y]
            go = ~hit & ((fx >= 0) | (fy >= 0))
            live, x, y, fx, fy = live[go], x[go], y[go], fx[go], fy[go]
            split_b = fy >= fx
            s = live[split_b]
            gone_b[s], b[s] = fy[split_b], self.left[y[split_b]]
            s = live[~split_b]
            gone_a[s], a[s] = fx[~split_b], self.right[x[~split_b]]
        return out

    def propose(self, k: str) -> list[int] | None:
        """Greedy longest matches, or None if some place has no match."""
        out, i, n, keys, lengths = [], 0, len(k), self.keys, self.lengths
        while i < n:
            # keys that begin with the next three characters, else with fewer
            for j in lengths.get(k[i:i + 3]) or lengths.get(k[i:i + 2]) or lengths.get(k[i:i + 1], ()):
                j += i
                if j <= n and (t := keys.get(k[i:j])) is not None and (j == n or j < n - 2):
                    break
            else:
                j = next((j for j in (i + 2, i + 1, n) if j <= n and (j == n or j < n - 2) and k[i:j] in keys), 0)
                if not j:
                    return None
                t = keys[k[i:j]]
            out.append(t)
            i = j
        return out

    def propose_all(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The same of many words, given by their places in ``symbols``: tokens, how many each word has, and which words
        have a place without a match."""
        counts, bad = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
        rounds = []
        live, at = np.arange(len(starts)), starts
        while len(live):  # the next token of each word
            token, stop, limit = np.full(len(live), -1), at.copy(), ends[live]
            run, p, node = np.arange(len(live)), at, np.zeros(len(live), np.int64)
            while len(run):  # one symbol further down the tree of keys
                node = self.children.get(node << 9 | symbols[p])
                ok = node >= 0
                run, p, node = run[ok], p[ok] + 1, node[ok]
                t = self.token[node]
                ok = t >= 0
                token[run[ok]], stop[run[ok]] = t[ok], p[ok]
                ok = p < limit[run]
                run, p, node = run[ok], p[ok], node[ok]
            ok = token >= 0
            bad[live[~ok]] = True
            rounds.append((live[ok], token[ok]))
            counts[live[ok]] += 1
            ok &= stop < limit
            live, at = live[ok], stop[ok]
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        for i, (w, t) in enumerate(rounds):
            flat[first[w] + i] = t
        return flat, counts, bad

    def merge_all(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Exact merging of many words: always the lowest rank, leftmost first.  Tokens, and how many each word has."""
        part = self.symbol[symbols[ranges(starts, ends - starts)]]
        word = np.repeat(np.arange(len(starts)), ends - starts)
        part, word = part[part >= 0], word[part >= 0]  # a symbol that the vocabulary lacks is left out, as there is no unknown token

        def ranks(i):  # of the pairs that begin at i
            out = np.full(len(i), NONE)
            ok = i + 1 < len(part)
            ok[ok] = word[i[ok]] == word[i[ok] + 1]
            r = self.ranks.get(part[i[ok]] << 20 | part[i[ok] + 1])
            out[ok] = np.where(r < 0, NONE, r)
            return out

        rank = ranks(np.arange(len(part)))
        done = [(word[:0], part[:0])]
        while len(part):  # a merge of each word
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(part)), first)
            at, r = least & 0xFFFFFFFF, least >> 32
            go = r < NONE
            if not go.all():
                stay = np.repeat(go, np.diff(np.append(first, len(part))))
                done.append((word[~stay], part[~stay]))
                at, r = (np.cumsum(stay) - 1)[at[go]], r[go]
                part, word, rank = part[stay], word[stay], rank[stay]
            part[at] = self.made_by[r]
            stay = np.ones(len(part), bool)
            stay[at + 1] = False
            part, word, rank = part[stay], word[stay], rank[stay]
            at = at - np.arange(len(at))  # each word before lost a part
            rank[at] = ranks(at)
            before = at[at > 0] - 1
            rank[before] = ranks(before)
        word, part = map(np.concatenate, zip(*done))
        return part[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(starts))

    def merge(self, k: str) -> list[int]:
        """The same of one word, with a heap."""
        n = len(k) - 2
        parts = [self.single.get(c) for c in k[:n - 1]] + [self.single.get(k[n - 1:])]
        parts = [p for p in parts if p is not None]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := self.rank.get(parts[p] << 20 | parts[q])) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> tuple[int, int]:
        """Encode words into ``kept``; returns how many there were and how many had to be merged exactly."""
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        words = [w for w in words if len(raw[w]) <= LONG]
        long = [w for w in raw if len(raw[w]) > LONG]
        ends = np.cumsum(np.fromiter(map(len, map(raw.__getitem__, words)), np.int64, len(words)))
        starts = np.append(0, ends)[:-1]
        symbols = np.frombuffer(b"".join(map(raw.__getitem__, words)), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        flat, sizes, bad = self.propose_all(symbols, starts, ends)
        keys = [raw[w].decode("latin-1") + END for w in long]
        guesses = [self.propose(k) for k in keys]
        flat = np.append(flat, np.fromiter((t for g in guesses if g for t in g), np.int64))
        sizes = np.append(sizes, np.array([len(g) if g else 0 for g in guesses], np.int64))
        bad = np.append(bad, np.array([g is None for g in guesses], bool))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pair, which = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
            clash = self.clash(pair >> 20, pair & 0xFFFFF, np.int64(1) << 40)
            bad |= np.bincount(owner[inner], clash[which], len(bad)) > 0
        self._keep([w for w, b in zip(words + long, bad.tolist()) if not b], flat[~bad[owner]], sizes[~bad])
        again = np.flatnonzero(bad[:len(words)])
        self._keep([words[i] for i in again.tolist()], *self.merge_all(symbols, starts[again], ends[again]))
        for w, k, b in zip(long, keys, bad[len(words):].tolist()):
            if b:
                self.kept[w] = np.array(self.merge(k), "<u4").tobytes()
        return len(bad), int(bad.sum())

    def _keep(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        ids = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        self.kept.update((w, ids[i:j]) for w, i, j in zip(words, [0, *ends], ends))

    def pieces_of(self, text: str) -> list[str]:
        """Normalised text by blanks.  A word never spans two pieces."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return BLANKS.split(text) if CONTROL.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []  # of each text: pieces, and special tokens as their ids' bytes
        for t in texts:
            if self.special_pattern and "<" in t and self.special_pattern.search(t):
                seq: list = []
                for piece in self.special_pattern.split(t):
                    seq += [np.uint32(self.special[piece]).tobytes()] if piece in self.special else self.pieces_of(piece)
                split.append(seq)
            else:
                split.append(self.pieces_of(t))
        for kept in (self.kept, self.pieces):
            if len(kept) > WORDS_KEPT:
                kept.clear()
        known = self.pieces
        new = {p for s in split for p in s if p not in known}
        known |= {p: p for p in new if isinstance(p, bytes)}
        words = {p: PATTERN.findall(p) for p in new if isinstance(p, str)}
        self.learn(list({w for ws in words.values() for w in ws if w not in self.kept}))
        get = self.kept.__getitem__
        for p, ws in words.items():
            known[p] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def forget(self) -> None:
        self.kept.clear()
        self.pieces.clear()

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MODELS: dict[int, Bpe] = {}


def _model(sent) -> Bpe:
    if sent.value["key"] not in _MODELS:
        _MODELS.clear()
        _MODELS[sent.value["key"]] = Bpe(sent.value["raw"])
    return _MODELS[sent.value["key"]]


def _send(df: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the texts) to all tasks."""
    with open(path, "rb") as f:
        raw = f.read()
    ship_package(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast({"key": hash(raw), "raw": raw})


def _steps(column: pa.Array, most: int):
    """(first, last + 1) of runs of rows of at most ``most`` bytes, or one row."""
    size = 0
    first = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if len(column):
        yield first, len(column)


def _add(df: DataFrame, source: str, new: list[T.StructField], sent, make) -> DataFrame:
    """``df`` with columns that ``make`` computes with the model from steps of ``source``."""
    names = [f.name for f in new]
    keep = [c for c in df.columns if c.lower() not in names]
    if source not in keep:
        raise ValueError(f"{source} cannot be both read and replaced")

    def run(batches):
        model = _model(sent)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            for i, j in _steps(column, STEP_CHARS):
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, *make(model, column.slice(i, j - i))], [*rows.schema.names, *names])
        model.forget()  # the worker lives on after the task
        give_back()

    src = df.select(*[f"`{c}`" for c in keep])
    return src.mapInArrow(run, T.StructType([*src.schema.fields, *new]))


def _ids(model: Bpe, column: pa.Array) -> tuple[list[bytes], pa.Array, pa.Array]:
    out = model.encode([t or "" for t in column.to_pylist()])
    return out, pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())


def encode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` (long)."""
    return _add(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())], _send(df, path),
                lambda model, column: _ids(model, column)[1:])


def decode(df: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of ``ids``."""
    return _add(df, ids, [T.StructField(decoded, T.StringType())], _send(df, path),
                lambda model, column: [pa.array([model.decode(x or b"") for x in column.to_pylist()], pa.string())])


def encode_decode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens",
                  decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass over the texts, by one worker a task."""
    def make(model, column):
        out, packed, n = _ids(model, column)
        return packed, n, pa.array(list(map(model.decode, out)), pa.string())

    return _add(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), T.StructField(decoded, T.StringType())],
                _send(df, path), make)
