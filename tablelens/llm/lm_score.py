"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class of the word | history) * P(word | its class).

The class of a token is a function of its bytes (its first two and whether it ends
in punctuation; the end of a text is a class of its own), so unseen words have one
too.  The class factor is a maximum-entropy model over hashed features of the
history: the last word, the word before it (skip) and the classes of both (n-gram),
each a row of one table of ``2**TABLE_BITS`` rows, whatever the corpus.
The word factor is the smoothed share of the word in its class, with one unknown
word per class; so the probabilities of known tokens and unknown ones sum to 1.

1. Texts become blocks of token numbers with a dictionary of the block's distinct
   words, written once to the shared folder.
2. Word counts of all training texts come from the blocks' dictionaries (each word
   once a block), by one group; the counts go back to the blocks by one join.
3. The table is trained in rounds, each over its share of all training texts, so
   every text is used once: tasks update copies of it with adaptive gradient steps,
   their changes are averaged by weight of tokens in parallel, a part of the table
   each, and the next round starts from there.
4. Blocks are scored in numpy, a few thousand tokens at a time.

Null and empty texts consist of their end token.  Null ``train`` marks count as
false (so rows without an id are scored, but neither learnt from nor held out in ``op1``).  Repeated
rows are tokens as often as they appear.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.words import U64, Words, blank_table, buffers, folded, i64, materialise, mix, slices
from tablelens.session import ship_package

TABLE_BITS, CLASSES = 14, 32
#: Text of one block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Tokens of one numpy step.
STEP = 1 << 13
SMOOTH = 0.1
#: Parts in which the tasks' changes of the table are averaged.
PARTS = 16
END = U64(0x5EED)


def _classes(w: Words) -> np.ndarray:
    """Class of each word: 1 to CLASSES - 1."""
    if len(w.starts) == 0:
        return np.zeros(0, np.int8)
    b = w.table[w.data].astype(np.uint64)
    first, last = b[w.starts], b[w.ends - 1]
    second = np.where(w.ends - w.starts > 1, b[np.minimum(w.starts + 1, len(b) - 1)], U64(0))
    letter = (last >= 0x80) | ((last >= 0x61) & (last <= 0x7A)) | ((last >= 0x30) & (last <= 0x39))
    return (1 + mix((first << U64(9)) | (second << U64(1)) | letter) % U64(CLASSES - 1)).astype(np.int8)


def _blocks(docs: DataFrame) -> DataFrame:
    """A row per block: ids, train marks and token counts of its texts, tokens as numbers of its dictionary
    (packed), and the dictionary: hashes, classes, counts in training texts."""
    table = folded(blank_table())
    names = ["ids", "train", "lens", "tokens", "words", "classes", "counts"]

    def run(batches):
        for batch in batches:
            for i, j, data, offs in slices(*buffers(batch.column("_text")), BLOCK_BYTES):
                h, c, n = [], [], []
                for _, _, d, o in slices(data, offs):
                    w = Words(d, o, table)
                    h.append(w.hashes())
                    c.append(_classes(w))
                    n.append(w.counts)
                h, c, n = np.concatenate(h), np.concatenate(c), np.concatenate(n)
                ends = np.cumsum(n + 1) - 1
                tok, cls = np.full(len(h) + len(n), END), np.zeros(len(h) + len(n), np.int8)
                word = np.ones(len(tok), bool)
                word[ends] = False
                tok[word], cls[word] = h, c
                words, first, number = np.unique(tok, return_index=True, return_inverse=True)
                # frequent words get small numbers, whose upper bytes compress well
                often = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
                place = np.empty(len(words), np.int32)
                place[often] = np.arange(len(words))
                words, first, number = words[often], first[often], place[number]
                rows = batch.slice(i, j - i)
                train = rows.column("_train").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(number[np.repeat(train, n + 1)], minlength=len(words))
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([
                    one(rows.column("_id")), one(rows.column("_train")), one(pa.array((n + 1).astype(np.int32))),
                    pa.array([_packed(number)], pa.binary()), one(i64(words)), one(pa.array(cls[first])),
                    one(pa.array(counts.astype(np.int32)))], names)

    id_type = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"ids array<{id_type}>, train array<boolean>, lens array<int>, tokens binary, words array<long>, "
                                "classes array<tinyint>, counts array<int>")


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


@dataclass
class _Block:
    ids: pa.Array
    train: np.ndarray
    lens: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> _Block:
        get = lambda name: batch.column(name)[i]
        return cls(get("ids").values, get("train").values.to_numpy(zero_copy_only=False).astype(bool), get("lens").values.to_numpy(),
                   _unpacked(get("tokens").as_buffer()), get("words").values.to_numpy().view(U64), get("classes").values.to_numpy())

    def features(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers, classes and feature rows (token x feature) of the texts that ``docs`` marks."""
        use = np.repeat(docs, self.lens)
        tok = self.tokens[use]
        lens = self.lens[docs]
        c = self.classes[tok].astype(np.uint64)
        at = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)

        def back(x, k, none):
            out = np.full(len(x), none, U64)
            out[k:] = x[:-k]
            out[at < k] = none
            return out

        top = U64(64 - TABLE_BITS)
        one, skip = ((mix(self.words ^ U64(x)) >> top)[tok] for x in (11, 222))
        c1, c2 = back(c, 1, U64(CLASSES)), back(c, 2, U64(CLASSES))
        rows = [back(one, 1, U64(1)), back(skip, 2, U64(2)), mix(c1 * U64(CLASSES + 1) + c2 + U64(4444)) >> top]
        return tok, c.astype(np.int64), np.stack(rows, 1).astype(np.int64)


def _logits(table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Token x class."""
    z = np.take(table, rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        z += np.take(table, rows[:, k], 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def _train_round(blocks: DataFrame, state, share: int, rounds: int, rate: float) -> DataFrame:
    """(part, weight, change): each task's change of the table after its share of texts."""
    def run(batches):
        table, bias = state.value[0].copy(), state.value[1]
        seen = np.full(len(table), 1.0, np.float32)  # sum of squared steps by row
        weight = 0
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block.of(batch, i)
                _, c, rows = b.features(b.train & (np.arange(len(b.lens)) % rounds == share))
                weight += len(c)
                for s in range(0, len(c), STEP):
                    f, y = rows[s:s + STEP], c[s:s + STEP]
                    g = np.exp(_logits(table, bias, f))
                    g /= g.sum(1, keepdims=True)
                    g[np.arange(len(y)), y] -= 1
                    flat = f.astype(np.uint16).ravel()
                    order = np.argsort(flat, kind="stable")
                    sorted_ = flat[order]
                    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
                    total = np.add.reduceat(np.take(g, order // f.shape[1], 0), begin, axis=0)
                    r = sorted_[begin]
                    n = np.diff(np.append(begin, len(flat))).astype(np.float32)
                    seen[r] += (total * total).sum(1) / n
                    table[r] -= rate * total / np.sqrt(n * seen[r])[:, None]
        if weight:
            change = (table - state.value[0]).astype(np.float16)
            for p, x in enumerate(np.array_split(change, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([weight], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["part", "weight", "change"])

    return blocks.select("ids", "train", "lens", "tokens", "words", "classes").mapInArrow(run, "part int, weight long, change binary")


def _averaged(changes: DataFrame) -> np.ndarray:
    """Mean change by weight of tokens; each part of the table is summed in a task of its own, batch by batch."""
    def mean(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for p, w, x in zip(batch.column("part").to_pylist(), batch.column("weight").to_pylist(), batch.column("change")):
                total = sums.setdefault(p, [0.0, 0])
                total[0] = total[0] + np.frombuffer(x.as_buffer(), np.float16).astype(np.float64) * w
                total[1] += w
        for p, (x, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([(x / w).astype(np.float32).tobytes()], pa.binary())], ["part", "change"])

    got = changes.repartition(PARTS, "part").mapInArrow(mean, "part int, change binary").collect()  # the table, 2 MB
    if not got:
        return np.zeros((1 << TABLE_BITS, CLASSES), np.float32)
    return np.concatenate([np.frombuffer(r.change, np.float32) for r in sorted(got, key=lambda r: r.part)]).reshape(-1, CLASSES)


def score(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """Train on the rows that ``train`` marks, score all.  One row per document: doc_id, trained,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (smoothed unigram) and score, both log10."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    blocks = materialise(_blocks(src).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")

    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts", "classes")).alias("at", "x")).select(
        "block", "at", F.col("x.words").alias("h"), F.col("x.counts").alias("n"), F.col("x.classes").alias("k"))
    vocab = materialise(each.filter("n > 0").groupBy("h").agg(F.sum("n").alias("c"), F.min("k").alias("k")), "lm-vocabulary")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("h").alias("v")).first()
    known = (each.select("block", "at", "h").join(vocab.select("h", "c"), "h").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c")))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocab.groupBy("k").agg(F.sum("c").alias("n"), F.count("h").alias("v")).collect():  # CLASSES rows
        class_n[r.k], class_v[r.k] = r.n, r.v
    bias = np.log((class_n + SMOOTH) / (class_n.sum() + SMOOTH * CLASSES)).astype(np.float32)
    weights = np.zeros((1 << TABLE_BITS, CLASSES), np.float32)
    for r in range(rounds):
        state = spark.sparkContext.broadcast((weights, bias))  # 2 MB
        weights = weights + _averaged(_train_round(blocks, state, r, rounds, rate))
        state.destroy()
    sent = spark.sparkContext.broadcast((weights, bias, class_n, class_v))
    n_all, v_all = total["n"], total["v"]

    def run(batches):
        table, bias, class_n, class_v = sent.value
        in_class = np.log10(class_n + SMOOTH * (class_v + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block.of(batch, i)
                count = np.zeros(len(b.words))
                if batch.column("at")[i].is_valid:
                    count[batch.column("at")[i].values.to_numpy()] = batch.column("c")[i].values.to_numpy()
                smooth = np.log10(count + SMOOTH)
                begin = np.cumsum(b.lens) - b.lens
                tok, c, rows = b.features(np.ones(len(b.lens), bool))
                logp = smooth[tok] - in_class[c]
                for s in range(0, len(c), STEP):
                    z = _logits(table, bias, rows[s:s + STEP])
                    y = c[s:s + STEP]
                    logp[s:s + STEP] += (z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))) / np.log(10)
                base = np.add.reduceat(smooth[tok], begin) - b.lens * np.log10(n_all + SMOOTH * (v_all + 1))
                yield pa.RecordBatch.from_arrays([
                    b.ids, pa.array(b.train), pa.array(b.lens.astype(np.int64)), pa.array(np.add.reduceat((count > 0)[tok].astype(np.int64), begin)),
                    pa.array(np.full(len(b.lens), n_all, np.int64)), pa.array(base), pa.array(np.add.reduceat(logp, begin))],
                    ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    counted = blocks.drop("counts").join(known, "block", "left").drop("block")
    return counted.mapInArrow(run, f"doc_id {src.schema['_id'].dataType.simpleString()}, trained boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double")

