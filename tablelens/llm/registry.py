"""Queries and DuckDB SQL of this package's operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op5_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, text
  FROM documents),
counting AS (SELECT doc_id, trim(line, E' \t\x0b\x0c\r') AS line, i,
                    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
             FROM lines WHERE trim(line, E' \t\x0b\x0c\r') <> ''),
wins AS (SELECT doc_id, p, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
         FROM counting WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
firsts AS (SELECT win, min(struct_pack(d := doc_id, p := p)) AS f FROM wins WHERE win IS NOT NULL GROUP BY win),
later AS (SELECT w.doc_id, w.p FROM wins w JOIN firsts f USING (win) WHERE struct_pack(d := w.doc_id, p := w.p) > f.f),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, (VALUES (0), (1), (2)) t(d)),
kept AS (SELECT l.doc_id, l.i, l.line FROM lines l LEFT JOIN counting c ON c.doc_id = l.doc_id AND c.i = l.i
         WHERE c.p IS NULL OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.p = c.p)),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM counting GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN texts t USING (doc_id)""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under repeated three-line windows go; counts and the digest of the text that stays."""
    from tablelens.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_total").cast("long").alias("n_lines"), F.col("lines_removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The contract's URL rules.
def _url_rules():
    from tablelens.llm.url_filter import UrlRule

    return [UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"),
            UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/")]


@register("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then boosted trees learnt from the URLs that rules label."""
    from tablelens.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), _url_rules()).select(
        "page_id", "host", "path", "rule", "verdict", "block_score")


@register("op7_quality_rules", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov c USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             5 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
             OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS bad
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text measures, the base verdict and the cascade's verdict."""
    from tablelens.llm.quality import cascade, features, measured_rules, sampled

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    df = cascade(features(docs), measured_rules(), sample=features(sampled(docs)))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                     (~failed & F.col("rejected_by").isNull()).alias("kept"))


@register("op8_substring_dedup", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20)),
firsts AS (SELECT win, min(struct_pack(d := doc_id, p := p)) AS f FROM wins GROUP BY win HAVING count(*) > 1),
later AS (SELECT x.doc_id, x.p FROM wins x JOIN firsts f USING (win) WHERE struct_pack(d := x.doc_id, p := x.p) > f.f),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
         WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT x.doc_id, len(x.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words x LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept k USING (doc_id)""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 20-word windows that start earlier elsewhere go."""
    from tablelens.llm.substring import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op9_decontamination", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS win
         FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS win
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM iwin) WHERE len(w) >= m)),
hits AS (SELECT d.doc_id, d.p, d.m, i.item_id FROM dwin d JOIN iwin i USING (m, win)),
hitw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       coalesce(i.s, sha256('')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hitw h USING (doc_id) LEFT JOIN its i USING (doc_id)""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in documents."""
    from tablelens.llm.decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def vocabulary_path() -> str:
    """The public vocabulary file that op2 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again; digests of both."""
    from tablelens.llm.bpe import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _remainder(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the documents, label all."""
    from tablelens.llm.langid import label, learn

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs.filter(F.coalesce(_remainder(4), F.lit(0)) != 2))
    out = label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def toxicity_scores(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """``docs`` scored by what the labels of rows outside the held-out quarter teach."""
    from tablelens.llm import toxicity

    return toxicity.score(docs, toxicity.learn(docs, labels.filter(_remainder(4) != 2)), **names)


#: Score from which a document counts as toxic.
TOXIC_FROM = 0.3


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly supervised toxicity score of every text."""
    out = toxicity_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "toxic_terms")


@register("op3_minhash_dedup", r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b USING (s) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM words UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM words w JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) c ON c.d = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id""")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have similarity 0.8 or more."""
    from tablelens.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).drop("text_hash")


@register("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and maximum-entropy log10 probabilities of every text."""
    from tablelens.llm.lm_score import score

    out = score(_table(spark, sf_dir, "documents"), _remainder(10) != 0)
    return out.select("doc_id", F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def byte_vocabulary_path() -> str:
    """The public vocabulary file that op11 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of at most 1024 tokens; one row per piece."""
    from tablelens.llm.packing import pack

    out = pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op12_hard_negatives", r"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM e a, e r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
WHERE rank <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, against all rows."""
    from tablelens.llm.negatives import mine

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
                                                      "embedding")
    return mine(rows, F.col("vec_id") % 50 == 0)


@register("op13_bag_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
st AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (SELECT item_id, doc_id,
              sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_all))))::BIGINT AS score
       FROM it JOIN tf USING (t) JOIN df USING (t), st GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc WHERE score > 0) WHERE rank <= 50""")
def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from tablelens.llm.bag_search import search

    return search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
