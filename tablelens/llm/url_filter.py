"""URL filters: allow and block rules, and gradient-boosted trees for the URLs that no rule fits
(DataFrame functions and Spark ML only).

A rule is ``host/path-prefix``.  It fits its host and all subdomains if the
URL's path starts with the rule's path; the longest fitting rule decides.

The trees learn from the URLs that rules label and judge the others by lexical
features: lengths, depth, digit ratio, character entropy, parameter counts and
suffix statistics (how a host's last label, its name and the first path part
stand among labelled URLs, smoothed, and their share of all URLs).

Null URLs and URLs without ``://`` have empty host and path; no rule fits them
and the trees judge them like any other.  Repeated rows are judged each for
itself.  Without labelled URLs of both kinds there are no trees: the only label
seen (``allow`` if none) is the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs that the trees are fitted on, at most; those with the smallest hash are taken.
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    rule: str  # host/path prefix



def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        h, slash, p = r.rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        name, verdict = F.when(fits, F.lit(r.rule)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def entropy(s: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    step = lambda a: F.when(a["run"] > 0, a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0)))).otherwise(0.0)
    runs = F.aggregate(
        F.sort_array(F.split(s, "")),
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(x.alias("c"), F.when(x == a["c"], a["run"] + 1.0).otherwise(1.0).alias("run"),
                              F.when(x == a["c"], a["sum"]).otherwise(a["sum"] + step(a)).alias("sum")),
        lambda a: a["sum"] + step(a))
    n = F.length(s).cast("double")
    return F.when(n > 0, F.log2(n) - runs / n).otherwise(0.0)


def _count(s: Column, pattern: str) -> Column:
    return (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("double")


LEXICAL = ["len_url", "len_host", "len_path", "depth", "host_labels", "digit_ratio", "hyphens", "entropy", "entropy_host",
           "n_params", "len_query", "has_fragment", "is_https"]
KEYS = {"tld": r"([^.]*)$", "name": r"([^.]+)\.[^.]+$"}


def features(urls: DataFrame, url: str) -> DataFrame:
    """Adds host, path, the lexical features and the keys of the suffix statistics, all prefixed ``_u_``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    cols = {
        "host": host, "path": path, "len_url": F.length(u).cast("double"), "len_host": F.length(host).cast("double"),
        "len_path": F.length(path).cast("double"), "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "host_labels": F.size(F.split(host, "[.]")).cast("double"), "digit_ratio": _count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "hyphens": _count(host, "-"), "entropy": entropy(u), "entropy_host": entropy(host),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"), "len_query": F.length(query).cast("double"),
        "has_fragment": F.contains(u, F.lit("#")).cast("double"), "is_https": F.startswith(F.lower(F.substring(u, 1, 8)), F.lit("https://")).cast("double"),
        **{k: F.regexp_extract(host, p, 1) for k, p in KEYS.items()}, "part": F.regexp_extract(path, r"^/([^/]*)", 1)}
    return urls.withColumns({f"_u_{k}": v for k, v in cols.items()})


def judge(urls: DataFrame, rules: list[UrlRule], *, url: str = "url", train_rows: int = TRAIN_ROWS, trees: int = 10,
          depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (null where a rule decides).

    Columns of these names, in any case, are replaced.
    """
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    df = features(urls, url)
    rule, said = fitting_rule(F.col("_u_host"), F.col("_u_path"), rules)
    df = df.withColumns({"_u_rule": rule, "_u_said": said})

    # suffix statistics over all URLs: one row per key value, pre-aggregated; joined back by an ordinary join
    label = F.when(F.col("_u_said").isNotNull(), (F.col("_u_said") == "block").cast("double"))
    names = list(LEXICAL)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(label), F.lit(0.5)).alias("rate"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    for k in (*KEYS, "part"):
        s = (df.groupBy(f"_u_{k}").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("m"), F.coalesce(F.sum(label), F.lit(0.0)).alias("b"))
             .select(F.col(f"_u_{k}"), (F.col("n") / max(total["n"], 1)).alias(f"_u_{k}_share"),
                     ((F.col("b") + 5 * total["rate"]) / (F.col("m") + 5)).alias(f"_u_{k}_rate")))
        df = df.join(s, f"_u_{k}", "left")
        names += [f"{k}_share", f"{k}_rate"]

    labelled = df.filter(F.col("_u_said").isNotNull()).select(url, label.alias("_u_y"), *[f"_u_{n}" for n in names])
    if total["lo"] is None or total["lo"] == total["hi"]:
        score = F.lit(0.0 if total["lo"] is None else float(total["lo"]))
    else:
        pack = VectorAssembler(inputCols=[f"_u_{n}" for n in names], outputCol="_u_x", handleInvalid="keep")
        sample = labelled.orderBy(F.xxhash64(url), url).limit(train_rows).coalesce(1)
        trees_ = GBTClassifier(featuresCol="_u_x", labelCol="_u_y", maxIter=trees, maxDepth=depth, seed=7, predictionCol="_u_p")
        model = trees_.setRawPredictionCol("_u_raw").setProbabilityCol("_u_prob").fit(pack.transform(sample))
        df = model.transform(pack.transform(df))
        score = vector_to_array("_u_prob")[1]
    by_trees = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return df.select(*kept, F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"),
                     F.coalesce("_u_said", by_trees).alias("verdict"), F.when(F.col("_u_said").isNull(), score).alias("block_score"))
