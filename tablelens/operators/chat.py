"""Chat-log jobs: load in time order, last-N per conversation, role
relabelling, and intent tagging of messages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.functions.text import WORD_CLASS

# History bound, role names, command words, trigger phrases
# and stop words of the reference.
MAX_HISTORY = 20
ROLE_LABELS = {"user": "human", "assistant": "ai"}
COMMANDS = ("/reset", "/profile", "/insights", "/help", "insights", "help")
SWITCH_PHRASES = ("switch to", "use", "load", "change to", "open", "analyze", "work with", "go to")
STOP_WORDS = ("the", "my", "dataset", "data", "file", "table", "previous", "old", "new", "last")
LIST_PHRASES = ("list datasets", "show datasets", "what datasets", "available datasets", "my datasets")
PLOT_WORDS = ("plot", "chart", "graph", "histogram", "scatter", "bar", "pie", "heatmap",
              "visualization", "interactive", "box", "pairplot", "line", "violin", "qq")

_LEFT = f"(?:^|[^{WORD_CLASS}])"
SWITCH_RE = _LEFT + "(?:" + "|".join(SWITCH_PHRASES) + r") "
TARGET_RE = _LEFT + r"%s (.+?)(?:[ \t\n]|$)"
FOLLOW_RE = _LEFT + "(?:" + "|".join(SWITCH_PHRASES) + r") +.*? +and +([^.!?\n]*)"
PLOT_RE = _LEFT + "(?:" + "|".join(PLOT_WORDS) + ")"


def chat_log_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                        role: str = "role", text: str = "text") -> DataFrame:
    """Chat-log rows ``(conv_id, id, role, content, timestamp)`` from a
    table of conversation turns; the timestamp follows the turn order."""
    base = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("id"), F.col(role).alias("role"),
                        F.col(text).alias("content"),
                        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(turn).cast("decimal(18,6)"))
                         ).alias("timestamp"))


def append_messages(messages: DataFrame, path: str) -> None:
    """Append messages to the log table at ``path`` (made if it isn't there), each (conv_id, id) once.

    A batch that is appended again, whole or in part, adds nothing, so a job that fails may be rerun.  The
    log is partitioned by day, and only days between the batch's first and last are looked at."""
    spark = messages.sparkSession
    new = messages.withColumn("day", F.to_date("timestamp")).dropDuplicates(["conv_id", "id"])
    try:
        log = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log = None
    if log is not None:
        days = new.agg(F.min("day"), F.max("day")).first()
        old = log.filter(F.col("day").between(*[F.lit(d) for d in days])).select("conv_id", "id")
        new = new.join(old, ["conv_id", "id"], "left_anti")
    new.select(*messages.columns, "day").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a log table."""
    return spark.read.parquet(path).drop("day")


def load_history(log: DataFrame) -> DataFrame:
    """The log in timestamp order (id breaks ties); a range-partitioned
    global sort, not a single-task one."""
    return log.orderBy("conv_id", "timestamp", "id")


def last_n_messages(log: DataFrame, n: int = MAX_HISTORY, by: str = "conv_id") -> DataFrame:
    """Last ``n`` messages of each conversation.  ``row_number() <= n`` is
    planned with a per-partition group limit before the shuffle, so a huge
    conversation sends at most ``n`` rows per map task."""
    if n <= 0:
        return log.limit(0)
    w = Window.partitionBy(by).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return log.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def dialogue_messages(log: DataFrame) -> DataFrame:
    """Only user and assistant messages, relabelled human / ai."""
    role = F.col("role")
    label = F.lit(None).cast("string")
    for k, v in ROLE_LABELS.items():
        label = F.when(role == k, F.lit(v)).otherwise(label)
    return log.filter(role.isin(list(ROLE_LABELS))).withColumn("role", label)


def _strip_stop_words(clause: Column) -> Column:
    words = F.filter(F.split(F.trim(clause), " "),
                     lambda w: (w != "") & ~F.array_contains(F.array(*[F.lit(s) for s in STOP_WORDS]), w))
    joined = F.array_join(words, " ")
    return F.when(joined != "", joined)


def message_intents(messages: DataFrame, text: str = "content") -> DataFrame:
    """Per message: slash command, switch target (the word after the first
    phrase, in the phrases' order, that isn't a stop word), the follow-up request of a combined command, list intent, plot intent."""
    low = F.lower(F.col(text))
    cmd = F.trim(low)
    # the phrases in their order; a phrase followed by a stop word only gives way to the next one
    target = F.coalesce(*[_strip_stop_words(F.regexp_extract(low, TARGET_RE % p, 1)) for p in SWITCH_PHRASES])
    has_switch = low.rlike(SWITCH_RE)
    follow = F.trim(F.regexp_extract(low, FOLLOW_RE, 1))
    listing = F.lit(False)
    for p in LIST_PHRASES:
        listing = listing | low.contains(p)
    return messages.select(
        "*",
        F.when(cmd.isin(list(COMMANDS)), cmd).alias("command"),
        target.alias("switch_target"),
        F.when(has_switch & (F.length(follow) > 3), follow).alias("follow_up"),
        listing.alias("list_intent"),
        low.rlike(PLOT_RE).alias("plot_intent"))
