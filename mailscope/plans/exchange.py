"""The exchange table: one row per recipient of a message, with the status of both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions import text
from mailscope.operators.aliases import counted_directory, replicated, status_directory, with_status
from mailscope.operators.cleaning import clean_employees, clean_messages, complete_messages
from mailscope.operators.sharing import always
from mailscope.sources.tables import Sources, write_table

#: Columns a reader of the table asks for; the others serve the analyses.
EXCHANGE_COLUMNS = (
    "date", "year", "month", "sender", "status_sender", "rtype", "recipient", "status_recipient", "subject",
    "reference",
)

SIDES = ("sender", "recipient")


def build_exchange(
    sources: Sources, config: CorpusConfig, directory: DataFrame | None = None, co_located: bool = False
) -> DataFrame:
    """Clean and join the four sources.

    The wide part (bodies, sender status, everything derived from texts) is put together per message,
    where each text is looked at once, and the narrow recipient rows then join it once, on ``mid``.
    Callers select what they need; Catalyst prunes the rest, regular expressions and bodies included.

    Bodies are matched on the key wrapped in a struct. Matched on ``mid`` itself they would leave the
    messages partitioned by it, the last join would take them without a shuffle, and adaptive
    execution, which only splits between two shuffles, could not spread a message with very many
    recipients over several tasks.

    Addresses are looked up as they are and lose their spaces only afterwards, so an address with a
    space has no status.

    Where missing addresses match each other, lookups carry counts, and rows are repeated at the very end.

    A saved ``directory`` takes the place of looking it up in the staff list. Sources that are ``co_located``, bucketed by
    ``mid`` (see :mod:`mailscope.plans.startup`), are joined bucket by bucket instead of being shuffled by it.
    """
    counted = config.match_blank
    if directory is None:
        directory = (counted_directory if counted else status_directory)(clean_employees(sources.employees, config), config)
    body_key = F.col("mid") if co_located else F.struct("mid")
    copies = {side: f"_copies_{side}" if counted else None for side in SIDES}

    sent = complete_messages(clean_messages(sources.messages, config))
    sent = with_status(sent, "sender", directory, "status_sender", config, copies["sender"])
    bodies = sources.references.select(body_key.alias("_body_of"), *_text_columns(config))
    sent = sent.join(bodies, body_key == F.col("_body_of"), "left").select(
        "mid",
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.trunc("date", "MM").alias("year_month"),
        text.strip_spaces(F.col("sender")).alias("sender"),
        "status_sender",
        "subject",
        "reference",
        "text_key",
        text.word_count(F.col("subject")).alias("subject_words"),
        "email_words",
        *[text.flag(F.col("subject"), t.subject_pattern).alias(t.subject_flag) for t in config.topics],
        *[t.email_flag for t in config.topics],
        text.flag(F.col("subject"), config.company_pattern).alias("subject_company"),
        "email_company",
        *([copies["sender"]] if counted else []),
    )

    received = with_status(
        sources.recipients.select("rid", "mid", "rtype", "rvalue"), "rvalue", directory, "status_recipient", config,
        copies["recipient"],
    ).withColumn("recipient", text.strip_spaces(F.col("rvalue")))

    rows = received.drop("rvalue").join(sent, "mid").drop("mid")
    if not counted:
        return rows
    return replicated(rows, F.col(copies["sender"]) * F.col(copies["recipient"]), "rid").drop(*copies.values())


def status_pairs(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Rows of the exchange table per type and pair of statuses, from counts; repeated rows are never written out."""
    directory = counted_directory(clean_employees(sources.employees, config), config)
    bodies = sources.references.groupBy(F.struct("mid").alias("_body_of")).agg(F.count("*").alias("_bodies"))
    sent = complete_messages(clean_messages(sources.messages, config)).select("mid", "sender")
    sent = with_status(sent, "sender", directory, "status_sender", config, "_copies_sender")
    sent = sent.join(bodies, F.struct("mid") == F.col("_body_of"), "left")
    received = sources.recipients.select("mid", "rtype", "rvalue")
    received = with_status(received, "rvalue", directory, "status_recipient", config, "_copies_recipient")
    rows = F.col("_copies_sender") * F.col("_copies_recipient") * F.coalesce("_bodies", F.lit(1))
    return received.join(sent, "mid").groupBy("rtype", "status_sender", "status_recipient").agg(F.sum(rows).alias("n"))


def _text_columns(config: CorpusConfig) -> list[F.Column]:
    body = F.col("reference")
    return [
        body,
        text.text_key(body).alias("text_key"),
        text.word_count(body).alias("email_words"),
        *[text.flag(body, t.email_pattern).alias(t.email_flag) for t in config.topics],
        text.flag(body, config.company_pattern).alias("email_company"),
    ]


#: Over how many keys rows without a body are spread before a join on the body's key; a power of two.
SPREAD = 4096


def texts(sources: Sources, needed: DataFrame | None = None) -> DataFrame:
    """``(text_key, reference)``: the bodies whose keys are in ``needed``, or all, each once.

    Keys decide, before anything is grouped; one shuffle by key serves the choice, the grouping and the
    caller's join. The choice reads all columns of ``needed``: a caller that joins back to the same rows then
    has the same shuffle, which Spark runs once.
    """
    body = F.col("reference")
    keyed = sources.references.where(body.isNotNull()).select(text.text_key(body).alias("text_key"), body)
    if needed is not None:
        key, wanted = F.col("b.text_key"), [F.col(f"n.{c}") for c in needed.columns]
        same = (key == F.col("n.text_key")) & always(*wanted, key)
        keyed = keyed.alias("b").join(needed.alias("n"), same, "left_semi")
    return keyed.dropDuplicates(["text_key"])


def with_text(df: DataFrame, sources: Sources, most: bool = False) -> DataFrame:
    """Replace ``text_key`` by the body it stands for.

    The keys of ``df`` choose the bodies, unless it holds ``most`` of them anyway: then looking for the keys
    would cost more than it saves. ``df`` is shuffled by key once, for the choice and for the join back.

    Most messages have no body. Their missing key, which matches nothing, would be one hot key of the
    join, so it gets one of many values that no body has. The key is then known not to be null; were it
    not, Spark would filter one of the two uses and no longer see that they are equal.
    """
    none = F.concat(F.lit("-"), F.xxhash64(*df.columns).bitwiseAND(SPREAD - 1).cast("string"))
    spread = df.withColumn("text_key", F.coalesce("text_key", none))
    bodies = texts(sources, None if most else spread)
    return spread.join(bodies, "text_key", "left").drop("text_key")


def corpus_exchange(sources: Sources, config: CorpusConfig) -> DataFrame:
    """The exchange table as analysts see it."""
    return build_exchange(sources, config).select(*EXCHANGE_COLUMNS)


def save_exchange(exchange: DataFrame, path: str) -> None:
    """Write the table by year, for analyses that share it; an address would give far too many folders."""
    write_table(exchange, path, partition_by=("year",))


def saved_exchange(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
