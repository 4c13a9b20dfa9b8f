"""The upload path: injected model calls with retry, chunk -> embed -> store by document, and status transitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from docmill.functions.chunking import chunks
from docmill.operators.lineage import cut


class ServiceError(Exception):
    """A model service's answer with an HTTP-like status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


#: Errors of a service, which are values of the rows concerned.
REFUSALS = (ServiceError, ConnectionError, TimeoutError, ValueError)


def with_retry(call: Callable, tries: int = 3, wait: float = 0.5) -> Callable:
    """The call, repeated after a connection error or a status of 500 or more; waits double. The last error is raised."""

    def run(values: list) -> list:
        for k in range(tries):
            try:
                return call(values)
            except (ConnectionError, TimeoutError, ServiceError) as x:
                if k + 1 == tries or isinstance(x, ServiceError) and x.status < 500:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError("unreachable")

    return run


def called(df: DataFrame, value: str, call: Callable[[list], list], result: DataType | None = None, batch: int = 64, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Adds ``result`` and ``error``: an injected call on lists of values (one result for each), a batch at a time.

    A batch that the service refuses is called value by value, so that one bad
    value spoils no other row; what then fails has its error and a null result,
    as has a result of None. Where the service is down (no connection, status
    500 or more, after all tries), the whole batch has that error at once: no
    value is tried again alone. Errors of the call's own code are raised. One
    narrow pass.
    """
    schema = StructType([*df.schema.fields, StructField("result", result or StringType()), StructField("error", StringType())])
    retried = with_retry(call, tries, wait)

    def one(v) -> tuple:
        try:
            r = retried([v])[0]
            return r, None if r is not None else "no result"
        except REFUSALS as x:  # a row's error is a value
            return None, str(x)[:200]

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                values = part[value].tolist()
                try:
                    pairs = [(r, None if r is not None else "no result") for r in retried(values)]
                except REFUSALS as x:
                    down = isinstance(x, (ConnectionError, TimeoutError)) or isinstance(x, ServiceError) and x.status >= 500
                    pairs = [(None, str(x)[:200])] * len(values) if down else [one(v) for v in values]
                part["result"], part["error"] = [p[0] for p in pairs], [p[1] for p in pairs]
                yield part

    return df.mapInPandas(run, schema)


def message_lists(turns: DataFrame, conversation: str, order: str, role: str, content: str, last: int = 4, system: str | None = None) -> DataFrame:
    """``(conversation, messages)``: the last turns of each conversation in order as role and content, behind a system message if given.

    The newest turns are chosen before they are gathered, so a list is short however long the conversation.
    """
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(order).desc()))
    rows = turns.withColumn("_nth", newest).where(F.col("_nth") <= last)
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content")))), lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))) if system else None
    return rows.groupBy(conversation).agg((F.concat(first, said) if system else said).alias("messages"))


def chat(df: DataFrame, messages: str, call: Callable[[list], list], **options) -> DataFrame:
    """called on message lists: the call gets a list of lists of ``{"role", "content"}`` and gives one answer for each."""
    return called(df, messages, lambda values: call([[dict(m) for m in v] for v in values]), **options)


def chat_pieces(df: DataFrame, messages: str, call: Callable[[list], list], **options) -> DataFrame:
    """chat with answers that come in pieces (lists of strings): the rows with ``result`` joined and one row for each ``(piece, text)``; a failed one has a row without a piece."""
    from pyspark.sql.types import ArrayType

    rows = called(df, messages, lambda values: call([[dict(m) for m in v] for v in values]), ArrayType(StringType()), **options)
    return rows.select(*df.columns, F.array_join("result", "").alias("result"), "error", F.posexplode_outer("result").alias("piece", "text"))


def ingest(docs: DataFrame, id_col: str, text_col: str, embedder: Callable[[list], list], dimension: int, size: int = 240, overlap: int = 48, **retry) -> tuple[DataFrame, DataFrame]:
    """Points to store and each document's outcome: ``(id, sequence, text, embedding)`` and ``(id, status, error)``.

    Texts are chunked and chunks embedded by the injected embedder, in one
    narrow pass. A document is stored whole or not at all: one chunk without an
    embedding of this dimension, or no chunk, fails it.
    """
    from pyspark.sql.types import ArrayType, DoubleType

    pieces = chunks(docs, id_col, text_col, size, overlap).select(id_col, "sequence", "start_token", "end_token", "text")
    done = called(pieces, "text", embedder, ArrayType(DoubleType()), **retry)
    wrong = F.when(F.col("result").isNotNull() & (F.size("result") != dimension), "wrong dimension")
    done = cut(done.withColumn("error", F.coalesce("error", wrong)))  # the embedder is called once
    by_doc = done.groupBy(id_col).agg(F.min("error").alias("error"), F.count("*").alias("n"))
    status = docs.select(id_col).join(by_doc, id_col, "left")
    status = status.select(id_col, F.when(F.col("n").isNull() | F.col("error").isNotNull(), "failed").otherwise("completed").alias("status"), F.when(F.col("n").isNull(), "no text").otherwise(F.col("error")).alias("error"))
    points = done.join(status.where("status = 'completed'"), id_col, "left_semi")
    return points.select(id_col, "sequence", "start_token", "end_token", "text", F.col("result").alias("embedding")), status


def reingest(stored: DataFrame, docs: DataFrame, id_col: str, text_col: str, embedder: Callable[[list], list], dimension: int, size: int = 240, overlap: int = 48, **retry) -> tuple[DataFrame, DataFrame]:
    """The stored points after documents have changed, and each one's outcome: ``(id, status, error, kept, embedded)``.

    stored are points of ingest. A chunk whose text the document had before
    keeps its vector, wherever it stands now; of all other texts each distinct
    one reaches the embedder once, however many documents have it. A document
    is replaced whole, or keeps its old points if one chunk fails; documents
    that aren't in ``docs`` stay, and one without text fails. The result holds
    what a fresh ingest of the same texts would.
    """
    from pyspark.sql.types import ArrayType, DoubleType

    h = F.sha2(F.col("text").cast("binary"), 256)
    pieces = cut(chunks(docs, id_col, text_col, size, overlap).select(id_col, "sequence", "start_token", "end_token", "text").withColumn("h", h))
    known = stored.select(id_col, h.alias("h"), F.col("embedding").alias("old")).groupBy(id_col, "h").agg(F.first("old").alias("old"))
    joined = pieces.join(known, [id_col, "h"], "left")
    new = joined.where("old is null").select("h", "text").dropDuplicates(["h"])
    done = called(new, "text", embedder, ArrayType(DoubleType()), **retry)
    wrong = F.when(F.col("result").isNotNull() & (F.size("result") != dimension), "wrong dimension")
    done = cut(done.select("h", "result", F.coalesce("error", wrong).alias("error")))
    full = joined.join(done, "h", "left").withColumn("error", F.when(F.col("old").isNull(), F.col("error")))
    by_doc = full.groupBy(id_col).agg(F.min("error").alias("error"), F.count("old").alias("kept"), F.count_if(F.col("old").isNull()).alias("embedded"))
    status = docs.select(id_col).distinct().join(by_doc, id_col, "left")
    failed = F.col("kept").isNull() | F.col("error").isNotNull()
    status = cut(status.select(id_col, F.when(failed, "failed").otherwise("completed").alias("status"), F.when(F.col("kept").isNull(), "no text").otherwise(F.col("error")).alias("error"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("embedded", F.lit(0)).alias("embedded")))
    fine = status.where("status = 'completed'").select(id_col)
    made = full.join(fine, id_col, "left_semi").select(id_col, "sequence", "start_token", "end_token", "text", F.coalesce("old", "result").alias("embedding"))
    return stored.join(fine, id_col, "left_anti").select(*made.columns).unionByName(made), status


def transitions(status: DataFrame, id_col: str) -> DataFrame:
    """``(id, step, from_status, to_status)``: what the driver of the upload path writes, pending -> processing -> completed or failed."""
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("pending").alias("from_status"), F.lit("processing").alias("to_status")),
        F.struct(F.lit(2).alias("step"), F.lit("processing").alias("from_status"), F.col("status").alias("to_status")),
    )
    return status.select(id_col, F.explode(steps).alias("s")).select(id_col, "s.*")


def personal_uploads(uploads: DataFrame, profiles: DataFrame) -> DataFrame:
    """New documents of the second uploader: scope personal, department from the uploader's profile (none without one), status pending."""
    own = profiles.select(F.col("account_id").alias("uploader_id"), "department_id")
    return uploads.join(own, "uploader_id", "left").withColumns({"access_scope": F.lit("personal"), "status": F.lit("pending")})
