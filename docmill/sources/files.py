"""File sources and sinks: texts with metadata, validation, content addressing, CSV and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The largest file and the types that are read.
MAX_BYTES = 100 * 1024 * 1024
TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
}


def kind_of(name: Column) -> Column:
    """The supported type that a file name's ending tells; null for others."""
    ending = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[ending]


def file_error(name: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Why a file isn't read: its type, or its size; null if it is."""
    return F.when(kind_of(name).isNull(), "unsupported type").when(size > most, "too large")


def parse_docx(content: bytes) -> str:
    """The text of a DOCX file: its paragraphs, a line each, tabs and line breaks kept."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in body.iter(f"{w}p"):
        lines.append("".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" for x in p.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br")))
    return "\n".join(lines)


#: Parsers that come with the engine; a PDF parser is given to read_files, as no library for it is assumed.
PARSERS = {TYPES[".docx"]: parse_docx}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of every text or markdown file below a path, each whole."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(F.lower("path").rlike(r"\.(txt|md)$"))


def read_files(spark: SparkSession, path: str, parsers: dict | None = None) -> DataFrame:
    """``(path, mime, text, error)`` of all files: texts decoded, others by the parser for their type (bytes -> str), of PARSERS or given.

    A file that is too large or of no supported type has an error and no text.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fits = rows.where(F.col("length") <= MAX_BYTES).select("path", "length", "content")
    large = rows.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"))  # whose content isn't read
    return parsed(fits.unionByName(large), parsers)


def parsed(rows: DataFrame, parsers: dict | None = None) -> DataFrame:
    """``(path, mime, text, error)`` of stored files ``(path, length, content)``, as read_files gives them."""
    rows = rows.select("path", "length", "content", kind_of(F.col("path")).alias("mime"))
    error = file_error(F.col("path"), F.col("length"))
    given = PARSERS | dict(parsers or {})

    def parse(batches):
        import pandas as pd

        for b in batches:
            texts, errors = [], []
            for kind, content, e in zip(b["mime"], b["content"], b["error"]):
                text = None
                if e is None:
                    try:
                        text = bytes(content).decode("utf-8") if kind in ("text/plain", "text/markdown") else given[kind](bytes(content)) if kind in given else None
                        e = None if text is not None else "no parser"
                    except Exception as x:  # noqa: BLE001  a file's error is a value
                        e = str(x)[:200]
                texts.append(text)
                errors.append(e)
            yield pd.DataFrame({"path": b["path"], "mime": b["mime"], "text": texts, "error": errors})

    return rows.select("path", "mime", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error")).mapInPandas(parse, "path string, mime string, text string, error string")


def text_metadata(df: DataFrame, text: str) -> DataFrame:
    """Adds words, chars, lines and pages (300 words each, one at least)."""
    words = F.regexp_count(F.col(text), F.lit(r"\S+")).cast("long")
    rows = df.withColumn("words", words).withColumn("chars", F.length(text).cast("long")).withColumn("lines", F.size(F.split(text, "\n", -1)).cast("long"))
    return rows.withColumn("pages", F.greatest(F.lit(1), F.floor(F.col("words") / 300)).cast("long"))


def content_addressed(df: DataFrame, key: str, content: str) -> DataFrame:
    """``(name, key, copies)``: one stored file for each distinct content, named by its md5."""
    return df.groupBy(F.md5(F.col(content).cast("binary")).alias("name")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def validate(df: DataFrame, size: str, kind: str, most: int = MAX_BYTES, kinds: list[str] | None = None) -> DataFrame:
    """Adds ok: small enough and of an allowed type."""
    return df.withColumn("ok", (F.col(size) <= most) & F.coalesce(F.col(kind).isin(kinds or list(TYPES.values())), F.lit(False)))


def csv_cell(value: Column) -> Column:
    """A CSV cell, quoted only if it holds a comma."""
    return F.when(F.contains(value, F.lit(",")), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose content's sha-256 differs from the stored ``h``, or that are new."""
    now = new.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_now"))
    return now.join(old.select(key, "h"), key, "left").where(~F.col("_now").eqNullSafe(F.col("h"))).select(key)


def hashing_embedding(df: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """``(key, embedding)``: counts of words by hash, normalised; an offline stand-in for an embedding service."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % dimension)
    zero = F.array_repeat(F.lit(0.0), dimension)
    counted = df.select(key, F.explode_outer(slots).alias("s")).groupBy(key, "s").agg(F.count("*").cast("double").alias("n"))
    pairs = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "n")))).alias("m"), F.sqrt(F.sum(F.when(F.col("s").isNotNull(), F.col("n") * F.col("n")))).alias("norm"))
    vector = F.transform(zero, lambda _, i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0)))
    return pairs.select(key, vector.alias("embedding"))
