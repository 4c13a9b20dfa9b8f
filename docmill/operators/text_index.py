"""An inverted index for full text: stemmed terms with positions, AND, phrase and BM25 from postings alone.

Documents fall into cells of ids next to each other, the same for every term,
so that postings of different terms meet by an equality join on the cell. A row
holds one term's postings in one cell with their largest count and shortest
document: an upper bound of what the term can add there. The best-ranked search
scores the cells of the largest bounds first; what the k-th document has then
rules out all cells that can't reach it, and only the others' postings are read.

The index is a folder of segments. A segment holds all postings of the cells
that it names, so the newest segment that names a cell owns it, and adding,
replacing or deleting documents rewrites no cell but theirs. Rows are in folders
by a hash of the term and sorted by it, so a search reads few files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmill.operators.lineage import cut, small

#: Ids of a cell; folders by term; tasks that write one folder at least (a frequent term is in all of them).
CELL, BUCKETS, WRITERS = 1024, 16, 4
#: Documents whose words are gathered at once.
TOGETHER = 2000
#: Cells that are scored first, to learn what the k-th document has.
FIRST_CELLS = 16
# Words that are not indexed.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "not", "of", "on", "only", "or", "other", "our", "out", "over", "she", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "under", "up", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your",
)


def singular(word: Column) -> Column:
    """A lower-case English word without the s or es of a plural; a plain look at its end settles most words."""
    y, es = F.regexp_replace(word, "ies$", "y"), F.regexp_replace(word, "es$", "")
    cut_off = F.when(word.rlike("[^aeiou]ies$"), y).when(word.rlike("(ss|x|ch|sh|zz)es$"), es).when(word.rlike("[^su]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when(F.endswith(word, F.lit("s")), cut_off).otherwise(word)


def bare(word: Column) -> Column:
    """A word without ing and ed behind a vowel and a letter."""
    ing = F.endswith(word, F.lit("ing")) & (F.length(word) > 5) & word.rlike("^.*[aeiouy].*[a-z]ing$")
    ed = F.endswith(word, F.lit("ed")) & (F.length(word) > 4) & word.rlike("^.*[aeiouy].*[a-z]ed$")
    return F.when(ing, F.regexp_replace(word, "ing$", "")).when(ed, F.regexp_replace(word, "ed$", "")).otherwise(word)


def _words(text_col: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda w: w != "")


def analysed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, position, term)`` of every indexed word: ASCII letters and digits in lower case, positions counted over all words from 0, stems in place of words."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(_words(text_col)).alias("position", "word")).where(~F.col("word").isin(*STOP_WORDS))
    return rows.withColumn("word", singular(F.col("word"))).select("id", "position", bare(F.col("word")).alias("term"))


def query_terms(spark: SparkSession, text: str) -> list[tuple[int, str]]:
    """The positions and terms of a query, analysed as documents are."""
    one = spark.range(1).select("id", F.lit(text).alias("text"))
    return [(r.position, r.term) for r in analysed(one, "id", "text").orderBy("position").collect()]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _cell(id_: Column) -> Column:
    return F.call_function("div", id_.cast("long"), F.lit(CELL))


def stem(word: str) -> str:
    """singular and bare of one word, as Python."""
    if word.endswith("s"):
        if re.search("[^aeiou]ies$", word):
            word = word[:-3] + "y"
        elif re.search("(ss|x|ch|sh|zz)es$", word):
            word = word[:-2]
        elif re.search("[^su]s$", word) and len(word) > 3:
            word = word[:-1]
    if word.endswith("ing") and len(word) > 5 and re.search("[aeiouy].*[a-z]ing$", word):
        return word[:-3]
    if word.endswith("ed") and len(word) > 4 and re.search("[aeiouy].*[a-z]ed$", word):
        return word[:-2]
    return word


#: A term's postings in a cell as one array, which is small when it moves: how many, their ids less the cell's first, where
#: their positions begin and (once more) end, lengths of their documents, positions.
_PART = "cell long, term string, data array<int>"


def _packed(cells: np.ndarray, terms: pa.Array, edges: np.ndarray, ids: np.ndarray, n: np.ndarray, tf: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Rows of _PART: the r-th has the postings from edges[r] on, and their positions stand in order."""
    many = np.diff(edges)
    ends = np.r_[0, np.cumsum(tf)]
    lengths = 2 + 3 * many + ends[edges[1:]] - ends[edges[:-1]]
    begin = np.r_[0, np.cumsum(lengths)]
    out = np.empty(begin[-1], np.int32)
    row = np.repeat(np.arange(len(many)), many)
    at = begin[row] + 1 + np.arange(len(row)) - edges[row]
    out[begin[:-1]] = many
    out[at] = ids - cells[row] * CELL
    out[at + many[row]] = ends[:-1] - ends[edges[row]]
    out[begin[:-1] + 1 + 2 * many] = ends[edges[1:]] - ends[edges[:-1]]
    out[at + 2 * many[row] + 1] = n
    word = np.repeat(row, tf)
    out[begin[word] + 2 + 3 * many[word] + np.arange(len(word)) - ends[edges[word]]] = positions
    return pa.record_batch([pa.array(cells), terms, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(out))], ["cell", "term", "data"])


def _unpacked(data: Column, cell: Column, kind: str) -> Column:
    """The postings of an array of _PART, ids as that type."""
    many = F.get(data, F.lit(0))

    def posting(i: Column) -> Column:
        start = F.get(data, 1 + many + i)
        tf = F.get(data, 2 + many + i) - start
        id_ = F.get(data, 1 + i) + cell * CELL
        return F.struct(id_.cast(kind).alias("id"), tf.cast("long").alias("tf"), F.get(data, 2 + 2 * many + i).cast("long").alias("n"), F.slice(data, 3 + 3 * many + start, tf).alias("positions"))

    return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), posting)).otherwise(F.array().cast(f"array<struct<id:{kind},tf:bigint,n:bigint,positions:array<int>>>"))


def _gathered(ids: np.ndarray, words: pa.Array, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _PART of some documents, from their words one document after the other; a row of a null term for each cell."""
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    terms: dict[str, int] = {}
    number = np.array([terms.setdefault(stem(w), len(terms)) if w and w not in STOP_WORDS else -1 for w in names] or [-1])
    empty = np.array([not w for w in names] or [True])
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, word = np.repeat(np.arange(len(ids)), sizes), ~empty[code] if len(code) else np.zeros(0, bool)
    code, doc = code[word], doc[word]  # positions count all words, but no empty ones
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    kept = number[code] >= 0 if len(code) else np.zeros(0, bool)
    code, doc, place = number[code[kept]] if len(code) else code, doc[kept], place[kept]
    n = np.bincount(doc, minlength=len(ids))
    cell = np.where(ids < 0, -(-ids // CELL), ids // CELL)
    # by cell and term; documents are in the order of their ids, so that this is the order below
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    cells, cell_no = np.unique(cell, return_inverse=True)
    order = np.lexsort((place, rank[doc], cell_no[doc] * max(1, len(terms)) + code))
    code, doc, place = code[order], doc[order], place[order]
    row = cell_no[doc] * max(1, len(terms)) + code
    new_row = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    new_post = new_row | np.r_[True, doc[1:] != doc[:-1]] if len(row) else new_row
    at = np.flatnonzero(new_post)
    tf = np.diff(np.r_[at, len(row)])
    edges = np.r_[np.flatnonzero(new_row[at]), len(at)]
    first = np.flatnonzero(new_row)
    if len(row):
        yield _packed(cells[cell_no[doc[first]]], pa.array(list(terms)).take(pa.array(code[first])), edges, ids[doc[at]], n[doc[at]], tf, place)
    order = np.lexsort((ids, cell_no))
    edges = np.r_[np.searchsorted(cell_no[order], np.arange(len(cells))), len(ids)]
    yield _packed(cells, pa.nulls(len(cells), pa.string()), edges, ids[order], n[order], np.zeros(len(ids), np.int64), np.zeros(0, np.int64))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, TOGETHER):
            part = b.slice(lo, TOGETHER)
            words, ids = part.column("words"), part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.asarray(words.value_lengths().fill_null(0))
            yield from _gathered(ids, words.flatten(), sizes)


def _postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of _PART: what each task has of a term in a cell, gathered before anything moves, and a row of a null term for each cell; an id has one document."""
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.split(F.lower(F.col(text_col)), "[^a-z0-9]+").alias("words"))
    return every.mapInArrow(_gather, _PART)


def _merged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of _PART for ids of several texts, whose words are those of one document."""
    by = analysed(docs, id_col, text_col).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    kept = F.filter(_words(text_col), lambda w: ~w.isin(*STOP_WORDS))
    n = docs.select(F.col(id_col).alias("id"), F.greatest(F.size(kept), F.lit(0)).alias("n")).groupBy("id").agg(F.sum("n").cast("int").alias("n"))
    rows = by.join(n, "id").select("id", "term", "tf", "n", "positions")
    rows = rows.unionByName(n.select("id", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), "n", F.array().cast("array<int>").alias("positions")))
    return _parts(rows.select(_cell(F.col("id")).alias("cell"), "term", F.array(F.struct("id", "tf", "n", "positions")).alias("postings")))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows ``(cell, term, postings)`` as rows of _PART."""
    p = F.col("postings")
    every = lambda of: F.transform(p, lambda x: of(x).cast("int"))
    ends = F.aggregate(every(lambda x: x.tf), F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    data = F.concat(F.array(F.size(p)), every(lambda x: x.id.cast("long") - F.col("cell") * CELL), ends, every(lambda x: x.n), F.flatten(F.transform(p, lambda x: x.positions)).cast("array<int>"))
    return rows.select("cell", "term", data.alias("data"))


def _rows(parts: DataFrame, kind: str) -> DataFrame:
    """One row for each term and cell: its postings by id (of that type), and what bounds their scores. At most CELL documents stand in one.

    Rows move once, to the tasks that write them; writers: tasks for a folder.
    """
    writers = max(WRITERS, -(-int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term")))
    parts = parts.withColumn("_writer", (bucket * writers + F.pmod(F.xxhash64("term", "cell"), F.lit(writers))).cast("int"))
    held = parts.repartition(2 * BUCKETS * writers, "_writer").groupBy("_writer", "cell", "term").agg(F.collect_list("data").alias("_parts"))
    every = F.flatten(F.transform("_parts", lambda x: _unpacked(x, F.col("cell"), kind)))
    rows = held.select(bucket.alias("bucket"), "cell", "term", F.array_sort(every).alias("postings"))
    words = F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + p.n)
    return rows.select("cell", "term", "postings", F.size("postings").cast("long").alias("docs"), words.alias("words"), F.array_max(F.transform("postings", lambda p: p.tf)).alias("most_tf"), F.array_min(F.transform("postings", lambda p: p.n)).alias("least_n"), "bucket")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows ``(cell, term, postings)`` as rows of _PART without the ids of gone, which are looked up as bits of their cells."""
    bit = lambda id_, cell: id_.cast("long") - cell * CELL + (CELL - 1)  # noqa: E731  # cell 0 has negative ids too
    at = gone.select(_cell(F.col("id")).alias("cell"), bit(F.col("id"), _cell(F.col("id"))).alias("_bit"))
    bits = at.groupBy("cell", (F.col("_bit") / 32).cast("int").alias("_at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 32).cast("int"))).alias("_bits"))
    bits = bits.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_bits"))).alias("_gone"))
    off = lambda p: bit(p.id, F.col("cell"))
    kept = F.filter("postings", lambda p: F.getbit(F.coalesce(F.try_element_at("_gone", (off(p) / 32).cast("int")), F.lit(0).cast("long")), (off(p) % 32).cast("int")) == 0)
    rows = rows.join(small(bits), "cell").select("cell", "term", kept.alias("postings")).where(F.size("postings") > 0)
    return _parts(rows)


class TextIndex:
    """The index in a folder, which all of the cluster must see; ids are integers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _segments(self) -> list[int]:
        """Whole segments in order."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[8:]) for n in found if n.startswith("segment=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/cells/_SUCCESS")))

    def _write(self, rows: DataFrame, cells: DataFrame, number: int) -> None:
        """Writes a segment; the list of its cells last, which makes it whole."""
        at = f"{self.path}/segment={number}"
        rows.sortWithinPartitions("bucket", "term", "cell").write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/postings")
        cells.write.mode("overwrite").parquet(f"{at}/cells")

    def _owners(self) -> DataFrame | None:
        """``(cell, segment)``: the newest segment that names a cell; None where one segment holds all."""
        numbers = self._segments()
        if len(numbers) < 2:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/segment={n}/cells").select("cell", F.lit(n).alias("segment")) for n in numbers]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("cell").agg(F.max("segment").alias("segment"))

    def rows(self, terms: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows that count, of the terms (all, if None): only their folders and matching row groups are read, and only the columns."""
        numbers = self._segments()
        if not numbers:
            raise FileNotFoundError(f"no index in {self.path}")
        wanted = [*dict.fromkeys(["cell", "term", *(columns or ["postings", "docs", "words", "most_tf", "least_n", "bucket"])])]
        folders = None
        if terms is not None:
            names = self.spark.createDataFrame([(x,) for x in terms] or [("",)], "t string")
            folders = sorted({r.b for r in names.select(_bucket(F.col("t")).alias("b")).collect()})
        parts = []
        for n in numbers:
            part = self.spark.read.parquet(f"{self.path}/segment={n}/postings")
            if terms is not None:
                part = part.where(F.col("bucket").isin(folders) & F.col("term").isin(terms or [""]))
            parts.append(part.select(*wanted, F.lit(n).alias("segment")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        owners = self._owners()
        return (every if owners is None else every.join(owners, ["cell", "segment"], "left_semi")).drop("segment")

    def documents(self) -> DataFrame:
        """The rows of a null term: each cell's documents and lengths."""
        numbers, parts = self._segments(), []
        for n in numbers:
            parts.append(self.spark.read.parquet(f"{self.path}/segment={n}/postings").where(F.col("bucket") == -1).select("cell", "docs", "words", "postings", F.lit(n).alias("segment")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        owners = self._owners()
        return (every if owners is None else every.join(owners, ["cell", "segment"], "left_semi")).drop("segment")

    def add(self, docs: DataFrame, id_col: str, text_col: str, deleted: DataFrame | None = None) -> int:
        """Puts documents in, in place of older ones of the same id, takes those of the deleted ids out, and returns the new segment's number.

        A new segment has all postings of the cells that change, old and new;
        nothing else is written or read but these cells. Rows without an id are
        left out, a null text has no term, of several texts of an id all words
        are those of one document in no fixed order.
        """
        numbers = self._segments()
        docs = docs.where(F.col(id_col).isNotNull())
        gone = docs.select(F.col(id_col).alias("id"))
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col(deleted.columns[0]).alias("id")).where("id is not null"))
        gone = gone.distinct()
        cells = cut(gone.select(_cell(F.col("id")).alias("cell")).distinct())
        key = F.col(id_col)
        several = cut(docs.groupBy(key.alias("id")).count().where("count > 1").select("id"))
        if several.isEmpty():
            parts = _postings(docs, id_col, text_col)
        else:
            held = docs.select(key.alias("id"), F.col(text_col).alias("text"))
            parts = _postings(held.join(small(several), "id", "left_anti"), "id", "text").unionByName(_merged(held.join(small(several), "id", "left_semi"), "id", "text"))
        if numbers:
            parts = parts.unionByName(_without(self.rows(columns=["postings"]), gone))
        number = (numbers[-1] if numbers else -1) + 1
        self._write(_rows(parts, docs.schema[id_col].dataType.simpleString()), cells, number)
        return number

    def compact(self) -> int:
        """Writes all rows that count as one segment that owns every cell; older segments stay for readers that have begun."""
        rows = self.rows()
        number = self._segments()[-1] + 1
        self._write(rows.repartition("bucket", F.pmod(F.xxhash64("term", "cell"), F.lit(WRITERS))), rows.select("cell").distinct(), number)
        return number

    def all_of(self, text: str) -> DataFrame:
        """``(id)`` of documents that hold all terms of the query: postings are intersected cell by cell. A query without terms finds none."""
        terms = list(dict.fromkeys(t for _, t in query_terms(self.spark, text)))
        rows = self.rows(terms, ["postings"]).select("cell", "term", F.transform("postings", lambda p: p.id).alias("ids"))
        by = rows.groupBy("cell").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(terms))
        both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return by.select(F.explode(both).alias("id")).where(F.lit(bool(terms)))

    def phrase(self, text: str) -> DataFrame:
        """``(id, times)`` of documents with the query's terms at its distances, stop words counted as places."""
        terms = query_terms(self.spark, text)
        first = terms[0][0] if terms else 0
        offsets = F.create_map(*[x for i, (p, t) in enumerate(terms) for x in (F.lit(i), F.struct(F.lit(t).alias("t"), F.lit(p - first).alias("o")))]) if terms else F.create_map()
        if not terms:
            return self.rows([], ["docs"]).select(F.col("cell").alias("id"), F.col("docs").alias("times")).limit(0)
        asked = self.rows(sorted({t for _, t in terms}), ["postings"])
        each = asked.select("cell", F.explode(F.filter(F.map_values(offsets), lambda x: x.t == F.col("term"))).alias("at"), "postings")
        starts = F.transform("postings", lambda p: F.struct(p.id.alias("id"), F.transform(p.positions, lambda x: x - F.col("at.o")).alias("starts")))
        by = each.select("cell", F.explode(starts).alias("p")).groupBy("cell", "p.id").agg(F.collect_list("p.starts").alias("lists")).where(F.size("lists") == len(terms))
        both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return by.select("id", F.size(both).alias("times")).where("times > 0")

    def _weights(self, text: str, k1: float, b: float) -> tuple[list[str], dict[str, float], float]:
        """Terms that documents hold, their weights, and the mean length: a handful of numbers from the rows' sums."""
        terms = list(dict.fromkeys(t for _, t in query_terms(self.spark, text)))
        sums = self.documents().agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        total = float(sums.docs or 0)
        df = {r.term: float(r.df) for r in self.rows(terms, ["docs"]).groupBy("term").agg(F.sum("docs").alias("df")).collect()}
        idf = {r.t: r.w for r in self.spark.createDataFrame([(t, n) for t, n in df.items()] or [("", 1.0)], "t string, n double").select("t", F.ln(1 + (total - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("w")).collect()}
        return [t for t in terms if t in df], idf, (sums.words or 0) / total if total else 1.0

    def bm25(self, text: str, k: int | None = None, k1: float = 1.2, b: float = 0.75, first_cells: int = FIRST_CELLS) -> DataFrame:
        """``(id, score)`` by BM25, of all documents with a term, or the k best, equal scores by ascending id.

        With k, cells are ruled out by their bounds: first the bounds alone are
        read, then the postings of the most promising cells, then those of the
        cells that may still hold one of the k best.
        """
        terms, idf, mean = self._weights(text, k1, b)
        if not terms:
            return self.rows([], ["docs"]).select(F.col("cell").alias("id"), F.col("docs").cast("double").alias("score")).limit(0)
        weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, idf[t])]), F.col("term"))
        gain = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))

        def scored(cells: DataFrame | None) -> DataFrame:
            rows = self.rows(terms, ["postings"])
            if cells is not None:
                rows = rows.join(cells, "cell", "left_semi")
            each = rows.select(weight.alias("w"), F.explode("postings").alias("p"))
            return each.groupBy("p.id").agg(F.sum(F.col("w") * gain(F.col("p.tf"), F.col("p.n"))).alias("score"))

        if k is None:
            return scored(None)
        bounds = cut(self.bounds(terms, idf, mean, k1, b))
        best = bounds.orderBy(F.desc("bound"), "cell").limit(first_cells)
        tops = cut(scored(best.select("cell")).orderBy(F.desc("score"), "id").limit(k))
        least = tops.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        rest = bounds.join(best.select("cell"), "cell", "left_anti")
        if least.n == k:
            rest = rest.where(F.col("bound") >= least.least - 1e-9)
        return tops.unionByName(scored(rest.select("cell"))).orderBy(F.desc("score"), "id").limit(k)

    def bounds(self, terms: list[str], idf: dict[str, float], mean: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``(cell, bound)``: what no document of a cell can exceed; postings are not read."""
        weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, idf[t])]), F.col("term"))
        most = F.col("most_tf") * (k1 + 1) / (F.col("most_tf") + k1 * (1 - b + b * F.col("least_n") / mean))
        return self.rows(terms, ["most_tf", "least_n"]).groupBy("cell").agg(F.sum(weight * most).alias("bound"))


def ranked(found: DataFrame) -> DataFrame:
    """Rows of ``(id, score)`` with their rank; for the k best only, as it ranks in one task."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
