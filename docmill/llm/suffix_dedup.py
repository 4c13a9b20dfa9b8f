"""Removal of long repeated byte strings by a sparse suffix array.

Every window of LENGTH bytes is named by one suffix that starts in it: that at
its least GRAM-byte string by hash (the leftmost of equals). Equal windows so
have equal named suffixes at equal offsets, and only suffixes that start with
the same GRAM bytes need comparing; one in some 70 positions has one.

1. Named suffixes are written once. Those whose first bytes occur once are
   dropped by bits of a hash.
2. The others are range-partitioned by splitters that a sample gives: values of
   their leading bytes and, where many suffixes share these, of their *reach*,
   the union of their windows. A bucket is sorted, and runs of equal reaches
   repeat whole: whole copies and the inside of repeated passages end here. A
   reach that is several splitters by itself stands in the sample several
   times, so it needs no run across boundaries to be known as repeated.
3. One suffix of each distinct reach that has others with the same first bytes
   in its bucket, or stands at a bucket's edge, is compared with those of all
   buckets: partitioned by splitters of leading and of all first bytes, sorted
   by multikey quicksort, the windows of runs with equal first bytes compared.
   No such run lies across a boundary. Runs of very many distinct reaches are
   compared by an aggregation of their windows' hashes instead.

Strings are compared by 64-bit hashes. Texts are read whole; suffixes are named
in overlapping pieces of PIECE windows at most, and no more than that at once,
so that arrays and packed positions are bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.common import cut, delete_path, forget, free, hits, key_bits, marked, scratch_path, slices, small_batches, worker_state
from docmill.llm.shingles import _powers, mix

#: Bytes by which suffixes are named and first compared.
GRAM = 32
#: Longest piece of a text that is worked on at once.
PIECE = 1 << 24
#: Distinct reaches with one leading string that a task compares at most.
HOT = 20_000
#: Reaches that are sorted at once: so many, and the rest of the last one's run.
SORTED = 4096
_POSITION = np.uint64((1 << 26) - 1)
_BYTES = np.random.default_rng(30).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(base: int, n: int) -> np.ndarray:
    tables = worker_state("powers", dict)
    have = tables.get(base)
    if have is None or len(have) < n:
        have = tables[base] = _powers(base, max(n, 1 << 16))
    return have


def _sums(a: np.ndarray) -> np.ndarray:
    """Prefix sums from which any substring's hash follows."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * _table(_BASE, len(a))[: len(a)])])


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of substrings, which don't hang on where they stand."""
    return mix((sums[stop] - sums[start]) * _table(_INVERSE, len(sums))[start] + (stop - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def named_suffixes(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The suffixes that name the pieces' windows: piece, first window, windows, offset of the suffix in the first, hashes of its first bytes and of its reach, and its first 8 bytes as a signed number in byte order."""
    a = np.frombuffer(b"".join(pieces), np.uint8)
    assert len(a) < 1 << 26, "positions are packed in 26 bits"
    none = np.zeros(0, np.int64)
    if len(a) < length:
        return (none,) * 7
    sums = _sums(a)
    at = np.arange(len(a) - GRAM + 1)
    gram = _hash(sums, at, at + GRAM)
    least = _sliding_min((gram & ~_POSITION) | at.astype(np.uint64), length - GRAM + 1)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    start = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes.tolist(), ends.tolist()) if s >= length] or [none])
    if not len(start):
        return (none,) * 7
    piece = np.searchsorted(ends, start, side="right")
    name = (least[start] & _POSITION).astype(np.int64)
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(start)]]))
    piece, name, lo = piece[first], name[first], start[first]
    lead = np.zeros(len(name), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | a[name + k].astype(np.uint64)
    reach = mix(_hash(sums, lo, lo + count + length - 1) + (name - lo).astype(np.uint64))
    return piece, lo - (ends - sizes)[piece], count, name - lo, gram[name].view(np.int64), reach.view(np.int64), (lead ^ np.uint64(1 << 63)).view(np.int64)


def _pieces(texts: list[bytes], length: int, longest: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in pieces that overlap by length - 1 bytes, in groups of longest + length - 1 bytes at most; of each piece the text's number and the offset in it."""
    parts, text, base, held = [], [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), longest):
            part = t[lo : lo + longest + length - 1]
            if parts and held + len(part) > longest + length - 1:
                yield parts, np.array(text, np.int64), np.array(base, np.int64)
                parts, text, base, held = [], [], [], 0
            parts.append(part)
            text.append(i)
            base.append(lo)
            held += len(part)
    if parts:
        yield parts, np.array(text, np.int64), np.array(base, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Rows that are sorted by (something and) the key, ``least`` or more at a time and never cut inside a key's run."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        if sum(x.num_rows for x in held) >= least:
            at = np.flatnonzero(np.concatenate([[k[0] != last], k[1:] != k[:-1]]))
            if len(at):
                held.append(b.slice(0, at[0]))
                yield pa.Table.from_batches(held)
                held, b = [], b.slice(at[0])
        held.append(b)
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way partitions by one word, the equal part by the next."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == words.shape[1]:
            continue
        part = order[lo:hi]
        key = words[part, d]
        if hi - lo <= 64:
            order[lo:hi] = part[np.lexsort(words[part, d:].T[::-1])]
            continue
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, same = part[key < pivot], part[key == pivot]
        order[lo:hi] = np.concatenate([less, same, part[key > pivot]])
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(lo, a, d), (a, b, d + 1), (b, hi, d)]
    return order


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, spans)``: the maximal covered byte spans ``(lo, stop)`` of texts that have some.

    th is the text's xxhash64, which keeps apart rows that share an id; rows
    that are equal in both repeat each other. A null text is empty.
    """
    spark = docs.sparkSession
    hot_size, longest = HOT, PIECE
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), text.alias("t"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 750_000, keep="powers"):
            for pieces, text, base in _pieces(b.column(2).to_pylist(), length, longest):
                piece, lo, count, offset, gram, reach, lead = named_suffixes(pieces, length)
                at = text[piece]
                ids, ths = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                yield pa.record_batch([ids, ths, pa.array(lo + base[piece]), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(gram), pa.array(reach), pa.array(lead)], ["id", "th", "lo", "n", "offset", "gram", "reach", "lead"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = rows.where(F.length("t") >= length).mapInArrow(name, f"id {kind}, th long, lo long, n int, offset int, gram long, reach long, lead long")
    store = scratch_path(spark, "suffixes")
    with small_batches(spark):
        named.write.parquet(store)
    named = spark.read.parquet(store)
    several = named.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    bits = key_bits(several, F.col("gram"))
    sample = _sample(named)
    cuts, common = _splitters(sample, "reach", parts)
    gram_cuts, _ = _splitters(sample, "gram", parts)
    hot = F.col("reach").isin([int(x) for x in common])  # repeated, as the sample shows; too many rows for a bucket
    repeated_hot = named.where(hot).select("id", "th", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("stop"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(hits(bits, b.column(5))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_buckets(cuts, b.column(7).to_numpy(), b.column(6).to_numpy()))], names=[*b.schema.names, "bucket"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, "reach", SORTED):
            reach, gram = g.column("reach").to_numpy(), g.column("gram").to_numpy()
            new = np.concatenate([[True], (reach[1:] != reach[:-1]) | (gram[1:] != gram[:-1])])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(new)))
            of = gram[at]
            edge = np.ones(len(at), bool)  # what stands first or last may have others beyond
            edge[1:-1] = (of[1:-1] == of[:-2]) | (of[1:-1] == of[2:])
            twice = np.flatnonzero(np.repeat(times > 1, times))
            for rows, told in ((twice, np.zeros(len(twice), np.int64)), (at[edge], times[edge])):
                for b in g.take(pa.array(rows)).append_column("times", pa.array(told)).combine_chunks().to_batches():
                    yield b.select(["id", "th", "lo", "n", "offset", "gram", "times"])

    columns = f"id {kind}, th long, lo long, n int, offset int, gram long, reach long, lead long"
    dealt = named.where(~hot).mapInArrow(deal, f"{columns}, bucket int").repartitionById(len(cuts[0]) + 1, F.col("bucket")).sortWithinPartitions("bucket", "lead", "gram", "reach")
    ended = cut(dealt.mapInArrow(settle, f"id {kind}, th long, lo long, n int, offset int, gram long, times long"))
    free(spark)
    settled = ended.where("times = 0").select("id", "th", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("stop")).unionByName(repeated_hot)
    one_hot = named.where(hot).groupBy("reach").agg(F.min(F.struct("id", "th", "lo", "n", "offset", "gram")).alias("m")).select("m.*", F.lit(2).cast("long").alias("times"))
    open_ = ended.where("times > 0").unionByName(one_hot)
    size = open_.groupBy("gram").agg(F.count("*").alias("size"), F.min("times").alias("least")).where("least = 1 and size > 1").drop("least")
    meet = open_.join(cut(size), "gram")
    meet = meet.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n", "offset", "gram", "times", "size")).alias("s"))

    def reach_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 750_000, keep="powers"):
            out: list[list] = [[] for _ in range(9)]
            for i, th, t, each in zip(*(b.column(k).to_pylist() for k in range(4))):
                for s in each:
                    at = s["lo"] + s["offset"]
                    lead = int.from_bytes(t[at : at + 8], "big") - (1 << 63)
                    row = (i, th, s["lo"], s["offset"], lead, s["times"], s["size"] > hot_size, t[s["lo"] : s["lo"] + s["n"] + length - 1], s["gram"])
                    for c, x in zip(out, row):
                        c.append(x)
            bucket = _buckets(gram_cuts, np.array(out[4], np.int64), np.array(out[8], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.bool_()), pa.array(out[7], pa.binary()), pa.array(out[8], pa.int64())], names=["bucket", "id", "th", "lo", "offset", "lead", "times", "hot", "x", "gram"])

    meet = cut(meet)
    free(spark)
    key = F.xxhash64("id", "th")
    met = meet.withColumnsRenamed({"id": "mid", "th": "mth"})
    texts = marked(rows, key, key_bits(meet, key)).join(met.hint("merge"), F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth"))).select("id", "th", "t", "s").mapInArrow(reach_bytes, f"bucket int, id {kind}, th long, lo long, offset int, lead long, times long, hot boolean, x binary, gram long")

    placed = cut(texts)
    free(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("powers")
        for g in _runs(batches, "gram", SORTED):
            if g.num_rows < 2:
                continue
            x, offset = g.column("x").to_pylist(), g.column("offset").to_numpy()
            words = np.frombuffer(b"".join(s[o : o + GRAM] for s, o in zip(x, offset.tolist())), ">u8").reshape(len(x), GRAM // 8)
            order = multikey_quicksort(words.astype(np.uint64))
            ranked = words[order]
            run = np.concatenate([[0], np.cumsum((ranked[1:] != ranked[:-1]).any(1))])
            row, begin, stop = _repeats([x[i] for i in order], offset[order], run, g.column("times").to_numpy()[order], length)
            at = pa.array(order[row])
            lo = g.column("lo").take(at).to_numpy()
            if len(row):
                yield pa.RecordBatch.from_arrays([g.column("id").take(at).combine_chunks(), g.column("th").take(at).combine_chunks(), pa.array(lo + begin), pa.array(lo + stop)], names=["id", "th", "lo", "stop"])

    span = f"id {kind}, th long, lo long, stop long"
    cool = placed.where("not hot").select("bucket", "lead", "gram", "id", "lo", "offset", "th", "times", "x")
    cool = cool.repartitionById(len(gram_cuts[0]) + 1, F.col("bucket")).sortWithinPartitions("bucket", "lead", "gram")
    found = cool.mapInArrow(compare, span)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x", 200_000, keep="powers"):
            for i, th, lo, offset, x, times in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "th", "lo", "offset", "x", "times"))):
                sums = _sums(np.frombuffer(x, np.uint8))
                s = np.arange(len(x) - length + 1)
                h = mix(_hash(sums, s, s + length) + (offset - s).astype(np.uint64)).view(np.int64)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, b.column(b.schema.get_field_index("id")).type), pa.array(np.full(n, th)), pa.array(lo + s), pa.array(h), pa.array(np.full(n, times))], names=["id", "th", "lo", "h", "times"])

    hot = placed.where("hot").select("id", "th", "lo", "offset", "x", "times").mapInArrow(windows, f"id {kind}, th long, lo long, h long, times long")
    twice = hot.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    melted = hot.where("times = 1").join(twice, "h", "left_semi").select("id", "th", "lo", (F.col("lo") + length).alias("stop"))
    every = settled.unionByName(found).unionByName(melted)
    every = every.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "stop"))).alias("s"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for each in b.column(2).to_pylist():
                merged: list[dict] = []
                for s in each:
                    if merged and s["lo"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(s)
                lists.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.struct([("lo", pa.int64()), ("stop", pa.int64())])))], names=["id", "th", "spans"])

    spans = cut(every.mapInArrow(union, f"id {kind}, th long, spans array<struct<lo: long, stop: long>>"))
    delete_path(spark, store)
    return spans


def _sample(named: DataFrame, rows: int = 50_000) -> np.ndarray:
    """Leading bytes, reach and first bytes' hash of about so many suffixes, chosen by a hash: what splitters are made of."""
    n = named.count()
    at = F.pmod(F.xxhash64("id", "th", "lo", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    got = named.where(at < min(1.0, rows / max(n, 1))).select("lead", "reach", "gram").toArrow()
    return np.array([tuple(x) for x in zip(*(got.column(c).to_numpy() for c in ("lead", "reach", "gram")))], [("lead", "<i8"), ("reach", "<i8"), ("gram", "<i8")])


def _splitters(sample: np.ndarray, second: str, parts: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Quantiles of (leading bytes, second key), and second keys that are two of them or more, which are left out."""
    if not len(sample) or parts < 2:
        none = np.zeros(0, np.int64)
        return (none, none), none
    held = np.sort(sample[["lead", second]], order=["lead", second])
    picked = held[[len(held) * i // parts for i in range(1, parts)]]
    each, count = np.unique(picked, return_counts=True)
    whole = np.unique(held, return_counts=True)
    often = each[second][(count > 1) & (whole[1][np.searchsorted(whole[0], each)] > 1)]
    return (each["lead"], each[second]), often


def _buckets(cuts: tuple[np.ndarray, np.ndarray], lead: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many splitters are at or below each (leading bytes, second key)."""
    out = np.searchsorted(cuts[0], lead, "left")
    last = np.searchsorted(cuts[0], lead, "right")
    for i in np.unique(out[last > out]).tolist():
        at = np.flatnonzero((out == i) & (last > i))
        j = int(last[at[0]])
        out[at] = i + np.searchsorted(cuts[1][i:j], second[at], "right")
    return out.astype(np.int32)


def _repeats(x: list[bytes], offset: np.ndarray, run: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of reaches in runs: the maximal stretches of windows that another one of the run has too, for those that stand once."""
    rows, begins, stops = [], [], []
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    block: list[int] = []

    def flush() -> None:
        if not block:
            return
        sums = _sums(np.frombuffer(b"".join(x[i] for i in block), np.uint8))
        size = np.array([len(x[i]) for i in block])
        base = np.cumsum(size) - size
        n = size - length + 1
        row = np.repeat(np.arange(len(block)), n)
        s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = base[row] + s
        h = mix(_hash(sums, start, start + length) + (offset[block][row] - s).astype(np.uint64))
        order = np.argsort(h, kind="stable")
        k = h[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= times[block][row] == 1
        step = np.diff(np.concatenate([[0], twice.astype(np.int8), [0]]))
        edge = np.concatenate([[True], row[1:] != row[:-1]])
        begin = np.flatnonzero(twice & (edge | (step[:-1] == 1)))
        last = np.concatenate([edge[1:], [True]])
        end = np.flatnonzero(twice & (last | (step[1:] == -1)))
        rows.append(np.array(block)[row[begin]])
        begins.append(s[begin])
        stops.append(s[end] + length)
        block.clear()

    held = 0
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo > 1:
            block.extend(range(lo, hi))
            held += sum(len(x[i]) for i in range(lo, hi))
            if held > 500_000:
                flush()
                held = 0
    flush()
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) if c else none for c in (rows, begins, stops))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of docs, and ``(n_bytes, n_removed, n_spans, kept)``; kept holds the remaining bytes,
    or with as_text what of them is whole characters, as a string.

    Every byte covered by a string of ``length`` bytes that also starts
    elsewhere, in the same text or another, is removed; strings are judged on
    the input. A null text is the empty one; shorter texts stay whole; equal
    rows repeat each other. Columns of docs that are named like a new one give way.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    spans = repeated_spans(docs, length, id_col, text_col)
    free(docs.sparkSession)
    columns = docs.columns
    own = docs.withColumn("_docmill_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.xxhash64(F.col(id_col), F.col("_docmill_own"))
    bits = key_bits(spans, F.xxhash64("id", "th"))  # texts that have no spans need not move
    found = spans.withColumnsRenamed({"id": "_docmill_id", "th": "_docmill_th", "spans": "_docmill_spans"})
    moved = marked(own, key, bits).join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col("_docmill_id")) & (F.col("_docmill_own") == F.col("_docmill_th")), "left")

    def strip(batches: Iterator[pa.RecordBatch], spans: bool = True) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 750_000, keep="powers"):
            if not spans:
                b = b.filter(pa.array(~hits(bits, b.column(len(columns)))))
            kept, removed, n_spans, sizes = [], [], [], []
            texts = pc.cast(pc.fill_null(b.column(columns.index(text_col)), ""), pa.binary())
            for t, each in zip(texts, b.column(len(columns)).to_pylist() if spans else [None] * b.num_rows):
                t, out, at, gone, n = t.as_py(), [], 0, 0, len(each or ())
                for s in each or ():
                    out.append(t[at : s["lo"]])
                    gone += s["stop"] - s["lo"]
                    at = s["stop"]
                out.append(t[at:])
                kept.append(b"".join(out).decode("utf-8", "ignore") if as_text else b"".join(out))
                removed.append(gone)
                n_spans.append(n)
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    # One Python function in a stage at most (the hints keep a shuffle between two): each has a worker of its own, which stays with what later stages load into it.
    stay = own.select(*columns, key.alias("_docmill_hashed")).mapInArrow(lambda batches: strip(batches, spans=False), schema)
    return moved.select(*columns, "_docmill_spans").mapInArrow(strip, schema).unionByName(stay)
