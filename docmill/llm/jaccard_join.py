"""Exact join of documents by the Jaccard similarity of their word n-gram sets, with a prefix tree.

Sets are sorted by one global order, rare n-grams first, and those with
similarity s or more share one of their leading n - ceil(s n) + 1 n-grams
(their prefixes). A document whose prefix holds only n-grams of its own links
with nothing, and so does most of a corpus; only the others' sets move.

1. Documents with equal sets are one class.
2. Of every class the n-grams with the smallest hashes are counted, a share a
   little above 1 - s. A class is suspect if fewer of them than its prefix is
   long are its own (also where so few were counted, as of short sets); all other
   classes are settled: in an order that begins with those n-grams, their prefixes
   are their own.
3. All n-grams of suspects are counted among suspects. This gives their order
   (number of suspects, then hash) and their prefixes, and the n-grams that
   several prefixes share: posting lists.
4. Suspects meet in the buckets of their two longest lists. A bucket's sets are
   stored in a path-compressed trie; every set walks down it, sharing the overlap
   counted so far, and leaves a subtree as soon as what remains of either set is
   too little, or as no set below can do by a bound from bitmaps or is unconnected
   yet. The links give preliminary components.
5. What lists hold of different components is compared too. Lists of up to SHORT
   suspects give pairs, counted and left out where the count rules out a link;
   longer ones give pairs of blocks of suspects, never pairs. Either way the
   blocks' sets are stored in tries and walked as before, so no link that matters
   to the components is lost, and none within a component is looked for again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.common import cut, free, groups, key_bits, marked, slices
from docmill.llm.components import components
from docmill.llm.shingles import ngram_sets, signature

#: N-grams that a task gathers before it deals them out.
ENTRIES = 400_000
#: Suspects of one task's gathering from which on an n-gram ranks as very frequent, and its rank then.
OFTEN, VERY = 64, (1 << 31) - 1
#: Lists by which suspects meet at first, and suspects of such a bucket that are compared at once.
FIRST, BUCKET = 2, 256
#: A longer list of several components gives pairs of blocks, a list up to this gives pairs: fewer than so many for each of its suspects.
SHORT = 16
#: Suspects of a block.
BLOCK = 512


def need(a, b, percent: int):
    """The least overlap of sets of sizes a and b whose similarity is percent / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    """How many leading n-grams a set of n > 0 is indexed by."""
    return n - (-(-percent * n // 100)) + 1


class _Node:
    __slots__ = ("children", "depth", "first", "hi", "least", "lo", "most")

    def __init__(self, first, lo, hi, depth):
        self.first, self.lo, self.hi, self.depth = first, lo, hi, depth
        self.children = []


def _trie(sets: list[np.ndarray]) -> _Node:
    """The path-compressed trie of sorted sets; a node has the sets lo to hi - 1 and the path to depth."""
    n = len(sets)
    common = [0] * n
    for i in range(1, n):
        a, b = sets[i - 1], sets[i]
        m = min(len(a), len(b))
        diff = a[:m] != b[:m]
        k = int(diff.argmax()) if m else 0
        common[i] = k if m and diff[k] else m

    def build(lo: int, hi: int, depth: int) -> _Node:
        top = _Node(lo, lo, hi, depth)
        todo = [top]
        while todo:
            node = todo.pop()
            sizes = [len(sets[i]) for i in range(node.lo, node.hi)]
            node.least, node.most = min(sizes), max(sizes)
            if node.hi - node.lo == 1:
                node.depth = len(sets[node.lo])
                continue
            node.depth = min(common[node.lo + 1 : node.hi])
            cuts = [node.lo, *(i for i in range(node.lo + 1, node.hi) if common[i] == node.depth), node.hi]
            node.children = [_Node(a, a, b, 0) for a, b in zip(cuts, cuts[1:])]
            todo += node.children
        return top

    return build(0, n, 0)


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set, of every residue whether an odd number of its n-grams has it: two sets differ in at least as many n-grams as bitmaps in bits."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, x in enumerate(sets):
        odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(bool)).view(np.uint64)
    return out


def trie_links(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected by similarity: (id, id) pairs, at most one less than the sets.

    sets are sorted; empty ones link with nothing. Those with equal ``known``
    are connected already. Of side 0 are sets in the trie only, of side 1 those
    that only walk; all others (without side: all) do both.
    """
    order = sorted((i for i in range(len(ids)) if len(sets[i])), key=lambda i: (sets[i].astype(">u8").tobytes(), ids[i]))
    known = [known[i] for i in order] if known is not None else list(range(len(order)))
    side = [side[i] for i in order] if side is not None else [2] * len(order)
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    stored = np.array([i for i, s in enumerate(side) if s != 1], np.int64)
    if len(ids) < 2 or not len(stored):
        return []
    root, out = np.unique(np.array(known), return_inverse=True)[1], []  # of each set, the component
    sizes = np.array([len(s) for s in sets])
    bits = 1 << min(16, max(9, int(sizes.max() * 2 - 1).bit_length()))
    maps, n_stored, trie = _bitmaps(sets, bits), sizes[stored], None
    for i, x in enumerate(sets):
        if side[i] == 0:
            continue
        nx = len(x)
        apart = np.bitwise_count(maps[stored] ^ maps[i]).sum(1, dtype=np.int64)
        able = (nx + n_stored - apart) // 2 >= need(nx, n_stored, percent)
        open_ = able & (root[stored] != root[i])
        if not open_.any():
            continue
        trie = trie or _trie([sets[j] for j in stored.tolist()])
        before = np.concatenate([[0], np.cumsum(open_)])
        todo = [(trie, 0, 0, 0)]  # node, its parent's depth, overlap and place in x so far
        while todo:
            node, depth, overlap, at = todo.pop()
            if before[node.hi] == before[node.lo]:
                continue
            if node.depth > depth:
                run = sets[stored[node.first]][depth : node.depth]
                places = np.searchsorted(x[at:], run)
                inside = places < nx - at
                overlap += int(np.count_nonzero(x[at:][places[inside]] == run[inside]))
                at += int(np.searchsorted(x[at:], run[-1], side="right"))
            left = nx - at
            size = min(max(node.depth + left, node.least), node.most)  # of sets below, the size most likely to do
            if overlap + min(left, size - node.depth) < need(nx, size, percent):
                continue
            if node.children:
                todo += [(c, node.depth, overlap, at) for c in node.children]
                continue
            for k in range(node.lo, node.hi):
                j = int(stored[k])
                if root[j] != root[i] and overlap >= need(nx, len(sets[j]), percent):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
                    before = np.concatenate([[0], np.cumsum(able & (root[stored] != root[i]))])
    return out


def _hashed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches whose second column is the text, few bytes at a time, with the texts' sets."""
    for b in slices(batches, "t", 750_000):
        yield b, ngram_sets(pc.cast(pc.fill_null(b.column(1), ""), pa.binary()).to_pylist(), n)


def _limit(percent: int) -> np.uint64 | None:
    """The hash below which a set's n-grams are counted first; None: all."""
    share = (100 - percent) / 60
    return np.uint64(int(share * 2**64)) if share < 1 else None


def _sorted_pairs(grams: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (n-gram, key) pairs in order, where each n-gram begins, and of each pair how many keys its n-gram has."""
    o = np.lexsort((keys, grams))
    g, k = grams[o], keys[o]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    new = head.copy()
    new[1:] |= k[1:] != k[:-1]
    g, k, head = g[new], k[new], head[new]
    run = np.cumsum(head) - 1
    return g, k, head, np.bincount(run)[run] if len(run) else run


def _dealt(places: int, names: list[str], *columns: tuple[np.ndarray, list[np.ndarray]]) -> pa.RecordBatch:
    """Arrays dealt to places, each with the places of its entries: one row for each place, with what it gets as bytes."""
    out = []
    for place, arrays in columns:
        order, ends = np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=places)).tolist()
        for values in arrays:
            values = values[order]
            out.append([values[a:b].tobytes() for a, b in zip([0, *ends], ends)])
    some = [i for i, row in enumerate(zip(*out)) if any(row)]
    return pa.record_batch([pa.array(some, pa.int32()), *(pa.array([c[i] for i in some], pa.binary()) for c in out)], names)


def _deal(sets: Iterator[tuple[int, np.ndarray]], ranges: int, often: int, counts: bool, entries: int) -> Iterator[pa.RecordBatch]:
    """Deals (class, n-grams) by n-gram to ranges: rows of many entries each.

    An n-gram of ``often`` or more classes of one gathering is told to its range
    once, and those classes' entries are settled here (``told``, with their
    n-grams, or with how many of them): so no n-gram's entries pile up in a task.
    """

    def flush() -> pa.RecordBatch:
        g, k, head, m = _sorted_pairs(np.concatenate([x for _, x in held]), np.repeat(np.array([i for i, _ in held], np.int64), [len(x) for _, x in held]))
        hot = m >= often
        told, what = k[hot], g[hot]
        if counts:
            told, n = np.unique(told, return_counts=True)
            at, what = np.full(len(told), int(g[0] % np.uint64(ranges))), n.astype(np.uint64)
        else:
            at = (what % np.uint64(ranges)).astype(np.int64)
        single, several = ((g[x] % np.uint64(ranges)).astype(np.int64) for x in (~hot, hot & head))
        return _dealt(ranges, ["range", "keys", "grams", "hot", "told", "what"], (single, [k[~hot], g[~hot]]), (several, [g[hot & head]]), (at, [told, what]))

    held, size = [], 0
    for key, grams in sets:
        for lo in range(0, len(grams), entries):
            held.append((key, grams[lo : lo + entries]))
            size += len(held[-1][1])
            if size >= entries:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


_DEALT = "range int, keys binary, grams binary, hot binary, told binary, what binary"


def _count(batches: Iterator[pa.RecordBatch], counts: bool, places: int) -> Iterator[pa.RecordBatch]:
    """Of each range that _deal dealt: for each class its n-grams that others have too, with their ranks, or how many they are, dealt by class to places."""
    for tb in groups(batches, 1):
        k, g, hot, told, what = (np.frombuffer(b"".join(tb.column(i).to_pylist()), t) for i, t in ((1, np.int64), (2, np.uint64), (3, np.uint64), (4, np.int64), (5, np.uint64)))
        g, k, _, m = _sorted_pairs(g, k)
        rank = np.where(np.isin(g, hot), VERY, np.minimum(m, VERY - 1)).astype(np.int32)
        shared = rank > 1
        if counts:
            keys, c = np.unique(k[shared], return_counts=True)
            keys, c = np.concatenate([keys, told]), np.concatenate([c, what.astype(np.int64)])
            yield _dealt(places, ["place", "keys", "counts"], (keys % places, [keys, c]))
        else:
            keys = np.concatenate([k[shared], told])
            yield _dealt(places, ["place", "keys", "grams", "ranks"], (keys % places, [keys, np.concatenate([g[shared], what]), np.concatenate([rank[shared], np.full(len(told), VERY, np.int32)])]))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each place: the sums of its classes' counts."""
    for tb in groups(batches, 1):
        keys, at = np.unique(np.frombuffer(b"".join(tb.column(1).to_pylist()), np.int64), return_inverse=True)
        c = np.zeros(len(keys), np.int64)
        np.add.at(c, at, np.frombuffer(b"".join(tb.column(2).to_pylist()), np.int64))
        for lo in range(0, len(keys), 50_000):
            yield pa.record_batch([pa.array(keys[lo : lo + 50_000]), pa.array(c[lo : lo + 50_000])], ["k", "c"])


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each place: the shared n-grams of its classes' prefixes, with the class's size and its prefix's end in the global order."""
    for tb in groups(batches, 1):
        class_, size = (np.array([x for x in tb.column(i).to_pylist() if x is not None], np.int64) for i in (1, 2))
        k, g, rank = (np.frombuffer(b"".join(x for x in tb.column(i).to_pylist() if x), t) for i, t in ((3, np.int64), (4, np.uint64), (5, np.int32)))
        if not len(k):
            continue
        o = np.lexsort((g, rank, k))
        k, g, rank = k[o], g[o], rank[o]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        o = np.argsort(class_)
        n = size[o][np.searchsorted(class_[o], k[first])]
        taken = np.clip(prefix_length(n, percent) - (n - count), 0, count)  # those that are the class's own come first
        first, taken, n = first[taken > 0], taken[taken > 0], n[taken > 0]
        ends = np.cumsum(taken)
        at = np.repeat(first - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)
        last = np.repeat(first + taken - 1, taken)
        signed = (g ^ np.uint64(1 << 63)).view(np.int64)  # in the order of unsigned numbers
        columns = [k[at], signed[at], np.repeat(n, taken), rank[last].astype(np.int64), signed[last]]
        for lo in range(0, len(at), 50_000):
            yield pa.record_batch([pa.array(c[lo : lo + 50_000]) for c in columns], ["k", "gram", "n", "end_rank", "end_gram"])


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)``, one row for each row of docs.

    A null or wordless text has an empty set and is alone; a text with fewer
    words than n has one n-gram, all its words. A row without an id is a document
    of its own that links as others do; where no id is reachable its component is
    null. Rows with one id are one document: the links of all its texts connect
    it (an empty set stays alone). Repeated rows and an empty table are fine; other columns are
    not read. Texts are read whole, three times, and those of suspects move.
    Sets and classes are told apart by 64-bit and 128-bit hashes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col).isNull(), id_col, text_col).alias("row"))  # a hash alone skips nulls: an id without text would be a text without id
    limit, id_type = _limit(percent), docs.schema[id_col].dataType.simpleString()

    def below(s: np.ndarray) -> np.ndarray:
        return s if limit is None else s[: np.searchsorted(s, limit)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _hashed(batches, n):
            out = [(*signature(s), len(s), len(below(s))) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in zip(*out))], names=["id", "row", "k", "s2", "n", "low"])

    coded = cut(rows.mapInArrow(code, f"id {id_type}, row long, k long, s2 long, n long, low long"))
    classes = cut(coded.where("n > 0").groupBy("k", "s2", "n").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("low").alias("low")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _deal(((signature(s)[0], below(s)) for _, sets in _hashed(batches, n) for s in sets if len(s)), 4 * parts, 2, True, ENTRIES)

    dealt = rows.mapInArrow(first, _DEALT).repartition(parts, "range").sortWithinPartitions("range")
    common = dealt.mapInArrow(lambda batches: _count(batches, True, parts), "place int, keys binary, counts binary")
    common = common.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(_sum, "k long, c long")
    own = F.col("low") - F.coalesce("c", F.lit(0))  # a class of which nothing counted is common may still have too few of its own: short sets
    suspects = classes.join(common, "k", "left").where(own < F.expr(f"n - ceil({percent} * n / 100) + 1")).select("k", "n", "row")
    suspects = cut(suspects)
    free(spark)

    # One row stands for each suspect class, known by the hash of its id and text.
    texts = marked(rows, F.col("row"), key_bits(suspects, F.col("row"))).join(suspects.select("k", "row"), "row").dropDuplicates(["row", "k"]).select("k", "t")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _hashed(batches, n):
            mine = [i for i, (k, s) in enumerate(zip(b.column(0).to_pylist(), sets)) if signature(s)[0] == k]  # another row may have that hash
            yield pa.record_batch([b.column(0).take(pa.array(mine, pa.int64())), pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["k", "grams"])

    sets = cut(texts.mapInArrow(whole, "k long, grams binary"))
    free(spark)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((k, np.frombuffer(x, np.uint64)) for b in batches for i in range(b.num_rows) for k, x in [(b.column(0)[i].as_py(), b.column(1)[i].as_py())])
        yield from _deal(pairs, parts, OFTEN, False, ENTRIES)

    dealt = sets.mapInArrow(again, _DEALT).repartition(parts, "range").sortWithinPartitions("range")
    told = dealt.mapInArrow(lambda batches: _count(batches, False, parts), "place int, keys binary, grams binary, ranks binary")
    sizes = suspects.select(F.pmod("k", F.lit(parts)).cast("int").alias("place"), "k", "n", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "grams", "ranks")])
    told = told.select("place", *[F.lit(None).cast("long").alias(c) for c in ("k", "n")], "keys", "grams", "ranks").unionByName(sizes)
    told = told.repartition(parts, "place").sortWithinPartitions("place")
    posts = cut(told.mapInArrow(lambda batches: _prefixes(batches, percent), "k long, gram long, n long, end_rank long, end_gram long"))
    free(spark)
    shared = cut(posts.groupBy("gram").agg(F.count("*").alias("c"), F.min("k").alias("lead")).where("c > 1"))  # as a table, so that the join's hot grams are split
    entries = cut(posts.join(shared, "gram"))
    free(spark)

    def linked(members: DataFrame) -> DataFrame:
        """Links ``(a, b)`` within each bucket of members ``(bucket, part, side, k, comp)``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, 2):
                if g.num_rows > 1:
                    side, k, comp, grams = (g.column(i).to_pylist() for i in range(2, 6))
                    found = trie_links(k, [np.frombuffer(x, np.uint64) for x in grams], percent, comp, side)
                    yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        rows = members.join(sets, "k").select("bucket", "part", "side", "k", "comp", "grams")
        return rows.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", "k").mapInArrow(run, "a long, b long")

    longest = Window.partitionBy("k").orderBy(F.desc("c"), "gram")
    leading = entries.withColumn("at", F.row_number().over(longest)).where(F.col("at") <= FIRST).select("k", "gram", "lead", F.ceil(F.col("c") / BUCKET).cast("long").alias("parts"))
    shares = leading.select("k", F.col("gram").alias("bucket"), F.pmod(F.xxhash64("k"), F.col("parts")).alias("part"))
    heads = leading.where("parts > 1").select("gram", "lead", "parts").distinct()
    heads = heads.select(F.col("lead").alias("k"), F.col("gram").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    shares = shares.unionByName(heads).distinct().withColumns({"side": F.lit(2), "comp": F.col("k")})
    links = cut(linked(shares))
    comp = cut(components(links))
    free(spark)

    known = entries.join(comp.withColumnRenamed("id", "cid"), F.col("k") == F.col("cid"), "left").select("gram", "k", "n", "c", "end_rank", "end_gram", F.coalesce("component", "k").alias("comp"))
    held = known.groupBy("gram").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("gram")
    known = cut(known.join(cut(held), "gram", "left_semi"))
    free(spark)

    short = known.where(F.col("c") <= SHORT).drop("c")
    u, v = (short.select("gram", *[F.col(c).alias(c + side) for c in ("k", "n", "comp", "end_rank", "end_gram")]) for side in ("_u", "_v"))
    met = u.join(v, "gram").where("comp_u <> comp_v and k_u < k_v").where(F.col("n_u") * 100 >= F.col("n_v") * percent).where(F.col("n_v") * 100 >= F.col("n_u") * percent)
    met = met.groupBy("k_u", "k_v", "n_u", "n_v", F.struct("end_rank_u", "end_gram_u").alias("end_u"), F.struct("end_rank_v", "end_gram_v").alias("end_v")).agg(F.count("*").alias("c"))
    # Before the sooner of the two prefix ends, all common n-grams are counted (or in a longer list), and behind it are at most ceil(s n) - 1.
    behind = F.ceil(F.lit(percent) * F.when(F.col("end_u") <= F.col("end_v"), F.col("n_u")).otherwise(F.col("n_v")) / 100) - 1
    maybe = met.where(behind + F.col("c") >= F.ceil(F.lit(percent) * (F.col("n_u") + F.col("n_v")) / (100 + percent))).select("k_u", "k_v")

    # Blocks: suspects of one longest list and about one size.
    band = F.floor(F.ln(F.col("n").cast("double")) / float(-np.log(percent / 100) * (1 + 1e-9))) if percent < 100 else F.col("n")
    near = known.groupBy("k").agg(F.max(F.struct("c", "gram")).alias("top"), F.first("comp").alias("comp"), F.first("n").alias("n"))
    near = cut(near.select("k", "comp", F.col("top.gram").alias("top"), band.cast("long").alias("band")))
    blocks = near.groupBy("top", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    near = near.join(blocks, ["top", "band"]).select("k", "comp", "band", F.xxhash64("top", "band", F.pmod(F.xxhash64("k"), F.col("blocks"))).alias("block"))
    near = cut(near)
    lists = cut(known.where(F.col("c") > SHORT).select("gram", "k").join(near, "k").groupBy("gram", "band", "block").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")))
    x, y = (lists.select("gram", *[F.col(c).alias(c + side) for c in ("band", "block", "c1", "c2")]) for side in ("_x", "_y"))
    met = x.join(y, "gram").where("block_x <= block_y and abs(band_x - band_y) <= 1 and not (c1_x = c2_x and c1_y = c2_y and c1_x = c1_y)").select("block_x", "block_y")
    at = near.select("k", "block")
    pairs = maybe.join(at.toDF("k_u", "b_u"), "k_u").join(at.toDF("k_v", "b_v"), "k_v").select(F.least("b_u", "b_v").alias("block_x"), F.greatest("b_u", "b_v").alias("block_y"))
    pairs = cut(met.unionByName(pairs).distinct())
    one = pairs.select(F.xxhash64("block_x", "block_y").alias("bucket"), F.col("block_x").alias("block"), F.when(F.col("block_x") == F.col("block_y"), 2).otherwise(0).alias("side"))
    other = pairs.where("block_x <> block_y").select(F.xxhash64("block_x", "block_y").alias("bucket"), F.col("block_y").alias("block"), F.lit(1).alias("side"))
    around = one.unionByName(other).join(near, "block").select("bucket", F.lit(0).cast("long").alias("part"), "side", "k", "comp")
    more = cut(linked(around))
    free(spark)

    # An id with several sets connects their classes.
    named = coded.where("n > 0 and id is not null").select("id", "k")
    several = named.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("id", "a")
    meet = several.join(named.distinct(), "id").select("a", F.col("k").alias("b"))
    comp = cut(components(links.unionByName(more).unionByName(meet)))
    reached = comp.withColumnRenamed("id", "cid").join(classes.select("k", "id"), F.col("cid") == F.col("k"))
    least = reached.groupBy("component").agg(F.min("id").alias("component_id"))
    reached = comp.join(least, "component").select(F.col("id").alias("cid"), "component_id")
    by_class = classes.join(reached, F.col("k") == F.col("cid"), "left").select("k", "s2", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = coded.select("id", "k", "s2", "n").join(by_class, ["k", "s2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
