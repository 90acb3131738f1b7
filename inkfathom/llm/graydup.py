"""Near-duplicate records with small edits: a Gray-order hierarchical index over min-hash fingerprints.

Each class of records (see :mod:`shingles`) gets a fingerprint of 128 two-bit min-hashes. Two sets with similarity J
differ in one with probability 3 (1 - J) / 4, so the number of differences of pairs at the threshold concentrates
around 96 (1 - J); ``max_distance`` leaves 4.5 standard deviations. Unrelated sets differ in 96 of 128: 4.7 deviations
beyond the bound at 0.5 (one-bit min-hashes: 1.6), so hardly any unrelated pair is left to be verified.

The index is distributed by its upper nodes: the patterns of ``BANDS`` bands of ``ROWS`` min-hashes each. A pair at
J = 0.5 shares none of 32 two-row patterns with probability 0.75^32 = 1e-4, a pair at 0.7 with 4e-10. Below an upper
node the fingerprints are sorted by Gray rank, so that neighbours differ in few bits; runs of neighbours become leaves,
whose common bits (a mask and its pattern) are factored into the node above, and so on up. A search walks pairs of
nodes and drops a whole pair of groups as soon as the differences of their masked patterns exceed the bound. What is
left is verified exactly on the shingle sets. An upper node with no more classes than a leaf holds is a single leaf.

Sets are several times as large as the texts, so no set is stored: one pass over the texts keeps what the index needs of
them, and the sets of the few classes that are left to verify are made again. The bands are searched ``PASS`` at a time.

An upper node with more than ``TILE`` classes is cut into blocks; each pair of blocks is a task of its own, so that no
group is collected whole, and no record is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfathom.llm import shingles
from inkfathom.session import counted_broadcast, cut_lineage, release

BITS, PLANES, BANDS, ROWS, PASS, LEAF, FAN, TILE = 128, 2, 32, 2, 8, 16, 8, 4096
WORDS = PLANES * BITS // 64


def max_distance(least: float, bits: int = BITS, planes: int = PLANES) -> int:
    p = (1 - least) * (1 - 0.5**planes)
    return int(np.ceil(bits * p + 4.5 * np.sqrt(bits * p * (1 - p))))


def _multipliers(n: int) -> np.ndarray:
    """Fixed odd multipliers from the 64-bit golden-ratio sequence, mixed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x | np.uint64(1)


def min_hashes(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) min-hashes of the sets that lie one after the other in ``flat``; no set is empty."""
    out = np.empty((len(starts), n), np.uint64)
    for j, m in enumerate(_multipliers(n)):
        h = flat * m
        h ^= h >> np.uint64(29)
        out[:, j] = np.minimum.reduceat(h, starts)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Rank of each fingerprint (rows of 64-bit words, most significant first) in the order of the reflected Gray code."""
    out = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    carry = np.zeros(len(out), np.uint64)
    for w in range(out.shape[1]):  # a word is flipped if the bits before it have odd parity
        out[:, w] ^= np.where(carry == 1, ~np.uint64(0), np.uint64(0))
        carry = out[:, w] & np.uint64(1)
    return out


def differences(apart: np.ndarray, planes: int) -> np.ndarray:
    """Number of min-hashes that differ, from the words that show the bits that do; planes lie one after the other."""
    width = apart.shape[1] // planes
    return np.bitwise_count(np.bitwise_or.reduce(apart.reshape(len(apart), planes, width), axis=1)).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Hierarchical index over fingerprints (rows of 64-bit words, the planes of their bits one after the other)."""

    def __init__(self, words: np.ndarray, planes: int = 1):
        self.planes = planes
        rank = gray_rank(words)
        self.order = np.lexsort([rank[:, w] for w in reversed(range(rank.shape[1]))])
        self.words = words[self.order]
        # levels[0]: leaves; each level has the first and last bounds of its nodes and the bits common to all below.
        n = len(words)
        starts = np.arange(0, n, LEAF)
        ones, zeros = np.bitwise_and.reduceat(self.words, starts, axis=0), ~np.bitwise_or.reduceat(self.words, starts, axis=0)
        self.levels = [(ones | zeros, ones)]
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts, axis=0), np.bitwise_and.reduceat(zeros, starts, axis=0)
            self.levels.append((ones | zeros, ones))

    def _close(self, level: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether the accumulated differences of two nodes' common bits are within the bound."""
        mask, bits = self.levels[level]
        return differences((bits[a] ^ bits[b]) & mask[a] & mask[b], self.planes) <= most

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (in the order given) of all pairs within ``most`` differences."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            keep = self._close(level, a, b, most)
            a, b = a[keep], b[keep]
            n = len(self.levels[level - 1][0])
            ca, cb = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]), (b[:, None, None] * FAN + np.arange(FAN)[None, None, :])
            ca, cb = np.broadcast_arrays(ca, cb)
            ok = (ca < n) & (cb < n) & (ca <= cb)
            a, b = ca[ok], cb[ok]
        keep = self._close(0, a, b, most)
        out = []
        near_leaves = np.stack([a[keep], b[keep]], 1)
        for part in np.array_split(near_leaves, len(near_leaves) // 4096 + 1):
            x, y = part[:, 0], part[:, 1]
            i, j = np.broadcast_arrays(x[:, None, None] * LEAF + np.arange(LEAF)[None, :, None], y[:, None, None] * LEAF + np.arange(LEAF)[None, None, :])
            ok = (i < j) & (j < len(self.words))
            i, j = i[ok], j[ok]
            near = differences(self.words[i] ^ self.words[j], self.planes) <= most
            out.append(np.stack([i[near], j[near]], 1))
        p = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return self.order[p[:, 0]], self.order[p[:, 1]]


def _records(key: str, key_type, k: int):
    """What the index keeps of each record: its class and size, fingerprint, parity bits and upper nodes."""
    sets = shingles._sets(key, key_type, k)
    shifts = np.arange(63, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets(batches):
            flat, starts = batch.column("sh").flatten().to_numpy(), np.asarray(batch.column("sh").offsets)
            sizes, starts = np.diff(starts), starts[:-1] - starts[0]
            mh = min_hashes(flat.view(np.uint64), starts, BITS)
            out = {key: batch.column(key), "cls": batch.column("cls"), "n": batch.column("n")}
            for p in range(PLANES):
                bits = (mh >> np.uint64(p)) & np.uint64(1)
                for w in range(BITS // 64):
                    out[f"f{p * BITS // 64 + w}"] = pa.array(np.bitwise_or.reduce(bits[:, w * 64 : w * 64 + 64] << shifts, axis=1).view(np.int64))
            parity = shingles.parity_words(np.repeat(np.arange(len(sizes)), sizes), flat, len(sizes))
            out |= {f"b{w}": pa.array(parity[:, w]) for w in range(shingles.PARITY)}
            # The pattern of a band: its min-hashes and its number, mixed into one key.
            bands = np.zeros((len(mh), BANDS), np.uint64)
            for r in range(ROWS):
                bands = (bands ^ mh[:, r * BANDS : (r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
                bands ^= bands >> np.uint64(32)
            bands += np.arange(BANDS, dtype=np.uint64)
            out["nodes"] = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.record_batch(out)

    return run


def _search(most: int):
    """Pairs of each run of equal (node, i, j); runs arrive whole and in order, tiles are at most two blocks."""

    def leaf_pairs(sizes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Runs that fit into one leaf, all runs of the batch at once."""
        small = sizes <= LEAF
        left = np.repeat(np.where(small, starts + sizes, starts), sizes)
        row = np.arange(len(left))
        out = []
        for d in range(1, int(sizes[small].max(initial=1))):
            i = row[row + d < left]
            out.append((i, i + d))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        batches = iter(batches)
        done = False
        while not done:
            got = next(batches, None)
            done = got is None
            table = pa.Table.from_batches([x for x in (held, got) if x is not None and x.num_rows]) if held is not None or got is not None else None
            if table is None or not table.num_rows:
                held = None
                continue
            t = {c: table[c].to_numpy() for c in table.column_names}
            change = np.flatnonzero((t["node"][1:] != t["node"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])) + 1
            starts = np.concatenate([[0], change])
            if not done:  # the last run may go on in the next batch
                held = table.slice(int(starts[-1])).combine_chunks().to_batches()[0]
                n = int(starts[-1])
                starts = starts[:-1]
                if not n:
                    continue
            else:
                n = table.num_rows
            sizes = np.diff(np.concatenate([starts, [n]]))
            words = np.stack([t[f"f{w}"][:n].view(np.uint64) for w in range(WORDS)], 1)
            pairs = []
            for i, j in leaf_pairs(sizes, starts):
                near = differences(words[i] ^ words[j], PLANES) <= most
                pairs.append((i[near], j[near]))
            for k in np.flatnonzero(sizes > LEAF):
                lo, hi = starts[k], starts[k] + sizes[k]
                i, j = GrayIndex(words[lo:hi], PLANES).pairs(most)
                i, j = i + lo, j + lo
                if t["i"][lo] != t["j"][lo]:  # two blocks: pairs within one of them belong to another tile
                    other = t["block"][i] != t["block"][j]
                    i, j = i[other], j[other]
                pairs.append((i, j))
            if pairs:
                a, b = (np.concatenate([t["cls"][p[s]] for p in pairs]) for s in (0, 1))
                yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _band_pairs(classes: DataFrame, bands: range, least: float) -> DataFrame:
    """(a, b): candidates that share an upper node in one of the bands, each once."""
    words = [f"f{w}" for w in range(WORDS)]
    rows = classes.select(F.explode(F.slice("nodes", bands.start + 1, len(bands))).alias("node"), "cls", *words)
    # Upper nodes beyond a tile, at most rows / TILE of them, become block x block tasks; all others keep one tile.
    heavy = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    if heavy.isEmpty():
        placed = rows.select("node", "cls", *words, F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        shared = rows.join(counted_broadcast(heavy, 24), "node", "left")
        blocks = F.ceil(F.col("n") / (TILE / 2)).cast("int")
        block = F.coalesce(F.pmod(F.xxhash64("cls"), blocks), F.lit(0)).cast("int")
        tiles = F.coalesce(F.sequence(F.lit(0), blocks - 1), F.array(F.lit(0)))
        placed = shared.withColumn("block", block).withColumn("other", F.explode(tiles))
        placed = placed.select("node", "cls", *words, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = placed.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return parts.mapInArrow(_search(max_distance(least)), "a bigint, b bigint").where("a <> b").distinct()


def near_classes(df: DataFrame, key: str, column: str, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs), both cut from their lineage. members: (key, cls), one row per key; of several rows with one key the
    smallest class counts. pairs: (a, b, o) of classes with similarity of at least ``least``; o is the number of shared
    shingles. Records with a null key or text, or with fewer than k words, have no class.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    longs = [*(f"f{w}" for w in range(WORDS)), *(f"b{w}" for w in range(shingles.PARITY))]
    schema = T.StructType([T.StructField(key, kind), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("nodes", T.ArrayType(T.LongType()))])
    texts = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, F.col(column).alias("text"))
    records = cut_lineage(texts.mapInArrow(_records(key, kind, k), schema))
    members = cut_lineage(records.groupBy(key).agg(F.min("cls").alias("cls")))
    classes = cut_lineage(records.drop(key).dropDuplicates(["cls"]))
    del records
    release(spark)
    found = None
    for at in range(0, BANDS, PASS):
        part = cut_lineage(_band_pairs(classes, range(at, at + PASS), least))
        found = part if found is None else found.unionAll(part)
        release(spark)
    near = cut_lineage(shingles.plausible_pairs(found, classes.drop("nodes"), least))
    del classes, found, part
    release(spark)
    needed = near.select(F.col("a").alias("cls")).unionAll(near.select(F.col("b").alias("cls"))).distinct()
    chosen = cut_lineage(members.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min(key).alias(key)).select(key))
    sets = cut_lineage(shingles.sets_of(df, counted_broadcast(chosen, 64), key, column, k))
    return members, cut_lineage(shingles.verified_pairs(near, sets, least))


def near_duplicate_pairs(df: DataFrame, key: str = "id", column: str = "text", k: int = 3, least: float = 0.5) -> DataFrame:
    """(id_a, id_b): records whose sets of k-word shingles have a similarity of at least ``least``, smaller key first.

    Exact copies are pairs too. Null keys and texts, and texts with fewer than k words, are in no pair. Rows with the
    same key are one record. The order of rows, repeated rows and further columns make no difference.
    """
    members, near = near_classes(df, key, column, k, least)
    release(df.sparkSession)
    m = members.select(key, "cls")
    across = shingles.member_pairs(near, m, m, key)
    x, y = m.select("cls", F.col(key).alias("id_a")), m.select("cls", F.col(key).alias("id_b"))
    within = x.join(y, "cls").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", column: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """(key, class_id, copies, links): one row per record with the smallest key of its class (all records with the same set of
    shingles), the number of records in that class and the number of other classes with a similarity of at least
    ``least``. Records without k words have no class, 0 copies and 0 links.
    """
    members, near = near_classes(df, key, column, k, least)
    links = near.select(F.col("a").alias("cls")).unionAll(near.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min(key).alias("class_id"))
    known = members.join(sizes.join(links, "cls", "left"), "cls")
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(known, key, "left").select(key, "class_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
