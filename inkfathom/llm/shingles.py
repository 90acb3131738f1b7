"""Word shingles of look-folded texts, kept once per set of shingles.

Words are unbroken runs of letters, combining marks and decimal digits of the folded text in lower case. A class is
the set of all records with the same shingle set; operators on pairs work on classes and attach the members last, so
copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfathom.llm import textform
from inkfathom.session import cut_lineage, release

WORD = r"[\p{L}\p{M}\p{Nd}]+"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each different word of the array is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(words: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word sequences of each list of words, sorted by row and hash."""
    h = word_hashes(words.flatten())
    sizes = np.diff(np.asarray(words.offsets))
    row = np.repeat(np.arange(len(words)), sizes)
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    whole = row[:n] == row[k - 1 :]
    row, mixed = row[:n][whole], mixed[whole].view(np.int64)
    order = np.lexsort([mixed, row])
    row, mixed = row[order], mixed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])
    return row[new], mixed[new]


def _sets(key: str, key_type: T.DataType, k: int):
    lists = T.StructType([T.StructField("key", key_type), T.StructField("w", T.ArrayType(T.StringType()))])
    fold = textform.fold_batches(f"SELECT \"{key}\" AS key, regexp_extract_all(lower(folded), '{WORD}') AS w FROM folded", lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fold(batches):
            row, sh = shingle_sets(batch.column("w"), k)
            counts = np.bincount(row, minlength=batch.num_rows)
            has = np.flatnonzero(counts)
            if not len(has):
                continue
            starts = np.concatenate([[0], np.cumsum(counts[has])])
            # The class is named by the sum of a scramble of all shingles, and their number.
            sums = np.add.reduceat(mix(sh.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), starts[:-1])
            cls = mix(sums + counts[has].astype(np.uint64)).view(np.int64)
            yield pa.record_batch({key: batch.column("key").take(pa.array(has)), "cls": pa.array(cls), "n": pa.array(counts[has].astype(np.int32)), "sh": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sh))})

    return run


def shingle_classes(df: DataFrame, key: str = "id", column: str = "text", k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the records of ``df``, both cut from their lineage.

    members: (key, cls), one row per key; of several rows with one key the smallest class counts. classes: (cls, n,
    sh), sh sorted. Records with a null key or text, or with fewer than k words, have no shingles and no class.
    Sets go through one shuffle and are stored once, with the first record of their class.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sh", T.ArrayType(T.LongType()))])
    texts = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, F.col(column).alias("text"))
    first = F.row_number().over(Window.partitionBy("cls").orderBy(key)) == 1
    named = cut_lineage(texts.mapInArrow(_sets(key, kind, k), schema).select(key, "cls", "n", F.when(first, F.col("sh")).alias("sh")))
    members = cut_lineage(named.groupBy(key).agg(F.min("cls").alias("cls")))
    release(df.sparkSession)
    return members, named.where("sh IS NOT NULL").select("cls", "n", "sh")


#: Words of 64 parity bits in a signature.
PARITY = 8


def parity_words(row: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY) words: bit by bit, the parity of the number of a set's shingles that fall on the bit. Two sets differ
    in at least as many shingles as their signatures differ in bits."""
    bit = (mix(t.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(7)) % np.uint64(64 * PARITY)
    odd = np.bincount(row * 64 * PARITY + bit.astype(np.int64), minlength=n * 64 * PARITY).reshape(n, PARITY, 64) & 1
    return np.bitwise_or.reduce(odd.astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=2).view(np.int64)


def plausible_pairs(candidates: DataFrame, sig: DataFrame, least: float) -> DataFrame:
    """The distinct candidates (a, b) whose sizes and signatures (cls, n, b0, ...) allow the similarity; nothing at or
    above it is lost. Signatures are a twentieth of a usual set, so this comes before the sets themselves are made."""
    x, y = sig.alias("x"), sig.alias("y")
    need = f"{least / (1 + least)!r} * (x.n + y.n) - 1e-9"
    apart = " + ".join(f"bit_count(x.b{w} ^ y.b{w})" for w in range(PARITY))
    joined = candidates.distinct().alias("c").join(x, F.expr("c.a = x.cls")).join(y, F.expr(f"c.b = y.cls AND least(x.n, y.n) >= {need} AND {apart} <= x.n + y.n - 2 * ({need})"))
    return joined.select("c.a", "c.b")


def sets_of(df: DataFrame, records: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(cls, sh): the shingle sets of the texts of some records (key), made again from the text."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sh", T.ArrayType(T.LongType()))])
    texts = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, F.col(column).alias("text"))
    return texts.join(records, key, "left_semi").mapInArrow(_sets(key, kind, k), schema).groupBy("cls").agg(F.first("sh").alias("sh"))


def verified_pairs(candidates: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b) of the distinct candidates whose sets have a Jaccard similarity of at least ``least``; exact."""
    a = classes.select(F.col("cls").alias("a"), F.col("sh").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    # The set of a pair's first class is fetched with the pairs of that class, not once per later step.
    joined = candidates.distinct().join(a, "a").join(b, "b")
    return joined.withColumn("o", both).where(F.col("o") >= F.lit(least) * (F.size("sa") + F.size("sb") - F.col("o"))).select("a", "b", "o")


def member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b) of the members of linked classes, smaller key first; ``left`` and ``right`` are (key, cls)."""
    out = pairs.select("a", "b").join(left.select(F.col("cls").alias("a"), F.col(key).alias("ka")), "a").join(right.select(F.col("cls").alias("b"), F.col(key).alias("kb")), "b")
    return out.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"))
