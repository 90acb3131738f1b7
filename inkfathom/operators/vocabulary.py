"""TF-IDF over word and character n-grams (T9). Documents are rows of (key, gram, tf); nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{Nd}]+"


def _words(text: str):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_grams(df: DataFrame, key: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(key, gram): each sequence of ``sizes`` words, with repetitions."""
    w = df.where(F.col(text).isNotNull()).select(key, _words(text).alias("w"))

    def of(k: int):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + (k - 1) <= F.size("w"))
        return F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(k)), " "))

    grams = [of(k) for k in sizes]
    return w.select(key, F.explode(F.concat(*grams)).alias("gram"))


def character_grams(df: DataFrame, key: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(key, gram): each sequence of ``sizes`` characters inside words padded with one blank at both ends."""
    w = df.where(F.col(text).isNotNull()).select(key, F.explode(_words(text)).alias("w")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))

    def of(k: int):
        starts = F.filter(F.sequence(F.lit(1), F.length("w")), lambda i: i + (k - 1) <= F.length("w"))
        return F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(k)))

    grams = [of(k) for k in sizes]
    return w.select(key, F.explode(F.concat(*grams)).alias("gram"))


def tfidf(grams: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, gram, weight): (1 + ln tf) (1 + ln((1 + n) / (1 + df))), scaled to length 1 per document.

    Grams of fewer than ``least`` documents are left out; of the rest the ``most`` most frequent are kept (ties in order of
    the grams), which is the size of the vocabulary asked for.
    """
    tf = grams.groupBy(key, "gram").agg(F.count("*").alias("tf"))
    n = grams.agg(F.count_distinct(key).alias("n"))
    known = tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least).orderBy(F.desc("total"), "gram").limit(most)
    idf = known.crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
    x = tf.join(idf, "gram").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    return x.select(key, "gram", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))).alias("weight"))


def _tail_sql(least: int, most: int, key: str) -> str:
    return f"""tf AS (SELECT k, gram, count(*) AS tf FROM gr GROUP BY ALL), n AS (SELECT count(DISTINCT k) AS n FROM gr), kn AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM tf GROUP BY gram HAVING count(*) >= {least} ORDER BY total DESC, gram LIMIT {most}),
rw AS (SELECT k, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN kn USING (gram), n), w AS (SELECT k, raw / sqrt(sum(raw * raw) OVER (PARTITION BY k)) AS weight FROM rw)
--
SELECT k AS {key}, count(*) AS terms, sum(weight) AS weight, sum(weight * weight) AS norm FROM w GROUP BY k"""


def sql(source: str, sizes: tuple[int, ...], least: int, most: int, key: str) -> str:
    grams = " UNION ALL ".join(f"SELECT k, unnest(list_transform(range(1, len(w) - {s} + 2), lambda i: array_to_string(w[i:i + {s - 1}], ' '))) AS gram FROM src" for s in sizes)
    return f"WITH src AS ({source}), gr AS ({grams}), {_tail_sql(least, most, key)}"


def character_sql(source: str, sizes: tuple[int, ...], least: int, most: int, key: str) -> str:
    grams = " UNION ALL ".join(f"SELECT k, unnest(list_transform(range(1, length(c) - {s} + 2), lambda i: c[i:i + {s - 1}])) AS gram FROM one" for s in sizes)
    return f"WITH src AS ({source}), one AS (SELECT k, ' ' || unnest(w) || ' ' AS c FROM src), gr AS ({grams}), {_tail_sql(least, most, key)}"
