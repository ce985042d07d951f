"""Packing by optimal length buckets: dynamic programming over the global histogram picks the boundaries of least padding,
then batches of a token budget form inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.llm.common import forget, written

#: Production parameters: buckets, tokens of a batch with its padding, and the multiple that a bucket's length has.
BUCKETS, BUDGET, ALIGN = 16, 65_536, 64


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Of the ascending lengths those that end a bucket, so that the padding up to them is least.

    Exact: padding meets the quadrangle inequality, so the best split moves only forwards and each layer is solved by
    divide and conquer. Of equal solutions: the fewest buckets, then each last bucket as long as can be.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    docs, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    cost = lengths * docs[1:] - tokens[1:]  # one bucket for all up to j
    layers, splits = [cost], []
    for k in range(1, min(buckets, n)):
        before, best, split = layers[-1], np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        work = [(k, n - 1, k, n - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j, last) + 1)  # the last bucket starts at i
            total = before[i - 1] + lengths[j] * (docs[j + 1] - docs[i]) - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(total))
            best[j], split[j] = total[at], i[at]
            work += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        layers.append(best)
        splits.append(split)
    k = int(np.argmin([layer[n - 1] for layer in layers]))
    out, j = [], n - 1
    while True:
        out.append(int(lengths[j]))
        if not k:
            return out[::-1]
        k, j = k - 1, int(splits[k - 1][j]) - 1


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place: 0, 1, ... inside each group by the order, with no task for a whole group.

    Rows are range-partitioned by group and order and written; a place is the row's index in its partition plus the rows
    of its group in the partitions before. The offsets have at most a row per partition and group end, so they are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    split = written(split.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    ends = split.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("part", group, (before - F.col("first")).alias("offset"))
    return split.join(F.broadcast(offsets), ["part", group]).withColumn("place", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def pack(documents: DataFrame, length, buckets: int = BUCKETS, budget: int = BUDGET, align: int = ALIGN) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding: where each row of documents goes.

    length: a column expression of a document's tokens; null counts 0. A bucket's length is a multiple of align; a batch
    of a bucket has as many rows as fit the budget at that length, one at least, in the order of doc_id (null first).
    Repeated rows take slots of their own. An empty table gives an empty result. The histogram that goes to the driver
    has one row for each multiple of align that is some document's length, whatever the number of documents.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    rows = written(rows, "lengths")
    padded = F.greatest(F.ceil(F.col("n_tokens") / align), F.lit(1)) * align
    histogram = rows.groupBy(padded.cast("long").alias("length")).count().orderBy("length").collect()
    ends = boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    bucket = F.lit(0)
    for i, end in enumerate(ends[:-1]):
        bucket = F.when(F.col("n_tokens") > end, i + 1).otherwise(bucket)
    ends_of = F.array(*[F.lit(e).cast("long") for e in ends or [align]])
    placed = numbered(rows.withColumn("bucket", bucket.cast("int")), "bucket", ["doc_id", "n_tokens"])
    size = F.element_at(ends_of, F.col("bucket") + 1)
    per = F.greatest(F.floor(F.lit(budget) / size), F.lit(1))
    out = placed.withColumns({"bucket_tokens": size, "per": per})
    out = out.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("place") / F.col("per")).cast("long").alias("batch"), (F.col("place") % F.col("per")).cast("long").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
    out = written(out, "packed")
    forget(rows)
    return out


def byte_tokens(column: str = "text"):
    """A text's length in byte tokens with one end token."""
    return F.octet_length(F.coalesce(F.col(column).cast("string"), F.lit(""))) + 1


def pack_sql(buckets: int = BUCKETS, budget: int = BUDGET, align: int = ALIGN) -> str:
    """pack(documents, byte_tokens()) in DuckDB SQL: the same dynamic programming, a common table expression per layer."""
    layers = ["d1 AS (SELECT j, len * docs - tokens AS cost, 0::BIGINT AS i FROM h)"]
    for k in range(2, buckets + 1):
        layers.append(
            f"d{k} AS (SELECT j, cost, i FROM (SELECT h.j, p.cost + h.len * (h.docs - g.docs) - (h.tokens - g.tokens) AS cost, g.j + 1 AS i,"
            f" row_number() OVER (PARTITION BY h.j ORDER BY p.cost + h.len * (h.docs - g.docs) - (h.tokens - g.tokens), g.j) AS rn"
            f" FROM h JOIN h g ON g.j < h.j AND g.j >= {k - 2} JOIN d{k - 1} p ON p.j = g.j) WHERE rn = 1)"
        )
    everything = " UNION ALL ".join(f"SELECT {k} AS k, j, cost, i FROM d{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n_tokens FROM documents),
padded AS (SELECT *, greatest(((n_tokens + {align - 1}) // {align}), 1) * {align} AS len FROM rows_),
h AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS j, (sum(count(*)) OVER (ORDER BY len))::BIGINT AS docs,
  (sum(count(*) * len) OVER (ORDER BY len))::BIGINT AS tokens FROM padded GROUP BY len),
{", ".join(layers)},
d AS ({everything}),
top AS (SELECT k, j FROM d WHERE j = (SELECT max(j) FROM h) ORDER BY cost, k LIMIT 1),
back(k, j) AS (SELECT k, j FROM top UNION ALL SELECT d.k - 1, d.i - 1 FROM back JOIN d ON d.k = back.k AND d.j = back.j WHERE d.k > 1),
ends AS (SELECT h.len AS bucket_tokens, row_number() OVER (ORDER BY h.len) - 1 AS bucket, coalesce(lag(h.len) OVER (ORDER BY h.len), -1) AS below FROM back JOIN h ON h.j = back.j),
placed AS (SELECT p.doc_id, p.n_tokens, e.bucket, e.bucket_tokens, greatest({budget} // e.bucket_tokens, 1) AS per,
  row_number() OVER (PARTITION BY e.bucket ORDER BY p.doc_id NULLS FIRST, p.n_tokens) - 1 AS place
  FROM padded p JOIN ends e ON p.len > e.below AND p.len <= e.bucket_tokens)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, bucket::INTEGER AS bucket, bucket_tokens::BIGINT AS bucket_tokens, (place // per)::BIGINT AS batch,
  (place % per)::BIGINT AS slot, (bucket_tokens - n_tokens)::BIGINT AS padding FROM placed"""
