"""Packing: optimal length buckets and batches of a token budget inside each.

A dynamic programme over the exact histogram of all lengths chooses the bucket boundaries that minimise padding.  The
histogram has one row for each distinct length (rounded up to ``step``), whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..storage import cut
from .tokens import encoder

BUCKETS = 16
BUDGET = 1 << 15


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, ascending, the last the largest length, with the least total padding.

    With N(j) documents among the j shortest lengths, cost(j) = min over i<j of cost(i) + b(j) (N(j) - N(i)): for each
    number of buckets the lower envelope of the lines cost(i) - N(i) b, walked once since both slopes and queries are
    monotone.  Ties take the fewest buckets.
    """
    n = len(lengths)
    if not n:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    cost: list[float] = [0.0] + [float("inf")] * n
    cuts, best = [], []
    for _ in range(min(buckets, n)):
        hull: list[int] = []
        now, cut_at, head = [float("inf")] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] != float("inf"):
                while len(hull) - head >= 2 and (cost[i] - cost[hull[-2]]) * (total[hull[-1]] - total[hull[-2]]) <= (cost[hull[-1]] - cost[hull[-2]]) * (total[i] - total[hull[-2]]):
                    hull.pop()
                hull.append(i)
            if not len(hull) - head:
                continue
            b = lengths[j - 1]
            while len(hull) - head >= 2 and cost[hull[head + 1]] - total[hull[head + 1]] * b <= cost[hull[head]] - total[hull[head]] * b:
                head += 1
            now[j], cut_at[j] = cost[hull[head]] - total[hull[head]] * b + total[j] * b, hull[head]
        cuts.append(cut_at)
        best.append(now[n])
        cost = now
    k, j, out = min(range(len(best)), key=lambda i: (best[i], i)), n, []
    while j:
        out.append(lengths[j - 1])
        j = cuts[k][j]
        k -= 1
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, step: int = 1, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, position, padding), one row per row of ``lengths``, which is read twice.

    A batch has up to floor(budget / boundary) documents of a bucket, at least one, so a document over the budget is a
    batch of its own; documents fill a bucket's batches in the order of (id, length), nulls first.  padding is boundary -
    n_tokens.  A null length counts as 0.  Rows may be repeated; an empty table gives an empty result.

    Places within a bucket come from the row numbers in range partitions of (bucket, id) and from their sizes, one row
    for each partition and bucket: no task sees more than its share of a bucket.
    """
    spark = lengths.sparkSession
    d = lengths.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n_tokens"))
    at = F.ceil(F.col("n_tokens") / step).cast("long") * step
    histogram = sorted(d.groupBy(at.alias("length")).count().collect())  # one row for each distinct length
    bounds = boundaries([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    if not bounds:
        return d.selectExpr("doc_id", "n_tokens", "0 bucket", "0L boundary", "0L batch", "0L position", "0L padding")
    ends = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    d = d.withColumn("bucket", F.size(F.filter(ends, lambda b: b < F.col("n_tokens"))))
    d = d.withColumn("boundary", F.element_at(ends, F.col("bucket") + 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "bucket", "doc_id", "n_tokens", F.rand(7)).sortWithinPartitions("bucket", "doc_id", "n_tokens")

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            rank = np.zeros(len(bucket), np.int64)
            for x in np.unique(bucket).tolist():  # sorted: each bucket is one run
                own = np.flatnonzero(bucket == x)
                rank[own] = np.arange(len(own)) + seen.get(x, 0)
                seen[x] = seen.get(x, 0) + len(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], [*b.schema.names, "part", "rank"])

    d = cut(d, by=number, schema="doc_id long, n_tokens long, bucket int, boundary long, part int, rank long")
    sizes = d.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sizes.select("bucket", "part", before.alias("before")), ["bucket", "part"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))))
    place = F.col("before") + F.col("rank")
    return d.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(place / room).alias("batch"), F.pmod(place, room).alias("position"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))


def token_lengths(docs: DataFrame, tokenizer: str, end_ids: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), stored: the number of ids of the whole text and end_ids more; a null text has no ids of its own."""

    def count(batches):
        encode = encoder(tokenizer)
        for b in batches:
            n = [len(encode(t.as_py())) // encode.width + end_ids for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
        encode.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows, batch=250, by=count, schema="doc_id long, n_tokens long")


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op5_length_buckets": op5_length_buckets}
