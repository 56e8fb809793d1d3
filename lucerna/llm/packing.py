"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the ``buckets`` boundaries of least padding, with
the convex-hull trick; a bucket's length is that of its longest document. The histogram has a row for each length that
occurs: d different lengths take d * (d - 1) / 2 words at least, so the root of twice the number of words bounds it.
Inside a bucket, documents are ordered by a hash and dealt into batches of as many documents as ``token_budget`` holds
at the bucket's length (one at least).

Defined cases: lengths are words; a null text has length zero and goes to the shortest bucket; a document longer
than the token budget has a batch of its own; ties and repeated rows are separate documents; an empty table gives
an empty result. Extra columns are kept by ``pack``; names starting with ``_p_`` are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed_positions, materialise, text_or_empty, word_count

BUCKETS = 16
TOKEN_BUDGET = 16_384
BUCKET_ROWS = 1024


def boundaries(counts: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets over (length, count), with the least padding in all.

    Cost of a bucket over lengths i+1..j: length_j * (N_j - N_i) - (S_j - S_i), with N and S running counts and sums.
    """
    counts = sorted(counts)
    if not counts:
        return []
    lengths = [x for x, _ in counts]
    n, s = [0], [0]
    for x, c in counts:
        n.append(n[-1] + c)
        s.append(s[-1] + x * c)
    d = len(counts)
    best = [0] + [lengths[j] * n[j + 1] - s[j + 1] for j in range(d)]
    best[0] = math.inf  # no bucket is empty but for the first row below
    back = [[0] * (d + 1)]
    for _ in range(1, min(buckets, d)):
        # lines y = -n_i * x + best_i + s_i, asked for at rising x
        hull: list[tuple[int, float, int]] = []
        head, now, cut = 0, [math.inf] * (d + 1), [0] * (d + 1)
        for j in range(1, d + 1):
            i = j - 1
            if best[i] < math.inf:
                m, b = -n[i], best[i] + s[i]
                while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m) >= (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, b, i))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if head < len(hull):
                m, b, i = hull[head]
                now[j], cut[j] = x * n[j] - s[j] + m * x + b, i
        best, back = now, [*back, cut]
    ends, j = [], d
    for cut in reversed(back):
        ends.append(lengths[j - 1])
        j = cut[j]
    return sorted(ends)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = 5) -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_len, batch (in its bucket), place (in its batch) and padding."""
    length = word_count(text_or_empty("text")) if length is None else length
    held = materialise(docs.withColumns({"n_tokens": length, "_p_row": F.monotonically_increasing_id()}), "lengths")
    histogram = held.groupBy("n_tokens").agg(F.count("*").alias("n"))
    # bounded by the root of twice the number of words, see above
    ends = boundaries([(r["n_tokens"], r["n"]) for r in histogram.collect()], buckets)
    bounds = F.array(*[F.lit(int(e)).cast("long") for e in ends]) if ends else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))
    n_slices = -(-max(1, held.count()) // BUCKET_ROWS)
    placed = held.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", F.get(bounds, F.col("bucket")))
    placed = placed.withColumn("_p_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_p_slice", F.pmod("_p_key", F.lit(n_slices)))
    ranked = bucketed_positions(placed, ["bucket"], "_p_slice", ["_p_key", "_p_row"], {"rank": F.lit(1).cast("long")})
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.lit(1).cast("long"), "bucket_len")))
    out = ranked.withColumn("batch", F.floor(F.col("start_rank") / room)).withColumn("place", (F.col("start_rank") % room).cast("int"))
    return out.withColumn("padding", F.col("bucket_len") - F.col("n_tokens")).drop("_p_row", "_p_key", "_p_slice", "start_rank")


def packed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_len, batch, place, padding."""
    thin = docs.select("doc_id", word_count(text_or_empty("text")).alias("_p_words"))
    return pack(thin, F.col("_p_words")).drop("_p_words")
