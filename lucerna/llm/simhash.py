"""SimHash near-deduplication by the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half the XXH64 values (seed 42) of its word shingles have it.
Two fingerprints within ``distance`` bits agree to within t_i bits in some partition i, for any partition of the
bits into m groups and any thresholds t_i >= -1 with sum(t_i) = distance - m + 1. Correlated bits are grouped, and
thresholds are allotted by dynamic programming on candidate counts estimated from a bounded sample of
fingerprints; partitions of threshold -1 are not probed. The sample only steers cost: the search itself is exact.
Equal fingerprints are collapsed first, so copies never meet as pairs.

With ``every``, all texts of a Jaccard similarity of at least ``similarity`` over different ``words``-word shingles link
as well, however far their fingerprints are apart (at a similarity of 0.8, 64 bits differ in about 10 places, give or
take 3: no distance that keeps random texts out takes all of them in). Candidates share one of 28 bands of four
MinHash values, which two texts of similarity 0.8 miss with a probability of 4e-7. Inside a band's group of texts, a
search from text to text finds the components of the pairs that are similar enough, and only their links leave it.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows get the same answer; null doc_ids get the component of their fingerprint; an
empty table gives an empty result. Extra columns are kept by ``near_dedup``; names starting with ``_s_`` are reserved.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, small_batches, text_or_empty
from .components import components
from .lm_score import word_hashes

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that the candidate estimates are made from, at most.
SAMPLE = 8192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Bands of a text, MinHash values of each.
BANDS, ROWS = 28, 4
_MULTIPLIERS = np.random.default_rng(23).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str | Column = "text", width: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return each(F.col(text) if isinstance(text, str) else text)


def correlated_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """The columns of a 0/1 matrix in m groups of nearly equal size; bits that go together share a group."""
    centred = bits - bits.mean(axis=0, keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=0))
    both = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(both, 0)
    free, groups = set(range(bits.shape[1])), []
    for g in range(m):
        want = (bits.shape[1] - sum(map(len, groups))) // (m - g)
        order = sorted(free)
        one = [order[int(np.argmax(both[np.ix_(order, order)].sum(axis=1)))]]
        free.discard(one[0])
        while len(one) < want:
            order = sorted(free)
            one.append(order[int(np.argmax(both[np.ix_(order, one)].sum(axis=1)))])
            free.discard(one[-1])
        groups.append(sorted(one))
    return groups


def variants(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def _costs(bits: np.ndarray, group: list[int], distance: int, n_total: int) -> list[float]:
    """Estimated probes and candidates for thresholds -1 .. distance in one partition."""
    part = bits[:2048][:, group].astype(np.float32)
    n = max(2, len(part))
    apart = part @ (1 - part).T
    apart = (apart + apart.T).round().astype(int)
    near = np.bincount(np.clip(apart, 0, distance + 1).ravel(), minlength=distance + 2)[: distance + 1]
    near[0] -= len(part)
    seen = np.cumsum(near) / (n * (n - 1))
    costs = [0.0]
    for t in range(distance + 1):
        ways = variants(len(group), t)
        rows = float(max(n_total, 2))  # an empty table is planned like a small one
        costs.append(rows * (1 + ways) + rows**2 * max(seen[t], ways / 2.0 ** len(group)))
    return costs


def allot_thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The thresholds (-1 or more, summing to distance - m + 1) of least cost; costs[i][t + 1] is that of t in i."""
    budget = distance + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for per in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units in range(min(budget - used, len(per) - 1) + 1):
                new = (cost + per[units], [*chosen, units - 1])
                if used + units not in following or new[0] < following[used + units][0]:
                    following[used + units] = new
        best = following
    return best[budget]


def plan(sample: np.ndarray, n_total: int, distance: int = DISTANCE, parts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe: the cheapest over the numbers of partitions tried."""
    bits = np.unpackbits(np.asarray(sample, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if not len(bits):
        bits = np.zeros((1, BITS))
    found = []
    for m in parts:
        groups = correlated_groups(bits, m)
        cost, chosen = allot_thresholds([_costs(bits, g, distance, n_total) for g in groups], distance)
        found.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE) -> DataFrame:
    """a < b: all pairs of different fingerprints (column fp) within ``distance`` bits, each once: from the first partition
    in which the two agree."""
    n_total = distinct.count()
    some = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    index = probes = None
    differ, first = F.col("a").bitwiseXOR(F.col("b")), F.lit(True)
    earlier = F.lit(True)  # the two agree in no partition before this one
    for i, (group, t) in enumerate(plan(np.array(some, np.int64), n_total, distance)):
        mask = F.lit(_signed(sum(1 << b for b in group)))
        first = F.when(F.col("i.part") == i, earlier).otherwise(first)
        earlier = earlier & (F.bit_count(differ.bitwiseAND(mask)) > t)
        value = F.col("fp").bitwiseAND(mask)
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(group, k)]
        exact = distinct.select(F.lit(i).alias("part"), value.alias("key"), F.col("fp").alias("a"))
        varied = distinct.select(F.lit(i).alias("part"), F.explode(F.array(*[value.bitwiseXOR(F.lit(x)) for x in flips])).alias("key"), F.col("fp").alias("b"))
        index = exact if index is None else index.unionAll(exact)
        probes = varied if probes is None else probes.unionAll(varied)
    near = (F.bit_count(differ) <= distance) & first
    met = index.alias("i").join(probes.alias("p"), (F.col("i.part") == F.col("p.part")) & (F.col("i.key") == F.col("p.key")) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b")


def word_shingles(text: Column, words: int) -> Column:
    """Hashes of the different word shingles of a text, as ``fingerprint`` cuts words; a shorter text is one shingle."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.filter(F.split(lower, SPACE_CLASS + "+"), lambda w: w != "")
    cut = lambda w: F.when(F.size(w) > words, F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(w, i, words)))).otherwise(F.array(F.xxhash64(w)))
    return F.array_distinct(F.get(F.transform(F.array(found), cut), 0))


def similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: those of the pairs (a, b, least_a, least_b) whose documents have a Jaccard similarity of at least
    ``similarity`` over different ``words``-word shingles. Only documents of some pair are cut into shingles."""
    asked = pairs.select(F.explode(F.array("least_a", "least_b")).alias("_s_id")).distinct()
    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("_s_id")).groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = materialise(texts.select("doc_id", word_shingles(F.col("text"), words).alias("set")), "shingles")
    first, second = (sets.select(F.col("doc_id").alias(f"_s_{k}"), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = pairs.join(first, F.col("least_a") == F.col("_s_a")).join(second, F.col("least_b") == F.col("_s_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of the different word shingles of a text, sorted; words as ``fingerprint`` cuts them, a shorter text is one shingle."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(len(h), words)):
        out = _mixed(out) + h[k : k + n]
    return np.unique(_mixed(out))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band: of its number and the least values of its permutations."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out) + least[k::ROWS]
    return _mixed(out)


def bands_column(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([bands(shingle_set(t, words)).view(np.int64) for t in texts], dtype=object)

    return each(text)


def shingles_column(text: Column, words: int) -> Column:
    @F.pandas_udf("binary")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).tobytes() for t in texts], dtype=object)

    return each(text)


def similar_parts(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the place of the first one of its component under Jaccard similarity of at least ``similarity``."""
    size = np.array([len(x) for x in sets])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    part, left = np.full(len(sets), -1), np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not left[first]:
            continue
        part[first], left[first] = first, False
        waiting = [first]
        while waiting and left.any():  # each text meets those that no part has yet
            held = left[owner]
            place, owner = place[held], owner[held]
            now = waiting.pop()
            mine = np.zeros(len(names), bool)
            mine[np.searchsorted(names, sets[now])] = True
            shared = np.bincount(owner[mine[place]], minlength=len(sets))
            near = np.flatnonzero(left & (shared >= similarity * (size[now] + size - shared)))
            part[near], left[near] = first, False
            waiting += near.tolist()
    return part


def similar_links(thin: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: fingerprints that link all texts of at least ``similarity``; ``thin`` has fp, unit (a hash of the text) and bands."""
    keys = thin.filter("fp <> 0").select("fp", "unit", F.explode("bands").alias("key")).dropDuplicates(["key", "unit"])
    mates = Window.partitionBy("key")
    met = keys.withColumns({"differ": F.min("fp").over(mates) < F.max("fp").over(mates), "group": F.bit_xor(F.xxhash64("unit")).over(mates)})
    # bands that gather the same texts are one group
    members = materialise(met.filter("differ").select("group", "unit", "fp").distinct(), "members")
    asked = members.select(F.col("unit").alias("_s_unit")).distinct()
    texts = docs.select(F.xxhash64(text_or_empty()).alias("unit"), text_or_empty().alias("text")).join(asked, F.col("unit") == F.col("_s_unit"), "left_semi")
    with small_batches(docs.sparkSession):
        sets = materialise(texts.select("unit", shingles_column(F.col("text"), words).alias("set")).dropDuplicates(["unit"]), "shingles")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        part = similar_parts([np.frombuffer(x, np.uint64) for x in group["set"]], similarity)
        found = pd.DataFrame({"a": fp, "b": fp[part]})
        return found[found["a"] != found["b"]].drop_duplicates()

    return members.join(sets, "unit").groupBy("group").applyInPandas(linked, "a long, b long")


def grouped(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, further: int = 0, words: int = 5, similarity: float = 0.8, every: bool = False) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the least doc_id of its component).

    Fingerprints within ``distance`` bits link. With ``further`` above it, those within that many bits link as well
    where the similarity of their documents (the one of least doc_id for each fingerprint) bears it out. With ``every``, all documents of that similarity link.
    """
    more = [F.xxhash64(text_or_empty()).alias("unit"), bands_column(F.col("text"), words).alias("bands")] if every else []
    with small_batches(docs.sparkSession):
        thin = materialise(docs.select("doc_id", fingerprint_column("text", width).alias("fp"), *more), "fingerprints")
    distinct = materialise(thin.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct, max(distance, further))
    if further > distance:
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        found = materialise(found.withColumn("far", apart > distance), "links")
        named = found.filter("far").join(distinct.select(F.col("fp").alias("a"), F.col("least").alias("least_a")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("least").alias("least_b")), "b")
        found = found.filter("not far").select("a", "b").unionAll(similar(named, docs, words, similarity))
    if every:
        found = found.select("a", "b").unionAll(materialise(similar_links(thin, docs, words, similarity), "similar"))
    root = components(found)
    linked = root.select("node", "root").unionAll(root.select("root", "root").distinct())
    held = distinct.join(linked.withColumnRenamed("root", "_s_root"), F.col("fp") == F.col("node"), "left")
    held = materialise(held.select("fp", "least", "_s_root"), "linked")
    whole = held.filter("_s_root is not null").groupBy("_s_root").agg(F.min("least").alias("component_id"))
    labelled = held.filter("_s_root is not null").join(whole, "_s_root").select("fp", "component_id")
    labels = labelled.unionAll(held.filter("_s_root is null").select("fp", F.col("least").alias("component_id")))
    # keys are inverted so that both sides are exchanged anew: then Spark can split a hot fingerprint
    keyed = labels.select(F.bitwise_not("fp").alias("_s_key"), "component_id")
    return thin.join(keyed, F.bitwise_not("fp") == F.col("_s_key"), "left").select("doc_id", "fp", "component_id")


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, further: int = 0, words: int = 5, similarity: float = 0.8, every: bool = False) -> DataFrame:
    """One document of each component stays: the one with the least doc_id (null doc_ids stay)."""
    lost = grouped(docs, distance, width, further, words, similarity, every).filter("doc_id <> component_id").select(F.col("doc_id").alias("_s_lost")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("_s_lost"), "left_anti")
