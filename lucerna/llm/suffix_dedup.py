"""Suffix-array deduplication: bytes covered by a ``length``-byte string that starts anywhere else go.

Every window of ``length`` bytes has an anchor (see ``anchors``), and equal windows have equal anchors at equal
offsets; the windows of one anchor make a unit. Units found whole more than once (by a 64-bit hash) are repeated as
they stand. Where one anchor has different units, these are aligned at the anchor, cut at the depths where any two of
them part, and written as short texts of numbered pieces, weighted by their bytes. The suffix array of these texts,
built by linear grouping, gives each suffix its longest match in another unit, which decides all windows exactly.

An anchor with more than ``SPLIT`` different units (a passage that many texts quote) is divided first, so that no task
gathers it. Units share what stands before the anchor, and behind it, to some depth; a depth is hot where that many
units agree. A window that reaches beyond its unit's hot depth, on the left or else on the right, can only equal one
that shares the byte beyond as well: these meet in a class of their own. Windows inside the hot depths on both sides
are the same in all copies, of which one goes on; if there still are too many, these are divided in turn.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; repeated rows are
repeats of each other; strings are judged on the input, within documents; an empty table gives an empty result.
Extra columns are ignored by ``deduplicated`` and names starting with ``_d_`` are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import depth_keys, place_of, units, unpacked_place
from .common import materialise, only, small_batches
from .suffix_array import common_prefixes, suffix_array

LENGTH = 200
#: Different units of one anchor that are compared undivided, at most.
SPLIT = 1500
#: Times that a class is divided; what is left then is compared in one piece.
ROUNDS = 6
#: Bits of the filters of anchors that are sent to all executors, at most, and cells for each document in which anchors
#: are counted. With more repeated cells than an eighth of the bits, the filter stays partitioned.
FILTER_BITS = 1 << 25
CELLS_PER_DOC = 2048
#: Numbered pieces in one suffix array, about.
BATCH = 60_000


# -- one anchor's units -------------------------------------------------------------------------------------------


def _branches(parts: list[bytes]) -> list[int]:
    """Depths at which some two of the byte strings part."""
    parts = sorted(parts)
    out = set()
    for a, b in zip(parts, parts[1:], strict=False):
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        out.add(n - (x.bit_length() + 7) // 8)
    return sorted(out)


def repeated_windows(classes: Iterable[list[tuple[bytes, int, int]]], length: int = LENGTH) -> Iterator[list[list[tuple[int, int]]]]:
    """For each class of units of one anchor (bytes, anchor's offset, windows - 1): for each unit, the runs
    (first, last) of its windows that another unit of the class has as well. One suffix array for all classes."""
    text: list[int] = []
    numbers: dict[tuple, int] = {}
    starts: list[tuple[int, int, int, list[int]]] = []  # of suffixes that begin at a left boundary: class, unit, boundary's index, right boundaries
    where: dict[int, int] = {}
    lefts: list[list[int]] = []
    answers: list[list[list[tuple[int, int]]]] = []
    shape: list[list[tuple[int, int]]] = []
    for c, members in enumerate(classes):
        left = _branches([m[0][: m[1]][::-1] for m in members])
        right = _branches([m[0][m[1] :] for m in members])
        depths = [0, *(d for d in left if d)]
        lefts.append(depths)
        answers.append([[] for _ in members])
        shape.append([(m[1], m[2]) for m in members])
        for k, (raw, anchor, _) in enumerate(members):
            mine = [b for b in depths if b <= anchor]
            for j in range(len(mine) - 1, -1, -1):
                where[len(text)] = len(starts)
                starts.append((c, k, j, right))
                if j:
                    piece = (c, j, raw[anchor - mine[j] : anchor - mine[j - 1]])
                    text.append(numbers.setdefault(piece, len(numbers) + 1))
            at = 0
            for j, d in enumerate(right):
                if d > len(raw) - anchor:
                    break
                if d > at:
                    piece = (c, -1 - j, raw[anchor + at : anchor + d])
                    text.append(numbers.setdefault(piece, len(numbers) + 1))
                    at = d
            text.append(0)
    order = suffix_array(text)
    prefix = [*common_prefixes(text, order), 0]
    end_of = [0] * len(text)
    for i in range(len(text) - 1, -1, -1):
        end_of[i] = i if not text[i] else end_of[i + 1]
    for r, s in enumerate(order):
        if s not in where:
            continue
        c, k, j, right = starts[where[s]]
        shared = min(max(prefix[r], prefix[r + 1]), end_of[s] - s)
        depths = [d for d in right if d]
        if shared <= j or shared - j > len(depths):
            continue  # the match ends before the anchor does
        reach = depths[shared - j - 1]
        offset, more = shape[c][k]
        low = max(length - reach, lefts[c][j - 1] + 1 if j else 0, offset - more)
        if low <= lefts[c][j]:
            answers[c][k].append((offset - lefts[c][j], offset - low))
    yield from answers


# -- tables -------------------------------------------------------------------------------------------------------


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_units(texts: DataFrame, length: int) -> DataFrame:
    """_d_key, h (anchor), u (unit), place: all units of the packed texts."""

    def run(batches):
        for batch in batches:
            out = []
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, u, place = units(_unpacked(packed), length)
                if len(h):
                    out.append((np.full(len(h), key, np.int64), h.view(np.int64), u.view(np.int64), place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["_d_key", "h", "u", "place"])

    return texts.select("_d_key", "packed").mapInArrow(run, "_d_key long, h long, u long, place long")


def _possible(every: DataFrame, n_docs: int) -> DataFrame:
    """``every`` without units whose anchor certainly occurs once; ``mixed`` is false where all units of the anchor are
    certainly the same.

    Anchors are counted in cells of a hash. While few of these are hit twice, the outcome is folded into two Bloom filters
    of at most ``FILTER_BITS`` bits, which go to all executors; beyond, it stays partitioned by cell and meets the units there.
    """
    cells = 1 << min(40, (max(1, n_docs) * CELLS_PER_DOC - 1).bit_length())
    cell = F.col("h").bitwiseAND(F.lit(cells - 1).cast("long"))
    part = F.col("u").bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int")
    counted = every.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(part).alias("low"), F.max(part).alias("high")).filter("n > 1")
    counted = materialise(counted.select("cell", (F.col("low") < F.col("high")).alias("differ")), "cells")
    few = counted.count() <= FILTER_BITS // 8
    place = F.col("cell").bitwiseAND(F.lit((min(cells, FILTER_BITS) if few else cells) - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = counted.groupBy(F.shiftright(place, 6).alias("_d_word")).agg(F.bit_or(bit).alias("often"), F.bit_or(F.when(F.col("differ"), bit).otherwise(0)).alias("differ"))
    probed = every.withColumn("cell", cell).withColumn("_d_at", F.shiftright(place, 6)).join(F.broadcast(words) if few else words, F.col("_d_at") == F.col("_d_word"))
    return probed.filter((F.col("often").bitwiseAND(bit)) != 0).select("_d_key", "h", "u", "place", (F.col("differ").bitwiseAND(bit) != 0).alias("mixed"))


def _found(texts: DataFrame, length: int) -> DataFrame:
    """Units that occur twice, and units to be compared: _d_key, place, whole (found whole elsewhere), h (of the anchor,
    for the one copy of each unit that is compared with others of its anchor; else null)."""
    with small_batches(texts.sparkSession):
        every = materialise(_possible(text_units(texts, length), texts.count()), "units")
    each = every.groupBy("h", "u").agg(F.count("*").alias("n"), F.min(F.struct("_d_key", "place")).alias("one"), F.first("mixed").alias("mixed")).filter("n > 1 or mixed")
    # inverted keys: both sides are exchanged anew, so that Spark can split a hot unit
    kept = each.select(F.bitwise_not("h").alias("_d_h"), F.bitwise_not("u").alias("_d_u"), "n", F.when(F.col("mixed"), F.col("one")).alias("one"))
    joined = every.select("_d_key", "h", "u", "place").join(kept, (F.bitwise_not("h") == F.col("_d_h")) & (F.bitwise_not("u") == F.col("_d_u")))
    chosen = (F.col("_d_key") == F.col("one._d_key")) & (F.col("place") == F.col("one.place"))
    return joined.select("_d_key", "place", (F.col("n") > 1).alias("whole"), F.when(chosen, F.col("h")).alias("h"))


def _runs(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of byte spans (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _result(raw: bytes, runs: list[list[int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of what is kept."""
    kept, at = hashlib.sha256(), 0
    for a, b in runs:
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


_JOINED = pa.schema([("doc_id", pa.int64()), ("_d_key", pa.int64()), ("packed", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("todo", pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int64())])))])
_COMPARED = pa.schema([("_d_key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes of the text, compressed (they are moved twice at most), and _d_key, a number of the row."""

    def run(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=3).compress
            packed = [pack(_raw(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, packed binary")
    with small_batches(docs.sparkSession):  # written before anything uses the numbers, so that they hold
        return materialise(made.withColumn("_d_key", F.monotonically_increasing_id()), "texts")


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _first_round(texts: DataFrame, length: int) -> DataFrame:
    """Each document with its result, or (where units must be compared) with its text, sure spans and those units."""
    per_doc = _found(texts, length).groupBy("_d_key").agg(
        F.collect_list(F.when(F.col("whole"), F.col("place"))).alias("whole"),
        F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "place"))).alias("todo"),
    )
    both = texts.join(per_doc, "_d_key", "left").select("doc_id", "_d_key", "packed", "whole", "todo")

    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    raw, sure = _unpacked(r["packed"]), []
                    for place in r["whole"] or ():
                        first, _, more = unpacked_place(place)
                        sure.append((first, first + more + length))
                    runs = _runs(sure)
                    if r["todo"]:
                        yield r["doc_id"], r["_d_key"], r["packed"], len(raw), None, None, None, [x for run in runs for x in run], r["todo"]
                    else:
                        yield r["doc_id"], r["_d_key"], None, *_result(raw, runs), None, None

        return _batches(rows(), _JOINED, 500)

    spec = "doc_id long, _d_key long, packed binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, todo array<struct<h:long,place:long>>"
    with small_batches(texts.sparkSession):
        return materialise(both.mapInArrow(run, spec), "first-round")


_PART = "cls long, _d_key long, place long, raw binary, kind int, copies long"
#: Kinds of parts: to be compared in a class; the same in all copies, one of which goes on; found whole more than once.
_APART, _SHARED, _WHOLE = 0, 1, 2


def depths_of(raw: bytes, place: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Keys of what a unit has on the left and on the right of its anchor's start, and the depths to which these are hot."""
    anchor = unpacked_place(place)[1]
    keys = depth_keys(raw[:anchor][::-1], 0), depth_keys(raw[anchor:], 1)
    return *keys, *(int(np.append(np.isin(k, hot), False).argmin()) - 1 for k in keys)


def parts_of(raw: bytes, place: int, hot: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """The windows of a unit, parted by where they reach beyond the hot depths: (class or 0, place, bytes).

    A class is named by the key of the first depth that isn't hot, on the left or, for windows hot on the left, on the
    right; the part without a class has the windows that are hot on both sides."""
    left, right, a, b = depths_of(raw, place, hot)
    first, anchor, more = unpacked_place(place)
    most, least = anchor, anchor - more  # bytes that the first and the last window have on the left
    for name, high, low in (
        (left[a + 1] if a + 1 < len(left) else 0, most, max(least, a + 1)),
        (right[b + 1] if b + 1 < len(right) else 0, min(most, a, length - b - 1), least),
        (0, min(most, a), max(least, length - b)),
    ):
        if low <= high:
            begin = anchor - high
            yield int(name), int(place_of(first + begin, first + anchor, first + anchor - low)), raw[begin : anchor - low + length]


def _class_of(h: int, name: int) -> int:
    """A signed number of 64 bits for an anchor's class of that name."""
    mixed = (h * 0x9E3779B97F4A7C15 ^ name) * 0x94D049BB133111EB & (1 << 64) - 1
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _divided(large: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Classes (cls, _d_key, place, raw) of bounded size out of large ones (h, _d_key, place, raw, n: the size), and spans
    (_d_key, a, b) of windows that are found whole in several units."""
    classes, spans = [], []

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys = [k for raw, place in zip(group["raw"], group["place"], strict=True) for k in depths_of(raw, place, _NONE)[:2]]
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        return pd.DataFrame({"h": group["h"].iloc[0], "prefix": keys[n > 1].view(np.int64), "n": n[n > 1]})

    def divide(group: pd.DataFrame, hot: pd.DataFrame) -> pd.DataFrame:
        rows, shared = [], {}
        known = np.sort(hot["prefix"].to_numpy(np.int64).view(np.uint64))
        for h, key, place, raw in zip(group["h"], group["_d_key"], group["place"], group["raw"], strict=True):
            for name, at, piece in parts_of(raw, place, known, length):
                if name:
                    rows.append((_class_of(h, name), key, at, piece, _APART, 1))
                else:
                    shared.setdefault((h, unpacked_place(at)[1:], piece), []).append((key, at))
        for (h, _, piece), some in shared.items():
            rows.append((h, *some[0], piece, _SHARED, len(some)))
            rows += [(h, *one, None, _WHOLE, len(some)) for one in some if len(some) > 1]
        return pd.DataFrame(rows, columns=["cls", "_d_key", "place", "raw", "kind", "copies"])

    def whole(rows: DataFrame) -> DataFrame:
        first, more = F.shiftright("place", 20), F.col("place").bitwiseAND(F.lit(1023).cast("long"))
        return rows.select("_d_key", first.alias("a"), (first + more + length).alias("b"))

    for turn in range(ROUNDS):
        # chunks of about SPLIT units; what a chunk has once is left out of the counts
        salt = F.pmod(F.xxhash64("_d_key", "place"), F.ceil(F.col("n") / SPLIT))
        large = materialise(large.select("h", "_d_key", "place", "raw", salt.alias("salt")), f"large-{turn}")
        counts = large.groupBy("h", "salt").applyInPandas(count, "h long, prefix long, n long").groupBy("h", "prefix").agg(F.sum("n").alias("n"))
        chunks = large.select(F.col("h").alias("_d_c"), F.col("salt").alias("chunk")).distinct()
        hot = counts.filter(F.col("n") >= SPLIT).join(chunks, F.col("h") == F.col("_d_c")).select("_d_c", "chunk", "prefix")
        parts = materialise(large.groupBy("h", "salt").cogroup(hot.groupBy("_d_c", "chunk")).applyInPandas(divide, _PART), f"parts-{turn}")
        classes.append(parts.filter(F.col("kind") == _APART).select("cls", "_d_key", "place", "raw"))
        spans.append(whole(parts.filter(F.col("kind") == _WHOLE)))
        # one row for each chunk that has the part
        shared = parts.filter(F.col("kind") == _SHARED).withColumn("shape", F.col("place").bitwiseAND(F.lit((1 << 20) - 1).cast("long")))
        each = shared.groupBy("cls", "shape", "raw").agg(F.sum("copies").alias("n"), F.min(F.struct("_d_key", "place")).alias("one"))
        again = each.filter("n > 1").select(F.col("cls").alias("_d_c"), F.col("shape").alias("_d_s"), F.col("raw").alias("_d_r"))
        alike = (F.col("cls") == F.col("_d_c")) & (F.col("shape") == F.col("_d_s")) & (F.col("raw") == F.col("_d_r"))
        spans.append(whole(shared.filter("copies = 1").join(again, alike)))
        left = materialise(each.select("cls", "one._d_key", "one.place", "raw"), f"left-{turn}")
        sizes = left.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cls").alias("_d_c"), "n")
        met = left.join(sizes, F.col("cls") == F.col("_d_c")).drop("_d_c")
        if turn == ROUNDS - 1 or sizes.filter(F.col("n") > SPLIT).isEmpty():
            classes.append(met.drop("n"))
            break
        classes.append(met.filter(F.col("n") <= SPLIT).drop("n"))
        large = met.filter(F.col("n") > SPLIT).withColumnRenamed("cls", "h")
    return classes, spans


_NONE = np.zeros(0, np.uint64)


def _compared(waiting: DataFrame, length: int) -> DataFrame:
    """_d_key, a, b: byte spans that the comparison of units adds."""

    def cut(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    raw = _unpacked(r["packed"])
                    for t in r["todo"]:
                        first, anchor, more = unpacked_place(t["place"])
                        yield r["_d_key"], t["h"], t["place"], raw[first : first + more + length]

        return _batches(rows(), pa.schema([("_d_key", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("raw", pa.binary())]))

    every = waiting.select("_d_key", "packed", "todo").mapInArrow(cut, "_d_key long, h long, place long, raw binary")
    sizes = materialise(waiting.select(F.explode("todo.h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "classes")
    # inverted keys, as above; anchors with one unit only are left out
    met = every.join(sizes.select(F.bitwise_not("h").alias("_d_h"), "n"), F.bitwise_not("h") == F.col("_d_h")).drop("_d_h")
    spans = []
    classes = met.filter(F.col("n") <= SPLIT).select(F.col("h").alias("cls"), "_d_key", "place", "raw")
    if not sizes.filter(F.col("n") > SPLIT).isEmpty():
        divided, spans = _divided(met.filter(F.col("n") > SPLIT), length)
        for some in divided:
            classes = classes.unionAll(some)

    def compare(batches):
        def met():
            rows = (r for batch in batches for r in batch.to_pylist())
            for _, some in groupby(rows, key=lambda r: r["cls"]):
                some = list(some)
                if len(some) > 1:
                    yield some

        def rows():
            held, weight = [], 0
            for some in met():
                held.append(some)
                weight += 8 * len(some)
                if weight >= BATCH:
                    yield from decided(held)
                    held, weight = [], 0
            if held:
                yield from decided(held)

        def decided(held):
            members = [[(r["raw"], *unpacked_place(r["place"])[1:]) for r in some] for some in held]
            for some, answers in zip(held, repeated_windows(members, length), strict=True):
                for r, runs in zip(some, answers, strict=True):
                    first = unpacked_place(r["place"])[0]
                    for a, b in _runs((first + a, first + b + length) for a, b in runs):
                        yield r["_d_key"], a, b

        return _batches(rows(), _COMPARED)

    dealt = classes.repartition("cls").sortWithinPartitions("cls")
    found = dealt.mapInArrow(compare, "_d_key long, a long, b long")
    for some in spans:
        found = found.unionAll(some)
    return found


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    with only(docs.sparkSession) as kept:  # the packed texts, units and cells are done with
        first = _first_round(_packed(docs), length)
        kept.append(first)
    waiting = first.filter("todo is not null")
    added = _compared(waiting, length).groupBy("_d_key").agg(F.collect_list(F.struct("a", "b")).alias("added"))
    both = waiting.select("doc_id", "_d_key", "packed", "spans").join(added, "_d_key", "left").select("doc_id", "packed", "spans", "added")

    def finish(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    flat = r["spans"] or []
                    spans = [*zip(flat[::2], flat[1::2], strict=True), *((s["a"], s["b"]) for s in r["added"] or ())]
                    yield r["doc_id"], *_result(_unpacked(r["packed"]), _runs(spans))

        return _batches(rows(), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rest = first.filter("todo is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return rest.unionAll(both.mapInArrow(finish, columns))
