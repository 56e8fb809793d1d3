"""Language-model scoring: Stupid-backoff scores of every document, from counts over all documents.

Every word counts as itself, by a 64-bit hash. Documents are taken in blocks, in which words have numbers of their own;
a block's different words and bigrams, with their counts, are dealt by hash to ``parts`` tables, where the counts of all
blocks add up (through several rounds where there are more tables than ``FAN``). The tables answer each block's n-grams
(hot ones cost one entry a block, whatever their number of documents), and answers are joined to the block and summed
per document. Only the number of words reaches the driver.
Sorted hashes travel as compressed differences.

The score of a word after another is c(v w) / c(v) if the table of bigrams has v w, else ``backoff`` times c(w) / N; a
document's first word has c(w) / N. The table keeps bigrams that occur ``least`` times or more: with one, every bigram
of the scored corpus would be there, as the corpus has taught it.

Defined cases: a null or empty text has no words and score null; repeated rows count as documents of their own; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

BACKOFF = 0.4
#: Occurrences that a bigram needs to be in the table.
LEAST = 2
#: Bytes that the hashes of a block's words take, about.
BLOCK_BYTES = 8_000_000
#: Bytes of text for each table of counts, about.
PART_BYTES = 16_000_000
#: Tables that a block asks at once, at most.
FAN = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
#: Keeps the bigrams of the hash zero apart from its own count.
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_SPACES = (32, *range(9, 14))
_NEXT = re.compile(rb"[^\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), _SPACES)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: polynomials of their bytes, mixed. Long texts are cut at white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= _CHUNK:
        return _mix(_sums(raw))
    out, at = [np.zeros(0, np.uint64)], 0
    while word := _NEXT.search(raw, at):
        at = word.start()
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):
            back = max(raw.rfind(bytes([c]), at, end) for c in _SPACES)
            if back > at:
                end = back
            else:  # a word longer than a chunk: its pieces' polynomials add up
                end = min((i for c in _SPACES if (i := raw.find(bytes([c]), end)) >= 0), default=len(raw))
                pieces = [(pow(_BASE, i - at, 1 << 64), _sums(raw[i : min(end, i + _CHUNK)])) for i in range(at, end, _CHUNK)]
                whole = sum(power * int(x[0]) for power, x in pieces) & (1 << 64) - 1
                out.append(_mix(np.array([whole], np.uint64)))
                at = end
                continue
        out.append(_mix(_sums(raw[at:end])))
        at = end
    return np.concatenate(out)


def _sums(raw: bytes) -> np.ndarray:
    """A polynomial of the bytes of each word."""
    codes = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[codes], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _UP[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _blocks(batches, block_bytes: int, convert=word_hashes) -> Iterator[tuple[list, list]]:
    """Documents of a partition, in blocks: ids and what ``convert`` makes of each text."""
    ids, words, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = convert(text)
            ids.append(i)
            words.append(w)
            held += w.nbytes
            if held >= block_bytes:
                yield ids, words
                ids, words, held = [], [], 0
                pa.default_memory_pool().release_unused()
    if ids:
        yield ids, words
    pa.default_memory_pool().release_unused()  # workers live on; what Arrow keeps would add up with the next stage's


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def _keyed(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different n-grams as sorted 64-bit keys, and where each word of its vocabulary and each bigram stand
    among them (the first word of a document has a bigram with no word before)."""
    words = _mixed(vocabulary)
    now = words[tokens]
    before = np.empty(len(now), np.uint64)
    before[1:] = now[:-1]
    before[_firsts(lengths)] = 1 << 17
    keys, back = np.unique(np.concatenate([words, _mixed((before + _PAIR) * np.uint64(_BASE) + now)]), return_inverse=True)
    return keys, back[: len(words)], back[len(words) :]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each table's keys begin among sorted ones: tables take equal ranges of the keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; the first bytes are the width and the size."""
    raw = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return bytes([values.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(raw: bytes) -> np.ndarray:
    width, size = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def _steps(rising: np.ndarray) -> bytes:
    """Hashes as compressed differences (which wrap, so any order is held; sorted ones take least)."""
    return _squeezed(np.diff(rising, prepend=np.uint64(0)))


def _unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(raw), dtype=np.uint64)


def _firsts(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - lengths)[lengths > 0]


BLOCK = "block string, n_words long, ids binary, known binary, lengths binary, vocabulary binary, tokens binary"


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: hashes of their different words, and each text's words as numbers among them."""

    def collect(batches):
        for ids, words in _blocks(batches, block_bytes):
            lengths = np.array([len(w) for w in words], np.int64)
            found, tokens = np.unique(np.concatenate(words), return_inverse=True)
            there = np.array([i is not None for i in ids], np.uint8)
            row = (uuid.uuid4().hex, len(tokens), np.array([i or 0 for i in ids], np.int64).tobytes(), there.tobytes(), lengths.tobytes(), _steps(found), _squeezed(tokens.astype(np.uint32)))
            types = [pa.string(), pa.int64(), *[pa.binary()] * 5]
            names = ["block", "n_words", "ids", "known", "lengths", "vocabulary", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(collect, BLOCK)


_ASKED = "block string, grams binary, counts binary"
_DEALT = pa.schema([("block", pa.string()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def asked(blocks: DataFrame) -> DataFrame:
    """The different n-grams of blocks, sorted, with their counts."""

    def run(batches):
        for batch in batches:
            for block, vocabulary, tokens, lengths in zip(*(batch.column(k).to_pylist() for k in ("block", "vocabulary", "tokens", "lengths")), strict=True):
                tokens = _unsqueezed(tokens)
                keys, of_word, of_pair = _keyed(_unstepped(vocabulary), tokens, np.frombuffer(lengths, np.int64))
                counts = np.bincount(of_pair, minlength=len(keys)) + np.bincount(of_word[tokens], minlength=len(keys))
                row = (block, _steps(keys), _squeezed(_narrow(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["block", "grams", "counts"])

    return blocks.select("block", "vocabulary", "tokens", "lengths").mapInArrow(run, _ASKED)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The n-grams of blocks (block, grams, counts), a row for each of ``parts`` tables they go to."""

    def deal(batches):
        for batch in batches:
            for block, grams, counts in zip(*(batch.column(k).to_pylist() for k in ("block", "grams", "counts")), strict=True):
                keys, counts = _unstepped(grams), _unsqueezed(counts)
                cuts = _cuts(keys, parts)
                for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    a, b = cuts[p], cuts[p + 1]
                    row = (block, p, _steps(keys[a:b]), _squeezed(_narrow(counts[a:b])))
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DEALT, strict=True)], schema=_DEALT)

    return rows.mapInArrow(deal, "block string, part int, grams binary, counts binary")


def answered(rows: DataFrame, n_blocks: int, parts: int, width: int | None = None) -> DataFrame:
    """block, part, totals: for each block and each table it asked, in order, the counts of all blocks.

    A block of ``width`` tables' range deals to all of these at once if they are ``FAN`` at most. Else its n-grams go to
    ``FAN`` lanes; in each lane, some ``FAN`` blocks make one, which asks in their stead and passes the answers on. So a
    round has ``FAN`` rows a block, however many tables there are.
    """
    width = parts if width is None else width
    if width <= FAN:
        return dealt(rows, parts).groupBy("part").applyInPandas(_answer, "block string, part int, totals binary")
    n_lanes = FAN * -(-parts // width)  # over the whole range of hashes
    n_groups = -(-n_blocks // FAN)
    lanes = materialise(dealt(rows, n_lanes).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(n_groups))), "lanes")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys, back = np.unique(np.concatenate([_unstepped(g) for g in group["grams"]]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([_unsqueezed(c) for c in group["counts"]])).astype(np.int64)
        return pd.DataFrame({"block": [f"{group['part'].iloc[0]}:{group['group'].iloc[0]}"], "grams": [_steps(keys)], "counts": [_squeezed(_narrow(counts))]})

    def pass_on(group: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([_unstepped(g) for g in group["grams"]]))
        totals = np.concatenate([_unsqueezed(t).astype(np.int64) for t in got.sort_values("part")["totals"]])
        each = [totals[np.searchsorted(keys, _unstepped(g))] for g in group["grams"]]
        return pd.DataFrame({"block": group["block"], "part": group["part"], "totals": [_squeezed(_narrow(t)) for t in each]})

    merged = materialise(lanes.groupBy("part", "group").applyInPandas(merge, _ASKED), "merged")
    below = answered(merged, FAN * n_groups, parts, -(-width // FAN))
    place = F.split("block", ":")
    named = below.select(place[0].cast("int").alias("lane"), place[1].cast("long").alias("of"), F.col("part"), "totals")
    return lanes.groupBy("part", "group").cogroup(named.groupBy("lane", "of")).applyInPandas(pass_on, "block string, part int, totals binary")


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """One table: the counts of all blocks, for each n-gram that a block has asked for."""
    grams = [_unstepped(g) for g in asked["grams"]]
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(back, np.concatenate([_unsqueezed(c) for c in asked["counts"]])).astype(np.int64)[back]
    cuts = np.cumsum([0, *map(len, grams)])
    return pd.DataFrame({"block": asked["block"], "part": asked["part"], "totals": [_squeezed(_narrow(totals[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def scored(docs: DataFrame, backoff: float = BACKOFF, least: int = LEAST, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, score (sum of log10), mean_score, n_backoff (words scored by backing off)."""
    total_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total_bytes // part_bytes))
    with small_batches(docs.sparkSession):
        blocks = materialise(blocks_of(docs, block_bytes), "blocks")
    n_all, n_blocks = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()

    def add_up(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        totals = np.concatenate([_unsqueezed(g).astype(np.int64) for g in theirs.sort_values("part")["totals"]] or [np.zeros(0, np.int64)])
        block = mine.iloc[0]
        lengths, tokens = np.frombuffer(block["lengths"], np.int64), _unsqueezed(block["tokens"])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        _, of_word, of_pair = _keyed(_unstepped(block["vocabulary"]), tokens, lengths)
        pair, word = totals[of_pair], totals[of_word[tokens]]
        first = np.zeros(len(tokens), bool)
        first[_firsts(lengths)] = True
        context = np.concatenate(([1], word[:-1])) if len(word) else word
        found = (pair >= least) & ~first
        logs = np.log10(np.where(found, pair / context, np.where(first, 1.0, backoff) * word / max(n_all, 1)))
        there = np.frombuffer(block["known"], np.uint8).astype(bool)
        ids = pd.arrays.IntegerArray(np.frombuffer(block["ids"], np.int64).copy(), ~there)
        return pd.DataFrame({"doc_id": ids, "n_words": lengths, "score": np.bincount(doc, logs, len(lengths)), "n_backoff": np.bincount(doc, ~found & ~first, len(lengths)).astype(np.int64)})

    answers = answered(asked(blocks), n_blocks, parts)
    summed = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add_up, "doc_id long, n_words long, score double, n_backoff long")
    some = F.col("n_words") > 0
    return summed.select("doc_id", "n_words", F.when(some, F.col("score")).alias("score"), F.when(some, F.col("score") / F.col("n_words")).alias("mean_score"), "n_backoff")
