"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans to theirs.

The field tags every token of a text as secret begin, inside or outside, from its shape, neighbouring words and features
of the whole file, decoded by Viterbi. Tokens are runs of characters other than white space, quotes, brackets and commas.
Texts of more than ``WINDOW`` tokens are decoded in windows of that many, each with ``CONTEXT`` tokens on either side.

The field is fitted on ``max_rows`` documents at most (the documented bound of the fit), chosen by a hash of their id:
half of them have base spans, wherever in the table they are. Base spans are its tags; ``SECRETS`` of a document are also
replaced by ``VARIANTS`` made-up secrets of other forms, and each document without one gets a made-up one. It learns from pieces of ``PIECE`` tokens around secrets and
from two others of each document, ``max_pieces`` at most, of which those with tags come first. Word features are dropped
at random, so that shape alone can carry a tag. Spans that the field adds never overlap a base span, and base spans
always stay.

Defined cases: a null text counts as empty and has no spans; positions are code points; repeated rows get the same
answer; without any base span in the sample nothing is added; an empty table gives an empty result. Extra columns
are kept by ``scan``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .crf import BEGIN, INSIDE, Crf, train

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

TOKEN = re.compile(r"[^\x20\x09-\x0D\"'`,;()\[\]{}<>]+")
#: The base patterns as one pattern, to find documents to learn from.
ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
WINDOW, CONTEXT = 256, 16
HASH_BITS = 15
MAX_ROWS = 8_000
MAX_PIECES = 4_000
PIECE = 40
#: Secrets of a document that are varied in the fit, and made-up variants of each.
SECRETS, VARIANTS = 4, 6
#: Tokens whose features are held between texts, about, and their characters.
HELD, HELD_CHARS = 300_000, 8_000_000
EDGES = "\"'`,;()[]{}<>"

_IS_HEX = np.isin(np.arange(256), [*range(48, 58), *range(97, 103)])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    other = np.flatnonzero(~_IS_HEX[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)])
    if np.diff(other, prepend=-1, append=len(text.encode("utf-8", "surrogatepass"))).max(initial=0) > HEX_CHARS:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(1 << 16)
def _id(slot: int, value: str) -> int:
    return 1 + zlib.crc32(f"{slot}:{value}".encode("utf-8", "surrogatepass")) % ((1 << HASH_BITS) - 1)


def _number(value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass"))


def _shape(token: str) -> str:
    shape = re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", token)))
    shape = re.sub(r"(.{1,2}?)\1+", r"\1+", shape)
    return shape if len(shape) <= 12 else f"{shape[:10]}~{len(shape).bit_length()}{_number(shape[10:]) % 8}"


@lru_cache(1 << 14)
def _of_shape(shape: str, n: int, digits: int, upper: bool, lower: bool) -> tuple[int, int, int, int]:
    """Feature ids of shape, length and mix, and the shape's number."""
    mix = f"{4 * digits // n}{digits > 0}{upper}{lower}{min(9, n.bit_length())}"
    return _id(0, shape), _id(1, str(min(40, n))), _id(2, mix), _number(shape)


#: Feature ids by tenths of a token's characters that differ, and its length in bits.
_SPREAD = [[_id(3, f"{tenths}:{bits}") for bits in range(32)] for tenths in range(11)]


def _own(token: str) -> tuple[int, ...]:
    """Of a whole token: feature ids of its shape, length, mix, spread and word; numbers for its word and its shape; is it
    of a form that prose seldom has?"""
    n, plain = len(token), token[:-1] if token[-1] == "." else token
    capital = "A" <= token[0] <= "Z"
    if plain.isalpha() and (plain[1:] if capital else plain).islower():  # most words, also at the end of a sentence
        shape, size, mix, shape_number = _of_shape(("Aa" if capital else "a") + token[len(plain) :], n, 0, capital, True)
        word, odd = plain.lower(), n >= 20
    else:
        digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
        shape, size, mix, shape_number = _of_shape(_shape(token), n, digits, upper > 0, lower > 0)
        word, odd = token.strip(".:=").lower(), n >= 20 or digits > 0 or "=" in token or ":" in token
    number = _number(word)
    spread = _SPREAD[10 * len(set(token)) // n][min(31, n.bit_length())]
    return shape, size, mix, spread, 1 + (number * 0x9E3779B1 >> 12) % ((1 << HASH_BITS) - 1), number, shape_number, odd


class _Held:
    """What ``_own`` gives for the tokens seen lately, as rows of a table."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.numbers = array("q")
        self.chars = 0

    def of(self, tokens: list[str]) -> np.ndarray:
        """Rows for each token."""
        if len(self.place) > HELD or self.chars > HELD_CHARS:
            self.__init__()
        for t in set(tokens).difference(self.place):
            self.place[t] = len(self.place)
            self.numbers.extend(_own(t))
            self.chars += len(t)
        rows = np.frombuffer(self.numbers, np.int64).reshape(-1, 8)
        return rows[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))]


_held = _Held()


SLOTS = 14
#: Slots of words: those that training drops at random.
WORD_SLOTS = (4, 5, 6, 7, 11)


def _joined(slot: int, *parts: np.ndarray) -> np.ndarray:
    """Feature ids of pairs of numbers."""
    h = np.full(len(parts[0]), slot * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for x in parts:
        h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (1 + h % np.uint64((1 << HASH_BITS) - 1)).astype(np.int32)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places before (after, if negative); zero beyond the text."""
    out = np.zeros_like(x)
    if abs(by) < len(x):
        out[max(0, by) : len(x) + min(0, by)] = x[max(0, -by) : len(x) - max(0, by)]
    return out


def featured(text: str, source: str | None, about: str | None = None) -> np.ndarray:
    """Feature ids (token, slot) of all tokens of a text. Slots: own shape, length, mix, spread and word; words and shapes
    around; the file, its source, beginnings of lines; no feature but the bias."""
    tokens, begins = [], []
    for line in text.split("\n"):
        begins.append(len(tokens))
        tokens += TOKEN.findall(line)
    if not tokens:
        return np.zeros((0, SLOTS), np.int32)
    own = _held.of(tokens)
    word, shape = own[:, 5].astype(np.uint64) + np.uint64(1), own[:, 6].astype(np.uint64) + np.uint64(1)
    out = np.empty((len(tokens), SLOTS), np.int32)
    out[:, :5] = own[:, :5]
    one, two, after = _shifted(word, 1), _shifted(word, 2), _shifted(word, -1)
    before, following = _shifted(shape, 1), _shifted(shape, -1)
    out[:, 5], out[:, 6], out[:, 7] = _joined(5, one), _joined(6, two, before), _joined(7, after)
    out[:, 8], out[:, 9] = _joined(8, before, shape), _joined(9, shape, following)
    first = np.zeros(len(tokens) + 1, np.int64)
    first[begins] = 1
    out[:, 10] = _id(10, file_features(text, int(own[:, 7].sum())) if about is None else about)
    out[:, 11] = _id(11, source or "")
    out[:, 12] = np.where(first[:-1], _id(12, "start"), _id(12, "within"))
    out[:, 13] = _id(13, "")
    return out


def file_features(text: str, n_odd: int) -> str:
    """What holds of the whole file: its length, how many odd tokens it has, and whether it speaks of keys."""
    low = text.lower()
    return f"{len(text).bit_length()} {min(5, n_odd.bit_length())} {'key' in low} {'secret' in low or 'passw' in low or 'token' in low}"


def tags_of(spans: list[tuple[int, int]], secrets: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of tokens from secret spans: the first token that a span touches begins, unless it is in one already."""
    tags = np.zeros(len(spans), np.int8)
    starts, ends = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    for a, b, _ in secrets:
        low, high = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
        for i in range(low, high):
            tags[i] = tags[i] or (INSIDE if i > low else BEGIN)
    return tags


# Words that announce secrets beyond those of the base patterns, and starts of well-known tokens.
ANNOUNCE = ("credential", "auth", "bearer", "passphrase", "private_key", "access_key", "client_secret", "key", "pwd", "secret", "token", "password")
STARTS = ("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "eyJ", "AKIA", "pk_test_")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SETS = ("0123456789abcdef", "0123456789ABCDEF", _LETTERS + _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789+/", _LETTERS + "0123456789", _LETTERS.upper() + "0123456789")


def made_up(rng: np.random.Generator) -> str:
    """A random secret: characters of one set, at times with a known start, parts or padding."""
    chars = _SETS[rng.integers(len(_SETS))]
    value = "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(16, 49)))
    if rng.random() < 0.35:
        value = STARTS[rng.integers(len(STARTS))] + value
    if rng.random() < 0.15:
        value = value[:12] + "." + value[12:]
    return value + "=" * int(rng.integers(1, 3)) if rng.random() < 0.1 else value


def variant(text: str, span: tuple[int, int, str], rng: np.random.Generator) -> tuple[str, tuple[int, int, str]]:
    """The text around a secret with another secret in its place, and where that stands."""
    a, b, _ = span
    before, after = text[max(0, a - 200) : a].rstrip("\"'"), text[b : b + 200].lstrip("\"'")
    quote = ("", '"', "'")[rng.integers(3)]
    lead = ""
    if rng.random() < 0.6:
        lead = ANNOUNCE[rng.integers(len(ANNOUNCE))] + (" = ", ": ", "=", ":", " ")[rng.integers(5)]
    whole = f"{lead}{quote}{made_up(rng)}{quote}"
    return f"{before}{'' if not before or before[-1].isspace() else ' '}{whole}{'' if not after or after[0].isspace() else ' '}{after}", (len(before) + (bool(before) and not before[-1].isspace()), len(before) + (bool(before) and not before[-1].isspace()) + len(whole), "made")


def with_secret(text: str, rng: np.random.Generator) -> tuple[str, tuple[int, int, str]]:
    """A text with a made-up secret between two of its words, and where that stands."""
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    at = gaps[int(rng.integers(len(gaps)))]
    return variant(text[max(0, at - 400) : at + 400], (at - max(0, at - 400), at - max(0, at - 400), "none"), rng)


def pieces_of(tags: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of ``size`` tokens: around each tagged run that no range before holds, and two others."""
    out, n = [], len(tags)
    for i in np.flatnonzero(tags == BEGIN).tolist():
        if not out or i + 4 > out[-1][1]:
            low = max(0, min(i - size // 2, n - size), min(out[-1][1], i) if out else 0)
            while low < i and tags[low] == INSIDE:
                low += 1
            out.append((low, min(n, low + size)))
    for low in (0, max(0, n // 2)):
        if not tags[low : low + size].any() and low < n:
            out.append((low, min(n, low + size)))
    return out


def _training_rows(batches):
    for batch in batches:
        rows = []

        def add(text, source, secrets, about=None, real=False):
            spans = [m.span() for m in TOKEN.finditer(text)]
            ids, tags = featured(text, source, about), tags_of(spans, secrets)
            for a, b in pieces_of(tags):
                rows.append((bool(tags[a:b].any()), real and bool(tags[a:b].any()), ids[a:b].astype(np.uint16).tobytes(), tags[a:b].tobytes()))

        for text, source in zip(batch["text"], batch["source"], strict=True):
            text = text or ""
            secrets = base_spans(text)
            add(text, source, secrets, real=True)
            rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            about = file_features(text, int(_held.of(TOKEN.findall(text))[:, 7].sum()))
            if not secrets:
                other, place = with_secret(text, rng)
                add(other, source, [place], about if rng.random() < 0.5 else None)
            for k in rng.permutation(len(secrets))[:SECRETS]:
                for _ in range(VARIANTS):
                    other, place = variant(text, secrets[k], rng)
                    add(other, source, [place], about if rng.random() < 0.5 else None)
        yield pd.DataFrame(rows, columns=["tagged", "real", "ids", "tags"])


def padded(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in ids])
    out = np.zeros((len(ids), lengths.max(initial=1), SLOTS), np.int32)
    for k, x in enumerate(ids):
        out[k, : len(x)] = x
    return out, lengths


def training_documents(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, source: documents to learn from, half of them with base spans if there are as many."""
    known = docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.col("text").rlike(ANY_BASE), F.lit(False)).alias("has"))
    known = materialise(known.groupBy("doc_id").agg(F.max("has").alias("has")), "with-secrets")
    half = lambda has, n: known.filter(F.col("has") == F.lit(has)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.col("doc_id").alias("_c_id"))
    chosen = half(True, max_rows - max_rows // 2).unionAll(half(False, max_rows // 2))
    # at most max_rows numbers are sent to the executors
    return materialise(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_c_id")).select("text", "source").repartition(8), "scanned")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_pieces: int = MAX_PIECES) -> Crf | None:
    """The field, learned from the base spans of at most ``max_rows`` documents; None where the table has no secret."""
    made = training_documents(docs, max_rows).mapInPandas(_training_rows, "tagged boolean, real boolean, ids binary, tags binary")
    pieces = materialise(made, "pieces")
    if pieces.filter("real").isEmpty():
        return None
    rows = pieces.orderBy(F.desc("tagged"), F.xxhash64("ids", "tags"), "ids", "tags")
    some = [r for tagged in (True, False) for r in rows.filter(F.col("tagged") == F.lit(tagged)).limit(max_pieces // 2).collect()]
    ids = [np.frombuffer(r["ids"], np.uint16).reshape(-1, SLOTS).astype(np.int32) for r in some]
    tags = [np.frombuffer(r["tags"], np.int8) for r in some]
    x, lengths = padded(ids)
    y = np.zeros(x.shape[:2], np.int8)
    for k, t in enumerate(tags):
        y[k, : len(t)] = t
    rng = np.random.default_rng(4)
    for slot in WORD_SLOTS:
        x[..., slot] *= rng.random(x.shape[:2]) > 0.3
    return train(x, y, lengths, 1 << HASH_BITS)


def _added(text: str, tags: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the tagged runs of a text's tokens, without what overlaps base spans."""
    if not (tags == BEGIN).any():
        return []
    spans, out, i = [m.span() for m in TOKEN.finditer(text)], [], 0
    while i < len(tags):
        if tags[i] != BEGIN:
            i += 1
            continue
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE:
            j += 1
        a, b = spans[i][0], spans[j - 1][1]
        b -= len(text[a:b]) - len(text[a:b].rstrip(EDGES + ".:"))
        if b - a >= ASSIGN_CHARS and not any(x < b and a < y for x, y, _ in base):
            out.append((a, b, "crf"))
        i = j
    return out


def windows_of(n: int) -> list[tuple[int, int, int, int]]:
    """(from, to, first, last) of the windows of ``n`` tokens: tokens from..to are decoded, tags of first..last are kept."""
    if n <= WINDOW + CONTEXT:
        return [(0, n, 0, n)] if n else []
    cores = [(a, min(n, a + WINDOW)) for a in range(0, n, WINDOW)]
    return [(max(0, a - CONTEXT), min(n, b + CONTEXT), a, b) for a, b in cores]


def tags_of_texts(texts: list[str], sources: list[str | None], model: Crf) -> list[np.ndarray]:
    """The tags of all tokens of each text. Windows of like lengths are decoded together."""
    held: dict[int, list[tuple[int, int, int, int, np.ndarray]]] = {}
    tags: list[np.ndarray] = []

    def decode(some):
        ids, lengths = padded([x for *_, x in some])
        for (k, low, a, b, _), found in zip(some, model.decode(ids, lengths), strict=True):
            tags[k][a:b] = found[a - low : b - low]

    for k, text in enumerate(texts):
        ids = featured(text, sources[k])
        tags.append(np.zeros(len(ids), np.int8))
        for low, high, a, b in windows_of(len(ids)):
            size = -(-(high - low) // 32)
            held.setdefault(size, []).append((k, low, a, b, ids[low:high]))
            if len(held[size]) * size >= 1000:
                decode(held.pop(size))
    for some in held.values():
        decode(some)
    return tags


def scan_texts(texts: list[str], sources: list[str | None], model: Crf | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind as listed."""
    found = [base_spans(t) for t in texts]
    if model is None:
        return found
    tags = tags_of_texts(texts, sources, model)
    return [sorted(base + _added(t, x, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for t, x, base in zip(texts, tags, found, strict=True)]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, model: Crf | None) -> DataFrame:
    """``docs`` with spans: kind, start and end of every secret found."""

    @F.pandas_udf(SPANS)
    def each(texts: pd.Series, sources: pd.Series) -> pd.Series:
        got = scan_texts([t or "" for t in texts], list(sources), model)
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in got])

    return docs.withColumn("spans", each("text", "source"))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text)."""
    thin = docs.select("doc_id", "text", "source")
    model = fit(thin)
    with small_batches(docs.sparkSession):
        listed = materialise(scan(thin, model).select("doc_id", "spans"), "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base: Column = F.filter("spans", lambda s: s["kind"] != "crf")
    return listed.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
