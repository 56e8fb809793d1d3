import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lucerna.llm.crf import NEVER, Crf, likelihood, train
from lucerna.llm.registry import QUERIES
from lucerna.llm.secret_scan import SLOTS, TOKEN, _id, _number, _of_shape, _own, _shape, base_spans, featured, file_features, fit, found_secrets, made_up, pieces_of, redacted, scan, scan_texts, tags_of_texts, training_documents, windows_of

from .helpers import awkward, empty


def slow_base(text):
    out = []
    for order, (kind, pattern, least) in enumerate((("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24))):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [(a, b, k) for a, _, b, k in sorted(out)]


PIECES = ["token", "=", ":", " ", '"', "'", "api_key", "ApiKey", "PASSWORD", "secret", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 3, "abc", "é", "\n", "toKen", "paſſword", "x-y.z/12345"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert base_spans(text) == slow_base(text)


def slow_ids(text, source):
    """Feature ids of all tokens, one at a time."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    own = [_own(text[a:b]) for a, b in tokens]
    about = file_features(text, sum(o[7] for o in own))
    word = lambda i: own[i][5] + 1 if 0 <= i < len(own) else 0
    shape = lambda i: own[i][6] + 1 if 0 <= i < len(own) else 0

    def joined(slot, *parts):
        h = slot * 0x9E3779B97F4A7C15 % 2**64
        for x in parts:
            h = (h ^ x) * 0xBF58476D1CE4E5B9 % 2**64
            h ^= h >> 31
        return 1 + h % (2**15 - 1)

    out = []
    for i, (a, _) in enumerate(tokens):
        first = "start" if not TOKEN.search(text[text.rfind("\n", 0, a) + 1 : a]) else "within"
        out.append([*own[i][:5], joined(5, word(i - 1)), joined(6, word(i - 2), shape(i - 1)), joined(7, word(i + 1)), joined(8, shape(i - 1), shape(i)), joined(9, shape(i), shape(i + 1)), _id(10, about), _id(11, source or ""), _id(12, first), _id(13, "")])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "x1", "k=v", "a" * 25, "é", '{"k":"v"}', "\n", "\n\n ", "(", "A" * 70]), max_size=25).map(" ".join))
def test_every_token_has_its_features(text):
    assert featured(text, "s").tolist() == slow_ids(text, "s")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcABCéÉß中ª0.:-'", min_size=1, max_size=8))
def test_words_have_the_features_of_any_token(token):
    """The short way for plain words gives what the long one does."""
    digits, upper, lower = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    want = _of_shape(_shape(token), len(token), digits, upper > 0, lower > 0)
    got = _own(token)
    assert (*got[:3], got[6]) == want and got[5] == _number(token.strip(".:=").lower())


def test_long_tokens_are_read_to_their_end():
    assert _own("a" * 500) != _own("a" * 499 + "7") and _own("ab" * 300)[4] != _own("ab" * 299 + "ac")[4]


def test_windows_cover_every_token_once():
    for n in (0, 1, 255, 272, 273, 512, 1000, 5000):
        kept = [i for _, _, a, b in windows_of(n) for i in range(a, b)]
        assert kept == list(range(n)) and all(low <= a and b <= high for low, high, a, b in windows_of(n))


def test_tags_of_windows_are_those_of_whole_texts():
    """A long text gets the tags that one Viterbi pass over all of it gives, but for ties beyond the context."""
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["the", "of", "token", "key", "4f9a2c", "x", "Zq81Lk22pQ"], 3000))
    model = Crf(rng.normal(size=(1 << 15, 3)), Crf.zero(1).moves + rng.normal(size=(3, 3)), Crf.zero(1).starts)
    ids = featured(text, None)
    whole = model.decode(ids[None], np.array([len(ids)]))[0]
    assert (tags_of_texts(["", text, "a b"], [None] * 3, model)[1] == whole).mean() > 0.999


def test_pieces_hold_all_secrets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        tags = np.zeros(rng.integers(1, 400), np.int8)
        for i in rng.integers(0, len(tags), rng.integers(0, 6)):
            tags[i] = 1
        parts = pieces_of(tags)
        assert all(any(a <= i < b for a, b in parts) for i in np.flatnonzero(tags)) and all(0 <= a < b <= len(tags) and b - a <= 40 for a, b in parts)


def random_model(rng, n=40):
    model = Crf.zero(n)
    return Crf(rng.normal(size=model.weights.shape), model.moves + rng.normal(size=(3, 3)), model.starts + rng.normal(size=3))


def chain_score(model, ids, tags):
    s = model.emissions(ids)
    return model.starts[tags[0]] + sum(s[i, t] for i, t in enumerate(tags)) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:]))


def test_viterbi_and_likelihood_against_all_taggings():
    rng = np.random.default_rng(2)
    model, ids, lengths = random_model(rng), rng.integers(1, 40, (4, 5, 3)), np.array([5, 3, 1, 4])
    gold = np.array([[0, 1, 2, 0, 1], [1, 2, 2, 0, 0], [1, 0, 0, 0, 0], [0, 0, 1, 1, 0]])
    decoded, value = model.decode(ids, lengths), 0.0
    for k, n in enumerate(lengths):
        every = {t: chain_score(model, ids[k, :n], t) for t in itertools.product(range(3), repeat=int(n))}
        assert tuple(decoded[k, :n]) == max(every, key=every.get) and not decoded[k, n:].any()
        value += every[tuple(gold[k, :n])] - np.log(sum(np.exp(v - max(every.values())) for v in every.values())) - max(every.values())
    assert likelihood(model, ids, gold, lengths)[0] == pytest.approx(value / 4)


def test_gradient():
    rng = np.random.default_rng(3)
    model, ids, lengths = random_model(rng, 9), rng.integers(1, 9, (3, 4, 2)), np.array([4, 2, 3])
    gold = np.array([[0, 1, 2, 2], [1, 1, 0, 0], [0, 0, 1, 0]])
    grad = likelihood(model, ids, gold, lengths)[1]
    for part, at in (("weights", (4, 1)), ("weights", (2, 2)), ("moves", (1, 2)), ("starts", (0,))):
        x = getattr(model, part)
        x[at] += 1e-5
        up = likelihood(model, ids, gold, lengths)[0]
        x[at] -= 2e-5
        down = likelihood(model, ids, gold, lengths)[0]
        x[at] += 1e-5
        assert getattr(grad, part)[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_training_learns_and_never_breaks_the_constraint():
    rng = np.random.default_rng(6)
    ids = rng.integers(1, 4, (200, 6, 1))
    tags = np.zeros((200, 6), np.int8)
    for k, t in itertools.product(range(200), range(6)):
        tags[k, t] = 0 if ids[k, t, 0] == 1 else 2 if t and tags[k, t - 1] and ids[k, t, 0] == 3 else 1
    model = train(ids, tags, np.full(200, 6), 4)
    assert (model.decode(ids, np.full(200, 6)) == tags).mean() > 0.99 and model.moves[0, 2] == NEVER


def test_query_matches_brute_force_and_adds_spans_apart(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = slow_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, _, k in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert [s for s in spans if s[2] != "crf"] == want and spans == sorted(spans, key=lambda s: s[0])
        assert not any(a < y and x < b for a, b, k in spans if k == "crf" for x, y, _ in want)


def test_added_spans_on_secrets_held_out_of_the_fit(spark, sf_dir):
    """Made-up secrets put into documents that the field has not learned from: recall of them, and precision of what it adds."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = fit(docs.filter("doc_id % 3 > 0"))
    assert model is not None and model.weights.shape == (1 << 15, 3)
    rng, texts, places = np.random.default_rng(77), [], []
    for r in docs.filter("doc_id % 3 = 0").orderBy("doc_id").collect():
        words = (r.text or "").split(" ")[:400]
        at = int(rng.integers(0, len(words) + 1))
        lead = ["my passphrase is", "credential:", "auth =", "the key"][rng.integers(4)]
        before = " ".join([*words[:at], lead, ""])
        value = made_up(rng)
        texts.append(before + value + " " + " ".join(words[at:]))
        places.append((len(before), len(before) + len(value)))
    hit = wrong = sought = 0
    for text, (a, b), spans in zip(texts, places, scan_texts(texts, [None] * len(texts), model)):
        added = [s for s in spans if s[2] == "crf"]
        if any(x < b and a < y for x, y, k in spans if k != "crf"):
            continue  # a base pattern has it
        sought += 1
        hit += any(x < b and a < y for x, y, _ in added)
        wrong += sum(not (x < b and a < y) for x, y, _ in added)
    print(f"recall {hit} of {sought}, {wrong} false spans")
    assert sought > 100 and hit >= 0.8 * sought and hit >= 0.8 * (hit + wrong)
    plain = "Them thering of the atner was 12 and 1999 to the ones"
    assert scan_texts([plain, ""], ["src1", None], model) == [[], []]
    assert redacted("a token = abcdefgh b", base_spans("a token = abcdefgh b")) == "a [SECRET] b" and SLOTS == 14


def test_rare_secrets_are_learned_from(spark):
    """One document of many has a base span: the sample holds it."""
    rows = [(i, "plain words of no interest " * 3, "s") for i in range(400)] + [(999, "here token = abc123def456 it is", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert training_documents(docs, 20).filter("text like '%token%'").count() == 1 and training_documents(docs, 20).count() == 11
    assert fit(docs, 20) is not None and fit(docs.filter("doc_id < 400"), 20) is None


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert found_secrets(docs).count() == 11 and found_secrets(empty(spark)).count() == 0
    out = scan(docs, None)
    assert out.columns == [*docs.columns, "spans"] and out.filter("size(spans) > 0").count() == 0
    hot = spark.createDataFrame([(i, "secret: abcdef123 " * 3, None) for i in range(5)], "doc_id long, text string, source string")
    assert {r.n_assign for r in found_secrets(hot).collect()} == {3}
