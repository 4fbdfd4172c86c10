"""Brute-force versions and round trips of what needs no Spark."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import _words, ann, quality, rules, sentencepieces, simhash, token_counts, token_files, toxicity
from textloom.llm._linear import Sparse, ftrl, sigmoid
from textloom.llm._words import words_of

TEXTS = ["", " ", "a", "  two  words ", "naïve café – ünïcode 日本語 😀", "x" * 300, "a\n\nb\tc\r\n", "<|endoftext|> and <|startoftext|>", "it's we'll THE End...!!", "▁under▁", "no break 　 wide", "́combining é"]


def random_texts(n, seed=1, alphabet="abcdefghijklmnop qrstuvwxyz   ABC019.,;:!?'\"-_()<>|&äößéñç\n\t日😀"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(n)]


# words


@settings(max_examples=80)
@given(st.lists(st.text(alphabet="aB é\n\t.", max_size=20), max_size=6))
def test_words_are_those_of_split(texts):
    data = [t.encode() for t in texts]
    w = words_of(data)
    got = [(int(d), bytes(w.buffer[s:e])) for d, s, e in zip(w.doc, w.start, w.end, strict=True)]
    assert got == [(d, x) for d, t in enumerate(data) for x in t.split()]
    by = {}
    for (_, word), h in zip(got, w.hash.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


# 1


def test_quantiser_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16)) + rng.normal(size=(20, 16)).repeat(100, 0) * 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books, eta = ann.fit(x)
    codes = ann.encode(x, books, eta).T.copy()
    ids = np.arange(len(x))
    hits = 0
    for q in x[:50]:
        want = set(np.argsort(-(x @ q))[:5])
        hits += len(want & set(ids[ann.best(ann.scan(codes, ann.tables(q, books)), ids, 100)]))
    assert hits >= 0.95 * 250


def test_anisotropic_codes_keep_parallel_error_smaller():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books, eta = ann.fit(x)
    assert eta > 0
    parts = np.arange(8)
    loss = []
    for e in (1.0, 8.0):
        c = ann._assign(x, books, e)
        r = (books[parts, c].reshape(len(x), -1) - x)
        loss.append((np.abs((r * x).sum(1)).mean(), (r**2).sum(1).mean()))
    assert loss[1][0] < loss[0][0] and loss[1][1] >= loss[0][1]


def test_best_breaks_ties_by_id():
    s = np.array([1, 2, 2, 2, 0], np.float32)
    assert ann.best(s, np.array([9, 8, 3, 5, 1]), 2).tolist() == [2, 3]


# 3


def brute_repeats(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(covered)


@settings(max_examples=150)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=24))
def test_repeated_words(words):
    assert rules.repeated_words(words) == brute_repeats(words)


def test_line_rules():
    f = lambda line: rules.fails(line, line.split())
    assert f("home | news | about | contact") == "navigation"
    assert f("one two three four five six seven eight nine - ten.") is None
    assert f("BUY!! NOW!! CHEAP!!") == "punctuation" and f("short one") == "punctuation" and f("Short one.") is None
    assert f("Please accept our Cookie settings to go on here.") == "boilerplate"
    assert f("Please see the catalog in the library.") is None and f("You may log in here now, dear reader.") == "boilerplate"
    text = "Good line with several words.\nhome | news | about\nAnother good one follows here."
    assert rules.clean(text) == ("Good line with several words.\nAnother good one follows here.", 5)
    assert rules.measures("") == (0, 0, 0, 0, 0)
    assert rules.measures("é #a\né #a\n\n \n") == (4, 6, 2, 1, 0)


# 4


def test_token_counts_are_the_library_s():
    path = token_counts.default_vocabulary()
    texts = TEXTS + random_texts(300)
    want = [len(e.ids) for e in token_counts._library(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count(path, texts) == want


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (100, 16), (37, 1)])
def test_splices_give_whole_counts(chunk, overlap):
    path = token_counts.default_vocabulary()
    texts = [t for t in TEXTS + random_texts(120, 2) if t]
    texts += ["y" * 900, "ab " * 300, " " * 500, "word " * 30 + "z" * 400 + " tail <|endoftext|> end" * 9, "日本語" * 200]
    want = [len(e.ids) for e in token_counts._library(path).encode_batch(texts, add_special_tokens=False)]
    assert [token_counts.spliced(path, t, chunk, overlap) for t in texts] == want


def test_very_long_texts_count_as_the_library_s():
    path = token_counts.default_vocabulary()
    r = random.Random(6)
    texts = [" " * 10**6, "\n" * 10**6, "".join(r.choice("abcdefgh") for _ in range(10**6)), "日本語" * 20_000, " \n" * 50_000, "é word <|endoftext|> " * 20_000]
    want = [len(token_counts._library(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count(path, texts) == want


def test_splices_with_the_library_s_own_offsets(monkeypatch):
    path = token_counts.default_vocabulary()
    monkeypatch.setattr(token_counts, "_fast", lambda p: None)
    texts = random_texts(60, 3) + ["word and word " * 60]
    want = [len(e.ids) for e in token_counts._library(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count(path, texts, 50, 8) == want


# 5


def test_pieces_are_the_library_s():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    e = sentencepieces.Encoder(sentencepieces.default_model())
    texts = TEXTS + random_texts(400, 5) + ["<s>", "<0x41>", "   ", "\n", "word  two   three    four     ."]
    got = [np.frombuffer(x, "<i4").tolist() for x in e.encode(texts)]
    assert got == sp.encode(texts)
    assert [e.pieces.decode(x) for x in got] == [sp.decode(x) for x in got]
    plain = [t for t in texts if "▁" not in t]
    assert [e.pieces.decode(np.frombuffer(x, "<i4").tolist()) for x in e.encode(plain)] == plain


@pytest.mark.parametrize("kind", ["letters", "one letter", "spaces", "line feeds", "ideographs", "zero bytes"])
def test_long_texts_without_white_space_take_near_linear_time(kind):
    import time

    import sentencepiece

    r = random.Random(4)
    text = {
        "letters": "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(10**6)), "one letter": "a" * 200_000, "spaces": " " * 200_000,
        "line feeds": "\n" * 10**6, "ideographs": "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(300_000)), "zero bytes": "\0ab" * 10_000,
    }[kind]
    e = sentencepieces.encoder(sentencepieces.default_model())
    began = time.process_time()
    got = np.frombuffer(e.encode([text])[0], "<i4")
    assert time.process_time() - began < 10
    assert got.tolist() == sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model()).encode(text)
    assert e.pieces.decoded(got, np.array([0, len(got)])) == [text]


def test_runs_merge_alike_in_tables_and_by_heap():
    p = sentencepieces.encoder(sentencepieces.default_model()).pieces
    r = random.Random(5)
    for n in (2, 3, 5, 17, 64, 65, 200):
        text = "".join(r.choice("abcdertionhs") for _ in range(n))
        ids, at = [], 0
        for k in filter(None, p.merged(text)):
            ids.append(p.ids.get(text[at : at + k], p.single.get(text[at : at + k])))
            at += k
        assert np.frombuffer(p.segments([text])[0], "<i4").tolist() == ids


def test_suffix_array_finds_every_occurrence():
    p = sentencepieces.Encoder(sentencepieces.default_model()).pieces
    text = "▁the▁other▁▁there"
    place, length, piece = p.edges(np.array([ord(c) for c in text], np.uint32))
    got = sorted(zip(place.tolist(), piece.tolist(), strict=True))
    want = sorted((k, int(i)) for i in p.longer for k in range(len(text)) if text.startswith(p.text[i], k))
    assert got == want and (np.diff(place) >= 0).all()


# 7


def test_word_ids_are_the_library_s():
    e = token_files.encoder(token_files.default_vocabulary())
    texts = TEXTS + random_texts(400, 7)
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want
    assert [np.frombuffer(e.encode([t])[0], e.kind).tolist() for t in texts] == want


@settings(max_examples=60)
@given(st.lists(st.integers(0, 10**6), max_size=700))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    u = int(v[-1]) if len(v) else 0
    data = token_files.ef_encode(v, u)
    ef = token_files.EliasFano(memoryview(data))
    assert (ef.all() == v).all() and [ef.select(i) for i in range(len(v))] == v.tolist()
    some = np.arange(0, len(v), 3)
    assert (ef.selects(some) == v[some]).all()
    with pytest.raises(IndexError):
        ef.select(len(v))


def test_elias_fano_is_small():
    v = np.arange(0, 10**6, 100)
    assert len(token_files.ef_encode(v, 10**6)) * 8 < len(v) * (2 + np.log2(100) + 1)


def test_shard_round_trip():
    docs = [np.array([5, 6, 2], np.uint16), np.array([2], np.uint16), np.array([40_000, 2], np.uint16)]
    s = token_files.Shard(token_files.shard_bytes([None, 7, 1 << 40], [d.tobytes() for d in docs], 2))
    assert [s.doc_id(i) for i in range(3)] == [None, 7, 1 << 40] and [s.tokens(i).tolist() for i in range(3)] == [d.tolist() for d in docs]
    with pytest.raises(ValueError):
        token_files.Shard(b"x" * 100)


# 8


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for t in TEXTS + random_texts(60, 8):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_golay_code():
    parities, errors = simhash.golay()
    words = (np.arange(4096) << 11) | parities
    weights = np.bitwise_count(words)
    assert set(weights.tolist()) == {0, 7, 8, 11, 12, 15, 16, 23}
    v = np.random.default_rng(0).integers(0, 1 << 23, 500)
    far = np.bitwise_count(v[:, None] ^ words[None, :])
    for k, row in zip(simhash.golay_keys(v), far, strict=True):
        assert {x for x in k.tolist() if x >= 0} == set(np.flatnonzero(row <= 4).tolist())


def test_fingerprints_within_three_bits_share_a_key():
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63 - 1, 400)
    for flips in (0, 1, 2, 3):
        other = base.view(np.uint64).copy()
        for k in range(len(other)):
            for b in r.choice(64, flips, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        a, ka = simhash.keys_of(base)
        b, kb = simhash.keys_of(other.view(np.int64))
        left = set(zip(a.tolist(), ka.tolist(), strict=True))
        assert {i for i, _ in left & set(zip(b.tolist(), kb.tolist(), strict=True))} == set(range(len(base)))


def test_forest_keeps_every_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 5).repeat(12)
    x = np.unique(base ^ (1 << r.integers(0, 8, len(base))) ^ (1 << r.integers(0, 8, len(base))))
    edges = list(simhash.forest(x, 3))
    root = {int(v): int(v) for v in x}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and find(a) != find(b)
        root[find(b)] = find(a)
    for a in x.tolist():
        for b in x.tolist():
            if bin(a ^ b).count("1") <= 3:
                assert find(a) == find(b)


# 2 and 9


def plain_features(text):
    """The classifier's features word by word, in plain Python."""
    def mixed(h, salt):
        h ^= salt
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * c % 2**64
        return h ^ h >> 33

    def polynomial(data):
        return sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(data)) % 2**64

    def shape(word):
        kinds = [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in word]
        return polynomial([b for k, b in enumerate(kinds) if not k or kinds[k - 1] != b])

    words = text.encode().split()
    h = [polynomial(w) for w in words]
    s = [2**64 - 1 - shape(w) if k and h[k] == h[k - 1] else shape(w) for k, w in enumerate(words)]
    k1, k2, k3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
    out = [mixed(x, 1) for x in h] + [mixed(x, 3) for x in s]
    for x, salt in ((h, 2), (s, 4)):
        out += [mixed((b * k1 + a * k2) % 2**64, salt) for a, b in zip(x, x[1:])]
    out += [mixed((c * k1 + b * k2 + a * k3) % 2**64, 5) for a, b, c in zip(s, s[1:], s[2:])]
    return [x >> (64 - quality.BITS) for x in out]


def test_quality_scores_are_those_of_plain_python(monkeypatch):
    w = np.random.default_rng(7).normal(size=(1 << quality.BITS) + 1)
    rows = TEXTS + random_texts(40, 11) + ["a A a a b1 b1 b22"]
    want = []
    for t in rows:
        f = plain_features(t)
        want.append(1 / (1 + np.exp(-(sum(w[f]) * quality.SCALE / max(len(f), 1) + w[-1]))))
    data = [t.encode() for t in rows]
    assert np.allclose(quality.scores(data, w), want, atol=1e-9)
    # long texts go by blocks and slices of words, with the same result
    for m, name, value in ((_words, "BLOCK", 64), (quality, "BLOCK", 64), (quality, "WORDS", 5)):
        monkeypatch.setattr(m, name, value)
    monkeypatch.setattr(quality, "blocks", lambda t: _words.blocks(t, 400))
    assert np.allclose(quality.scores(data, w), want, atol=1e-9)


def test_toxicity_terms_are_those_of_plain_python(monkeypatch):
    rows = random_texts(30, 12) + ["Bad bad word wording words x"]
    data = [t.encode() for t in rows]
    x, words = toxicity.counted(data, toxicity.FINE)
    want = []
    for t in data:
        cut = [w.lower() for w in t.translate(toxicity._PART).split()]
        count = {}
        for key in [(0, w) for w in cut] + [(n, w[:n]) for n in toxicity.BEGINNINGS for w in cut if len(w) >= n]:
            count[key] = count.get(key, 0) + 1
        want.append((len(cut), sorted(count.values())))
    assert [(int(n), sorted(x.value[a:b].tolist())) for n, a, b in zip(words, x.ptr[:-1], x.ptr[1:], strict=True)] == want
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(toxicity, "blocks", lambda t: _words.blocks(t, 400))
    y, again = toxicity.counted(data, toxicity.FINE)
    assert (again == words).all() and all((getattr(x, c) == getattr(y, c)).all() for c in ("ptr", "index", "value"))


def test_blocks_of_long_texts_keep_words():
    for t in random_texts(30, 13):
        data = (t + " ").encode() * 9
        for most in (300, 500):
            assert [w for b in _words.blocks(data, most) for w in b.split()] == data.split()
    long = b"x" * 900
    got = [b.strip() for b in _words.blocks(long + b" b " + long, 100) if b.strip()]
    assert len(got) == 3 and got[1] == b"b" and got[0] == got[2] and got[0].startswith(b"x" * 16) and len(got[0]) < 100


def test_a_very_long_text_takes_bounded_memory():
    import resource

    text = ("some words of a very long text, Again and again! " * 1_400_000).encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    w = np.zeros((1 << quality.BITS) + 1)
    assert quality.scores([text], w)[0] == 0.5
    known = np.zeros(1 << toxicity.BITS, bool)
    assert toxicity.counted([text], toxicity.BITS, known)[1][0] == 14_000_000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1_500


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(4)
    rows, feats, y = [], [], []
    for k in range(600):
        good = k % 2
        words = rng.integers(100, 1000, 20).tolist() + ([1] if good else [2])
        rows += [k] * len(words)
        feats += words
        y.append(good)
    x = Sparse.of(np.array(rows), np.array(feats), 600)
    w = ftrl(x, np.array(y, float), 1024, alpha=0.5, l1=1.0, l2=0.0, epochs=3)
    p = sigmoid(x.dot(w) + w[-1])
    assert ((p > 0.5) == np.array(y)).mean() > 0.98 and (w != 0).sum() < 300


def test_label_model_learns_accuracies_and_discounts_copies():
    rng = np.random.default_rng(5)
    n = 4000
    y = rng.random(n) < 0.2
    m = toxicity.OWN + toxicity.DEALT + 5
    v = np.zeros((n, m), np.int8)
    for k, rate in enumerate((0.8, 0.7, 0.6, 0.5)):
        v[:, k] = np.where(y, rng.random(n) < rate, rng.random(n) < 0.003)  # voters are precise: they are mined so
    v[:, 4] = v[:, 3]  # a copy adds nothing
    v[:, -1] = v[:, :5].sum(1) == 0
    known = np.arange(0, n, 10)
    p, rates, weight = toxicity.label_model(v, known, y[known].astype(float))
    assert ((p > 0.5) == y).mean() > 0.97
    assert abs(rates[1, 0] - 0.8) < 0.05 and weight[4] < 0.7 and abs(weight[3] - weight[4]) < 1e-6
