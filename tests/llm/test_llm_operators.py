"""Operators over small tables with nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, components, line_dedup, mixing, quality, rules, sentencepieces, simhash, token_counts, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, pos int, __gone string"


@pytest.fixture(scope="module")
def docs(spark):
    line = "This very line is found on many sites of the net."
    data = []
    for k in range(40):
        text = f"{line}\nOwn words of text number {k} stand here, {'and more of them ' * (k % 5)}to the end.\n{line if k % 7 == 0 else 'Another line.'}"
        data.append((k, text, "en", f"s{k % 12:02d}", len(text), 1.0, 1, 1, "x"))
    data += [(40, None, None, "s00", None, None, None, None, None), (41, "", "en", None, 0, None, None, None, None), (42, "word " * 60_000, "de", "s01", 300_000, None, None, None, None)]
    data += [data[3], (None, "no id here", "en", "s02", 10, None, None, None, None), (43, "\n\n \n", "en", "s03", 4, None, None, None, None), (44, "tab\tand\x0bodd\x0cspaces   kept", "fr", "s04", 20, None, None, None, None)]
    return spark.createDataFrame(data, DOCS).cache()


def got(df, *cols):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=key)


def oracle(docs, sql, *cols):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()  # noqa: F841
    r = duckdb.sql(sql)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(x[r.columns.index(c)] for c in cols) for x in r.fetchall()), key=key)


def test_search(spark):
    rng = np.random.default_rng(0)
    data = [(k, rng.normal(size=6).tolist(), 1, "x") for k in range(300)]
    data += [(1000 + k, data[7][1], 1, "x") for k in range(200)]  # a third of the rows are one vector
    data += [(900, None, 1, "x"), (950, [0.0] * 6, 1, "x"), (901, [float("nan")] * 6, 1, "x"), (902, [None] + [1.0] * 5, 1, "x"), (None, [1.0] * 6, 1, "x"), (903, [1.0], 1, "x"), (904, [float("inf")] + [1.0] * 5, 1, "x"), (5, data[5][1], 1, "x")]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>, ids int, q string")
    res = {}
    for r in ann.search(v).collect():
        res.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = {i: np.array(e) for i, e, *_ in data if i is not None and e and len(e) == 6 and None not in e and np.isfinite(e).all() and np.any(e)}
    assert set(res) == {i for i in ok if i % 50 == 0}
    hits = 0
    for q, rows in res.items():
        rows = sorted(rows)
        want = sorted(((-float(ann.cosine(ok[q][None], x[None])[0]), i) for i, x in ok.items() if i != q))[:5]
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        hits += len({r[1] for r in rows} & {i for _, i in want})
        assert all(abs(s - float(ann.cosine(ok[q][None], ok[i][None])[0])) < 1e-12 for _, i, s in rows)
    assert hits >= 0.95 * 5 * len(res)
    assert ann.search(v.limit(0)).count() == 0
    assert ann.search(v.where("vec_id in (0, 1)")).count() == 1


def test_search_is_the_same_over_any_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(4_000)], "vec_id long, embedding array<double>").repartition(5).cache()
    one = got(ann.search(v, every=10, rerank=20))
    assert ann.grid(4_000, 2, 7, 4) == (1, 4) and len(one) == 5 * 400
    for most in (20_000, 9_000):  # bytes a stripe: 2 and 5 stripes, blocks until each core has a cell
        monkeypatch.setattr(ann, "STRIPE_BYTES", most)
        assert ann.grid(4_000, 2, 7, 4)[0] == -(-40_000 // most)
        assert got(ann.search(v, every=10, rerank=20)) == one
    # codes travel once a block, and blocks do not grow with the rows
    monkeypatch.undo()
    stripes, blocks = ann.grid(1_000_000_000, 16, 312_500, 1_000)
    assert stripes * 16 < 10_000 and blocks == -(-1_000 // stripes)


def test_rules_match_the_sql(docs):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept")
    assert got(rules.judge(docs), *cols) == oracle(docs, rules.OP3_SQL, *cols)
    assert rules.judge(docs.limit(0)).count() == 0


def test_token_counts(docs):
    lib = token_counts._library(token_counts.default_vocabulary())
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=lambda r: tuple((x is None, x) for x in r))
    assert got(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(docs).where("over_limit <> (n_tokens > 512)").count() == 0
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rows = sentencepieces.encode(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_pieces == len(r.ids)
    assert sentencepieces.encode(docs.limit(0)).count() == 0


def test_token_files(spark, docs, tmp_path):
    import zlib

    shards = token_files.write(docs.repartition(3), f"file://{tmp_path}/ids", shard_size=4_000)
    assert len(shards) > 1 and token_files.shards_of(f"file://{tmp_path}/ids") == shards
    rows = sorted((tuple(r) for r in token_files.read(spark, shards).collect()), key=lambda r: r[1])
    lib = token_files.encoder(token_files.default_vocabulary()).library
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want
    assert sorted(p.name for p in (tmp_path / "ids").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")) == []
    assert token_files.read(spark, token_files.write(docs.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_line_dedup_matches_the_sql(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = line_dedup.dedup_lines(rows)
    digest = out.select("doc_id", F.col("removed_lines").cast("long"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
    known = [r for r in got(digest) if r[0] != 40]
    assert known == oracle(rows.where("text is not null"), line_dedup.OP6_SQL, "doc_id", "removed_lines", "n_chars", "text_md5")
    assert sum(r[1] for r in known) > 30 and out.columns == [*rows.columns, "removed_lines"]


def test_line_dedup_edges(docs):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[40].text is None and out[41].text == "" and out[None].text == "no id here" and out[43].text == "\n\n \n"
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    first = out[0].text.split("\n")[0]
    assert first.startswith("This very line") and not out[1].text.startswith("This very line")
    assert out[1].score == 1.0 and out[0].removed_lines == 1  # its second occurrence
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_lines_of_one_text_take_linear_time(spark):
    import time

    rows = [(k, "a common line of many words\nown", f"s{k}") for k in range(10)] + [(99, "a common line of many words\n" * 60_000 + "end", "s99")]
    began = time.time()
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 99").first()
    assert out.text == "\nend"[1:] and out.removed_lines == 60_000 and time.time() - began < 30


def test_near_threshold_lines_are_counted_exactly(spark):
    data = [(k, f"line of exactly {n} sites", f"site{k}") for n in (9, 10, 11) for k in range(n)]
    d = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(data)], "doc_id long, text string, source string")
    n = {r[0]: r[1] for r in line_dedup.dedup_lines(d).where("removed_lines > 0").groupBy(F.lit(1)).count().collect()}
    assert n == {1: 9 + 10}


def brute_groups(rows):
    fps = [simhash.fingerprint(r.text or "") for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x.doc_id for k, x in enumerate(rows) if find(k) == find(i) and x.doc_id is not None]
        out.append((r.doc_id, fps[i] - (1 << 64) * (fps[i] >> 63), min(ids, default=None)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def test_near_duplicates_match_brute_force(spark, docs):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 4
    more = [(100 + k, base + " ".join(f"w{j}" for j in range(k)), "en", "s", 1, None, None, None, None) for k in range(12)]
    rows = docs.union(spark.createDataFrame(more, DOCS))
    found = simhash.near_duplicates(rows)
    want = brute_groups(rows.collect())
    assert got(found) == want
    assert len({r[2] for r in want if r[0] and r[0] >= 100}) < 12  # some of them link
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 900), (900, 700), (5, 5), (None, 1), (800, None)]
    e = spark.createDataFrame(chain, "a long, b long").repartition(7)
    roots = dict(tuple(r) for r in components.components(e).collect())
    assert roots == {k: 0 for k in range(1, 201)} | {900: 500, 700: 500}
    assert components.components(e.limit(0)).count() == 0


def test_mixing_matches_the_sql_and_its_terms(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    cols = ("doc_id", "size", "source_size", "target", "taken")
    mine = got(mixing.mix(rows), *cols)
    assert mine == oracle(rows, mixing.OP10_SQL, *cols) == got(mixing.mix(rows.repartition(5)), *cols)
    by = {}
    for r in mixing.mix(rows).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    sizes = {s: x[1] for s, x in by.items()}
    # water filling by rounds, as the terms say
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    for s, (target, _, taken) in by.items():
        assert target == pytest.approx(want[s], rel=1e-9, abs=1e-6) and abs(taken - target) < 1 + 1e-6
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_reruns_agree_with_repeated_and_missing_ids(spark):
    data = [(None if k % 3 == 0 else k % 7, "word " * (k % 11 + 1) + f"t{k % 5}", f"s{k % 2}") for k in range(200)]
    rows = spark.createDataFrame([*data, data[0], data[1], (None, None, None)], "doc_id long, text string, source string")
    cols = ("doc_id", "size", "source_size", "target", "taken")
    want = got(mixing.mix(rows.coalesce(1)), *cols)
    for n in (2, 3, 5):
        assert got(mixing.mix(rows.repartition(n)), *cols) == want


def test_mixed_documents_hold_the_taken_words(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken for r in mixing.mix(rows).collect() if r.taken}
    out = mixing.mixed_documents(spark, rows, "")
    have = {}
    for r in out.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
    assert have == want and out.columns == rows.columns


def test_classifiers_hold_out(spark):
    import zlib

    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(300)]
    data, labels = [], []
    for k in range(900):
        text = " ".join(rng.choice(words, 60)) + "."
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if toxic:
            text += f" grubber{rng.integers(99)} you grubber{rng.integers(99)}"
        data.append((k, text, 1, "x"))
        labels.append((k, int(not bad), int(toxic)))
    data += [(2000, None, 1, "x"), (2001, "", 1, "x"), (None, "text without an id", 1, "x"), data[1], (2002, "long " * 100_000, 1, "x")]
    d = spark.createDataFrame(data, "doc_id long, text string, score int, y string")
    lab = spark.createDataFrame([*labels, (2000, None, None), (None, 1, 1), (2001, 1, 0)], "doc_id long, quality int, toxic int")
    for f, col, fold in ((quality.classify, 1, (4, 2)), (toxicity.toxicity, 2, (3, 1))):
        rows = f(d, lab).collect()
        assert len(rows) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows if r.doc_id is not None)
        truth = {x[0]: x[col] for x in labels}
        held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
        assert np.mean(held) > 0.95
        # labels of the held-out fold change nothing
        flipped = lab.withColumn(("quality", "toxic")[col - 1], F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], 1 - F.col(("quality", "toxic")[col - 1])).otherwise(F.col(("quality", "toxic")[col - 1])))
        assert got(f(d, flipped), "doc_id", "score") == got(f(d, lab), "doc_id", "score")
        assert f(d.limit(0), lab).count() == 0 and f(d, lab.limit(0)).count() == len(data)


def test_rates_from_patterns_are_those_of_votes_at_hand(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 12)) + (" grubber" * (k % 4 == 0)) for k in range(300)] + [None, ""]
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "grubber", "x", 1), (7, texts[7], "x", 1)], "doc_id long, text string, pattern string, count int").repartition(5)
    y = {k: int(k % 4 == 0) for k in range(0, 300, 3)}
    known = spark.createDataFrame([(k, v, texts[k]) for k, v in y.items()], "doc_id long, y int, text string")
    lexicon, weight = toxicity.voters(known)
    patterns = toxicity.vote_patterns(d, known.select("doc_id", "y"), lexicon)
    rows = [(k, t or "") for k, t in [*enumerate(texts), (7, texts[7])]]
    x, words = toxicity._presence([t.encode() for _, t in rows])
    v = toxicity.votes(x, words, lexicon)
    assert patterns.agg(F.sum("count")).first()[0] == len(rows)
    assert sorted(r.pattern for r in patterns.collect() for _ in range(r["count"])) == sorted(b.tobytes() for b in np.packbits(v, axis=1))
    at = np.array([k for k, (i, _) in enumerate(rows) if i in y])
    _, rates, w = toxicity.label_model(v, at, np.array([y[rows[k][0]] for k in at], float))
    assert np.allclose(w, weight)
    assert np.allclose(rates, toxicity.corpus_rates(patterns, weight)[0], atol=1e-9)
    assert toxicity.voters(known.where("y = 0")) is None and toxicity.voters(known.limit(0)) is None


def test_near_copies_match_brute_force(spark, docs):
    import random

    r = random.Random(9)
    words = [f"word{k}" for k in range(400)]
    texts = []
    for base in range(8):
        own = [r.choice(words) for _ in range(150)]
        texts.append(own)
        for edits in (1, 2, 3, 4, 6, 9, 14):
            copy = list(own)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy)
    more = [(200 + k, " ".join(t), "en", "s", 1, None, None, None, None) for k, t in enumerate(texts)]
    rows = docs.union(spark.createDataFrame(more, DOCS)).where("doc_id is null or doc_id <> 42")
    got_ = {x.doc_id: x.component_id for x in simhash.near_copies(rows).collect()}
    known = {x.doc_id: set(simhash.shingle_hashes(x.text or "").tolist()) for x in rows.collect() if x.doc_id is not None}
    parent = {k: k for k in known}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [(a, b) for a in known for b in known if a < b and (known[a] == known[b] or len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b]))]
    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert set(got_) == set(known)
    assert all(find(k) == find(c) for k, c in got_.items())  # nothing joined that has no link
    assert sum(got_[a] == got_[b] for a, b in links) >= 0.97 * len(links)
    kept = simhash.keep_one(spark, rows, "")
    assert kept.columns == rows.columns and kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(spark, docs.limit(0), "").count() == 0


def edited_copies(n, share, seed=3):
    """Texts that are each about ``share`` similar to a last one and less to one another."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    edits = round((1 - share) / (1 + share) * 300 / 5)
    out = []
    for _ in range(n):
        copy = list(base)
        for k in r.sample(range(2, 298, 5), edits):
            copy[k] = f"e{r.randrange(10**9)}"
        out.append(" ".join(copy))
    return [*out, " ".join(base)]


def test_edited_copies_link_through_an_original_of_any_id(spark):
    texts = edited_copies(60, 0.86)
    sets = [simhash.shingle_hashes(t) for t in texts]
    linked = [simhash.similarity(x, sets[-1]) >= 0.8 for x in sets]
    assert all(linked) and max(simhash.similarity(sets[0], x) for x in sets[1:-1]) < 0.8
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.near_copies(rows).collect()}
    assert out == dict.fromkeys(range(61), 0)


def test_no_pair_at_the_threshold_is_lost(spark):
    rows = []
    for k in range(300):
        text = edited_copies(0, 0.8, k)[0].split()
        copy = list(text)
        sets = [simhash.shingle_hashes(" ".join(text))]
        for at in range(2, 298, 5):  # edits as long as the pair stays at 0.8 or more
            copy[at] = f"e{k}x{at}"
            if simhash.similarity(sets[0], simhash.shingle_hashes(" ".join(copy))) < 0.8:
                copy[at] = text[at]
                break
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        assert 0.8 <= simhash.similarity(*(simhash.shingle_hashes(t) for _, t in rows[-2:])) < 0.83
    out = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[2 * k + 1] == 2 * k for k in range(300)) == 300 and len(set(out.values())) == 300


def test_rows_without_an_id_have_their_own_shares(spark):
    data = [(None if k % 2 else k, f"text {k} " + "word " * (k % 9), f"s{k % 3}") for k in range(60)]
    data += [data[1], (4, "another text of document 4", "s2"), data[6]]
    rows = spark.createDataFrame(data, "doc_id long, text string, source string")
    want, have = {}, {}
    for r in mixing.mix(rows).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in mixing.mixed_documents(spark, rows, "").collect():
        have[r.source] = have.get(r.source, 0) + len(r.text.split())
    assert have == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize(("stage", "most"), [("score", 55e6), ("near", 55e6), ("pieces", 12e6)])
def test_idle_workers_give_back_what_a_task_held(spark, stage, most):
    import psutil

    def docs(n):
        return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 500), i -> hex(xxhash64(id, i))), ' ')").alias("text"))

    def run(d):
        if stage == "score":
            return quality.score(d, np.zeros((1 << quality.BITS) + 1, np.float32)).agg(F.sum("score")).first()
        return simhash.near_copies(d).count() if stage == "near" else sentencepieces.encode(d).agg(F.sum("ids_crc32")).first()

    def largest():
        new = [p for p in psutil.Process().children(recursive=True) if p.pid not in others and "pyspark.daemon" in " ".join(p.cmdline())]
        return max(p.memory_full_info().uss for p in new)

    others = {p.pid for p in psutil.Process().children(recursive=True)}
    env = spark.sparkContext.environment
    env["TEXTLOOM_WORKERS"] = stage  # another environment, so workers of our own
    try:
        run(docs(4))
        least = largest()
        run(docs(2000))
        assert largest() - least < most
    finally:
        del env["TEXTLOOM_WORKERS"]
