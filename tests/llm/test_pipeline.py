"""Each stage on its own input against a brute-force version, and the whole."""

import corpus_pipeline as P
from textloom.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs
        docs = P.stash(stage(spark, before, SF), "stage")
        old, new = {r.doc_id: r for r in before.collect()}, docs.collect()
        if name == "quality classifier":
            assert {r.doc_id for r in new} <= set(old) and all(tuple(r) == tuple(old[r.doc_id]) for r in new)
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(good - {r.doc_id for r in new}) <= 0.05 * len(good)
        elif name == "line dedup":
            sites = {}
            for r in old.values():
                for line in r.text.split("\n"):
                    if line.split():
                        sites.setdefault(line.strip(), set()).add(r.source)
            seen, want = set(), {}
            for k in sorted(old):
                kept = []
                for line in old[k].text.split("\n"):
                    common = len(sites.get(line.strip(), ())) >= 10
                    if not common or line.strip() not in seen:
                        kept.append(line)
                    if common:
                        seen.add(line.strip())
                want[k] = "\n".join(kept)
            assert {r.doc_id: r.text for r in new} == want and all(r.n_chars == len(r.text) for r in new)
        elif name == "simhash near-dedup":
            sets = {k: set(simhash.shingle_hashes(r.text).tolist()) for k, r in old.items()}
            group = {k: k for k in sets}
            changed = True
            while changed:
                changed = False
                for a in sets:
                    for b in sets:
                        if group[b] < group[a] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                            group[a], changed = group[b], True
            assert sorted(r.doc_id for r in new) == sorted(set(group.values()))
        elif name == "mixing to target weights":
            want = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
            have = {}
            for r in new:
                have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
            assert have == want
        if name != names[-1]:
            assert docs.columns == columns and docs.count() > 0
    import sentencepiece

    from textloom.llm.sentencepieces import default_model

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = sorted((r.doc_id, sp.encode(r.text)) for r in before.collect())
    assert sorted((r.doc_id, r.ids) for r in docs.collect()) == texts
    assert P.run(spark, SF).count() == len(texts)


def test_last_stage_encodes_and_decodes(spark):
    import sentencepiece

    from textloom.llm.sentencepieces import default_model, encode_mixed

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = ["two  words\n and a line", None, "", " ", "▁ 中\U0001f600 é\0z", "k" * 300, "two  words\n and a line"]
    docs = spark.createDataFrame([(None if k == 4 else k // 2, t, "x", [7]) for k, t in enumerate(texts)], "doc_id long, text string, decoded string, ids array<int>")
    rows = encode_mixed(spark, docs, SF).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0, sp.encode(r.text or "")) for r in docs.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in rows) == want
    assert all(r.decoded == sp.decode(r.ids) and r.n_pieces == len(r.ids) for r in rows)
    plain = sorted(t or "" for t in texts if "▁" not in (t or ""))
    assert sorted(r.decoded for r in rows if r.doc_id is not None) == plain
    assert encode_mixed(spark, docs.limit(0), SF).count() == 0
