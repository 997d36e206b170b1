import corpus_pipeline as P


def test_stages_on_odd_rows(spark, sf, odd, none):
    docs = odd
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns, name
    P.STAGES[-1][1](spark, docs, sf).count()
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_run_against_stagewise_brute_force(spark, sf):
    from test_decontam import brute as leaks
    from test_ngramjoin import brute as near
    from test_quality_and_lines import brute_lines, stats

    from ontolith.llm import quality
    from ontolith.llm.util import cut, table

    docs = table(spark, sf, "documents")
    one = cut(P.quality_rules(spark, docs, sf))
    kept = {r["doc_id"] for r in one.collect()}
    verdict = {r["doc_id"] for r in quality.verdicts(docs, table(spark, sf, "labels")).where("kept").collect()}
    failed = {r["doc_id"] for r in docs.collect() if (s := stats(r["text"]))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert kept == verdict and not kept & failed
    two = cut(P.line_dedup(spark, one, sf))
    want = [(d, t) for d, t, gone in brute_lines([(r["doc_id"], r["text"]) for r in one.collect()]) if not gone or t.strip()]
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    three = cut(P.ngram_join(spark, two, sf))
    assert three.count() == near(rows)[1]
    rows = [(r["doc_id"], r["text"]) for r in three.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    four = cut(P.decontamination(spark, three, sf))
    bad = {d for d, _, _, found in leaks(rows, items) if len(found) >= 2}
    assert {r["doc_id"] for r in four.collect()} == {d for d, _ in rows} - bad
    assert all(not found for _, _, _, found in leaks([(r["doc_id"], r["text"]) for r in four.collect()], items) if len(found) >= 2)
    run = {r["doc_id"] for r in P.run(spark, sf).collect()}
    assert run and run == {r["doc_id"] for r in P.mix_sources(spark, four, sf).collect()}


def test_mixing_stage_takes_topics_from_all_texts(spark, sf, monkeypatch):
    from test_models import BLURRED, blurred, off_by

    from ontolith.llm import mixing

    monkeypatch.setattr(mixing, "FEW", 0, raising=False)
    monkeypatch.setattr(mixing, "MOVED", 0.0, raising=False)
    monkeypatch.setattr(mixing, "TOPIC_ROUNDS", 200, raising=False)
    plain, seen = mixing._assigned, []
    monkeypatch.setattr(mixing, "_assigned", lambda *args: seen.append(plain(*args)) or seen[-1])
    rows = blurred(6000)
    drawn = {r["doc_id"] for r in P.mix_sources(spark, spark.createDataFrame(rows, BLURRED), sf).collect()}
    (out, kept), = seen
    told = out.select(kept["doc_id"], "topic", "drawn").collect()
    assert (off_by(rows, {r[0]: r[1] for r in told}) < 1e-3).all()
    assert drawn == {r[0] for r in told if r[2]}
