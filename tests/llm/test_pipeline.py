"""The pipeline's stages, each held against what it must keep, on the small tables."""

import re

import corpus_pipeline as cp
from callscope.llm import near_dup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "minhash", "secrets", "mixing", "bpe"]
    outs = []
    for _, stage in cp.STAGES:
        outs.append(stage(spark, outs[-1] if outs else docs, SF).persist())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in outs[0].collect()}
    assert all(i in kept for i, y in labels.items() if not y)
    assert [o.columns for o in outs[:4]] == [first] * 4
    left = {r.doc_id for r in outs[1].collect()}
    assert left == {r.doc_id for r in near_dup.groups(outs[0]).collect() if r.kept}
    assert {r.doc_id for r in outs[2].collect()} == left
    masked = "\n".join(r.text or "" for r in outs[2].collect())
    assert not re.search(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", masked)
    assert not re.search(r"[0-9a-f]{32,}", masked)
    size = lambda t: len(WORD.findall(t or ""))
    before, after = (sum(size(r.text) for r in o.collect()) for o in outs[2:4])
    assert abs(after - before) <= 0.2 * before
    last = outs[4].collect()
    assert len(last) == outs[3].count() and all(r.round_trip for r in last)
    for o in outs:
        o.unpersist()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


def test_model_of_a_stage_is_that_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.toxic}
    assert {r.doc_id for r in cp.drop_toxic(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_odd_rows_go_through_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"w{i % 4000} of the" for i in range(30000))
    rows = [
        (1, None, None, None, None), (None, "a plain line of words here", "en", None, 26), (None, None, None, "s", None), (2, "", "en", "s", 0), (3, "   ", "en", "s", 3),
        (4, "same words in both of these rows", "en", "t", 1), (4, "same words in both of these rows", "en", "t", 1), (4, "other words under the very same id", "en", "t", 1),
        (5, "key token = abcdefgh12345 end", "en", None, 29), (6, long, "en", "t", len(long)), (7, long, "de", "t", len(long)),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grade int, ids string, taken double")
    out, kept = docs, {}
    for name, stage in cp.STAGES:
        made = stage(spark, out, SF)
        out = spark.createDataFrame(made.collect(), made.schema)
        kept[name] = out.collect()
        if name != "bpe":
            assert out.columns == cp.COLUMNS, name
    assert len(kept["toxicity"]) == len(rows)
    # one of the two long copies and of the two equal rows goes; nothing else is a copy
    assert sorted((r.doc_id or 0, r.text or "") for r in kept["minhash"]) == sorted((i or 0, t or "") for i, t, *_ in [*rows[:6], *rows[7:10]])
    by_id = {r.doc_id: r for r in kept["secrets"]}
    assert by_id[5].text == "key [SECRET] end" and by_id[5].n_chars == 16 and by_id[1].text is None and by_id[1].n_chars is None
    assert {r.text for r in kept["mixing"]} <= {r.text for r in kept["secrets"]}
    assert all(r.round_trip for r in kept["bpe"])
