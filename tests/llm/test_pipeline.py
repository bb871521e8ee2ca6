from test_near import brute
from test_text_operators import checked_pieces

import corpus_pipeline as pipeline
from pointloom.llm import mixing, pii, quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    run = dict(pipeline.STAGES)

    one = pipeline.stored(run["quality"](spark, docs, sf))
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept and one.count() == len(kept)

    two = pipeline.stored(run["near_duplicates"](spark, one, sf))
    heads = {i for i, _, c in brute([(r.doc_id, r.text) for r in one.collect()]) if i == c}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(heads)

    three = pipeline.stored(run["pii"](spark, two, sf))
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == {r.doc_id: r.text for r in pii.pseudonymised(two, pii.DEMO_KEY).collect()}

    four = pipeline.stored(run["mixing"](spark, three, sf))
    copies = {r.doc_id: r.copies for r in mixing.mixed(three).select("_row.doc_id", "copies").collect()}
    assert four.columns == columns and {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    five = run["packing"](spark, three, sf).collect()
    checked_pieces(five, {r.doc_id: r.text for r in three.collect()})
    whole = pipeline.run(spark, sf)
    assert whole.count() > 0 and {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {i for i, n in copies.items() if n}


def test_empty_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf))
    assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns_pass_all_stages(spark):
    words = lambda k: " ".join(f"{w}{k}" for w in "abcdefghijklmnopqrstuvwxyz" for _ in range(1)) + " " + " ".join(f"{w}{w}{k}" for w in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, words(i), "en", "s") for i in range(200)] + [(None, words(500), None, None), (None, words(501), "en", None), (3, words(3), "en", "s"), (4, words(777), "en", "t"), (900, None, "en", "s"), (901, "", None, "s"), (902, words(902) * 300, "en", "s")]
    docs = spark.createDataFrame([(*r, 0, "k", "u", "w", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, _print string, copies string, size int").repartition(3)
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, ""))
        assert docs.columns == columns
        if name == "near_duplicates":
            kept = [r.doc_id for r in docs.collect()]
            assert kept.count(None) == 2 and kept.count(3) == 1 and kept.count(4) == 2 and len(kept) == len(rows) - 4
    assert pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


HOSTILE = {"spaces": " " * 1_000_000, "dots": "." * 1_000_000, "tags": "<a " * 333_000, "divs": "<div>x" * 30_000, "digits": "7" * 1_000_000, "letter": "a" * 1_000_000, "host": "x@" + "a." * 500_000, "words": "a b c d e f g " * 70_000}


def test_hostile_texts_pass_every_operator(spark, tmp_path):
    """A megabyte of one kind of character or mark-up ends in every query and in the pipeline, with a row for each text."""
    from pointloom.llm import registry

    texts = list(HOSTILE.values())
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"http://a.com/{t[:300000]}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, [float(i), 1e-200]) for i in range(3)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in registry.QUERIES.items():
        out = query(spark, str(tmp_path))
        ids = {r[0] for r in out.select(out.columns[0]).distinct().collect()}
        assert name == "op5_nearest" or ids == set(range(len(texts))), name
    pipeline.run(spark, str(tmp_path)).count()
