import re
from collections import Counter

import pytest
from helpers import duck_rows, spark_rows
from pyspark.sql import Row

from pointloom.llm import quality as q

SPACE = "[\x20\x09-\x0d]+"


def expected(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "  \t\n ", "one", "a b", "a b c", "a b c a b c", "x x x x x", "é ß ñ 日本 " * 30, "line\nline\n \nline \nother\nother",
    " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 70}" for i in range(100)), "#a *b $c %d &e |f <g> " * 20, "\x0b\x0c mixed\r\nspace\x1fkept", "word " * 3000,
]


def rows(spark, texts=TEXTS, **more):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_statistics_match_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measured(rows(spark)).collect()}
    assert got == {i: expected(t) for i, t in enumerate(TEXTS)}


def test_statistics_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.op1_quality_rules(spark, sf).collect()}
    for r in docs.collect():
        e = expected(r.text)
        assert got[r.doc_id] == (*e, e[0] < 50 or 100 * e[4] > 50 * e[0])


def test_query_same_as_sql(spark, duck, sf):
    assert spark_rows(q.op1_quality_rules(spark, sf)) == duck_rows(duck, q.ORACLE)


def test_exact_path_equals_fast_path(spark, monkeypatch):
    monkeypatch.setattr(q, "_COLLIDES", "true")
    monkeypatch.setattr(q, "_PLACES", q._PLACES.replace("n_words > 1048576 OR", "true OR"))
    got = {r.doc_id: r.n_repeat_words for r in q.measured(rows(spark)).collect()}
    assert got == {i: expected(t)[4] for i, t in enumerate(TEXTS)}


def test_limits_follow_the_group(spark):
    plain = " ".join(f"word{i}" for i in range(100))
    noisy = " ".join(f"wo#rd{i}" for i in range(100))
    data = [(i, plain, "en", "clean") for i in range(100)] + [(1000, noisy, "en", "clean")] + [(2000 + i, noisy, "en", "code") for i in range(100)]
    kept = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[0] and not kept[1000] and kept[2000]  # symbols are usual in one source, not in the other


def test_quantile_of_sketch_is_close(spark):
    sketch = spark.createDataFrame([Row(lang="en", source="s", metric="word_len", bucket=b, n=1) for b in range(0, 100)])
    r = q.limits(sketch).first()
    assert r.word_len_lo == 24 - max(200, 3 * 50) and r.word_len_hi == 74 + 300


def test_nulls_ties_and_extra_columns(spark):
    text = " ".join(f"word{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text, None, None, 5), (1, text, None, None, 5), (None, text, "en", None, 6), (2, None, "en", "s", 7)], "doc_id long, text string, lang string, source string, n_words int")
    assert sorted((str(r.doc_id), r.kept) for r in q.judge(docs).collect()) == [("1", True), ("1", True), ("2", False), ("None", True)]
    out = q.keep_good(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]


@pytest.mark.parametrize("f", [q.judge, q.keep_good])
def test_empty(spark, f):
    assert f(rows(spark, [])).count() == 0


def test_good_labels_stay_and_bad_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
