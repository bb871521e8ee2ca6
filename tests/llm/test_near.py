import random
import re

import pytest

from pointloom.llm import near
from pointloom.llm.components import connected_components


def brute(docs):
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets, up, where = {}, {}, {}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        up[i] = i
        for j in {j for g in sets[i] for j in where.get(g, ())}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_same_as_brute_force_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(near.op9_jaccard_join(spark, sf)) == brute(docs)


def corpus(seed, groups=12, size=14):
    """Copies with edits around the threshold, chains, shared passages and short texts."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 80]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(size):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                new[rng.randrange(len(new))] = word()
            if rng.random() < 0.3:
                base = new  # a chain: the next copy is of this one
            out.append(" ".join(new).upper() if rng.random() < 0.2 else "  ".join(new))
    rng.shuffle(out)
    return [*enumerate(out), (9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "é É")]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force_on_random_corpora(spark, seed, monkeypatch):
    docs = corpus(seed)
    monkeypatch.setattr(near, "BLOCK_DOCS", 40)  # several blocks of documents in each partition
    monkeypatch.setattr(near, "BLOCK", 6)  # components in several blocks
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(near.joined(df)) == brute(docs)


def test_links_within_against_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        base = [rng.sample(range(60), 30) for _ in range(4)]
        sets = []
        for k in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randrange(6)):
                s ^= {rng.randrange(60)}
            sets.append(near.np.array(sorted(s), near.np.uint64))
        forest, want = near.Forest(), near.Forest()
        for a, b in near.links_within(list(range(40)), sets):
            assert near.linked(len(set(sets[a].tolist()) & set(sets[b].tolist())), len(sets[a]), len(sets[b]))
            forest.union(a, b)
        for a in range(40):
            for b in range(a):
                if near.linked(len(set(sets[a].tolist()) & set(sets[b].tolist())), len(sets[a]), len(sets[b])):
                    want.union(a, b)
        assert [forest.find(k) for k in range(40)] == [want.find(k) for k in range(40)]


def test_repeated_rows_null_ids_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text, "x"), (5, text, "x"), (3, text + " more", "x"), (None, text, "x"), (8, "alone here now", "x"), (None, None, "x")], "doc_id long, text string, component_id string")
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near.joined(docs).collect()))
    assert got == [("3", 37, "3"), ("5", 36, "3"), ("5", 36, "3"), ("8", 1, "8"), ("None", 0, "None"), ("None", 36, "3")]
    out = near.one_of_each(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["3", "8", "None"]
    assert near.joined(docs.limit(0)).count() == 0 and near.one_of_each(docs.limit(0)).count() == 0


def test_unlike_texts_with_null_or_repeated_ids_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = [(None, a + " more", 0), (5, a, 1), (None, b + " more", 2), (9, b, 3), (None, c, 4), (None, c + " more", 5), (None, d, 6), (7, "one text", 7), (7, "another text here", 8), (None, "", 9), (None, None, 10), (None, " ", 11)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row long").repartition(3)
    got = {(r.doc_id, r.component_id) for r in near.joined(df.where("row < 4")).collect()}
    assert got == {(None, 5), (5, 5), (None, 9), (9, 9)}  # two sets without ids are not one
    kept = sorted(r.row for r in near.one_of_each(df).collect())
    assert len(kept) == 9 and {1, 3, 6, 7, 8, 9, 10, 11} < set(kept) and len({4, 5} & set(kept)) == 1
    assert sorted(r.row for r in near.one_of_each(df.repartition(1)).collect()) == kept


def test_shingles_follow_the_words():
    assert len(near.shingles(b"a b c d e f")) == 2 and len(near.shingles(b"a b")) == 1 and len(near.shingles(b" ")) == 0
    assert near.shingles("A\x0bB \x1fc".encode()).tolist() == near.shingles("a b \x1fC".encode()).tolist()
    assert near.shingles("É x".encode()).tolist() != near.shingles("é x".encode()).tolist()
    assert len(near.shingles(("same " * 100_000).encode())) == 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(40))
