"""Licences, URLs, mixing, pseudonyms, languages, packing, HTML."""

import hashlib
import random
import re
import time
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
import regex
from helpers import duck_rows, spark_rows
from pyspark.sql import functions as F

from pointloom.llm import html, langid, licenses, mixing, packing, pii, urls

# --- licences ------------------------------------------------------------------------------------


def found(text):
    x = licenses.scan(None if text is None else text.encode(), licenses.compiled(), [(p.encode().split(), label) for p, label in licenses.PHRASES.items()])
    return x["n_words"], sorted(x["base"]), sorted({(s[0], s[1]) for s in x["spans"]})


def wordings(template, rng):
    """A random text that the template accepts, and the place of each mandatory word in it."""
    out, must, skip, depth = [], [], 0, 0
    for item in licenses.tokens_of(template):
        if item == "<<":
            depth += 1
            skip += bool(skip) or rng.random() < 0.5
        elif item == ">>":
            depth, skip = depth - 1, max(0, skip - 1)
        elif not skip:
            words = [f"name{k}" for k in range(rng.randint(1, item))] if isinstance(item, int) else rng.choice(item)
            if not depth and not isinstance(item, int) and len(item) == 1:
                must.append(len(out))
            out += words
    return out, must


def pattern(template):
    """The same template as a regular expression over words that each end in a space: an independent matcher."""
    out = ""
    for item in licenses.tokens_of(template):
        if item in ("<<", ">>"):
            out += "(?:" if item == "<<" else ")?"
        elif isinstance(item, int):
            out += "(?:[^ ]+ ){1,%d}" % item
        else:
            out += "(?:" + "|".join("".join(w + " " for w in wording) for wording in item) + ")"
    return re.compile(out)


def test_templates():
    assert found(None) == (0, [], [])
    assert found("The MIT  License; a mit license") == (6, [(1, "mit"), (4, "mit")], [])
    assert found("Licensed under the Apache License, Version 2.0.") == (8, [(3, "apache")], [("apache-2.0", "mention")])
    assert found("licensed under the GNU General Public License, version 3.")[2] == [("gpl-3.0", "mention")]
    assert found("Licensed under CC BY-NC 4.0.")[2] == [("cc-by-nc", "mention")] and found("Licensed under a Creative Commons CC BY 4.0 International")[2] == [("cc-by", "mention")]
    assert found("Released under the MIT License.")[2] == [("mit", "mention")]


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_templates_against_an_independent_matcher(k):
    label, kind, template = licenses.TEMPLATES[k]
    automaton, regex, rng = licenses.Automaton(template), pattern(template), random.Random(k)
    for _ in range(12):
        words, must = wordings(template, rng)
        whole = [*(f"x{j}" for j in range(rng.randint(0, 3))), *words, *(f"y{j}" for j in range(rng.randint(0, 3)))]
        assert (label, kind) in found(" ".join(whole))[2]
        left = rng.choice(must)  # without any one mandatory word the wording is another
        for text in (whole, [*whole[: whole.index(words[0])], *words[:left], *words[left + 1 :]], [w if j % 7 else "other" for j, w in enumerate(whole)]):
            encoded = [w.encode() for w in text]
            got = [k for k in range(len(text)) if text[k].encode() in automaton.first and automaton.accepts_at(encoded, k)]
            joined, starts = "".join(w + " " for w in text), {}
            at = 0
            for j, w in enumerate(text):
                starts[at] = j
                at += len(w) + 1
            assert got == [j for at, j in starts.items() if regex.match(joined, at)]


def test_licence_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in licenses.op6_license_scan(spark, sf).collect()}
    for d in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licence_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "MIT LICENSE " * 5000, 4)], "doc_id long, text string, labels int")
    got = sorted((str(r.doc_id), r.n_words, r.n_base) for r in licenses.scanned(docs).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("None", 10000, 5000)] and licenses.scanned(docs.limit(0)).count() == 0


# --- URLs ------------------------------------------------------------------------------------------


def test_url_query_same_as_sql(spark, duck, sf):
    assert spark_rows(urls.op7_url_filter(spark, sf)) == duck_rows(duck, urls.ORACLE)


def test_url_edges(spark):
    cases = [None, "", "nohost/en/", "HTTP://A.Example.COM/en/7x?q#f", "http://x.example.com/en/7", "http://com/en/", "http://example.net/de/81", "http://spam-farm.example.org", "http://spam-farm.example.org/x", "http://a.com#/en/", "http://a.com?/en/", "x://" + "a." * 300_000 + "org/es/", "http://a.com/" + "x" * 500_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(5, "http://com/en/", "h")], "page_id long, url string, host string")
    entries = urls.listing(spark, sites=["spam-farm.example.org"])
    got = {r.page_id: (r.host[:20], r.path, r.rule, r.verdict) for r in urls.filtered(pages, entries).collect()}
    assert got[0] == ("", "", None, "allow") == got[1] == got[2]
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[4][2:] == ("example.com/en/7", "allow")
    assert got[5] == ("com", "/en/", "com/en/", "block") and got[6][2:] == ("example.net/de/8", "block")
    assert got[7] == ("spam-farm.example.org"[:20], "", None, "allow") and got[8][3] == "block"
    assert got[9][1:] == ("", None, "allow") and got[11][2:] == ("org/es/", "block") and got[12][2:] == (None, "allow")
    assert urls.filtered(pages, entries).count() == 14 and urls.filtered(pages.limit(0), entries).count() == 0


def test_url_rules_are_those_of_the_contract(spark, sf):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for h, p, v in urls.RULES} == words
    cases = {"https://b.test.net/de/x": "net/de/", "http://example.net/de/7": "net/de/", "http://a.example.net/de/8": "example.net/de/8", "http://spam-farm.example.net/de/1": "net/de/", "http://net/de/": "net/de/", "http://a.org/es/": "org/es/"}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filtered(pages, urls.listing(spark, pages=urls.on_named_sites(pages))).collect()}
    assert got == {i: (rule, words[rule]) for i, rule in enumerate(cases.values())}
    ruled = [(r.rule, r.verdict) for r in urls.op7_url_filter(spark, sf).where("rule IS NOT NULL").collect()]
    assert ("net/de/", "allow") in ruled and all(v == words[k] for k, v in ruled)


def test_listed_pages_decide_the_verdict(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    free = [r.url for r in urls.op7_url_filter(spark, sf).where("verdict = 'allow' AND rule IS NULL").join(pages, "page_id").orderBy("page_id").collect()]
    listed = spark.createDataFrame([(free[0].split("#")[0] + ("&" if "?" in free[0] else "?") + "utm_medium=mail",)], "url string")
    got = {r.url: r.verdict for r in urls.filtered(pages, urls.listing(spark, pages=listed)).join(pages, "page_id").collect()}
    assert got[free[0]] == "block" and sum(got[u] == "block" for u in free) < len(free)
    named = urls.on_named_sites(spark.createDataFrame([(u,) for u in ("http://ads-track.example.net/a", "https://www.ads-track.test/", "http://ads-track-not.example.com/", "http://x.com/ads-track.")], "url string"))
    assert named.count() == 2


def test_bloom_has_no_false_negatives_and_exact_join_no_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("https://site"), "id", F.lit(".example/page?utm_source=x")).alias("url"))
    entries = urls.listing(spark, rules=[], sites=[], pages=listed)
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.site"), "id", F.lit(".example/page/#top")).alias("url"))
    got = {r.page_id: r.verdict for r in urls.filtered(pages, entries).collect()}
    assert all((v == "block") == (k < 3000) for k, v in got.items()) and len(got) == 6000


# --- mixing ----------------------------------------------------------------------------------------


def test_mixing_same_as_sql(spark, duck, sf):
    assert spark_rows(mixing.op8_mixing(spark, sf)) == duck_rows(duck, mixing.ORACLE)


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None, "abc"[i % 3], f"{i} w w", "z") for i in range(2100)], "doc_id long, source string, text string, _u string")
    copies = {r.n for r in mixing.mixed(docs).groupBy("_row.source").agg(F.countDistinct("copies").alias("n")).collect()}
    assert 2 in copies and mixing.mixed(docs).agg(F.sum(F.col("copies") * F.col("size"))).first()[0] in range(9440, 9461)


def test_mixing_targets_and_edges(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}" if i % 10 else None, "w " * (i % 7 + 1), 1) for i in range(900)] + [(5, "s2", None, 1), (5, "s2", "", 1), (None, "s1", "w " * 30_000, 1)], "doc_id long, source string, text string, copies int")
    out = mixing.mixed(docs).select("_row.source", "size", "source_size", "target", "copies").collect()
    total, by = sum(r.size for r in out), {}
    for r in out:
        assert 0 <= r.copies <= 2
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.copies * r.size
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-6
    assert all(abs(t - got) <= 30_000 and t <= 2 * size + 1e-9 for t, got, size in by.values())
    mix = mixing.resampled(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in out)
    assert mixing.resampled(docs.limit(0)).count() == 0
    assert spark_rows(mixing.resampled(docs.repartition(5))) == spark_rows(mix)


# --- pseudonyms --------------------------------------------------------------------------------------


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


SAMPLES = ["+1 (743) 555-3824", "555-123-4567", "4785380592391139", "4785 3805 9239 1139", "70.23.22.57", "123-45-6789", "2024-05-31", "31.05.2024", "05/31/2024", "1999/12/31", "the.72@mail3.example.com", 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7"']
CLEAN = ["4785380592391138", "999.1.1.1", "2024-02-31", "000-12-3456", "plain words only", "version 1.2.3", "12345", "1.2.3.4.5", "a@b"]


def test_pseudonyms_keep_format_and_links(spark):
    docs = spark.createDataFrame([(i, f"x {s} y {s}", "k") for i, s in enumerate(SAMPLES)] + [(100 + i, f"x {s} y", "k") for i, s in enumerate(CLEAN)] + [(200, None, "k"), (201, "", "k")], "doc_id long, text string, pii string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs.drop("pii"), "k").collect()}
    for i, s in enumerate(SAMPLES):
        one, two = re.fullmatch("x (.*) y (.*)", got[i].text).groups()
        assert one == two != s
        shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "9", t))
        if "." not in s or "@" in s or "-" in s:
            if "token" not in s:
                assert shape(one) == shape(s)
    assert luhn(got[2].text.split()[1]) % 10 == 0 and got[2].text[2] == "4"
    assert re.sub(" ", "", " ".join(got[3].text.split()[1:5])) == got[2].text.split()[1]  # same number, other layout
    assert all(int(x) <= 255 for x in got[4].text.split()[1].split("."))
    for i, s in enumerate(CLEAN):
        assert got[100 + i].text == f"x {s} y" and got[100 + i].pii == []
    assert got[200].text is None and got[201].text == ""
    docs = docs.withColumns({"_found": F.lit("a"), "_new": F.lit("b"), "_PII": F.lit("c"), "_pii_": F.lit("d")})
    out = pii.without_pii(docs.withColumn("n_chars", F.length("text")), "k")
    assert {(r._found, r._new, r._PII, r._pii_, r.pii) for r in out.collect()} == {("a", "b", "c", "d", "k")} and pii.without_pii(docs.limit(0), "k").count() == 0
    assert out.unionAll(out).count() == 2 * pii.without_pii(docs, "k").count()
    assert out.columns == [*docs.columns, "n_chars"] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_gate_passes_whatever_the_patterns_match(spark):
    texts = [*SAMPLES, 'password = "correcthorse"', "PASSWD: abcdefghi", "api_key=abcdefghi", "access-key: 'abcdefghi'", "secret:abcdefghi", "dns 8.8.8.8 here", "1.1.1.1", "me@example.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, "k").collect()}
    assert all(got[i].text != t and len(got[i].pii) == 1 for i, t in enumerate(texts))


def test_pseudonyms_are_one_to_one(spark):
    ids = spark.range(4000)
    texts = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("10.0."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250, F.lit(" "), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).cast("string")).alias("text"))
    got = [r.text.split() for r in pii.pseudonymised(texts, "k").collect()]
    assert len({a for a, _ in got}) == 4000 == len({b for _, b in got})
    assert [r.text for r in pii.pseudonymised(texts, "another").limit(3).collect()] != [r.text for r in pii.pseudonymised(texts, "k").limit(3).collect()]


class Plain:
    """The pseudonyms once more, from their definition, in plain Python."""

    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return hashlib.sha256("|".join((self.key, *parts)).encode()).hexdigest()

    def by_char(self, x, kind):
        halves, hexa = [list(x[: len(x) // 2]), list(x[len(x) // 2 :])], bool(re.fullmatch("[0-9a-f]+", x)) and bool(re.search("[a-f]", x))
        for i in range(1, 11):
            mine, other = halves[(i + 1) % 2], "".join(halves[i % 2])
            o = self.digest(kind, str(i), other)
            for j, c in enumerate(mine):
                e = hashlib.sha256(f"{o}{j // 12}".encode()).hexdigest()
                for alphabet in ("0123456789abcdef" if hexa else "", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                    if c in alphabet:
                        mine[j] = alphabet[(alphabet.index(c) + int(e[5 * (j % 12) : 5 * (j % 12) + 5], 16)) % len(alphabet)]
                        break
        return "".join(halves[0] + halves[1])

    def by_number(self, v, a, b, kind):
        x, y = divmod(v, b)
        for i in range(1, 11):
            if i % 2:
                x = (x + int(self.digest(kind, str(i), str(y))[:14], 16)) % a
            else:
                y = (y + int(self.digest(kind, str(i), str(x))[:14], 16)) % b
        return x * b + y

    def refilled(self, m, ds):
        it = iter(ds)
        return "".join(next(it) if c.isdigit() else c for c in m)

    def one(self, m):
        d = re.sub("[^0-9]", "", m)
        if re.search("[=:]", m):
            v = re.search(r"[A-Za-z0-9+/_.-]{8,}$", m)[0]
            return m[: -len(v)] + self.by_char(v, "secret")
        if "@" in m:
            name, _, host = m.partition("@")
            return self.by_char(name, "mail") + "@" + host
        if re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", m):
            o = [int(x) for x in m.split(".")]
            if max(o) > 255:
                return m
            v = self.by_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, "ip")
            return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
        for shape, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d{4}/\d\d/\d\d", "%Y/%m/%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y")):
            if re.fullmatch(shape, m):
                try:
                    k = (datetime.strptime(m, form) - datetime(1800, 1, 1)).days
                except ValueError:
                    return m
                return (datetime(1800, 1, 1) + timedelta(self.by_number(k, 189, 773, "date"))).strftime(form) if 0 <= k < 146097 else m
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            a, b, c = map(int, m.split("-"))
            if not (1 <= a <= 899 and a != 666 and b and c):
                return m
            v = self.by_number(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 88902, 9999, "ssn")
            a = v // 989901 + 1
            return f"{a + (a >= 666):03}-{v // 9999 % 99 + 1:02}-{v % 9999 + 1:04}"
        if re.match(r"[+(]", m) or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m):
            g = max(1, len(d) - 10) if m[0] == "+" else 0
            return self.refilled(m, d[:g] + self.by_char(d[g:], "phone"))
        if not re.match("[3-6]|2[2-7]", d) or luhn(d) % 10:
            return m
        w = d[0] + self.by_char(d[1:-1], "card")
        return self.refilled(m, w + str(-luhn(w + "0") % 10))


def test_pseudonyms_against_plain_python(spark, sf):
    """Every text of the table and every sample: all matches found, and each pseudonym as defined."""
    plain, every = Plain("k"), regex.compile(pii.ANY)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, f"({s}) {s}; {s}, x{s}") for i, s in enumerate([*SAMPLES, *CLEAN])]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "k").collect()}
    for i, t in docs:
        want, pairs, at = "", [], 0
        for m in every.finditer(t or ""):
            new = plain.one(m[0])
            want += t[at : m.start()] + new
            at = m.end()
            pairs += [(m[0], new)] if new != m[0] else []
        assert got[i].text == (None if t is None else want + t[at:]) and [tuple(p) for p in got[i].pii] == pairs


def test_clean_documents_are_left_alone(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op10_pii(spark, sf).collect():
        assert (r.n_found > 0) == (r.text != docs[r.doc_id])
        for m in re.findall(r"\S+@\S+", docs[r.doc_id]):
            assert m not in r.text


# --- languages ---------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = [r.lang == r.lang_pred for r in out if r.held_out]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in out)


def test_folded_matrix_equals_kernel_form():
    rng, letters = np.random.default_rng(1), langid.letter_table()
    texts = [" ".join("".join(rng.choice(list(a), 4)) for _ in range(30)) for a in ("abcdef", "defghi") for _ in range(20)]
    x = np.stack([langid.presences(t, letters) for t in texts])
    k = x @ x.T  # the blended presence kernel, against its definition
    for i, j in ((0, 1), (0, 30)):
        grams = lambda t, n: {f" {t} "[a : a + n] for a in range(len(t) + 3 - n)} - {" "}
        direct = np.mean([len(grams(texts[i], n) & grams(texts[j], n)) / np.sqrt(len(grams(texts[i], n)) * len(grams(texts[j], n))) for n in (1, 2, 3)])
        assert abs(k[i, j] - direct) < 0.05
    names, matrix, bias = langid.fit(x, ["a"] * 20 + ["b"] * 20)
    assert [names[i] for i in (x @ matrix + bias).argmax(1)] == ["a"] * 20 + ["b"] * 20


def test_fit_takes_each_text_of_an_id_once(spark):
    rows = [(7, "the same text in one language " * 3, "en", "x")] * 3000 + [(9, "ein ganz anderer satz auf deutsch", "de", "x")] + [(11 + 4 * k, f"un texte en voix {k}", "fr", "x") for k in range(40)]
    names, *_ = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string, _n string").repartition(5), 10)
    kept = [i for i in (7, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert names == sorted({"fr", *({7: "en", 9: "de"}[i] for i in kept)}) and kept


def plain_scores(texts, labels, asked):
    """Kernel ridge regression, one language against the rest, on all texts as landmarks, from the definitions."""
    letters = langid.letter_table()
    x = np.stack([langid.presences(t, letters) for t in texts]).astype(np.float64)
    names = sorted(set(labels))
    values, basis = np.linalg.eigh(x @ x.T)
    kept = values > 1e-8 * values.max()
    phi = x @ x.T @ basis[:, kept] / np.sqrt(values[kept])
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in labels])
    share = np.array([1 / labels.count(a) for a in labels])
    share *= len(labels) / share.sum()
    mean, top = (share[:, None] * phi).sum(0) / share.sum(), (share[:, None] * y).sum(0) / share.sum()
    a, d = phi - mean, np.diag(share)
    weights = np.linalg.inv(a.T @ d @ a + langid.RIDGE * len(labels) * np.eye(a.shape[1]) / len(names)) @ a.T @ d @ (y - top)
    z = np.stack([langid.presences(t, letters) for t in asked]).astype(np.float64) @ x.T @ basis[:, kept] / np.sqrt(values[kept])
    return names, (z - mean) @ weights + top


def test_predictions_against_plain_regression(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 10**6)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND text rlike '[a-z]'")
    rows = docs.collect()
    train = sorted((r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2), key=lambda r: (r.lang, r.doc_id))
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    names, want = plain_scores([r.text for r in train], [r.lang for r in train], [r.text for r in held])
    model = langid.learned(docs)
    model = langid.fit(np.stack([langid.presences(r.text, langid.letter_table()) for r in train]), [r.lang for r in train], 10**6) if model is None else model
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    agree = [got[r.doc_id].lang_pred == names[int(w.argmax())] for r, w in zip(held, want, strict=True)]
    assert sum(agree) >= 0.99 * len(agree)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "", None), (None, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identified(docs, None).collect()] == ["und"] * 4
    model = langid.learned(docs)
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs, model).collect()}[1] == ("und", 0.0)
    assert langid.identified(docs.limit(0), langid.learned(docs.limit(0))).count() == 0


# --- packing -----------------------------------------------------------------------------------------


def test_encoder_gives_the_ids_of_the_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    fast = packing.Tokens()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in [*texts, "", " ", "a  b\n\n c\t", "it's 1234 ok", "日本語 naïve 🎉", "<|endoftext|>", "hi <|endoftext|> there<|endoftext|>x <|endoftext", "\x1f\x85\u2028x", "don't WE'LL 'tis", "x" + " " * 200_000 + "y", "\n" * 6000 + "z", " " * 4999]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def checked_pieces(rows, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    slow, by_doc, by_seq = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array([*(slow.encode(text or "", add_special_tokens=False).ids), 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 1024 for r in parts[1:]) and (len(parts) == 1) == (len(ids) <= 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_seq)


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    rows = packing.packed(docs).collect()
    n = checked_pieces(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 5000, "x")], "doc_id long, text string, piece string")
    checked_pieces(packing.packed(docs).collect(), {1: None, 2: "", 3: "word " * 5000})
    assert packing.packed(docs.limit(0)).count() == 0
    twice = packing.packed(spark.createDataFrame([(7, "again"), (7, "again")], "doc_id long, text string")).collect()
    assert len(twice) == 2


def test_packing_ends_when_rounds_stop_paying(spark, monkeypatch):
    monkeypatch.setattr(packing, "SETTLED", 40)
    monkeypatch.setattr(packing, "TASK_ITEMS", 50)
    rounds = []
    monkeypatch.setattr(packing, "_next_round", lambda r, last, real=packing._next_round: rounds.append((r, last)) or real(r, last))
    docs = spark.createDataFrame([(i, "word " * 599) for i in range(400)], "doc_id long, text string").repartition(4)
    rows = packing.packed(docs).collect()
    assert len(rows) == 400 == len({r.sequence_id for r in rows}) and rounds == [(1, True)]


def test_packing_null_ids_of_tied_length(spark):
    docs = spark.createDataFrame([(None, "same words"), (4, "same words"), (None, "same words"), (2, "same words"), (None, "word " * 5000)], "doc_id long, text string").coalesce(1)
    rows = packing.packed(docs).collect()
    short = [r for r in rows if r.length < 100]
    assert sorted(str(r.doc_id) for r in short) == ["2", "4", "None", "None"] and len({r.length for r in short}) == 1
    assert sum(r.length for r in rows) == 4 * short[0].length + len(packing.encoder().encode("word " * 5000)) + 1
    assert [r.doc_id for r in sorted(short, key=lambda r: (r.sequence_id, r.offset))][:2] == [2, 4]


def test_best_fit_is_close_to_the_bound():
    sizes = np.random.default_rng(3).integers(1, 1024, 5000)
    bins = packing.best_fit([(int(s), [(i, 0, 0, int(s), 0, 0)]) for i, s in enumerate(sizes)])
    assert all(u <= 1024 and u == sum(p[3] for p in ps) for u, ps in bins) and sum(u for u, _ in bins) == sizes.sum()
    assert len(bins) <= 1.02 * sizes.sum() / 1024 + 1


# --- HTML ----------------------------------------------------------------------------------------------


def test_html_on_the_pages(spark, sf):
    import html as entities

    right = rows = 0
    for page, r in zip(spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect(), html.op3_html_extraction(spark, sf).orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p|div)[^>]*>", article)]
        rows += 1
        right += r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert right >= 0.97 * rows


def test_html_held_out_accuracy():
    w, rng, right, total = html.trained(), np.random.default_rng(123), 0, 0
    for _ in range(150):
        page, labels = html.generated(rng)
        if page:
            x, mask = html.padded([html.vectors(page)])
            right += ((html.forward(w, x, mask)[:, 0] > 0.5) == np.array(labels)).sum()
            total += len(labels)
    assert right >= 0.97 * total


def test_html_gradient_against_differences():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float64) for k, v in html.start_weights(rng).items()}
    x, mask = rng.standard_normal((4, 2, html.WIDTH)).astype(np.float32), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], np.float32)
    y = rng.integers(0, 2, (4, 2)).astype(np.float32)
    loss, g = html.gradients(w, x, mask, y)
    for name, at in (("fx", (3, 5)), ("fh", (2, 40)), ("bh", (1, 70)), ("bc", (30,)), ("o", (4, 0))):
        step = 1e-3
        w[name][at] += step
        up, _ = html.gradients(w, x, mask, y)
        w[name][at] -= 2 * step
        down, _ = html.gradients(w, x, mask, y)
        w[name][at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


@pytest.mark.parametrize("page", [None, "", "<p", "<!-- never closed", "<script>x", "<p>a<p>b</div></p>", "<div>" * 3000 + "x", "&#xFFFFFFFF; &bogus; &amp", "<a href='x>y'>t</a>", "a < b <c d", "<p title=\"never closed>text</p>", "&#" + "9" * 5000 + ";", "&#x" + "f" * 5000])
def test_html_odd_pages(page):
    html.texts_of([page], html.trained())


def test_html_reads_long_pages_in_parts():
    w, rng = html.trained(), np.random.default_rng(9)
    for _ in range(20):
        page, _ = html.generated(rng)
        if page:
            x, mask = html.padded([html.vectors(page)])
            assert np.allclose(html.forward(w, x, mask)[:, 0], html.long_scores(w, page, 7), atol=1e-5)


def test_html_blocks():
    got = [leaf.text for leaf in html.leaves("<p>one<p>two &amp; &#65;&#x42; <b>b</b></p><ul><li>x<li>y</ul><a <p>z</p> 1 < 2 <i>k</i><script>no</script><!-- no --><br>end <unclosed")]
    assert got == ["one", "two & AB b", "x", "y", "z", "1 < 2 k end <unclosed"]


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html.extracted(pages).collect()] == [("", 0), ("", 0)] and html.extracted(pages.limit(0)).count() == 0
