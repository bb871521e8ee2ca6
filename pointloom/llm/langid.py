"""Language identification with a string kernel (operator 2).

The kernel is the blended spectrum of presences: for n = 1, 2, 3 the share of letter n-grams that two
texts have in common, |A & B| / sqrt(|A| |B|), averaged over n. N-grams are hashed into a fixed number
of places, so a text is one vector of presences, whatever its length, and the kernel of two texts is an
inner product. Landmarks L (labelled texts) give the Nystrom features k(x, L) K^(-1/2) with K = k(L, L);
one ridge regression for each language against the rest is fitted on them. Because every step after
the presences is linear, landmarks, K^(-1/2) and regression weights fold into one matrix, and a batch
of texts is scored by one matrix product.

The fit takes at most ``PER_LANGUAGE`` labelled texts of each language (the smallest digests of
doc_id, each text of an id once); texts are taken whole there and in prediction, whatever their length. Defined results: null texts and texts without
a letter get ``und`` with score 0; null labels are not learned from; with no labelled text all get ``und``;
ties go to the first language by code point; repeated rows and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import ship, stored, table

PER_LANGUAGE = 300
LANDMARKS = 256
RIDGE = 1e-3
#: Counts of up to this many languages are broadcast; beyond, the join shuffles.
BROADCAST_LANGUAGES = 100_000
#: Places for hashed n-grams, by n.
PLACES = {1: 1 << 10, 2: 1 << 12, 3: 1 << 13}
WIDTH = sum(PLACES.values())
_ODD = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def presences(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """The unit presence vector of a whole text, or None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = np.where(letters[c], c, 0)
    if not c.any():
        return None
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # runs of other characters count as one
    out, at, gram = np.zeros(WIDTH, np.float32), 0, np.zeros(len(c) + 1, np.uint64)
    for n, places in PLACES.items():
        gram = gram[:-1] * np.uint64(1 << 21) + c[n - 1 :]
        mixed = gram * _ODD
        mixed = ((mixed ^ (mixed >> np.uint64(29))) * _ODD) >> np.uint64(64 - places.bit_length() + 1)
        part = out[at : at + places]
        part[mixed[gram != 0].astype(np.int64)] = 1
        if part.any():
            part /= np.sqrt(len(PLACES) * part.sum())
        at += places
    return out


def fit(vectors: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, matrix (WIDTH x languages) and biases: ``vector @ matrix + biases`` are the one-versus-rest outputs."""
    names = sorted(set(labels), key=lambda s: s.encode())
    y = np.array([names.index(s) for s in labels])
    # Landmarks: the same number of each language, in order.
    rank = np.array([int((y[:i] == y[i]).sum()) for i in range(len(y))])
    chosen = np.lexsort((y, rank))[:landmarks]
    marks = vectors[chosen].astype(np.float64)
    values, basis = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-8 * values.max()
    half = basis[:, kept] / np.sqrt(values[kept])
    phi = (vectors.astype(np.float64) @ marks.T) @ half
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.array([1.0 / max(1, (y == k).sum()) for k in range(len(names))])[y]  # languages weigh alike
    share *= len(y) / share.sum()
    mean, top = (share[:, None] * phi).sum(0) / share.sum(), (share[:, None] * goal).sum(0) / share.sum()
    x = (phi - mean) * np.sqrt(share)[:, None]
    weights = np.linalg.solve(x.T @ x + ridge * len(y) * np.eye(x.shape[1]) / len(names), x.T @ ((goal - top) * np.sqrt(share)[:, None]))
    return names, (marks.T @ (half @ weights)).astype(np.float32), (top - mean @ weights).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Fit on at most ``per_language`` labelled rows of each language; only their vectors reach the driver."""
    named = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    # Languages are few. A digest below this share of its range keeps about four times the ids that are
    # wanted of each, so that what is ranked does not grow with the corpus. Ids are counted, not rows: a repeated one counts once.
    digest = F.md5(F.col("doc_id").cast("string"))
    sizes = stored(named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")).coalesce(1))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    near = named.join(sizes, "lang").where(place * F.col("_n") < 4.0 * per_language)
    # Copies of a row go before they are ranked; only keys are ranked, only texts of the picked keys are read again.
    keys = ["lang", "doc_id", "_print"]
    near = near.select("lang", "doc_id", F.md5(F.col("text").cast("string").cast("binary")).alias("_print")).where("_print IS NOT NULL").distinct()
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "_print")
    picked = stored(near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language).select(*keys))
    few = F.broadcast(picked) if picked.count() <= BROADCAST_LANGUAGES else picked
    texts = named.withColumn("_print", F.md5(F.col("text").cast("string").cast("binary"))).join(few, keys, "left_semi").dropDuplicates(keys)
    texts = texts.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text", "cast(lang AS string) AS lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            rows = [(i, lang, presences(t, letters)) for i, t, lang in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)]
            rows = [(i, lang, np.packbits(v > 0).tobytes()) for i, lang, v in rows if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "lang", "bits"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, lang string, bits binary").collect(), key=lambda r: (r.lang, r.doc_id, r.bits))
    if not rows:
        return None
    vectors = np.zeros((len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        vectors[k], at = np.unpackbits(np.frombuffer(r.bits, np.uint8))[:WIDTH], 0
        for places in PLACES.values():
            part = vectors[k, at : at + places]
            if part.any():
                part /= np.sqrt(len(PLACES) * part.sum())
            at += places
    return fit(vectors, [r.lang for r in rows])


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``; only ``text`` is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            ids, out = batch.column(0), batch.column(1)
            texts, preds, scores = batch.column(2).to_pylist(), [], []
            for k in range(0, len(texts), 256):
                part = [presences(t, letters) if model else None for t in texts[k : k + 256]]
                got = [v for v in part if v is not None]
                if got:
                    names, matrix, bias = model
                    best = np.stack(got) @ matrix + bias
                    top = best.argmax(1)
                    value = np.clip((best[np.arange(len(top)), top].astype(np.float64) + 1) / 2, 0, 1)
                found = iter(zip(top.tolist(), value.tolist(), strict=True) if got else ())
                for v in part:
                    lang, score = next(found) if v is not None else (None, 0.0)
                    preds.append("und" if lang is None else names[lang])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([ids, out, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs.select("doc_id", "lang", "text")))


ship(__name__)
