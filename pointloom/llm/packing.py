"""Best-fit packing of documents into token sequences (operator 4), by hierarchical residual packing.

Each partition tokenizes its documents and packs their pieces best-fit, longest first. Sequences that
are nearly full are emitted. The rest is the residual: underfull sequences, taken apart into sequences of one
piece, become the items of the next round. Partitions are merged ``FAN`` at a time without a shuffle, and each merged one packs
its items best-fit again, round by round, until one partition is left and keeps what it has. Every round's sequences are
written to the shared folder, so a lost executor repeats one round's task only. A task holds at most
``TASK_ITEMS`` items, whatever the corpus.

The vocabulary is read from a ``tokenizers`` file of a byte-level BPE model; its ids are merge ranks,
so the same ids come from a rank-based encoder that is several times as fast (tests compare both). Words that the file adds, such as
its end-of-text mark, are found first, as the tokenizer does. Texts with very long runs of white space, which the fast
encoder's pattern refuses, go to the tokenizer itself.

Rounds go on while they pay: once tasks hold ``SETTLED`` items each and emit less than a tenth of them, merging more
cannot help (items of unlucky lengths never fill a sequence), and the next round keeps what it has.

Defined results: a null or empty text is the closing token alone; texts may be of any length; repeated rows are packed
as documents of their own; a null doc_id stays null and comes last among pieces of one length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import ship, stored, table

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: A sequence with at most this many free places is emitted at once.
NEARLY = 1
FAN = 8
TASK_ITEMS = 200_000
#: Items in a task from which a round that emits less than a tenth shows that more rounds will not help.
SETTLED = 10_000
#: A run of white space from here on is left to the tokenizer itself.
LONG_RUN = 5_000

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("used", pa.int32()), ("full", pa.bool_()), ("pieces", pa.list_(_PIECE))])
_DDL = "sequence_id long, used int, full boolean, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def encoder(path: str | None = None):
    """A rank-based encoder with the ids of a byte-level BPE file of ``tokenizers``."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level BPE writes the 188 visible Latin-1 characters as themselves, the other bytes from U+0100 on.
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that change the text around them are not supported")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Tokens:
    """Ids of whole texts, as the tokenizer gives them without its own additions at the ends."""

    def __init__(self, path: str | None = None):
        self.path, self.fast, self.slow, self.long_run = path, encoder(path), None, re.compile(r"\s{%d}" % LONG_RUN)

    def __call__(self, text: str) -> np.ndarray:
        if not self.long_run.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path or public_tokenizers.path(TOKENIZER))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit(items: list[tuple[int, list]], capacity: int = CAPACITY) -> list[tuple[int, list]]:
    """Pack (length, pieces) best-fit, longest first; piece offsets are moved along. Returns (used, pieces) of each bin."""
    items = sorted(items, key=lambda x: (-x[0], [(p[0] is None, p[0] or 0, p[1]) for p in x[1][:1]]))
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    mask, used, content = 0, [], []
    for length, pieces in items:
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(used)
            used.append(0)
            content.append([])
        shift = used[b]
        content[b] += [(*p[:5], p[5] + shift) for p in pieces] if shift else pieces
        used[b] += length
        if free > length:
            open_bins[free - length].append(b)
            mask |= 1 << (free - length)
    return list(zip(used, content, strict=True))


def _batch(bins: list[tuple[int, int, bool, list]]) -> pa.RecordBatch:
    flat = [p for b in bins for p in b[3]]
    columns = list(zip(*flat, strict=True)) if flat else [()] * 6
    pieces = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], fields=list(_PIECE))
    ends = np.concatenate([[0], np.cumsum([len(b[3]) for b in bins])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.int32()), pa.array([b[2] for b in bins], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pieces)], schema=_SCHEMA)


def _sorted_out(bins: list[tuple[int, list]], number: Iterator[int], last: bool) -> Iterator[tuple[int, int, bool, list]]:
    """Rows for nearly full sequences, or for all in the last round; of others, a row for each piece."""
    for used, pieces in bins:
        if last or used >= CAPACITY - NEARLY:
            yield next(number), used, True, pieces
        else:
            yield from ((next(number), p[3], False, [(*p[:5], 0)]) for p in pieces)


def _numbers(round_: int) -> Iterator[int]:
    """Sequence ids: unlike in any other task and round, the same again if the task is repeated."""
    first = (round_ << 56) | (TaskContext.get().partitionId() << 32)
    return iter(range(first, first + (1 << 32)))


def pieces_of(doc_id: int, ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple]:
    """(doc_id, piece, start, length, crc, offset 0); of a long document only the first piece may be short."""
    raw, n = ids.astype("<u4").tobytes(), len(ids)
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), 0) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _first_round(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, items = Tokens(path), _numbers(0), []

        def packed():
            bins = list(_sorted_out(best_fit(items), number, False))
            items.clear()
            for k in range(0, len(bins), 20_000):
                yield _batch(bins[k : k + 20_000])

        for batch in batches:
            whole = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END_ID))
                for p in pieces_of(doc_id, ids):
                    if p[3] == CAPACITY:
                        whole.append((next(number), CAPACITY, True, [p]))
                    else:
                        items.append((p[3], [p]))
            if whole:
                yield _batch(whole)
            if len(items) >= TASK_ITEMS:
                yield from packed()
        yield from packed()

    return run


def _next_round(round_: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items = _numbers(round_), []
        for batch in batches:
            for used, pieces in zip(batch.column("used").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                items.append((used, [tuple(p.values()) for p in pieces]))
            while len(items) >= TASK_ITEMS:
                yield _batch(list(_sorted_out(best_fit(items[:TASK_ITEMS]), number, last)))
                del items[:TASK_ITEMS]
        yield _batch(list(_sorted_out(best_fit(items), number, last)))

    return run


def _left(rows: DataFrame) -> tuple[int, int]:
    """(underfull items, pieces in all) of a round."""
    r = rows.agg(F.count_if(~F.col("full")), F.sum(F.size("pieces"))).first()
    return r[0], r[1] or 0


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stored(docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(_first_round(path), _DDL))
    done, rest, round_ = rows.where("full"), rows.where("NOT full"), 0
    tasks, (left, before) = max(1, rest.rdd.getNumPartitions()), _left(rows)
    while left:
        settled = before >= SETTLED * tasks and left > 0.9 * before
        round_, tasks, before = round_ + 1, max(1, -(-left // TASK_ITEMS), -(-tasks // FAN)), left
        last = tasks == 1 or settled
        rows = stored(rest.coalesce(tasks).mapInArrow(_next_round(round_, last), _DDL))
        done, rest = done.unionByName(rows.where("full")), rows.where("NOT full")
        left = 0 if last else _left(rows)[0]
    return done.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


ship(__name__)
