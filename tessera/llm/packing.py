"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best-fit. Pieces are ordered by length, longest first, and the gaps of open sequences by
size. As lengths are integers from 1 to the capacity, both sorted lists are kept as runs of equal values,
of which there can be only so many as the capacity has values, whatever the number of documents. One
superstep takes all pieces of a length at once: its successor sweep gives each the smallest gap that holds
it, pieces of the run take gaps in the order of their rank (so no two want the same place), the gaps are
updated, and the next superstep follows. The supersteps work on counts; every piece then finds its own
place from its rank among the pieces of its length, which is a distributed prefix sum. Hence no task and
not the driver ever holds a group of documents, and a length that a third of all rows share is no heavier
than any other. The outcome is that of sequential best-fit decreasing.

Defined cases: a null text counts as empty and is one piece that holds the end id alone; a text of any
length is tokenised whole; repeated rows are packed as often as they come; rows of an empty table give an
empty result; columns other than doc_id and text are ignored; a null doc_id is kept as it is. Equal
lengths are ranked by input partition and place, so a rerun over the same files packs alike.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .textops import portions

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_TEXT = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level BPE vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[tuple[str, bool], object] = {}


def encoder(path: str, special_as_text: bool = False):
    """text -> list of ids for a file of the tokenizers library, the ids that encode() gives without special tokens added.

    The name of an added token (such as <|endoftext|>) in a text becomes that token, as encode() has it, unless
    special_as_text is set. Where the vocabulary's ids are the ranks of its merges, the same ids come several
    times faster from tiktoken; texts that name an added token, texts beyond LONG_TEXT characters and other
    vocabularies go through tokenizers itself.
    """
    if (path, special_as_text) not in _encoders:
        own: list = []

        def slow(text: str) -> list[int]:
            if not own:  # loaded only where a text needs it
                from tokenizers import Tokenizer

                own.append(Tokenizer.from_file(path))
                own[0].encode_special_tokens = special_as_text
            return own[0].encode(text, add_special_tokens=False).ids

        fast = None
        model = json.load(open(path, encoding="utf-8"))
        pre = model.get("pre_tokenizer") or {}
        special = {t["content"] for t in model.get("added_tokens", [])}
        vocab = {k: v for k, v in model["model"].get("vocab", {}).items() if k not in special}
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"].get("merges", [])]
        ranked = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        bytewise = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if ranked and len(vocab) == 256 + len(merges) and bytewise and model.get("normalizer") is None:
            import tiktoken

            letters = _byte_letters()
            fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in vocab.items()}, special_tokens={}).encode_ordinary
        named = () if special_as_text else tuple(special)
        plain = lambda t: len(t) <= LONG_TEXT and not any(s in t for s in named)
        _encoders[path, special_as_text] = (lambda t: fast(t) if plain(t) else slow(t)) if fast else slow
    return _encoders[path, special_as_text]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids, as little-endian uint32)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def each(batches):
        encode = encoder(tokenizer)
        for batch in portions(batches):
            rows: list[list] = [[], [], [], [], [], []]
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py() or ""), end_id], "<u4")
                n = len(ids)
                start, k = 0, 0
                while start < n:
                    length = (n % capacity or capacity) if k == 0 and n > capacity else min(capacity, n)
                    raw = ids[start : start + length].tobytes()
                    for col, v in zip(rows, (i, k, start, length, zlib.crc32(raw), raw if with_ids else None)):
                        col.append(v)
                    start += length
                    k += 1
            cols = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(rows[j], pa.int64()) for j in (2, 3, 4))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over runs: (length, first rank, first sequence, pieces per sequence, offset) segments.

    counts has the number of pieces of each length; a segment reaches up to the next one of its length.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, number)
    sizes: list[int] = []
    opened = 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]

        def fill(gap: int, first: int, n: int) -> None:
            """Best fit of the run into n sequences with this gap: each is filled before the next."""
            nonlocal rank, left
            per = gap // length
            whole = min(n, left // per)
            if whole:
                segments.append((length, rank, first, per, capacity - gap))
                keep(gap - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:
                segments.append((length, rank, first + whole, left, capacity - gap))
                keep(gap - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            keep(gap, first + whole, n - whole)

        at = bisect.bisect_left(sizes, length)
        for gap in sizes[at:]:
            if not left:
                break
            found = gaps.pop(gap)
            sizes.remove(gap)
            for run in found:
                fill(gap, *run) if left else keep(gap, *run)
        if left:
            n = -(-left // (capacity // length))
            fill(capacity, opened, n)
            opened += n
    return segments


def pack(pieces: DataFrame, capacity: int = 1024, tag: str = "packing") -> DataFrame:
    """Add sequence_id and offset (both long) to rows that have a long length from 1 to capacity."""
    names = pieces.columns
    where = names.index("length")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches):
        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            length = b.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(length) and (length.min() < 1 or length.max() > capacity):
                raise ValueError("a piece is longer than a sequence or empty")
            order = np.argsort(length, kind="stable")
            put = length[order]
            first = np.searchsorted(put, put)
            nth = np.empty(len(put), np.int64)
            nth[order] = seen[put] + np.arange(len(put)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(put), pid, np.int32)), pa.array(nth)], [*names, "_pid", "_nth"])

    numbered = cut(pieces.mapInArrow(number, f"{fields}, _pid int, _nth bigint"), tag)
    by_part = numbered.groupBy("_pid", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    segments = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    key = (segments[:, 0] << 42) + segments[:, 1]
    before = W.partitionBy("length").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    bases = by_part.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")

    def place(batches):
        for b in batches:
            length, nth, base = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (where, len(names), len(names) + 1))
            rank = nth + base
            s = segments[np.searchsorted(key, (length << 42) + rank, side="right") - 1] if len(rank) else segments[:0]
            past = rank - s[:, 1]
            seq, off = s[:, 2] + past // np.maximum(s[:, 3], 1), s[:, 4] + past % np.maximum(s[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranked = numbered.join(bases, ["_pid", "length"]).select(*names, "_nth", "_base")
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenise whole documents, cut those longer than a sequence and pack all pieces."""
    return pack(tokenise(docs, tokenizer, capacity, end_id, with_ids), capacity)
