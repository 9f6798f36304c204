"""Hierarchical residual packing of documents into sequences of a fixed length.

Each partition packs its pieces best-fit. Bins filled to ``full`` of the
length or more are emitted; the others travel, as items of their own, to
as many partitions as they fill and are packed again with the bins of other
partitions, until one partition's worth is left or a round makes less than
a hundredth fewer bins of them: what is left then does not fit together.

Edge cases: a null or empty text is a document of one token, the closing id;
each row is a document of its own, so repeated rows are packed twice; null
ids are packed like others; an empty table gives no rows; ties between
equally good bins go to the newest. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch
from helixframe.llm.piece_codec import Memo
from helixframe.llm.words import remembered

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
ITEM = "item long, length long"


# Fixed value: the tokenizer's pattern for pre-tokens; what it does not match is dropped.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ENDS = b"\xff"  # stands for the word-end mark; no byte of UTF-8


class WordIds:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer folds case and composes characters within runs without
    white space and drops white space, so a text's ids are those of its
    blank-separated parts in order; each distinct part is encoded once
    while it is remembered. Parts of Latin-1 characters, whose case and
    composition are plain, are merged by rank with a byte for the word-end
    mark; any other part, and whole texts that may hold an added token's name
    or characters that only Python takes for white space, go to the
    tokenizer itself.
    """

    def __init__(self, path: str, most: int = 500_000):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tok, self.seen = Tokenizer.from_file(path), Memo(self.part, most)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in _printable().items()}
        ranks = {}
        for piece, rank in vocab.items():
            if not piece.startswith("<|"):
                word = piece.removesuffix("</w>") if len(piece) > 4 else piece
                ranks[bytes(byte_of[c] for c in word) + ENDS * (word != piece)] = rank
        for b in range(256):
            ranks.setdefault(bytes((b,)), 1_000_000 + b)
        self.merge = tiktoken.Encoding("word_ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def part(self, text: str) -> bytes:
        if len(text) < 64 and max(text) < "\u0100" and "\x85" not in text and "\xa0" not in text:
            text = text.lower()
            pieces = (text,) if text.isalpha() else PRETOKEN.findall(text)
            ids = [i for p in pieces for i in self.merge(p.encode() + ENDS)]
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(mark in text for mark in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        self.seen.turn()
        return b"".join(map(self.seen.__getitem__, text.split()))


def _printable() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _pieces(path: str, room: int, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, closing = remembered(f"ids {path} {most}", lambda: WordIds(path, most)), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    ids = ids_of(text or "") + closing
                    for k, b in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[b : b + 4 * room]
                        rows.append((doc, k, b // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, filled length of each bin): longest first, each into the open bin it leaves least room in.

    Open bins are found by their room in a bitmap over 0..room, so an item
    costs O(room / 64) at worst whatever the number of bins.
    """
    bin_of, used, by_room, mask = np.empty(len(lengths), np.int64), [], defaultdict(list), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = by_room[gap].pop()
            if not by_room[gap]:
                mask &= ~(1 << gap)
        else:
            b, gap = len(used), room
            used.append(0)
        used[b] += n
        bin_of[i] = b
        if gap > n:
            by_room[gap - n].append(b)
            mask |= 1 << (gap - n)
    return bin_of, np.array(used, np.int64)


def _round(room: int, full: float, level: int):
    """Pack a partition's items; a bin takes the number of its first item, which is unique in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        item, length = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(item, kind="stable")
        item, length = item[order], length[order]
        bin_of, used = best_fit(length, room)
        order = np.argsort(bin_of, kind="stable")
        first = np.searchsorted(bin_of[order], np.arange(len(used)))
        name, offset = item[order][first], np.empty(len(item), np.int64)
        run_up = np.cumsum(length[order]) - length[order]
        offset[order] = run_up - np.repeat(run_up[first], np.diff(np.append(first, len(item))))
        done = level < 0
        for at in range(0, len(item), 50_000):
            s = slice(at, at + 50_000)
            b = bin_of[s]
            yield pa.RecordBatch.from_arrays([pa.array(item[s]), pa.array(name[b]), pa.array(offset[s]), pa.array(used[b]), pa.array(np.full(len(b), done) | (used[b] >= full * room))], ["item", "bin", "offset", "filled", "done"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 1, most: int = 500_000) -> DataFrame:
    """Each document's ids with ``end`` after them, cut where they exceed ``room``; ``most`` bounds what a worker remembers, and changes no result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, room, end, most), PIECE)


def pack(pieces: DataFrame, room: int = 4096, full: float = 0.998, per_task: int = 50_000, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: hierarchical best-fit.

    ``per_task`` bounds the items one task packs at once (16 bytes each, and
    as much again for its bins); a level has as many partitions as that asks
    for, so no task ever has more than about that.
    """
    scratch = scratch or Scratch(pieces.sparkSession, "pack")
    # written once: the numbers are read again by the join at the end
    numbered = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()))
    n = numbered.count()
    parts = max(1, -(-n // per_task))
    items, levels, before = numbered.select("item", "length"), [], n
    while True:
        last = parts == 1
        dealt = items.coalesce(1) if last else items.repartition(parts, F.xxhash64("item", F.lit(len(levels))))
        out = scratch.keep(dealt.mapInArrow(_round(room, full, -1 if last else len(levels)), "item long, bin long, offset long, filled long, done boolean"))
        levels.append(out)
        if last:
            break
        items = out.where("not done").groupBy("bin").agg(F.first("filled").alias("length")).withColumnRenamed("bin", "item")
        left = items.count()
        if 100 * left > 99 * before:  # what is left does not fit together
            levels[-1] = out.withColumn("done", F.lit(True))
            break
        before, parts = left, max(1, -(-left // per_task))
    place = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for lower in reversed(levels[:-1]):
        whole = lower.where("done").select("item", F.col("bin").alias("sequence_id"), "offset")
        up = place.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
        moved = lower.where("not done").join(up, "bin").select("item", "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
        place = whole.unionByName(moved)
    return numbered.join(place, "item").drop("item")
