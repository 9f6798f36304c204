"""Alignment of two tokenizers' tokens over the same bytes, in relational steps.

Both vocabularies start a token at a space after another character, so a text with single spaces falls into
parts whose tokens, groups and links are their own; any other text is one part. Each distinct part of the corpus
is encoded and aligned once:

1. Tasks number the parts of their texts by chunks of some megabytes; the parts of all chunks are made distinct
   in one shuffle by ``slot``, a hash of the part, encoded, and written as a table of two id arrays a part, bucketed by slot.
2. ``posexplode`` gives a row a token, a broadcast join its length in bytes (the
   vocabulary bounds that table), and a window's running sum its end.
3. An equi-join of both sides on (slot, part, end) gives the cuts. The running count
   of cuts numbers the groups; the cut before gives where a group's tokens start.
4. Groups with one token on a side link it to all of the other's: a group join. In
   groups with several on both, whose ends differ within, links are the pairs whose
   byte ranges overlap: a range join within (part, group).
   The text of a part's groups is formatted from its ids and the places of its cuts.
5. Aligned parts go to the chunks that hold them, packed in blocks of a chunk's parts, and meet a chunk's documents, which
   lie bucketed by chunk and are not shuffled: sums, the digest, and the distinct pairs with how often the document links them.
6. A pair's count is the number of documents that hold it linked. Counts are summed by
   task before the shuffle; an A id's highest count is a maximum over its
   pairs. Documents meet their pairs' counts in a broadcast join where the measured number of
   pairs allows it; else the pairs that many documents hold are broadcast, whose number
   is bounded by the links of a document, and the rest is joined by pair.

Edge cases: a text that is null or empty, or whose tokens' bytes on either side are not those of
space + text, has no tokens: zeros and an empty ``groups_sha256``; each row is a document of its
own, so repeated rows count twice and null ids stay; a very long text is a chunk of its own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch
from helixframe.llm.piece_codec import codec
from helixframe.llm.words import remembered

#: Bytes of parts a bucket gets on average, so that its tokens sort in memory, until there are so many buckets; then they grow, and sorts spill.
#: The bytes of a part count once for each chunk that holds it.
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 100_000
#: Hashes of parts have so many values.
SLOTS = 1 << 22
#: Characters of texts after which a task begins another chunk, and parts that one row of a chunk holds.
CHUNK, LISTED = 24 << 20, 1 << 16


class ByteIds:
    """Ids of a byte-level vocabulary without special tokens.

    Merges are by rank where ids rise in the order of the merges (checked on loading), for
    texts whose characters every version of the pattern reads alike; all other texts go to the tokenizer.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from helixframe.llm.packing import _printable

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in _printable().items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in piece) for piece, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
        ranks = {b: i for i, b in self.bytes_of.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True
        return tok

    def __call__(self, text: str) -> list[int]:
        # the tokenizer itself takes memory and is loaded for the first text that needs it
        if self.fast is not None and max(text) < "ƀ" and not any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0"):
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids


class BothIds:
    """Ids of parts on both sides, none where their bytes are not those of space + part."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = ByteIds(byte_path), SentencePieceProcessor(model_file=piece_path)
        sp = self.b
        piece = lambda i: bytes((int(sp.id_to_piece(i)[3:5], 16),)) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        # a control or unknown piece has no bytes of a text: 0xFF is in no UTF-8
        self.b_bytes = [b"\xff" if sp.is_control(i) or sp.is_unknown(i) else piece(i) for i in range(sp.vocab_size())]

    def __call__(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        a_bytes, b_bytes, out = self.a.bytes_of, self.b_bytes, []
        for part, b in zip(parts, self.b.encode(parts, num_threads=1), strict=True):
            a, raw = self.a(" " + part), b" " + part.encode()
            same = b"".join([a_bytes[i] for i in a]) == raw == b"".join([b_bytes[i] for i in b])
            out.append((a, b) if same else ([], []))
        return out


def _both(byte_path: str, piece_path: str):
    """Parts to ids on both sides; the places where a part is asked for go with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = remembered(f"both {byte_path} {piece_path}", lambda: BothIds(byte_path, piece_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = zip(*ids_of(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), _lists(a), _lists(b)], ["slot", "row", "spots", "a", "b"])

    return run


TOLD = "chunk long, row long, doc_id long, words array<int>, base int, parts array<string>"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document with the numbers of its parts in its chunk, and rows with a chunk's distinct parts from number ``base`` on."""
    names = ["chunk", "row", "doc_id", "words", "base", "parts"]
    chunk, size, at_of = None, 0, defaultdict()

    def listed() -> Iterator[pa.RecordBatch]:
        parts = list(at_of)
        for base in range(0, len(parts), LISTED):
            none = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *none, pa.array([base], pa.int32()), pa.array([parts[base : base + LISTED]], pa.list_(pa.string()))], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            if chunk is None or size > CHUNK:
                yield from listed()
                chunk, size, at_of = part.column(0)[0].as_py(), 0, defaultdict()
                at_of.default_factory = at_of.__len__
            words = []
            for text in part.column(2).to_pylist():
                if not text:
                    words.append([])
                elif "  " in text or text[0] == " " or text[-1] == " ":
                    words.append([at_of[text]])
                else:
                    words.append(list(map(at_of.__getitem__, text.split(" "))))
                size += len(text or "")
            n = part.num_rows
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk), pa.int64()), part.column(0), part.column(1), _lists(words), *none], names)
    yield from listed()


MET = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which compress better."""
    return x.reshape(-1, 1).view(np.uint8).T.tobytes()


def _of_planes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0]


BLOCK = "chunk long, size int, block binary"


def _packed(parts: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block a chunk of its aligned parts, by their numbers there: counts, texts of groups and links, without loss."""
    spots, *counts, bodies, links = (parts[c].combine_chunks() for c in ("spots", "n_a", "n_b", "n_groups", "body", "links"))
    counts, bodies, spot = [c.to_numpy().astype(np.int32) for c in counts], bodies.cast(pa.binary()), spots.flatten()
    place, k = spot.field("place").to_numpy(), spot.field("k").to_numpy()
    owner = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
    order = np.lexsort((k, place))
    place, k, owner = place[order], k[order], owner[order]
    for at in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
        own = pa.array(owner[at])
        body, pairs = bodies.take(own), links.take(own)
        flat = pairs.flatten().to_numpy()
        sizes = [np.diff(x.offsets.to_numpy() if x is pairs else np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)) for x in (pairs, body)]
        numbers = np.stack([np.diff(k[at], prepend=0), *(c[owner[at]] for c in counts), *sizes]).astype(np.int32)
        text = b"".join(body.to_pylist())
        raw = np.array([len(at), len(text), len(flat)], np.int64).tobytes() + _planes(numbers) + text + _planes(flat)
        yield pa.RecordBatch.from_arrays([pa.array([place[at[0]]], pa.int64()), pa.array([len(raw)], pa.int32()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], ["chunk", "size", "block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LISTED:
            yield from _packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _packed(pa.Table.from_batches(held))


def _unpacked(sizes: list[int], blocks: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's parts by number: (n_a, n_b, n_groups), texts of groups, where links start, how many, and the links."""
    numbers, flats, bodies = [np.empty((6, 0), np.int32)], [np.empty(0, np.int64)], []
    for size, block in zip(sizes, blocks, strict=True):
        raw = pa.decompress(block, size, "zstd", asbytes=True)
        n, chars, links = np.frombuffer(raw, np.int64, 3).tolist()
        own = _of_planes(raw, np.int32, 6 * n, 24).reshape(6, n).copy()
        own[0] = np.cumsum(own[0])
        numbers.append(own)
        flats.append(_of_planes(raw, np.int64, links, 24 + 24 * n + chars))
        ends = (24 + 24 * n + np.cumsum(own[5], dtype=np.int64)).tolist()
        bodies += [raw[x:y] for x, y in zip([24 + 24 * n, *ends], ends)]
    numbers = np.concatenate(numbers, axis=1).astype(np.int64)
    order = np.argsort(numbers[0])
    count = numbers[4]
    start = np.cumsum(count) - count
    return numbers[1:4, order].T, [bodies[i] for i in order.tolist()], start[order], count[order], np.concatenate(flats)


def _met(docs: pa.Table, blocks: pa.Table) -> pa.Table:
    """The documents of a chunk with what their parts are in all."""
    docs = docs.combine_chunks()
    one = lambda t, c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
    n, bodies, start, count, flat = _unpacked(blocks["size"].to_pylist(), blocks["block"].to_pylist())
    pairs, code = np.unique(flat, return_inverse=True)
    sums, digests, held, times = [], [], [], []
    for w in _rows(one(docs, "words")):
        if not len(w) or not n[w, 0].all():
            sums.append((0, 0, 0, 0))
            digests.append("")
            held.append(pairs[:0])
            times.append(count[:0])
            continue
        c = count[w]
        at = np.repeat(start[w] - np.cumsum(c) + c, c) + np.arange(c.sum())
        own, often = np.unique(code[at], return_counts=True)
        sums.append((*n[w].sum(axis=0).tolist(), len(at)))
        digests.append(hashlib.sha256(b";".join([bodies[i] for i in w.tolist()])).hexdigest())
        held.append(pairs[own])
        times.append(often)
    ends = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
    sums = np.array(sums, np.int64).reshape(-1, 4)
    flat = lambda x, t: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, t), *x]).astype(t)))
    return pa.Table.from_arrays([one(docs, "row"), one(docs, "doc_id"), *(pa.array(sums[:, i]) for i in range(4)), pa.array(digests, pa.string()), flat(held, np.int64), flat(times, np.int32)], [f.split(" ")[0] for f in MET.split(", ")])


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class _Buckets:
    """Tables bucketed by ``key``, in the shared folder; equal bucket numbers meet without a shuffle."""

    def __init__(self, spark: SparkSession, scratch: Scratch, n: int, key: str):
        self.spark, self.scratch, self.n, self.key = spark, scratch, n, key

    def keep(self, df: DataFrame) -> DataFrame:
        self.scratch.n += 1
        path, name = f"{self.scratch.root}/{self.scratch.n}", f"aligned_{uuid.uuid4().hex}"
        df.write.bucketBy(self.n, self.key).options(path=path, compression="zstd").saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._table = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        self.spark.sql(f"drop table {df._table}")
        self.scratch.drop(df)


def lengths(spark: SparkSession, bytes_of: list[bytes] | dict[int, bytes]) -> DataFrame:
    """(id, n): the bytes of each id of a vocabulary."""
    items = bytes_of.items() if isinstance(bytes_of, dict) else enumerate(bytes_of)
    return spark.createDataFrame([(i, len(b)) for i, b in items], "id int, n int")


def ends(docs: DataFrame, ids: str, sizes: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """(slot, row, end, position, id): where each token of the array ``ids`` ends in its part."""
    tokens = docs.select("slot", "row", F.posexplode(ids).alias("at", "id")).join(F.broadcast(sizes), "id")
    running = Window.partitionBy("slot", "row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.select("slot", "row", F.sum("n").over(running).alias(names[0]), F.col("at").alias(names[1]), F.col("id").alias(names[2]))


def cut_groups(docs: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> DataFrame:
    """(slot, row, g, a_from, a_n, a_last, b_from, b_n, b_last): the groups that common ends cut, by places in
    the arrays a and b (from 0), and the last id of each side."""
    a = ends(docs, "a", a_sizes, ("end", "a_at", "a_last"))
    b = ends(docs, "b", b_sizes, ("end", "b_at", "b_last"))
    w = Window.partitionBy("slot", "row").orderBy("end")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(-1))
    cuts = a.join(b, ["slot", "row", "end"]).select("*", F.row_number().over(w).alias("g"), before("a_at").alias("a_was"), before("b_at").alias("b_was"))
    side = lambda s: [(F.col(f"{s}_was") + 1).alias(f"{s}_from"), (F.col(f"{s}_at") - F.col(f"{s}_was")).alias(f"{s}_n"), f"{s}_last"]
    return cuts.select("slot", "row", "g", *side("a"), *side("b"))


def pair(a: Column, b: Column) -> Column:
    """An id of either side in one long."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


SPOTS = "array<struct<place: long, k: int>>"
KEPT = f"slot int, row long, spots {SPOTS}, n_a long, n_b long, n_groups long, body string, links array<long>, both array<struct<g: int, a: array<int>, b: array<int>>>"


def _aligned(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """A row a part: counts, the text of its groups, links of one-sided groups, and the groups with several tokens on both sides."""
    single = F.expr("a_n = 1 and b_n = 1")
    collect = lambda where, x: F.collect_list(F.when(where, x))  # noqa: E731  other rows are null, which it leaves out
    listed = groups.groupBy("slot", "row").agg(
        F.sort_array(F.collect_list(pair(F.expr("a_from + a_n"), F.expr("b_from + b_n")))).alias("cuts"),
        collect(single, pair(F.col("a_last"), F.col("b_last"))).alias("links"),
        collect(~single, F.struct("g", "a_from", "a_n", "b_from", "b_n")).alias("gs"),
    )
    # not slice(): inside a lambda it copies the whole array for each group
    part = lambda c, start, n: F.transform(F.sequence(start, start + n - 1), lambda i: F.get(F.col(c), i))
    a_of = lambda x: part("a", x.a_from, x.a_n)
    b_of = lambda x: part("b", x.b_from, x.b_n)
    spread = F.filter("gs", lambda x: (x.a_n == 1) | (x.b_n == 1))
    spread = F.flatten(F.transform(spread, lambda x: F.when(x.a_n == 1, F.transform(b_of(x), lambda i: pair(F.get("a", x.a_from), i))).otherwise(F.transform(a_of(x), lambda i: pair(i, F.get("b", x.b_from))))))
    both = F.transform(F.filter("gs", lambda x: (x.a_n > 1) & (x.b_n > 1)), lambda x: F.struct(x.g.alias("g"), a_of(x).alias("a"), b_of(x).alias("b")))
    none = F.array().cast("array<long>")
    rows = docs.join(listed, ["slot", "row"], "left").select(
        "slot",
        "row",
        "spots",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.coalesce(F.size("cuts").cast("long"), F.lit(0)).alias("n_groups"),
        F.coalesce(F.concat("links", spread), none).alias("links"),
        both.alias("both"),
        "a",
        "b",
        F.coalesce("cuts", none).alias("cuts"),
    )
    return rows.mapInArrow(_group_texts, KEPT)


def group_text(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> str:
    """``a1,a2|b1;a3|b2,b3`` of the groups that end before these places of both sides."""
    sa, sb, out, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
    for k, m in zip(a_ends, b_ends, strict=True):
        out.append(f"{sa[i]}|{sb[j]}" if k - i == 1 == m - j else f"{','.join(sa[i:k])}|{','.join(sb[j:m])}")
        i, j = k, m
    return ";".join(out)


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    """A numpy array a row, without an object a value; none is null."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each part's groups, in place of its ids and cuts."""
    for batch in batches:
        *key, spots, n_a, n_b, n_groups, links, both, a_ids, b_ids, cuts = batch.columns
        texts = [group_text(a.tolist(), b.tolist(), (c >> 32).tolist(), (c & 0xFFFFFFFF).tolist()) for a, b, c in zip(*map(_rows, (a_ids, b_ids, cuts)), strict=True)]
        yield pa.RecordBatch.from_arrays([*key, spots, n_a, n_b, n_groups, pa.array(texts, pa.string()), links, both], ["slot", "row", "spots", "n_a", "n_b", "n_groups", "body", "links", "both"])


def range_links(groups: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> DataFrame:
    """(slot, row, pair): pairs of tokens of (slot, row, g, a, b) whose byte ranges in the group overlap."""

    def spans(side: str, sizes: DataFrame) -> DataFrame:
        tokens = groups.select("slot", "row", "g", F.posexplode(side).alias("at", "id")).join(F.broadcast(sizes), "id")
        running = Window.partitionBy("slot", "row", "g").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum("n").over(running)
        return tokens.select("slot", "row", "g", F.col("id").alias(side), (end - F.col("n")).alias(f"{side}_start"), end.alias(f"{side}_end"))

    met = spans("a", a_sizes).join(spans("b", b_sizes), ["slot", "row", "g"])
    return met.where("a_start < b_end and b_start < a_end").select("slot", "row", pair(F.col("a"), F.col("b")).alias("pair"))


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, scratch: Scratch | None = None, most: int = 1_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``most``: number of pairs up to which their counts are broadcast.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _Buckets(spark, scratch, tasks, "chunk")
    told = chunks.keep(rows.mapInArrow(_told, TOLD))
    listed = told.where("parts is not null")
    total = listed.agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p) + 1))).first()[0] or 0
    n = max(tasks, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))
    tables = _Buckets(spark, scratch, n, "slot")
    spots = listed.select("chunk", "base", F.posexplode("parts").alias("k", "part"))
    spot = F.struct(F.col("chunk").alias("place"), (F.col("base") + F.col("k")).alias("k"))
    spots = spots.select(F.xxhash64("part").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"), "part", spot.alias("spot")).repartition(n, "slot")
    parts = spots.groupBy("slot", "part").agg(F.collect_list("spot").alias("spots")).select("slot", F.monotonically_increasing_id().alias("row"), "part", "spots")
    a_sizes = lengths(spark, ByteIds(byte_vocabulary).bytes_of)
    b_sizes = lengths(spark, codec(piece_vocabulary).bytes_of)
    whole_key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(whole_key)
    spark.conf.set(whole_key, "false")  # tables bucketed by slot meet on (slot, part, end) as they lie
    try:
        ids = tables.keep(parts.mapInArrow(_both(byte_vocabulary, piece_vocabulary), f"slot int, row long, spots {SPOTS}, a array<int>, b array<int>"))
        aligned = tables.keep(_aligned(ids, cut_groups(ids, a_sizes, b_sizes)))
        tables.drop(ids)
        spark._jvm.System.gc()  # shuffles of the steps before leave the disks when the driver has collected their plans
        ranged = range_links(aligned.select("slot", "row", F.explode("both").alias("x")).select("slot", "row", "x.*"), a_sizes, b_sizes)
        more = ranged.groupBy("slot", "row").agg(F.collect_list("pair").alias("more"))
        links = F.concat("links", F.coalesce("more", F.array().cast("array<long>"))).alias("links")
        own = aligned.join(more, ["slot", "row"], "left").select("spots", "n_a", "n_b", "n_groups", "body", links).mapInArrow(_blocks, BLOCK)
        texts = told.where("words is not null").select("chunk", "row", "doc_id", "words")
        met = scratch.keep(texts.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_met, MET), compression="zstd")
        tables.drop(aligned)
    finally:
        spark.conf.set(whole_key, was)
    chunks.drop(told)
    counts = scratch.keep(met.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a_id = F.shiftright("pair", 32)
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    counts = scratch.keep(counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    found = met.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    n_pairs = counts.count()
    if n_pairs <= most:
        summed = sums(found.join(F.broadcast(counts), "pair"))
    else:
        # pairs in many documents: together they are in no more than all documents' links, so they are few
        held = counts.agg(F.sum("n")).first()[0]
        by_pair = found.join(F.broadcast(counts.where(F.col("n") > held / most)), "pair", "left")
        rest = by_pair.where("n is null").drop("n", "best").join(counts.where(F.col("n") <= held / most), "pair")
        both = by_pair.where("n is not null").select("row", "times", "n", "best").union(rest.select("row", "times", "n", "best"))
        summed = sums(both)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = met.drop("pairs", "times").join(summed, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
