"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures.

A document's signature has CHUNKS * WIDTH symbols of 16 bits. Two signatures
that differ in at most ``2 * CHUNKS - 1`` symbols have, by the pigeonhole
principle, a chunk with at most one error; so each chunk is indexed once for
each place an error may stand in (the chunk without that symbol), and equal
keys find every pair under the threshold, and most that lie above it: no chunk
of a pair at similarity 0.85 matches so with a chance of about 5e-7, at 0.80 of
2e-5. Candidates that differ in fewer than FAR symbols are confirmed on the
full shingle sets; at 0.85 a pair has more with a chance of about 2e-7, at 0.80
of 2e-5.

Edge cases: null or blank texts have an empty set and link with nothing; texts
of fewer words than a shingle are one shingle; equal sets are one class that
costs one row, however many copies there are (classes are told apart by a hash of
64 bits); rows that share a doc_id are one node with the links of all its rows, whose
texts may differ; rows with a null doc_id come back with a
null component, kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, join_small
from helixframe.llm.links import connected_components, link, links_in_blocks
from helixframe.llm.words import WordHasher, mix

CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Candidates that differ in so many symbols are not confirmed.
FAR = 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_rng = np.random.default_rng(20240229)
MULT = (_rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, words: int):
        self.words, self.hasher = words, WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        hashes = self.hasher(raw)[0]
        if not len(hashes):
            return np.empty(0, np.uint64)
        k = min(self.words, len(hashes))
        n = len(hashes) - k + 1
        acc = np.full(n, k * 0x9E3779B1, np.uint64)
        for i in range(k):
            acc *= ODD[i % 6]
            acc += hashes[i : i + n]
            acc = mix(acc)
        acc.sort()
        return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(low, (MULT[:, None] * s[at : at + 4096] + ADD[:, None]).min(axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(n, SYMBOLS) signatures to (n, CHUNKS * WIDTH) keys: each chunk without each of its symbols."""
    s = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    for gone in range(WIDTH):
        acc = np.zeros((len(sig), CHUNKS), np.uint64)
        for j in range(WIDTH):
            if j != gone:
                acc = (acc << np.uint64(16)) | s[:, :, j]
        tag = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gone + 1)
        out[:, :, gone] = mix(acc * ODD[0] + tag * ODD[1])
    return out.reshape(len(sig), -1)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            ids, n, one, sigs = [], [], [], []
            for k in range(batch.num_rows):
                s = shingle(batch.column(1)[k].as_py())
                ids.append(batch.column(0)[k].as_py())
                n.append(len(s))
                one.append(_class(s.tobytes()))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "s1", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(sig)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in under FAR symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) < FAR))


def _sets(words: int):
    """(doc_id, text) to (id, body): the class of the text's set and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [s.tobytes() for t in batch.slice(at, 500).column(1) if len(s := shingle(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["id", "body"])

    return run


def _class(s: bytes) -> int:
    """The name of the class of equal sets."""
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def _alike(percent: int):
    def one(x: bytes, y: bytes) -> bool:
        both = np.frombuffer(x + y, np.uint64).copy()
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    return lambda pairs: [one(x, y) for x, y in pairs]


def _confirm(percent: int):
    holds = _alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = holds((x.as_py(), y.as_py()) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return run


def _may(percent: int):
    def near(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
        x, y = np.ascontiguousarray(sa).view(np.uint16), np.ascontiguousarray(sb).view(np.uint16)
        return (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)) & ((x[:, None, :] != y).sum(2) < FAR)

    return near


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the groups of documents with ``100 * shared >= percent * union``."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(docs.mapInArrow(_sign(words), "doc_id long, n_shingles long, s1 long, sig binary"))
    # a class of equal sets is named by a hash of 64 bits; its text is read from its first document
    classes = signed.where("sig is not null and doc_id is not null").groupBy(F.col("s1").alias("id")).agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = scratch.keep(classes)
    keys = scratch.keep(classes.select("id", "sig").mapInArrow(_keys, "key long, id long"))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = scratch.keep(classes.select("id", "doc").join(ids, "id").select("id", F.col("doc").alias("doc_id")))
        own = wanted.select("doc_id").distinct()
        sets = join_small(docs, own, "doc_id", "left_semi", own.count()).mapInArrow(_sets(words), "id long, body binary")
        # a document of several texts gives sets that nobody asked for
        return sets.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])

    def verify(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
        b = classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
        close = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        close = scratch.keep(close.select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long"))
        sets = scratch.keep(fetch(close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()))
        full = close.join(sets.select(F.col("id").alias("a"), F.col("body").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("body").alias("tb")), "b")
        held = scratch.keep(full.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long"))
        scratch.drop(sets, close)
        return held

    def across(members: DataFrame) -> DataFrame:
        return links_in_blocks(members, classes.select("id", "n", "sig"), _may(percent), fetch, _alike(percent), scratch)

    comps = link(keys, verify, scratch, across)
    scratch.drop(keys)
    # a document of several texts joins their classes
    named = signed.where("sig is not null and doc_id is not null")
    twice = scratch.keep(named.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b"))
    if twice.limit(1).count():
        more = named.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("s1").alias("b")).union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comps = connected_components(more, scratch)
    member = scratch.keep(classes.select("id", "doc").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", "doc", F.coalesce("comp", "id").alias("comp")))
    # groups are named by their smallest document; a class of its own needs no look-up
    first = member.groupBy("comp").agg(F.min("doc").alias("component_id"))
    placed = scratch.keep(member.join(first, "comp").select(F.col("id").alias("s1"), "component_id"))
    per_row = signed.join(placed, "s1", "left").select("doc_id", "n_shingles", "component_id")
    out = per_row.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id. Its repeated rows
    stay once; if it has several texts, each of them stays."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    gone = near_duplicates(docs, words, percent).where("not kept").select("doc_id")
    kept = packed.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "t"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
