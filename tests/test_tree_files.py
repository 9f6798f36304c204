"""Tables of tree files, Newick texts, masks in chunks."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import export as X
from helixframe.operators import newick as N
from helixframe.sources import tree_tables as TT


def container(arrays: dict[str, np.ndarray]) -> bytes:
    """A file of arrays: header, descriptors, names, arrays at multiples of eight."""
    names = sorted(arrays)
    at = 64 + 64 * len(names)
    keys = []
    for n in names:
        keys.append(at)
        at += len(n)
    starts = []
    for n in names:
        at += -at % 8
        starts.append(at)
        at += arrays[n].nbytes
    out = bytearray(at)
    out[:64] = TT.MAGIC + struct.pack("<HHIQ", 1, 0, len(names), at) + bytes(40)
    for k, n in enumerate(names):
        kind = TT.KINDS.index(arrays[n].dtype.newbyteorder("<").str.replace("|", "<"))
        out[64 + 64 * k : 128 + 64 * k] = struct.pack("<B7xQQQQ24x", kind, keys[k], len(n), starts[k], len(arrays[n]))
        out[keys[k] : keys[k] + len(n)] = n.encode()
        out[starts[k] : starts[k] + arrays[n].nbytes] = arrays[n].tobytes()
    return bytes(out)


def good():
    return {
        "nodes/time": np.array([0.0, 0.0, 1.5]), "nodes/flags": np.array([1, 1, 0], "<u4"), "nodes/population": np.array([0, 0, -1], "<i4"), "nodes/individual": np.array([-1] * 3, "<i4"),
        "edges/left": np.array([0.0, 0.0]), "edges/right": np.array([9.0, 9.0]), "edges/parent": np.array([2, 2], "<i4"), "edges/child": np.array([0, 1], "<i4"),
        "sites/position": np.array([3.0, 4.0]), "sites/ancestral_state": np.frombuffer("Aé".encode(), "<i1"), "sites/ancestral_state_offset": np.array([0, 1, 3], "<u8"),
        "mutations/site": np.array([], "<i4"), "mutations/node": np.array([], "<i4"), "mutations/parent": np.array([], "<i4"), "mutations/derived_state": np.array([], "<i1"), "mutations/derived_state_offset": np.array([0], "<u4"),
        "sequence_length": np.array([9.0]),
    }


def test_tables_of_files(spark, tmp_path):
    raw = container(good())
    for k in range(3):
        (tmp_path / f"{k}.trees").write_bytes(raw)
    read = lambda t: TT.read_table(spark, str(tmp_path), t)
    nodes = read("nodes").where("path like '%/1.trees'").orderBy("id").collect()
    assert [(r.id, r.time, r.flags, r.population, r.error) for r in nodes] == [(0, 0.0, 1, 0, None), (1, 0.0, 1, 0, None), (2, 1.5, 0, -1, None)]
    assert read("edges").count() == 6 and read("mutations").count() == 0 and read("individuals").count() == 0
    sites = read("sites").where("path like '%/0.trees'").orderBy("id").collect()
    assert [(r.position, r.ancestral_state) for r in sites] == [(3.0, "A"), (4.0, "é")]


def test_damaged_files_tell_so(spark, tmp_path):
    raw, off = container(good()), good()
    off["sites/ancestral_state_offset"] = np.array([0, 2, 1], "<u4")
    short = good()
    short["edges/child"] = np.array([0], "<i4")
    text = good()
    text["sites/ancestral_state"] = np.array([-1, -2, -3], "<i1")
    bad = {"a": b"", "b": b"x" * 200, "c": raw[:-1], "d": raw[:8] + b"\x02" + raw[9:], "e": raw[:64] + b"\xff" + raw[65:], "f": raw[:88] + b"\xff" * 8 + raw[96:], "g": container(off), "h": container(short), "i": container(text)}
    for name, data in bad.items():
        (tmp_path / f"{name}.trees").write_bytes(data)
    failed = lambda t: {r.path[-7] for r in TT.read_table(spark, str(tmp_path), t).where("error is not null").collect()}
    assert failed("sites") == set("bcdefgi") and failed("edges") == set("bcdefh")  # Spark lists no empty file
    assert {r.path[-7] for r in TT.read_table(spark, str(tmp_path), "edges").where("error is null").collect()} == {"g", "i"}


def text_of(tree, rng):
    if isinstance(tree, str):
        name = f"'{tree}'" if rng.random() < 0.3 else tree
    else:
        name = "(" + ",".join(text_of(t, rng) for t in tree) + ")" + rng.choice(["", "x1", "'in ner'"])
    return name + rng.choice(["", " ", "[note, (a)]"]) + rng.choice(["", ":1", ":2.5e-3"])


def leaf_sets(tree):
    if isinstance(tree, str):
        return [], frozenset([tree])
    below = [leaf_sets(t) for t in tree]
    own = frozenset().union(*(b[1] for b in below))
    return [s for b in below for s in b[0]] + [own], own


def random_tree(rng, names):
    parts = [*names]
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 3]))
        some = rng.sample(parts, k)
        parts = [p for p in parts if p not in some] + [tuple(some)]
    return parts[0]


def test_newick_against_brute_force(spark):
    rng, trees = random.Random(3), []
    for k in range(60):
        trees.append(random_tree(rng, [f"t{i}" for i in range(rng.choice([1, 2, 5, 6]))]))
    rows = [(k, text_of(t, rng) + rng.choice([";", ""])) for k, t in enumerate(trees)] + [(100, None), (101, "  ")]
    frame = spark.createDataFrame(rows, "k long, text string").repartition(3)
    got = {}
    for r in N.node_table(frame, "text", "k").collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(range(60))
    for k, tree in enumerate(trees):
        inner, all_ = leaf_sets(tree)
        parents = {r.parent for r in got[k]}
        assert {r.name for r in got[k] if r.node not in parents} == all_
        assert sorted(r.leaves for r in got[k] if r.node in parents) == sorted(map(len, inner))
    leaves = {r.k: r.x for r in frame.select("k", N.leaves(F.col("text")).alias("x")).collect()}
    assert leaves[100] == [] == leaves[101] and all(leaves[k] == sorted(leaf_sets(t)[1]) for k, t in enumerate(trees))
    want = {}
    for t in trees:
        inner, all_ = leaf_sets(t)
        for s in set(inner) - {all_}:
            want[s] = want.get(s, 0) + 1
    keys = spark.createDataFrame([(sorted(s), n) for s, n in want.items()], "names array<string>, want long").withColumn("clade", N.clade_of(F.col("names")))
    met = N.clade_support(frame, "text", "k").join(keys, "clade", "full").collect()
    assert len(met) == len(want) and all(r.n == r.want and r.share == pytest.approx(r.n / 62) for r in met)


def test_texts_that_are_no_trees():
    assert [n[2] for n in N.parse("'it''s';")] == ["it's"] and N.parse("(,);")[1][4] == 1
    for bad in ("(a,b", "a,b", "(a:,b)", "(a)(b)", "a b", "(a,b));", "a;b", "(a:x)", "'open"):
        with pytest.raises(ValueError):
            N.parse(bad)


@pytest.mark.parametrize("period", [1, 3, 5])
def test_masks_whatever_their_chunks(spark, period):
    rng = random.Random(period)
    seqs = {"c1": "".join(rng.choices("ACN", k=137)), "c2": "G", "c3": "AC" * 20}
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "contig string, length long")
    whole = lambda df: {c: "".join(x[1] for x in sorted((r.chunk, r.seq) for r in df.collect() if r.contig == c)) for c in seqs}
    results = set()
    for size in (1, 7, 1000):
        chunks = spark.createDataFrame([(c, k // size, s[k : k + size]) for c, s in seqs.items() for k in range(0, len(s), size)], "contig string, chunk long, seq string")
        small = X.compress_chunks(chunks, period)
        assert whole(small) == {c: s[::period] for c, s in seqs.items()}
        results.add(tuple(whole(X.decompress_chunks(small, lengths, period)).values()))
    one = [X.decompress(F.lit(s[::period]), period, F.lit(len(s))) for s in seqs.values()]
    assert results == {tuple(spark.range(1).select(*one).first())}


def test_masks_of_other_lengths_are_an_error(spark):
    m = [(c, p, x, k) for k in "ab" for c, p, x in (("c", 1, "C"), ("c", 2, "A"), ("d", 1, "N"))]
    frame = lambda rows: spark.createDataFrame(rows, "contig string, pos long, code string, m string")
    assert {(r.contig, r.pos): r.code for r in X.consensus(frame(m), 1.0, 2, "m").collect()} == {("c", 1): "C", ("c", 2): "A", ("d", 1): "N"}
    for bad in (m + [("c", 3, "C", "a")], m[:-1]):
        with pytest.raises(Exception, match="masks differ in contig"):
            X.consensus(frame(bad), 1.0, 2, "m").collect()
