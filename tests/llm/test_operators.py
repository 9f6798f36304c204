import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import html_text, langid, line_dedup, line_hash, minhash_dedup, mixing, packing, quality, tiff, token_counts, vector_search
from helixframe.llm.links import connected_components
from helixframe.llm.common import Scratch, crc_of_id
from helixframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source); two more columns clash with names of results."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.0, "x") for r in rows], DOCS)


def some_docs(n=60, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        if k % 6 == 5:
            base = rows[k - 1][1].split()
            base[rng.randrange(len(base))] = "zzz"
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120)))
        rows.append((k, text, "en", f"s{k % 3}"))
    return [*rows, (100, None, None, None), (101, "", "en", "s0"), (102, " \n ", "en", "s1"), (103, "two words", "en", "s0"), (104, "two words", "en", "s1"), (0, rows[0][1], "en", "s0"), (105, "é " * 5000, "fr", "s2"), (None, "no id here at all", "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, some_docs()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).cache()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: c for x, c in label.items() if x in {y for a, b in edges if a != b for y in (a, b)}}


def brute_near(rows, words, percent):
    sets, node = {}, {}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = (t or "").encode().translate(minhash_dedup.LOWER).split()
        k = min(words, len(w))
        sets.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
        node[d] = d
    ids = sorted(sets)
    for _ in range(len(ids)):
        was = dict(node)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    node[a] = node[b] = min(node[a], node[b])
        if was == node:
            return node


def test_near_duplicates(docs, empty):
    rows = some_docs()
    got = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_near(rows, 3, 85)
    assert {r.doc_id: r.n_shingles for r in got}[103] == 1 and {r.doc_id: r.n_shingles for r in got}[100] == 0
    kept = minhash_dedup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and kept.where("doc_id = 104").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_across_groups(spark):
    """A chain of texts whose ends differ: blocks between groups find what representatives miss."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(base), "en", "s"))
        base = list(base)
        for _ in range(2):
            base[rng.randrange(100)] = f"n{k}_{rng.randrange(1000)}"
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(spark, rows), 3, 85).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_duplicates_of_repeated_ids(spark):
    """A doc_id with two texts is one node with the links of both; words that collide as polynomials differ."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, a, "en", "s"), (3, b + " end", "en", "s"), (4, c, "en", "s"), (4, text(), "en", "s"), (5, text(), "en", "s"), (6, c, "en", "s")]
    df = docs_of(spark, rows)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == brute_near(rows, 3, 85) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    assert sorted(r.doc_id for r in minhash_dedup.drop_near_duplicates(df, 3, 85).collect()) == [1, 1, 4, 4, 5]
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    twins = docs_of(spark, [(1, word, "en", "s"), (2, word.translate(str.maketrans("ab", "ba")), "en", "s")])
    assert minhash_dedup.near_duplicates(twins, 3, 85).where("not kept").count() == 0


def test_signature_index_finds_all_pairs_below_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, minhash_dedup.SYMBOLS, dtype=np.uint16)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(minhash_dedup.SYMBOLS, 2 * minhash_dedup.CHUNKS - 1, replace=False)
        b[at] ^= 1
        assert set(minhash_dedup.chunk_keys(a[None])[0]) & set(minhash_dedup.chunk_keys(b[None])[0])


def test_line_dedup(spark, empty):
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{line}\nunique line number one is here\nok", "en", "s"), (2, f"other text stands here alone\n{line.upper()}", "en", "s"), (3, line.replace("lazy", "hazy") + "\nok", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, f"{line}\n{line}", "en", "s"), (None, line, "en", "s")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "other text stands here alone" and got[6].text == "" and got[6].n_removed == 2
    assert got[4].text is None and got[5].text == "" and got[None].text == line and got[3].text == ""  # "ok" stays in the first document
    assert got[3].kept == "x"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_other_numbers(spark):
    """Lines of one form go only if their digits, too, are within a tenth."""
    rows = [(1, "12345678 98765432", "en", "s"), (2, "55501234 00017777", "en", "s"), (3, "12345678 98765433", "en", "s"), (4, "55501234 00017777", "en", "s")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: ""}


def test_line_keys_survive_replaced_words():
    """(K - 1) / 2 replaced words leave a block, one replaced word of a short line a key; long and odd lines are hashed too."""
    rng, hasher = random.Random(6), line_hash.LineHasher()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 10)))
    for n, e in ((5, 1), (9, 1), (18, 1), (25, 2), (40, 2), (60, 3), (100, 4), (200, 6)):
        for _ in range(40):
            x = [word() for _ in range(n)]
            y = list(x)
            for k in rng.sample(range(n), e):
                y[k] = word()
            _, keys, count = hasher([" ".join(x), " ".join(y)])
            assert set(keys[: count[0]]) & set(keys[count[0] :]), (n, e)
    for a, b in (("abcdefghijk", "abcdXfghijk"), ("abcdefghi", "abcdefghij"), ("abcdefghijklmnopqrs", "bcdefghijklmnopqrs")):
        _, keys, count = hasher([a, b])
        assert set(keys[: count[0]]) & set(keys[count[0] :])
    whole, keys, count = hasher(["q " * 700, "x", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900)), "a b"])
    assert whole.shape == (4, 2) and count[1] == 0 and count[2] > 5


def test_within_a_tenth():
    rng = random.Random(8)
    pairs, want = [], []
    for _ in range(600):
        x = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60)))
        y = list(x)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
        y = "".join(y) or "q"
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row = [last := i] + [last := min(row[j] + 1, last + 1, row[j - 1] + (a != b)) for j, b in enumerate(y, 1)]
        pairs.append((x, y))
        want.append(row[-1] <= max(len(x), len(y)) // 10)
        assert line_hash._distance(x, y, 99) == row[-1]
    assert line_hash.within_a_tenth(pairs).tolist() == want and 50 < sum(want) < 550
    long = "word " * 700
    assert line_hash.within_a_tenth([(long + "x" * 90, "y" * 90 + long), (long, long[::-1])]).tolist() == [True, False]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ij\u00ff\u0100\u4e2d", "".join(chr(0x4E00 + k) for k in range(400))])
def test_distances_on_diagonals(letters):
    """Bounds of their own for pairs of all lengths, empty texts too, against tables of distances."""
    rng, xs, ys, most, want = random.Random(3), [], [], [], []
    for _ in range(300):
        x = [rng.choice(letters) for _ in range(rng.randrange(60))]
        y = list(x)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row = [last := i] + [last := min(row[j] + 1, last + 1, row[j - 1] + (a != b)) for j, b in enumerate(y, 1)]
        xs.append("".join(x))
        ys.append("".join(y))
        most.append(rng.randrange(12))
        want.append(row[-1] <= most[-1])
    assert line_hash._on_diagonals(tuple(xs), tuple(ys), np.array(most)).tolist() == want and 50 < sum(want) < 290


def brute_lines(texts):
    """(pairs of distinct normalised lines within a tenth, the lines), with a bound by characters before the table of distances."""
    lines = sorted({n for t in texts for x in (t or "").split("\n") if (n := line_dedup.normalise(x))}, key=len)
    size, bags, pairs = np.array([len(x) for x in lines]), np.zeros((len(lines), 256), np.float32), []
    for k, x in enumerate(lines):
        for a, b in zip(x, x[1:]):
            bags[k, (ord(a) * 31 + ord(b)) % 256] += 1
    for i in np.flatnonzero(size >= 9):
        end = np.searchsorted(size, size[i] * 10 // 9 + 1, "right")
        far = np.abs(bags[i + 1 : end] - bags[i]).sum(1)
        pairs += [(i, j) for j in np.flatnonzero(far <= 4 * (size[i + 1 : end] // 10)) + i + 1]
    pairs = [p for p, yes in zip(pairs, line_hash.within_a_tenth([(lines[i], lines[j]) for i, j in pairs]), strict=True) if yes]
    return lines, pairs


def test_line_dedup_recall(spark):
    """All pairs of the small tables by brute force: 0.95 and more of them end in one group, by length, and no more are removed."""
    for sf, least in (("sf0.001", 1.0), ("sf0.01", 0.97)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = docs.collect()
        lines, pairs = brute_lines([r.text for r in rows])
        hasher, keys = line_hash.LineHasher(), []
        for at in range(0, len(lines), 256):
            _, k, n = hasher(lines[at : at + 256])
            keys += [set(x) for x in np.split(k, np.cumsum(n)[:-1])]
        words = np.array([len(x.split()) for x in lines])
        for lo, hi in ((1, 15), (15, 30), (30, 60), (60, 10**9)):
            own = [(i, j) for i, j in pairs if lo <= words[j] < hi]
            assert sum(bool(keys[i] & keys[j]) for i, j in own) >= 0.9 * len(own), (sf, lo)
        # groups by brute force: as many occurrences stay as there are groups, but for those that the missed pairs leave apart
        root = list(range(len(lines)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        joined = 0
        for i, j in pairs:
            a, b = find(i), find(j)
            joined += a != b
            root[a] = b
        all_lines = sum(bool(line_dedup.normalise(x)) for r in rows for x in (r.text or "").split("\n"))
        gone = line_dedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0]
        most = all_lines - len(lines) + joined
        assert all_lines - len(lines) + least * joined <= gone <= most


def test_line_dedup_repeated_ids_and_clashes(spark, empty):
    """Rows of one doc_id with other texts are told apart; columns named like internals pass through."""
    rows = [(1, "first of a kind here\nshared line of words", "a"), (1, "another text it is\nshared line of words", "b"), (2, "shared line of words\n\n", "c"), (2, "shared line of words\n\n", "d"), (3, "", "e"), (3, None, "f")]
    df = spark.createDataFrame(rows, "doc_id int, text string, gone string").withColumns({"h": F.lit(1), "t": F.lit("t"), "row": F.lit(2), "n_lines": F.lit("old"), "pos": F.lit(0)})
    got = line_dedup.dedup_lines(df)
    assert {r.gone: r.text for r in got.collect() if r.gone in "cdef"} == {"c": "\n", "d": "\n", "e": "", "f": None}
    assert sorted(len(r.text) for r in got.where("doc_id = 1").collect()) in ([len("another text it is"), len(rows[0][1])], [len("first of a kind here"), len(rows[1][1])])
    assert got.columns == ["doc_id", "text", "gone", "h", "t", "row", "pos", "n_lines", "n_removed"]


def test_token_counts_and_ids(docs, empty):
    import sentencepiece
    from tokenizers import Tokenizer

    odd = ["", " ", "  a", "a  b ", "▁x▁▁y", "a\x1cb\x85c", "<|endoftext|>x", "İI ß Ñ Ö̈", "x" * 4000, "don't we'll 3rd!?", "日本 語", "\n\na\tb"]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))(odd) == [len(sp.encode(t)) for t in odd]
    tok, ids = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), packing.WordIds(vocabulary("word_bpe_49k.json"))
    for t in odd:
        assert ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")).count() == docs.count()
    assert token_counts.token_counts(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_packing(docs, empty):
    for per_task in (50_000, 8):
        rows = packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), room=256), room=256, per_task=per_task).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for own in by.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 256
        total = sum(r.length for r in rows)
        assert len(by) <= -(-total // 256) * 1.2 + 1
        pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), room=256).count()
        assert len(rows) == pieces
    assert packing.pack(packing.token_pieces(empty, vocabulary("word_bpe_49k.json"))).count() == 0


def test_packing_of_pieces_that_do_not_fit_together(spark):
    """All above half the room: a round brings nothing, and no task gets more than its share."""
    df = spark.range(400).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(140 + id % 50 as long) as length", "0L as ids_crc32")
    rows = packing.pack(df, room=256, per_task=20).collect()
    assert len({r.sequence_id for r in rows}) == 400 == len(rows) and all(r.offset == 0 for r in rows)
    one = packing.pack(df.withColumn("length", F.lit(64).cast("long")), room=256, per_task=20).collect()
    assert len({r.sequence_id for r in one}) <= 104


def test_pieces_against_the_tokenizer(spark):
    """Start, length, checksum and order of ids of every piece, cuts included."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {1: "some words here " * 300, 2: "", 3: None, 4: "x" * 900, 5: "Ünïcode ñandú " * 50}
    got = packing.token_pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), vocabulary("word_bpe_49k.json"), room=128).collect()
    want = set()
    for d, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want |= {(d, k, at, len(ids[at : at + 128]), zlib.crc32(np.array(ids[at : at + 128], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 128))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want


def test_best_fit_never_overfills():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 101, 500)
    bin_of, used = packing.best_fit(n, 100)
    assert (np.bincount(bin_of, n) == used).all() and used.max() <= 100 and len(used) < n.sum() / 100 * 1.1


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by, target, size = Counter(), {}, Counter()
    for r in rows:
        by[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert all(abs(by[s] - target[s]) <= 48 and target[s] <= 2 * size[s] for s in by)
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in taken.collect()) == sum(by.values())
    assert mixing.mix(empty).count() == 0


def test_mixing_tells_null_from_names(spark):
    rows = [(1, "a b c", None), (2, "d e f", "\x00null"), (3, "g h", "\x00\x00null")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.source_size) for r in got) == [(1, 3), (2, 3), (3, 2)]


def test_seats_are_sainte_lague(spark):
    rng = random.Random(2)
    shares = [rng.random() ** 3 * 1000 + 1 for _ in range(30)]
    df = spark.createDataFrame([(f"c{i:02}", s, 77) for i, s in enumerate(shares)], "cell string, share double, total long")
    got = {r.cell: r.seats for r in mixing.seats(df, [], "total", "share").collect()}
    won = Counter()
    for _ in range(77):
        won[max(range(30), key=lambda i: shares[i] / (2 * won[i] + 1))] += 1
    assert got == {f"c{i:02}": won[i] for i in range(30)}


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8))
    v[50:120] = v[7]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k_of_every(df, 10, 5).collect()}
    q = np.floor(256 * v).astype(np.int64)
    want = {}
    for i in range(0, 300, 10):
        s = q @ q[i]
        for k, j in enumerate([j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]):
            want[i, k + 1] = (j, s[j])
    assert got == want
    assert vector_search.top_k_of_every(df.limit(0), 10, 5).count() == 0


def brute_top(v, every, k):
    q = {i: [math.floor(256 * x) for x in r] for i, r in v.items()}
    score = lambda i, j: sum(a * b for a, b in zip(q[i], q[j], strict=True))
    return {(i, r + 1): (j, score(i, j)) for i in q if i % every == 0 for r, j in enumerate(sorted((j for j in q if j != i), key=lambda j: (-score(i, j), j))[:k])}


def test_vector_search_repeated_query_row(spark):
    v = {i: [float(x) for x in r] for i, r in enumerate(np.random.default_rng(3).standard_normal((60, 4)))}
    df = spark.createDataFrame([*v.items(), (10, v[10]), (10, v[10]), (7, v[7])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k_of_every(df, 10, 5).collect()]
    assert sorted(got) == sorted((*a, *b) for a, b in brute_top(v, 10, 5).items())


def test_vector_search_many_query_blocks_and_odd_rows(spark):
    """More blocks of queries than are sent out; ids of several vectors; vectors of other lengths and of none."""
    rng = np.random.default_rng(7)
    v = {i: [float(x) for x in r] for i, r in enumerate(rng.standard_normal((300, 3)))}
    df = spark.createDataFrame([*v.items(), (0, [9.0, 9.0, 9.0]), (900, [1.0]), (901, []), (902, [2.0])], "vec_id long, embedding array<double>")
    v[0] = min(v[0], [9.0, 9.0, 9.0], key=lambda x: [math.floor(256 * y) for y in x])
    small = spark.createDataFrame([(i, [math.floor(256 * x) for x in r]) for i, r in v.items()] + [(900, [256]), (901, []), (902, [512])], "vec_id long, v array<bigint>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k_of_every(df, 1, 4).collect()}
    assert {k: x for k, x in got.items() if k[0] < 300} == brute_top(v, 1, 4)
    assert got[900, 1] == (902, 256 * 512) and (901, 1) not in got
    many = vector_search.top_k(small.repartition(80), small.repartition(80), 4).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in many} == got


def test_vector_search_large_components(spark):
    """Finite components over 1e7, and those whose products are not exact in double."""
    rng = np.random.default_rng(4)
    for size, first in ((3e7, 3), (1e6, 0)):
        v = {i: [float(x) for x in r] for i, r in enumerate(rng.standard_normal((60, 4)))}
        v |= {i: [float(x) for x in rng.standard_normal(4) * size] for i in range(first, 60, 6)}
        v[61] = [x + 1 / 256 for x in v[30]]
        df = spark.createDataFrame([*v.items(), (62, [float("inf")] * 4)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k_of_every(df, 10, 5).collect()}
        assert got == brute_top(v, 10, 5)


def test_tiff(spark, docs):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 255, (20, 33, c)).astype(t) for c, t in ((1, np.uint8), (3, np.uint16))]
    files = []
    for how in (tiff.NONE, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.PACKBITS):
        for kw in ({}, {"tile": 16, "predictor": 2}, {"order": ">", "predictor": 2, "strip_rows": 7}):
            data = tiff.write_tiff(pages, how, **kw)
            assert all((p.pixels == x).all() for p, x in zip(tiff.read_tiff(data), pages, strict=True))
            files.append((len(files), data))
    df = spark.createDataFrame([*files, (90, b"no image"), (91, b""), (92, None), (93, files[0][1][:60])], "f long, c binary")
    rows = tiff.tiff_pages(df, "f", "c").collect()
    assert sum(r.error is None for r in rows) == 2 * len(files) and {r.id for r in rows if r.error} == {90, 93}
    stored = tiff.stored_texts(docs).collect()
    texts = {d: t for d, t, *_ in some_docs()}
    for r in stored:
        n, payload = tiff.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def by_hand(width, height, compression, blocks, tile=0, extra=()):
    """A file put together byte by byte, little-endian, 8-bit grey."""
    out, at = bytearray(b"II*\0\0\0\0\0"), []
    for b in blocks:
        at.append(len(out))
        out += b
    lists = {}
    for name, values in (("at", at), ("size", [len(b) for b in blocks])):
        lists[name] = len(out) if len(values) > 1 else values[0]
        if len(values) > 1:
            out += b"".join(v.to_bytes(4, "little") for v in values)
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, compression), (277, 3, 1, 1)]
    tags += [(322, 3, 1, tile), (323, 3, 1, tile), (324, 4, len(blocks), lists["at"]), (325, 4, len(blocks), lists["size"])] if tile else [(273, 4, len(blocks), lists["at"]), (278, 4, 1, -(-height // len(blocks))), (279, 4, len(blocks), lists["size"])]
    tags = sorted([t for t in tags if t[0] not in {e[0] for e in extra}] + list(extra))
    out[4:8] = len(out).to_bytes(4, "little")
    out += len(tags).to_bytes(2, "little") + b"".join(a.to_bytes(2, "little") + b.to_bytes(2, "little") + c.to_bytes(4, "little") + d.to_bytes(4, "little") for a, b, c, d in tags) + bytes(4)
    return bytes(out)


def test_tiff_by_hand():
    # PackBits as in its published example
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    want = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    page = next(tiff.read_tiff(by_hand(24, 1, tiff.PACKBITS, [packed])))
    assert page.pixels.tobytes() == want
    # LZW: clear, 7, 258 (7 7), 8, 258 (7 7), end in 9 bits each, high bit first
    codes = [256, 7, 258, 8, 258, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert next(tiff.read_tiff(by_hand(6, 1, tiff.LZW, [data]))).pixels.tobytes() == bytes([7, 7, 7, 8, 7, 7])
    # four tiles of 16 by 16 for 20 by 18
    tiles = [bytes([k]) * 256 for k in (1, 2, 3, 4)]
    grid = next(tiff.read_tiff(by_hand(20, 18, tiff.NONE, tiles, tile=16))).pixels[:, :, 0]
    assert (grid[:16, :16] == 1).all() and (grid[:16, 16:] == 2).all() and (grid[16:, :16] == 3).all() and (grid[16:, 16:] == 4).all() and grid.shape == (18, 20)


def test_tiff_never_ends_a_job(spark):
    good = by_hand(4, 1, tiff.NONE, [b"abcd"])
    bad = [by_hand(2**31, 2**31, tiff.NONE, [b"abcd"]), by_hand(4, 1, tiff.NONE, [b"abcd"], extra=[(256, 3, 0, 4)]), by_hand(4, 1, tiff.NONE, [b"abcd"], extra=[(256, 2, 1, 4)]), by_hand(4, 1, tiff.NONE, [b"abcd"], extra=[(256, 11, 1, 4)]), by_hand(4, 1, tiff.NONE, [b"abcd"], extra=[(277, 3, 1, 0)]), by_hand(60_000, 60_000, tiff.ADOBE_DEFLATE, [zlib.compress(b"x")])]
    rng = random.Random(1)
    base = tiff.write_tiff([np.arange(600, dtype=np.uint8).reshape(30, 20)], tiff.LZW, predictor=2, tile=16)
    for _ in range(300):
        x = bytearray(base)
        for _ in range(3):
            x[rng.randrange(len(x))] = rng.randrange(256)
        bad.append(bytes(x))
    rows = tiff.tiff_pages(spark.createDataFrame([(0, good), (0, good), *((k + 1, b) for k, b in enumerate(bad))], "f long, c binary"), "f", "c").collect()
    assert [bytes(r.pixels) for r in rows if r.id == 0] == [b"abcd"] * 2 and all(r.error for r in rows if 1 <= r.id <= 6)
    assert {r.id for r in rows} == set(range(len(bad) + 1))


def test_tiff_forms_all_come_back():
    met = set()
    for k in range(60):
        _, payload = tiff.payload_of(f"text {k} " * (k * 9) + "aaaa" * k)
        media = tiff.store(payload)
        pages = list(tiff.read_tiff(media))
        assert b"".join(p.pixels.tobytes() for p in pages) == payload
        met.add((pages[0].compression, pages[0].predictor, pages[0].tiled))
    assert len(met) >= 7


PAGE = "<html><head><title>T</title></head><body><nav><ul><li>A<li>B</ul></nav><div class='cookie-notice'>We use</div><article><h1>{t}</h1><p>One &amp; <b>two</b><br>{t}<p>Last&nbsp;one</p><form>f</form><div id=comments><p>hi</p></div></article><aside>x</aside><footer>f</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(t=f"Title {i}")) for i in range(6)] + [(10, None, None), (11, "x", ""), (12, "http://h0.org/z", "<p>plain"), (12, "http://h0.org/z", "<p>plain")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title 3\nOne & two Title 3\nLast one" and got[3].n_chars == len(got[3].text) and got[3].fits
    assert got[10].text == "" == got[11].text and got[12].text == "plain"


def test_wrapper_generalises():
    w = html_text.infer([PAGE.format(t="a"), PAGE.format(t="b").replace("<p>Last&nbsp;one</p>", ""), PAGE.format(t="c").replace("<aside>x</aside>", "")])
    assert any(isinstance(n, tuple) for n in w.nodes)
    for p in (PAGE.format(t="q").replace("<aside>x</aside>", ""), PAGE.format(t="z")):
        assert w.fits(html_text.read_page(p)[0])


BARE = "<body><div class=top><p>Welcome to the site {c}</p></div><div class=lead><p>Lead {i} says {i} {i} and so on, at some length, about {i}</p></div><div class=extra><p>Extra words {i}</p></div>{more}<div class=legal><p>All rights reserved</p></div></body>"


def test_html_slots_decide_without_article(spark):
    """No element is marked: constant slots are template, varying ones and those of one page only are content."""
    pages = [BARE.format(c="", i=f"n{i}", more="<section class=odd><p>Only here</p></section>" if i == 29 else "") for i in range(30)]
    rows = [(i, f"http://bare.org/{i}", p) for i, p in enumerate(pages)] + [(50, "http://one.org/", pages[0])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == f"Lead n{i} says n{i} n{i} and so on, at some length, about n{i}\nExtra words n{i}" + "\nOnly here" * (i == 29)
    assert "Welcome" in got[50] and "Lead n0" in got[50]
    # copies of one article are no evidence that it is template
    w = html_text.infer([BARE.format(c=c, i="same", more="") for c in ("a", "b")])
    assert "Lead same says same" in html_text.main_text(BARE.format(c="a", i="same", more=""), w)[0]


def test_html_article_that_no_sampled_page_has(spark):
    """A page keeps both its articles where the host's sample holds the first one's path only."""
    lead = "<article class=lead><p>Lead {i}</p></article>"
    rows = [(i, f"http://two.org/{i}", "<body>" + lead.format(i=i) + ("<article class=update><p>Update</p></article>" if i == 7 else "") + "</body>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = html_text.infer([r[2] for r in rows if r[0] != 7][:12])
    assert html_text.main_text(rows[7][2], w)[0] == "Lead 7\nUpdate"
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[7] == "Lead 7\nUpdate" and got[8] == "Lead 8"


STORY = "<html><body><nav><ul><li>a<li>b</ul></nav><div class='side-bar'>s{i}</div><article><h1>Head {i}</h1><p class=byline>By the newsroom</p><section id='related-work'><p>Work {i}</p></section><div class='side-effects'>Effects {i}</div><p class='form-factor'>Form {i}</p><p id='search-algorithms'>Search {i}</p>{more}<p>{text}</p><div class='related-posts'>Other {i}</div><ul class='comment-list'><li>Me {i}</li></ul><p class=cta>Sign up for our letters</p></article><footer>f{i}</footer></body></html>"


def test_html_comes_through_the_wrapper(spark):
    """What all pages repeat inside an article is its text; names that merely hold a word of the lists stay; hand-checked."""
    pages = [STORY.format(i=i, text=f"Long text of number {i} that goes on", more="<p>Extra</p>" if i % 3 == 0 else "") for i in range(9)]
    want = [f"Head {i}\nBy the newsroom\nWork {i}\nEffects {i}\nForm {i}\nSearch {i}" + "\nExtra" * (i % 3 == 0) + f"\nLong text of number {i} that goes on\nSign up for our letters" for i in range(9)]
    rows = [(i, f"http://news.org/{i}", p) for i, p in enumerate(pages)] + [(20, "http://alone.org/", pages[1]), (21, "http://alone.org/", pages[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "wrapper": F.lit(1), "__h": F.lit(2)})
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert [got[i] for i in range(9)] == want
    plain = html_text.main_text(pages[1], None)[0]
    assert plain == want[1] == got[20] == got[21]
    assert "Other" not in plain and "Me 1" not in plain and "Effects 1" in plain
    # a page that does not match is aligned all the same
    odd = STORY.format(i=77, text="Odd one", more="<table><tr><td>cell</td></tr></table>")
    assert html_text.main_text(odd, html_text.infer(pages))[0] == "Head 77\nBy the newsroom\nWork 77\nEffects 77\nForm 77\nSearch 77\ncell\nOdd one\nSign up for our letters"
    assert html_text.extract(df.limit(0)).count() == 0
    long = html_text.main_text("<article>" + "<p>word</p>" * 30_000 + "</article>", None)[0]
    assert long.count("word") == 30_000


def test_language(spark):
    rng = random.Random(1)
    make = {"en": ["the", "and", "thing", "with"], "fr": ["êle", "que", "eau", "dans"]}
    rows = [(i, " ".join(rng.choice(make[x]) for _ in range(30)), x, "s") for i in range(160) for x in [("en", "fr")[i % 2]]]
    df = docs_of(spark, [*rows, (500, None, "en", "s"), (501, "123 !", "fr", "s"), (502, "the", None, "s")])
    model = langid.fit(df, crc_of_id() % 3 != 1)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows]) > 0.97
    assert got[500].lang_pred == "und" == got[501].lang_pred and got[500].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(df.limit(0), crc_of_id() % 3 != 1)
    assert none.predict("the") == ("und", 0.0, False)


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the of and thing water over rain".split()) + rng.choice(["", "", ",", "."]) for _ in range(80))
    bad = lambda: " ".join(rng.choice("CHEAP BUY NOW".split()) + "!!" for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), "en", "s") for i in range(400)]
    df = docs_of(spark, [*rows, (900, None, "en", "s"), (901, "", "en", "s")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(df, labels, crc_of_id() % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 4 > 0) for i in range(400)]) > 0.98 and len(got) == 402
    assert quality.keep_good(df, model).columns == df.columns
    blank = quality.fit(df, labels.limit(0), crc_of_id() % 5 != 0)
    assert quality.score(df, blank).where("score <> 0.5").count() == 0


def test_vector_search_any_finite_component(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, [rng.choice([1e18, 0.1, 1e300, -1.6e308, 3e7, 65_536 / 256]) * rng.random() for _ in range(5)]) for i in range(40)]
    rows += [(300, [1e18, 0.1]), (310, [1.0, 2.0]), (311, [-1e300, 5.0]), (320, []), (330, None), (340, [float("inf")] * 5), (20, rows[21][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(6)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k_of_every(df, 10, 4).collect()}
    best = {}
    for i, e in rows:
        if e and all(math.isfinite(x) for x in e):
            best[i] = min(best.get(i, e), e)
    v = {i: [math.floor(x * 256) if abs(x) < 2.0**900 else int(x) * 256 for x in e] for i, e in best.items()}
    clip, want = lambda n: max(-(2**63), min(2**63 - 1, n)), {}
    for q in (i for i in v if i % 10 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], w, strict=True)), i) for i, w in v.items() if i != q and len(w) == len(v[q]))
        want |= {(q, k): (i, clip(-n)) for k, (n, i) in enumerate(s[:4], 1)}
    assert got == want


@pytest.mark.parametrize("frame", ["<article><h1>{t}</h1>{b}</article>", "<div class='box'><h1>{t}</h1>{b}</div>"])
def test_headings_that_all_pages_repeat_stay(spark, frame):
    body = "<h2>Ingredients</h2><p>Take {k} eggs and {k} cups.</p><h2>Method</h2><p>Stir for {k} minutes and wait {k} hours.</p>"
    rows = [(k, "http://food.example/x", "<html><body><div class='top-line'><p>Food of the world</p></div>" + frame.format(t=f"Dish {k}", b=body.format(k=k)) + "<footer>c</footer></body></html>") for k in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r.text == f"Dish {r.page_id}\nIngredients\nTake {r.page_id} eggs and {r.page_id} cups.\nMethod\nStir for {r.page_id} minutes and wait {r.page_id} hours."


def test_html_template_is_learnt_from_all_pages(spark):
    """A slot that two pages of hundreds share goes, one that a single page of hundreds varies stays; copies count once."""
    page = "<html><body><div class=lead><p>Lead {i} says much about {i}, at some length</p></div><div class=place><p>{place}</p></div>{more}<div class=legal><p>All rights reserved</p></div></body></html>"
    more = {7: "<section class=rare><p>Only on two</p></section>", 90: "<section class=rare><p>Only on two</p></section>", 33: "<section class=own><p>Only here</p></section>"}
    rows = [(i, "http://large.org/x", page.format(i=i, place="Written in Berne" if i == 55 else "Written in Basle", more=more.get(i, ""))) for i in range(200)]
    rows += [(300 + k, rows[33][1], rows[33][2]) for k in range(3)] + [rows[33]]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(200):
        assert got[i] == f"Lead {i} says much about {i}, at some length\nWritten in {'Berne' if i == 55 else 'Basle'}" + "\nOnly here" * (i == 33), i
    assert got[300] == got[33]


def test_html_pages_of_no_host_are_all_learnt(spark):
    """Pages of unlike shapes get wrappers of their own, whose size is bounded by the shapes'; none is left out."""
    kinds = [["section", "div", "p", "ul", "blockquote"][k % 5] for k in range(200)]
    rows = [(i, None, "<body>" + "".join(f"<{kinds[(i * k) % 199]} class='c{chr(97 + (i * 7 + k) % 26)}{chr(97 + i % 26)}'>t{i}-{k}</{kinds[(i * k) % 199]}>" for k in range(40)) + "</body>") for i in range(120)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n".join(f"t{i}-{k}" for k in range(40)) for i in range(120)}
    shapes = [(html_text.fold(html_text.read_page(r[2])[0]), 90, [r[0]]) for r in rows[:30]]
    made = html_text.merged(shapes)
    assert len(made) > 1 and sorted(i for w in made for i in w[2]) == list(range(30)) and max(len(w[0]) for w in made) <= 2 * max(w[1] for w in made) + 64
