import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives, piece_codec, token_alignment
from helixframe.llm.exact_blocks import order_key
from helixframe.llm.queries import vocabulary

PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, row string, n_a long, links string"
TEXTS = [None, "", " ", "  two  blanks ", "ab", "Hello world, it's 12345!", "▁ mark", "<s> <unk> <0x0A>", "tab\tnew\nline\n\n end", "漢字 and émigré 👍🏽", "no​break\xa0space", "aaaaaaaaaaaaaaaaaaaaaaaa", "= = ==== =", "x" * 3000, "<|endoftext|> inside", "the cat the cat the cat", "the cat the cat the cat", "\x00 nul", "ﬁ ligature"]


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    some = [*" ▁aabcdeeest\n\t<>0x0A/s█é漢👍\x00", "the", "<s>", "tion", " an", "ing", "<0x0A>", "  "]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = TEXTS + odd_texts()
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)] + [(0, "repeated id", "x", 1, "y"), (None, "no id", "x", 1, "y"), (9001, "word " * 30_000, "x", 1, "y")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def test_digests_equal_the_library(spark, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in piece_codec.digests(docs, PIECES).collect()) == want
    assert piece_codec.digests(docs.limit(0), PIECES).count() == 0


def test_round_trip_and_decoding_of_any_ids(spark, docs, library):
    back = piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect())
    rng, own = random.Random(2), piece_codec.codec(PIECES)
    for _ in range(4000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids
    assert piece_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECES).first().text == ""


def test_backtracking_steps(library):
    own = piece_codec.codec(PIECES)
    for text in odd_texts(200, 8):
        whole = piece_codec.MARK + text.replace(" ", piece_codec.MARK)
        symbols = own.split(whole)  # without parts: as if a vocabulary had marks inside
        assert "".join(symbols) == whole
        assert all(own.remerge(a + b) == [a, b] for a, b in zip(symbols, symbols[1:], strict=False))


VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"


def brute_negatives(rows, every, positives, k, low, high):
    best = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        best[i] = min(best.get(i, (label, e)), (label, e))
    v = {i: (label, [math.floor(x * 256) if abs(x) < 2.0**900 else int(x) * 256 for x in e]) for i, (label, e) in best.items()}
    clip, out = lambda n: max(-(2**63), min(2**63 - 1, n)), set()
    for a, (la, q) in v.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, lb) for i, (lb, w) in v.items() if i != a and len(w) == len(q))
        for p, pid, _ in [x for x in s if x[2] == la][:positives]:
            held = [x for x in s if x[2] != la and -low * p <= -100 * x[0] <= -high * p]
            out |= {(a, pid, r, x[1], clip(-p), clip(-x[0])) for r, x in enumerate(held[:k], 1)}
    return out


@pytest.mark.parametrize("big", [False, True])
def test_hard_negatives(spark, big):
    rng = random.Random(4 + big)
    unit = lambda: [rng.gauss(0, 1) for _ in range(6)]
    centre = [unit() for _ in range(3)]
    rows = [(i, [c + 0.6 * x for c, x in zip(centre[i % 3], unit(), strict=True)], rng.randrange(3)) for i in range(240)]
    rows += [(i, rows[10][1], 1) for i in range(300, 420)]  # one vector many times: ties
    rows += [(500, None, 1), (501, [None] * 6, 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 0), (504, rows[3][1], None), (505, [1.0, 2.0], 0), (510, [1.0, 2.0], 0), (511, [0.5, 1.0], 1), (520, [], 0), (None, rows[0][1], 0), (20, rows[21][1], 2), (20, rows[20][1], rows[20][2])]
    if big:  # beyond 53 and 64 bits, and beyond doubles when multiplied
        rows += [(600 + k, [rng.choice([1e18, 1e300, 1.5e308, 3e5, -1e18]) * rng.random() for _ in range(6)], k % 3) for k in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, positives=4, k=7)
    rows_got = [tuple(r) for r in got.collect()]
    want = brute_negatives(rows, 10, 4, 7, 30, 90)
    assert len(rows_got) == len(set(rows_got)) and set(rows_got) == want and len(want) > 300
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_order_of_texts_is_that_of_numbers():
    rng = random.Random(1)
    numbers = sorted({rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 80)) for _ in range(500)} | {0})
    assert sorted(numbers, key=order_key) == numbers


def brute_alignment(rows, library):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    per, held = [], Counter()
    for doc, text in rows:
        per.append((doc, None))
        if not text:
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
        ab = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            continue
        ea, eb = ([sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 3000 else __import__("itertools").accumulate(map(len, x)) for x in (ab, bb))
        ea, eb = list(ea), list(eb)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({*ea} & {*eb}):
            ga, gb = [], []
            while i < len(ea) and ea[i] <= cut:
                ga.append(i)
                i += 1
            while j < len(eb) and eb[j] <= cut:
                gb.append(j)
                j += 1
            groups.append(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[y]) for y in gb))
            links += [(a[x], b[y]) for x in ga for y in gb if ea[x] - len(ab[x]) < eb[y] and eb[y] - len(bb[y]) < ea[x]]
        per[-1] = (doc, (len(a), len(b), groups, links))
        held.update(set(links))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return Counter((d, len_a, len_b, len(g), len(ls), sum(held[x] == top[x[0]] for x in ls), sum(held[x] for x in ls), sha(g)) if o else (d, 0, 0, 0, 0, 0, 0, "") for d, o in per for len_a, len_b, g, ls in [o or (0, 0, [], [])])


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_alignment(spark, docs, library, most):
    got = token_alignment.align(docs, BYTES, PIECES, most=most)
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()], library)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_alignment_of_nothing(spark, docs):
    assert token_alignment.align(docs.limit(0), BYTES, PIECES).count() == 0
    only = token_alignment.align(docs.where("text is null"), BYTES, PIECES).collect()
    assert [tuple(r) for r in only] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_byte_ids_equal_the_tokenizer():
    own = token_alignment.ByteIds(BYTES)
    assert own.fast is not None
    for text in [t for t in TEXTS if t] + odd_texts(600, 9):
        assert own(" " + text) == own.tok.encode(" " + text, add_special_tokens=False).ids, text


def test_parts_are_told_once_a_chunk(monkeypatch):
    """Texts travel as numbers of parts; each distinct part of a chunk is told once, however often texts repeat it."""
    import pyarrow as pa

    texts = ["the cat sat on the mat"] * 500 + [None, "", " odd  one ", "a b"] + ["the cat ran"] * 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row", "doc_id", "text"])
    for size, fewest in ((1 << 20, 1), (3_000, 2)):
        monkeypatch.setattr(token_alignment, "CHUNK", size)
        monkeypatch.setattr(token_alignment, "LISTED", 3)
        rows = [r for b in token_alignment._told(iter([batch])) for r in b.to_pylist()]
        parts = {}
        for r in rows:
            if r["parts"] is not None:
                own = parts.setdefault(r["chunk"], {})
                own |= {r["base"] + k: p for k, p in enumerate(r["parts"])}
        assert len(parts) >= fewest and all(len(set(own.values())) == len(own) <= 9 for own in parts.values())
        back = {r["row"]: " ".join(parts[r["chunk"]][k] for k in r["words"]) for r in rows if r["words"] is not None}
        assert back == {k: t or "" for k, t in enumerate(texts)}


def test_aligned_parts_travel_in_small_blocks():
    """A chunk's aligned parts come back from its blocks whole, and take a third of what they take as rows."""
    import numpy as np
    import pyarrow as pa

    n, rng = 6_000, np.random.default_rng(3)
    links = [rng.integers(0, 500, rng.integers(0, 6)).astype(np.int64) << 32 | 7 for _ in range(n)]
    bodies = [";".join(f"{x >> 32}|7" for x in own) + "é" for own in links]
    spots = [[(place, k if place == 5 else n - 1 - k) for place in ((5, 1 << 40) if k % 3 else (1 << 40,)) if place != 5 or k % 3] for k in range(n)]
    number = {5: {}, 1 << 40: {}}
    spots = [[{"place": p, "k": number[p].setdefault(k, len(number[p]))} for p, k in own] for own in spots]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("k", pa.int32())]))
    cols = {"spots": pa.array(spots, kind), "n_a": np.arange(n), "n_b": np.arange(n) * 300, "n_groups": np.ones(n, np.int64), "body": bodies, "links": pa.array([x.tolist() for x in links], pa.list_(pa.int64()))}
    table = pa.table(cols)
    got = [r for b in token_alignment._blocks(iter(table.to_batches(max_chunksize=1_000))) for r in b.to_pylist()]
    for place in number:
        own = [r for r in got if r["chunk"] == place]
        sums, texts, start, count, flat = token_alignment._unpacked([r["size"] for r in own], [r["block"] for r in own])
        at = {s["k"]: i for i, held in enumerate(spots) for s in held if s["place"] == place}
        assert len(sums) == len(texts) == len(at)
        for k, i in at.items():
            assert (*sums[k], texts[k].decode()) == (i, 300 * i, 1, bodies[i]) and flat[start[k] : start[k] + count[k]].tolist() == links[i].tolist()
    assert sum(len(r["block"]) for r in got) * 3 < table.nbytes + sum(len(b) + 8 * len(x) for b, x in zip(bodies, links, strict=True))
    assert not list(token_alignment._blocks(iter([])))
