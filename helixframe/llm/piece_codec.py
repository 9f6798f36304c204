"""Exact encoding and decoding with a merge-type piece vocabulary, by backtracking.

Merging takes, again and again, the neighbouring symbols whose joined string is
the best piece (ties: the leftmost). A sequence of pieces is what merging gives
exactly if every two neighbours, merged again on their own, give these two.
So a text is read from left to right: an Aho-Corasick automaton gives the pieces that
start at each position; the longest is taken, if merging it again together
with the one before gives these two and no failed position follows; else the
next shorter one; and if there is none, the position is marked in a bitfield as
failed and the piece before it is made shorter. A prefix has one encoding, so a
failed position never has to be tried again.

No piece of such a vocabulary has the space mark after another character
(checked when it is loaded; else texts are encoded whole), so a text falls into
runs of spaces with the characters after them, and these into runs of Latin letters or digits and of
others where no piece holds both (checked too); each is encoded once while it is remembered.

Edge cases: a null or empty text has no ids and decodes to the empty text; blank
texts are runs of marks; characters that are no piece become the pieces of their
UTF-8 bytes; a space mark in a text is read as a space, as the library reads it; names of
control pieces inside texts are plain text; very long texts and runs without a space
are encoded whole; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import remembered

MARK = "▁"
PRETOKEN = regex.compile(r" +[^ ]+| +")
LETTER = "A-Za-z0-9À-ÖØ-öø-ɏ"
RUN = re.compile(rf"{MARK}*[{LETTER}]+|{MARK}*[^{LETTER}{MARK}]+|{MARK}+")
#: What the library puts in place of the unknown piece, and of a byte that is no UTF-8.
UNKNOWN, BROKEN = " ⁇ ", "�"


class PieceCodec:
    """Ids of texts and texts of ids. Only the vocabulary is read from the model: pieces, scores and kinds.

    ``most`` bounds what is remembered: parts of texts, and pairs of pieces; it changes no result.
    """

    def __init__(self, path: str, most: int = 600_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.most, self.seen, self.runs, self.pairs = most, Memo(self.part, most), Memo(self._run, most), {}
        self.id_of, self.score, self.byte_id, self.text_of = {}, {}, {}, [""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif sp.is_unknown(i):
                self.text_of[i] = UNKNOWN
            elif not sp.is_control(i):
                self.id_of[piece], self.score[piece], self.text_of[i] = i, sp.get_score(i), piece.replace(MARK, " ")
        if len(self.byte_id) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a merge vocabulary with a piece for each byte and no unused pieces is needed")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        # a control piece has no text but parts the bytes around it; its 0xFF sends the ids to the careful path
        self.bytes_of = [bytes((self.byte_of[i],)) if i in self.byte_of else t.encode() or b"\xff" for i, t in enumerate(self.text_of)]
        self.name_of = [str(i) for i in range(n)]
        # a mark after another character would let merges cross the start of a run of spaces
        self.in_parts = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        # likewise where Latin letters and digits meet others
        self.in_runs = all(len(RUN.findall(p)) == 1 for p in self.id_of)
        self.starts = ahocorasick.Automaton()
        for p in self.id_of:
            self.starts.add_word(p, len(p))
        self.starts.make_automaton()

    def remerge(self, text: str) -> list[str]:
        """The symbols that merging leaves of a short text."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves these two of their joined string; an empty ``left`` is the start of the text."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            got = self.pairs[left, right] = self.remerge(left + right) == ([left, right] if left else [right])
        return got

    def split(self, text: str) -> list[str]:
        """The symbols of a text by backtracking."""
        n = len(text)
        if not n:
            return []
        sizes = [2] * n  # a bit for each size of a piece that starts there; a character that is no piece has size 1
        for end, size in self.starts.iter(text):
            sizes[end - size + 1] |= 1 << size
        pairs, failed, path, at, left, may = self.pairs, None, [], 0, "", sizes[0]
        while at < n:
            while may:
                size = may.bit_length() - 1
                end = at + size
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    fits = pairs.get((left, piece))
                    if self.compatible(left, piece) if fits is None else fits:
                        break
                may ^= 1 << size
            if may:
                path.append((left, may))
                left, at = piece, end
                may = sizes[at] if at < n else 0
                continue
            if not path:
                raise ValueError("the vocabulary is no merge vocabulary: a text has no encoding")
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            at -= len(left)
            left, may = path.pop()
        return [was for was, _ in path[1:]] + [left]

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of a run of spaces with what follows, given without its first space."""
        whole = MARK + part.replace(" ", MARK)
        if not self.in_runs:
            return self._run(whole)
        runs = RUN.findall(whole)
        return self.runs[whole] if len(runs) == 1 else tuple(chain.from_iterable(map(self.runs.__getitem__, runs)))

    def _run(self, run: str) -> tuple[int, ...]:
        ids = []
        for symbol in self.split(run):
            i = self.id_of.get(symbol)
            ids += [i] if i is not None else [self.byte_id[b] for b in symbol.encode()]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        self.turn()
        text = text.replace(MARK, " ")
        if not self.in_parts:
            parts = [text]
        elif "  " in text or text[0] == " " or text[-1] == " ":
            parts = [p[1:] for p in PRETOKEN.findall(" " + text)]
        else:
            parts = text.split(" ")
        return list(chain.from_iterable(map(self.seen.__getitem__, parts)))

    def turn(self) -> None:
        self.seen.turn()
        self.runs.turn()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first piece's mark is dropped, byte pieces that are no UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        # pieces without text (control pieces) before the first one leave it the first
        first = next((i for i in ids if self.text_of[i] or i in self.byte_of), None)
        return text[1:] if first is not None and self.text_of[first][:1] == " " and self.text_of[first] != UNKNOWN else text

    def _mended(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(BROKEN)
                    size = 1
                del run[:size]
            if i is not None:
                out.append(self.text_of[i])
        return "".join(out)


class Memo(dict):
    """What ``make`` gives for a key, for the ``most`` keys seen last or more: a full generation becomes the old one, which is asked before ``make``."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> tuple:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def turn(self) -> None:
        """Between texts: keeps what is remembered within twice ``most`` and a text's own keys."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def codec(path: str) -> PieceCodec:
    """The codec of a model, kept for later tasks of the worker."""
    return remembered(f"codec {path}", lambda: PieceCodec(path))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    ids = own.encode(text or "")
                    names = ",".join(map(own.name_of.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([own.encode(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids(model), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([own.decode(i or []) for i in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(model), "doc_id long, text string")
