"""Token counts of whole texts under a piece vocabulary, without ids.

No piece of the vocabulary has the space mark after another character, so no
merge crosses the start of a run of spaces: a text's pieces are those of its
pre-tokens (a run of spaces with the characters after it; the text itself
starts with the added mark). Each task counts a distinct pre-token once,
keeps the count, joins counts to each document's pre-token frequencies and
sums. The vocabulary of counts that a task remembers is bounded.

Edge cases: a null or empty text has 0 tokens and 0 bytes; a blank text counts
its run of marks; very long pre-tokens are counted whole; repeated rows are
counted each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import remembered

MARK = "▁"
PRETOKEN = regex.compile(r" +[^ ]+| +")


class PieceCounter:
    def __init__(self, path: str, most: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        self.sp, self.seen, self.most = SentencePieceProcessor(model_file=path), {}, most

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, each without its first mark."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in PRETOKEN.findall(" " + text)]
        return text.split(" ")

    def __call__(self, texts: list[str]) -> list[int]:
        freqs = [Counter(self.pretokens(t)) for t in texts]
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        new = [w for w in dict.fromkeys(w for f in freqs for w in f) if w not in seen]
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            # an empty one is a mark alone, which the library adds to no empty text
            seen.update((w, len(ids) if w else 1) for w, ids in zip(some, self.sp.encode(some, num_threads=1), strict=True))
        return [sum([seen[w] * n for w, n in f.items()]) for f in freqs]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = remembered(f"pieces {path}", lambda: PieceCounter(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counter([t or "" for t in texts]), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(model), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
