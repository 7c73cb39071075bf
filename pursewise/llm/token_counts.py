"""Token counts with overlap resynchronisation for huge documents (operator 5).

A document longer than ``CHUNK`` characters is never encoded in one piece. It is read as
overlapping chunks, each encoded with offsets, and two neighbouring encodings are spliced at
a position where both start a word and the cut is proven stable:

* the tokenizer scans words left to right without looking back, so from a position where
  both scans start a word they go on alike;
* the character there is ASCII, so Unicode composition cannot join it to what precedes;
* no special string spans the position.

When an overlap holds no such position (a very long word, say) the overlap is widened, up to
the whole chunk, and then the chunk itself, until one is found or the text ends. Texts of up
to ``CHUNK`` characters are encoded whole, piece by piece between ASCII blanks: every word,
composition and special string ends there, so the pieces' counts add up, and the count of a
piece met before is looked up. A document is one row, so it is read in one task, which holds
its text and the encodings of two chunks.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import batches

CHUNK, OVERLAP = 32_768, 512
#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 2048

_loaded: dict[int, Encoder] = {}


class Encoder:
    """Counts tokens as ``tokenizers`` gives them for the whole text (no special tokens added)."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; Spark has the others
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunk, self.overlap, self.limit = chunk, overlap, memo
        self.memo: dict[bytes, int] = {}

    def counts(self, texts: list[str | None]) -> list[int]:
        short = {i: t.encode("utf-8", "replace").split() for i, t in enumerate(texts) if t and len(t) <= self.chunk}
        distinct = set(chain.from_iterable(short.values()))
        if len(self.memo) > self.limit:  # go on with the pieces of this batch only
            self.memo = {w: self.memo[w] for w in distinct if w in self.memo}
        new = sorted(distinct.difference(self.memo))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            got = self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.memo.update(zip(part, (len(e.ids) for e in got)))
        look = self.memo.__getitem__
        return [sum(map(look, short[i])) if i in short else self.resynced(t) if t else 0
                for i, t in enumerate(texts)]

    def _encode(self, text: str, start: int, end: int):
        """(word starts as positions in the text, index of each word's first token, tokens)."""
        e = self.tok.encode(text[start:end], add_special_tokens=False)
        starts, first, last = [], [], object()
        for i, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word != last or word is None:
                starts.append(start + a)
                first.append(i)
                last = word
        return starts, first, len(e.ids)

    def stable(self, text: str, p: int) -> bool:
        return text[p] < "\x80" and not any(
            text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in self.special)

    def resynced(self, text: str) -> int:
        n, total = len(text), 0
        start, end = 0, min(len(text), self.chunk)
        left = self._encode(text, start, end)
        valid = 0  # tokens of the left encoding that are counted already
        while end < n:
            overlap = self.overlap
            while True:
                overlap = min(overlap, end - start)
                begin, stop = end - overlap, min(n, end - overlap + max(self.chunk, 2 * overlap))
                right = self._encode(text, begin, stop)
                cut = self._splice(text, left, right, begin, valid)
                if cut:
                    break
                if overlap == end - start:  # nothing in the whole chunk: make the chunk longer
                    end = min(n, start + 2 * (end - start))
                    left = self._encode(text, start, end)
                    if end == n:
                        return total + left[2] - valid
                else:
                    overlap *= 4
            total += cut[0] - valid
            left, valid, start, end = right, cut[1], begin, stop
        return total + left[2] - valid

    def _splice(self, text, left, right, begin, valid):
        """Tokens before the first proven common word start in each of the two encodings."""
        starts, first = left[0], left[1]
        there = dict(zip(right[0], right[1]))
        for k in range(bisect.bisect_left(starts, begin), len(starts)):
            p = starts[k]
            if p in there and first[k] >= valid and self.stable(text, p):
                return first[k], there[p]
        return None


def token_counts(docs: DataFrame, spec_json: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``spec_json`` is the content of a ``tokenizers`` file. A null text counts as empty (0
    bytes, 0 tokens); a null doc_id stays null; repeated rows give a row each; an empty table
    gives none. Texts of any length are read whole. Other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(spec_json)  # one vocabulary file: a few MB

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        encoder = _loaded.get(key) or _loaded.setdefault(key, Encoder(spec.value))
        for b in batches(frames, 2):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(encoder.counts(b.column(2).to_pylist()), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
