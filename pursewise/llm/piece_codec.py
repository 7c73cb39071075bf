"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 10).

A text is marked (a space becomes ``▁``, one is put in front) and falls into marked words:
runs of ``▁`` with the characters up to the next ``▁``. No piece of the model crosses such a
border, so each distinct marked word is encoded once. The distinct words of a batch are
sorted, which is the depth-first order of their trie, and the forward states (one per
character of the current path) are kept up to the common prefix with the next word.

The forward state of a prefix is the last piece of its best segmentation:

* unigram models: the best sum of piece scores, as in Viterbi's algorithm;
* BPE models (piece scores are merge ranks): the one piece that ends there and agrees with
  the state in front of it, that is, merging the two pieces' characters by rank gives back
  just these two. A row of pieces is the model's own encoding exactly when all neighbours
  agree, so the path found is the library's encoding. (Adding up merge ranks as if they
  were log-probabilities would give other pieces than the library.)

Unknown characters become their UTF-8 byte pieces. Words with three or more leading marks,
whose run pieces share one rank, are merged directly.
"""

from __future__ import annotations

import heapq
import re
import string
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pursewise.llm.common import batches

MARK = "▁"
_loaded: dict[int, PieceCodec] = {}


#: Words a codec remembers.
MEMO = 400_000


class PieceCodec:
    """Encodes and decodes with the vocabulary of a serialized SentencePiece model."""

    def __init__(self, model: bytes, memo: int = MEMO, unigram: dict[str, float] | None = None):
        import sentencepiece

        self.memo_limit, self.memo = memo, {}
        self.agree: dict[tuple[str, str], bool] = {}
        if unigram is not None:  # a plain score table, without bytes
            pieces = list(unigram)
            self.rank = {p: -s for p, s in unigram.items()}
            self.ids = {p: i for i, p in enumerate(pieces)}
            self.piece, self.byte_ids, self.bpe = pieces, None, False
        else:
            sp = sentencepiece.SentencePieceProcessor(model_proto=model)
            n = sp.get_piece_size()
            self.piece = [sp.id_to_piece(i) for i in range(n)]
            plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
            self.rank = {self.piece[i]: -sp.get_score(i) for i in plain}
            self.ids = {self.piece[i]: i for i in plain}
            self.byte_ids = {int(self.piece[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
            self.bpe = all(float(r).is_integer() for r in self.rank.values())
        self.longest = max(map(len, self.ids), default=1)
        # lengths of the pieces that end in these three characters, longest first, and two
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: (*sorted(n, reverse=True), 2) for t, n in tails.items()}
        # neighbours that stand side by side in no piece can never be merged
        self.beside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words_of = self._word_pattern().findall
        # what each id stands for in UTF-8; a piece starts a character, so no byte run reaches into it
        self.raw = [p.encode("utf-8") for p in self.piece]
        for b, i in (self.byte_ids or {}).items():
            self.raw[i] = bytes([b])

    # ---------------------------------------------------------------- words

    def _word_pattern(self) -> re.Pattern:
        """Words end before ``▁``, around line breaks and tabs that no longer piece holds,
        and between a letter or digit and punctuation that follows one in no piece: no piece
        crosses these borders."""
        alone = "".join(c for c in "\n\t\r" if not any(c in pair for pair in self.beside))
        follow = {pair[1] for pair in self.beside if re.match(r"\w", pair[0])}
        ends = re.escape("".join(c for c in string.punctuation if c != "_" and c not in follow))
        own = re.escape(alone)
        word = rf"{MARK}*[^\w{MARK}{own}]*(?:\w+(?:[^\w{MARK}{own}{ends}][^\w{MARK}{own}]*)?)*"
        return re.compile(f"[{own}]|{word}" if alone else word)

    def merged(self, word: str) -> list[str]:
        """Pieces by merging neighbours, best rank first, leftmost among equals."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if both + parts[k] in self.rank:
                    heapq.heappush(heap, (self.rank[both + parts[k]], i, both + parts[k]))
            h = before[i]
            if h >= 0 and parts[h] + both in self.rank:
                heapq.heappush(heap, (self.rank[parts[h] + both], h, parts[h] + both))
        return [p for p in parts if p is not None]

    def _agree(self, key: tuple[str, str]) -> bool:
        """Whether two neighbouring pieces stay two pieces when merged by rank."""
        a, b = key
        if a[-1] + b[0] not in self.beside:
            return True
        if len(self.agree) > 300_000:
            self.agree.clear()
        got = self.agree[key] = self.merged(a + b) == [a, b]
        return got

    def _extend_bpe(self, word: str, keep: int, last: list[str | None]) -> None:
        """Forward states from ``keep`` on: the piece that ends at each position and agrees
        with the state in front of it (the longest that does; a single character or a byte
        run is always left)."""
        del last[keep + 1:]
        ids, agree, tails, check = self.ids, self.agree, self.tails.get, self._agree
        two, add = (2,), last.append
        for end in range(keep + 1, len(word) + 1):
            best = word[end - 1]
            for n in tails(word[end - 3:end], two) if end > 2 else two:
                start = end - n
                if start < 0:
                    continue
                piece = word[start:end]
                if piece in ids:
                    if start == 0:
                        best = piece
                        break
                    key = (last[start], piece)
                    ok = agree.get(key)
                    if check(key) if ok is None else ok:
                        best = piece
                        break
            add(best)

    def _extend_unigram(self, word: str, keep: int, last: list[str | None], cost: list[float]) -> None:
        """Forward states from ``keep`` on: the last piece of the cheapest segmentation."""
        del last[keep + 1:], cost[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            best = word[end - 1]
            low = cost[end - 1] + self.rank.get(best, 1e9)
            for start in range(max(0, end - self.longest), end - 1):
                piece = word[start:end]
                if piece in self.ids and cost[start] + self.rank[piece] < low:
                    best, low = piece, cost[start] + self.rank[piece]
            last.append(best)
            cost.append(low)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (int32, packed) of each distinct word; words are sorted here, prefixes shared."""
        out, before = {}, ""
        last: list[str | None] = [None]
        cost = [0.0]
        for word in sorted(words):
            if self.bpe and word.startswith(MARK * 3):
                out[word] = self._to_ids(self.merged(word))
                continue
            keep = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                keep += 1
            if self.bpe:
                self._extend_bpe(word, keep, last)
            else:
                self._extend_unigram(word, keep, last, cost)
            before = word
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            out[word] = self._to_ids(reversed(pieces))
        return out

    def _to_ids(self, pieces) -> bytes:
        out = []
        known = self.ids.get
        for p in pieces:
            i = known(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8"))
            else:
                out.append(-1)
        return struct.pack(f"<{len(out)}i", *out)

    # ---------------------------------------------------------------- texts

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words_of(MARK + t.replace(" ", MARK)) if t else () for t in texts]
        distinct = set(chain.from_iterable(split))
        if len(self.memo) > self.memo_limit:  # go on with the words of this batch only
            self.memo = {w: self.memo[w] for w in distinct if w in self.memo}
        self.memo.update(self.encode_words(list(distinct.difference(self.memo))))
        look = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        """Text of a row of ids: pieces joined, bytes decoded, marks back to spaces."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:] if text.startswith(MARK) else text.replace(MARK, " ")


def _codec(model: bytes) -> PieceCodec:
    key = hash(model)
    return _loaded.get(key) or _loaded.setdefault(key, PieceCodec(model))


def encoded(docs: DataFrame, model: bytes, memo: int | None = None, batch: int = 8_000_000) -> DataFrame:
    """Per row of ``docs``: its other columns but ``text`` kept as they are, then ``ids``
    (array of int), ``n_ids`` and ``round_trip`` (decoding gives back the text).

    ``round_trip`` compares with the text whose ``▁`` are blanks, which the marking cannot
    tell apart. Null and empty texts have no ids and round-trip to the empty text; repeated
    rows give a row each, an empty table gives none. Columns named ids, n_ids or round_trip
    in ``docs`` are replaced.

    ``memo`` bounds the words a task remembers, which are then forgotten with the task (a worker
    process outlives its tasks and stages); without it they stay for the next one. ``batch``: bytes
    of text split at a time. The ids depend on neither.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file, under 1 MB
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_ids", "round_trip")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest),
                        "ids array<int>", "n_ids long", "round_trip boolean"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        codec.memo_limit = memo or MEMO
        for b in batches(frames, len(rest), batch):
            texts = b.column(len(rest)).to_pylist()
            ids = codec.encode_batch(texts)
            ok = [codec.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], lists, pa.array(n), pa.array(ok)],
                                             names=[*rest, "ids", "n_ids", "round_trip"])
        if memo is not None:
            codec.memo, codec.agree = {}, {}

    return docs.select(*rest, "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """Adds ``text`` decoded from ``ids`` (null ids: null text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), "text string"])

    def run(frames):
        codec = _codec(shared.value)
        for b in frames:
            texts = [None if x is None else codec.decode(x) for x in b.column(rest.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*rest, "text"])

    return rows.select(*rest).mapInArrow(run, schema)
