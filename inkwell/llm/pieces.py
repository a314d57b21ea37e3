"""SentencePiece encoding and decoding with a merge-type prefix table.

For a merge (BPE) vocabulary every prefix of a text has exactly one possible
last token.  The table stores it, found among the automaton's matches that end
there by testing whether it may follow the last token of the rest; the ids are
then recovered from the end backwards.  Time is linear in the text.

As a piece has a space at most at its front, a text falls into words that are
coded one by one.  A batch is cut into words as a whole, each distinct word of
it is coded once, or remembered, and ids are gathered from there.  Rows of which
the ids don't give the text again are coded by themselves once more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._lex import GRAM, buffers, mix, pieces, release, run_hashes, spans

SPACE = "▁"
#: Words of which a worker remembers the ids, twice so many at most, and the longest of them.
REMEMBERED, WORD = 250_000, 40
#: Pairs of tokens of which a worker remembers whether they fit, and bytes coded at a time.
PAIRS, BYTES = 300_000, 1 << 20
_U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[10, 32]] = False
_NEWLINE, _GAP = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def default_model() -> str:
    """The 32,000-piece vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.fallback = all(sp.is_byte(i) for i in self.byte_ids)
        self.texts = {i: sp.id_to_piece(i) for i in range(n) if i not in special}
        self.ids = {t: i for i, t in self.texts.items()}
        self.score = {i: sp.get_score(i) for i in self.texts}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece has a space after another character")
        self.bytes = [b""] * n
        for i, t in self.texts.items():
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if self.fallback:
                self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = " ⁇ ".encode()
        # merges of spaces alone come after all others, as all have one score
        order = sorted((i for i, t in self.texts.items() if len(t) > 1 and t.strip(SPACE)), key=lambda i: (-self.score[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        for k, i in enumerate(i for i, t in self.texts.items() if len(t) == 1):
            self.rank[i] = -1 - k
        self.halves: dict[int, tuple[int, int]] = {i: (i, i) for i, t in self.texts.items() if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in sorted(self.rank, key=lambda i: len(self.texts[i])):
            t = self.texts[i]
            if len(t) > 1:
                steps = self.merged(t)
                if steps is None:
                    continue
                self.halves[i] = steps
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.follows: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.recent: dict[int, np.ndarray] = {}
        self.older: dict[int, np.ndarray] = {}
        size = np.array([len(x) for x in self.bytes])
        self.piece_size, self.piece_at = size, np.cumsum(size) - size
        self.piece_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        #: Whether lines can be coded one by one.
        self.by_lines = self.fallback and not any("\n" in t for t in self.ids)

    def merged(self, text: str) -> tuple[int, int] | None:
        """The two tokens of which a piece's last merge is made; None if merging doesn't give the piece."""
        parts: list[int] = []
        for c in text:
            if c not in self.ids:
                return None
            parts.append(self.ids[c])
        while len(parts) > 2:
            best = min(((self.rank[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(self.texts[parts[k]] + self.texts[parts[k + 1]])) in self.rank), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [self.ids[self.texts[parts[k]] + self.texts[parts[k + 1]]]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart when their texts are merged as one."""
        ids, texts, rank, halves = self.ids, self.texts, self.rank, self.halves
        limit = 1 << 40
        while True:
            joint = rank.get(ids.get(texts[a] + texts[b], -1), 1 << 40)
            if joint < limit:
                return False
            if rank[a] > rank[b]:
                left = halves[a][1]
                if left != a:
                    limit, a = rank[a], left
                    continue
                right = halves[b][0]
                if right == b:
                    return True
                limit, b = rank[b] + 1, right
            else:
                right = halves[b][0]
                if right != b:
                    limit, b = rank[b] + 1, right
                    continue
                left = halves[a][1]
                if left == a:
                    return True
                limit, a = rank[a], left

    def table(self, text: str) -> list[int]:
        """Ids of a text in which a space can only come first."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        follows = self.follows
        for end, (i, length) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                if size[start] == 0:
                    if text[start - 1] in self.ids:
                        continue
                elif before >= 0:
                    key = before << 20 | i
                    fits = follows.get(key)
                    if fits is None:
                        if len(follows) > PAIRS:
                            follows.clear()
                        fits = follows[key] = self.compatible(before, i)
                    if not fits:
                        continue
            last[end], size[end] = i, length
        out, at = [], n
        while at:
            if size[at]:
                out.append(last[at])
                at -= size[at]
            else:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "surrogatepass"))] if self.fallback else [self.unknown]
        out.reverse()
        return out

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces: equal scores, so the leftmost pair is merged first."""
        if n not in self.runs:
            one = self.ids[SPACE]
            width, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            known = {len(t) for t in self.ids if not t.strip(SPACE)}
            heap = [(0, k, 1, 1) for k in range(n - 1)] if 2 in known else []
            while heap:
                _, k, a, b = heapq.heappop(heap)
                r = after[k]
                if width[k] != a or r >= n or width[r] != b:
                    continue
                width[k] += b
                width[r] = 0
                after[k] = after[r]
                if after[k] < n:
                    before[after[k]] = k
                    if width[k] + width[after[k]] in known:
                        heapq.heappush(heap, (0, k, width[k], width[after[k]]))
                if before[k] >= 0 and width[before[k]] + width[k] in known:
                    heapq.heappush(heap, (0, before[k], width[before[k]], width[k]))
            out = [one if w == 1 else self.ids[SPACE * w] for w in width if w]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = out
        return self.runs[n]

    def unit(self, word: str, gap: int) -> list[int]:
        """Ids of a word without spaces after so many spaces, or of spaces alone."""
        if not word:
            return self.spaces(gap)
        if not gap:
            return self.table(word)
        out = self.table(SPACE + word)
        if gap > 1:
            alone = out[0] == self.ids[SPACE]
            out = self.spaces(gap - (not alone)) + out[alone:]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        out: list[int] = []
        text = text.replace(SPACE, " ")
        for k, line in enumerate(text.split("\n") if self.by_lines else [text] if text else []):
            if not text:
                break
            if k:
                out.append(self.byte_ids[10])
            gap = int(not k)
            for n, w in enumerate(line.split(" ")):
                gap += n > 0
                if w:
                    out += self.unit(w, gap)
                    gap = 0
            if gap:
                out += self.spaces(gap)
        return out

    def encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each row has) of a batch's UTF-8 bytes, of a vocabulary whose lines can be coded one by one."""
        start, end, row, mask = spans(data, offs, _WORD)
        line = np.flatnonzero(data == 10)
        full = np.flatnonzero(offs[1:] > offs[:-1])
        stop, of = np.r_[line, offs[1:][full]], np.r_[np.searchsorted(offs, line, "right") - 1, full]

        def before(at: np.ndarray, mine: np.ndarray) -> np.ndarray:
            """Spaces that end at a place, and one more at the beginning of a row."""
            left, word, nl = offs[:-1][mine], np.searchsorted(end, at, "right") - 1, np.searchsorted(line, at) - 1
            since = np.maximum(left, np.where(word >= 0, end[word], 0) if len(end) else 0)
            since = np.maximum(since, np.where(nl >= 0, line[nl] + 1, 0) if len(line) else 0)
            return at - since + (since == left)

        gap, rest = before(start, row), before(stop, of)
        some = np.flatnonzero(rest)
        key = np.concatenate([
            mix(run_hashes(data, start, end, mask, fold=False) + gap.astype(np.uint64) * GRAM[45]),
            mix(rest[some].astype(np.uint64) * GRAM[46] + _GAP),
            np.full(len(line), _NEWLINE),
        ])
        place = np.concatenate([start * 4 + 2, stop[some] * 4, line * 4 + 1])
        order = np.argsort(place)
        key, owner = key[order], np.concatenate([row, of[some], of[: len(line)]])[order]
        every, first, inv = np.unique(key, return_index=True, return_inverse=True)
        raw, n_words, n_gaps = data.tobytes(), len(start), len(some)
        found = []
        for k, at in zip(every.tolist(), order[first].tolist()):
            ids = self.recent.get(k)
            if ids is None:
                ids = self.older.get(k)
                if ids is None:
                    if at < n_words:
                        ids = self.unit(raw[start[at] : end[at]].decode(), int(gap[at]))
                    else:
                        ids = self.spaces(int(rest[some[at - n_words]])) if at < n_words + n_gaps else [self.byte_ids[10]]
                    ids = np.array(ids, np.int32)
                if at >= n_words or end[at] - start[at] <= WORD:
                    if len(self.recent) >= REMEMBERED:
                        self.older, self.recent = self.recent, {}
                    self.recent[k] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = _gather(np.concatenate(found) if found else np.zeros(0, np.int32), np.cumsum(size) - size, size, inv)
        return ids, np.bincount(owner, size[inv], len(offs) - 1).astype(np.int64)

    def decoded(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of rows of ids; the dummy prefix's space is taken off."""
        n = self.piece_size[ids]
        data = _gather(self.piece_bytes, self.piece_at, self.piece_size, ids)
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(size)]]
        full = ends[1:] > ends[:-1]
        drop = ends[:-1][full][data[ends[:-1][full]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], ends - np.searchsorted(drop, ends)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy prefix's space is taken off."""
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _gather(values: np.ndarray, at: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs values[at : at + size] of the chosen ones, one after the other."""
    n = size[chosen]
    ends = np.cumsum(n)
    return values[np.repeat(at[chosen] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_held: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _held:
        _held[model] = Vocabulary(model)
    return _held[model]


def tokenised(docs: DataFrame, text: str = "text", model: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip`` (decoding gave the text again).

    With ``decoded``, ``text`` is what decoding gave.  A null text has null in all
    three; an empty one no ids.  U+2581 in a text is read as a space, as by the
    library.  Columns of these names in ``docs`` are replaced, whatever their
    case.  Every row is coded by itself, repeated rows alike; an empty table
    gives an empty result.  The model's path must be readable by the executors.
    """
    model = model or default_model()
    names = ("ids", "n_tokens", "round_trip")
    carried = docs.drop(*[c for c in docs.columns if c.lower() in names])
    schema = T.StructType([*carried.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        v = vocabulary(model)
        for whole in batches:
            for i, j, _, _ in pieces(whole.column(text), BYTES):
                b = whole.slice(i, j - i)
                texts = b.column(text)
                ids, size, back, same = _coded(v, texts)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.r_[null, False]), pa.array(ids))
                cols = [back.cast(b.schema.field(text).type) if decoded and c == text else b.column(c) for c in b.schema.names]
                cols += [listed, pa.array(size.astype(np.int32), mask=null), pa.array(same, mask=null)]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])

    return carried.mapInArrow(run, schema)


def _coded(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(ids, how many each row has, decoded texts, whether these are the texts)."""
    data, offs = buffers(texts)
    n = len(offs) - 1
    if v.by_lines:
        ids, size = v.encoded(data, offs)
        out, ends = v.decoded(ids, size)
        if np.array_equal(ends, offs) and np.array_equal(out, data):
            return ids, size, _strings(out, ends, texts), np.ones(n, bool)
    else:
        ids, size, out, ends = np.zeros(0, np.int32), np.zeros(n, np.int64), data[:0], np.zeros(n + 1, np.int64)
    at, every, back, same = np.r_[0, np.cumsum(size)], [], [], np.zeros(n, bool)
    for k, text in enumerate(texts.to_pylist()):
        mine, said = ids[at[k] : at[k + 1]], out[ends[k] : ends[k + 1]]
        if text and not np.array_equal(said, data[offs[k] : offs[k + 1]]):
            mine = np.array(v.encode(text), np.int32)
            said = v.decode(mine.tolist())
        else:
            said = text
        every.append(mine)
        back.append(said)
        same[k] = said == text
    return np.concatenate(every), np.array([len(x) for x in every], np.int64), pa.array(back, pa.string()), same


def _strings(data: np.ndarray, offs: np.ndarray, like: pa.Array) -> pa.Array:
    """A string array of the bytes, null where ``like`` is."""
    out = pa.LargeStringArray.from_buffers(len(like), pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    return pa.compute.if_else(like.is_valid(), out, pa.scalar(None, pa.large_string()))
