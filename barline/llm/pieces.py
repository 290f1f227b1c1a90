"""Merge-type SentencePiece encoding and decoding, without calls to the library's encoder.

Encoding goes by backtracking.  Aho-Corasick over the reversed text gives the longest
piece that starts at each position.  The search takes the longest piece that fits after
the one before it, where two neighbours fit when merging their joined text again gives
just these two; it steps back over positions from which no way leads on, kept in a
bitfield.  A sequence whose neighbours all fit is the one that merging by score yields.

Texts are cut only where no piece of the model can reach across, so words can be encoded
once and looked up.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .tables import BLOCK_BYTES, map_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in the model format
#: Words a worker remembers, and characters in them; beyond it the memory starts anew.  Results don't depend on it.
REMEMBERED, REMEMBERED_CHARS = 500_000, 8_000_000
#: Places of a table of pairs looked up by hash; stretches up to so long are searched many at a time.
PAIR_SLOTS, SHORT = 1 << 19, 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Flat:
    """Byte strings by number, to be joined many at a time."""

    def __init__(self, parts: Iterable[bytes]):
        parts = list(parts)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes, and where each row of numbers ends up in them."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[_places(self.starts[numbers], sizes, ends)], ends[offsets]


def _places(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])


class _Words(dict):
    """Numbers of words met so far; their ids lie one after the other in one array."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.flat, self.starts, self.chars, self.stretches = array("i"), array("q", [0]), 0, {}
        self[None] = self._add([self.codec.end])  # ends a text

    def _add(self, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def learn(self, words: set[str]) -> None:
        """Add words that are not known yet."""
        cut, known, codec = self.codec.cut, self.stretches, self.codec
        split = [(word, cut.findall(word)) for word in words]
        new = list({stretch for _, parts in split for stretch in parts if stretch not in known})
        known.update(zip(new, codec.many_ids(new)))
        for word, parts in split:
            self[word] = self._add(known[parts[0]] if len(parts) == 1 else list(chain.from_iterable(map(known.__getitem__, parts))))
            self.chars += len(word)


class PieceCodec:
    """The codec of a model.  It remembers the ids of words it has met."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the model is not of merge type")
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback and leading spaces can be used")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.end = proto.trainer_spec.eos_id
        self.unknown = proto.trainer_spec.unk_id
        self.unknown_text = proto.trainer_spec.unk_surface
        kinds = [p.type for p in proto.pieces]
        self.texts = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        byte_ids = [(int(p.piece[3:5], 16), i) for i, p in enumerate(proto.pieces) if p.type == BYTE]
        self.byte_ids = dict(byte_ids)
        self.byte_of = {i: b for b, i in byte_ids}
        self.shown = [
            "" if k == CONTROL else self.unknown_text if k == UNKNOWN else t.replace(SPACE, " ")
            for t, k in zip(self.texts, kinds)
        ]
        self.cut = self._cuts()
        self.pairs: dict[int, bool] = {}
        # A piece that its own merges never yield can't stand in an encoding.
        self.halves: dict[int, tuple[int, int]] = {}
        self.usable = {t: i for t, i in self.ids.items() if self._merged(t, self.halves) == [i]}
        # Scores fall as pieces are made of smaller ones; elsewhere, and among equal scores, pairs are merged in full.
        counts = Counter(self.scores[i] for i in self.ids.values())
        self.plain = {
            i for i in self.usable.values()
            if counts[self.scores[i]] == 1
            and (i not in self.halves or all(len(self.texts[h]) == 1 or self.scores[h] > self.scores[i] for h in self.halves[i]))
        }
        self.search = ahocorasick.Automaton()
        for text, i in self.usable.items():
            self.search.add_word(text[::-1], i)
        self.search.make_automaton()
        self.shorter: dict[int, int] = {}
        self.shown_bytes = _Flat(t.encode() if i not in self.byte_of else bytes([self.byte_of[i]]) for i, t in enumerate(self.shown))
        self.decimal_bytes = _Flat(b"%d " % i for i in range(len(kinds)))
        self.lengths = np.array([len(t) for t in self.texts])
        self.shorter_of = np.full(len(kinds), -1)
        for i in self.usable.values():
            self.shorter_of[i] = self._next_shorter(i)
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)
        self.words = _Words(self)

    def _cuts(self) -> re.Pattern:
        """A pattern of stretches that no piece reaches across."""
        kind = lambda c: "_" if c == SPACE else "n" if c == "\n" else "L" if c.isalpha() else "O"
        numerals = "".join(sorted(c for c in set("".join(self.ids)) if re.match(r"[^\W\d_]", c) and not c.isalpha()))
        seen = {kind(a) + kind(b) for text in self.ids for a, b in zip(text, text[1:])}
        self.by_word = seen <= {"LL", "OO", "__", "_L", "_O"}
        if self.by_word:
            letter, other = rf"[^\W\d_{numerals}]", rf"(?:[^\w{SPACE}\n]|[\d_{numerals}])"
            return re.compile(rf"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+|\n")
        return re.compile(".+", re.S)

    def _merged(self, text: str, halves: dict | None = None) -> list[int]:
        """Ids by merging the pair of the best score, the leftmost of equal ones, again and again.

        halves takes the two parts of the last merge when it yields the whole text.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            if halves is not None and len(parts) == 2:
                halves[self.ids[text]] = (self.ids[parts[0]], self.ids[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            fits = self.pairs[key] = self._check(left, right)
        return fits

    def _check(self, left: int, right: int) -> bool:
        """Whether merging the two joined texts gives the two pieces again.

        Undoes the later of the two pieces step by step.  The parts that then touch must not
        merge with each other before they merge on their own side; of equal scores the left
        merge comes first.
        """
        texts, scores, ids, halves = self.texts, self.scores, self.ids, self.halves
        a, b, least, or_equal = left, right, -math.inf, True
        while a in self.plain and b in self.plain:
            joined = ids.get(texts[a] + texts[b])
            if joined is not None and (scores[joined] > least or or_equal and scores[joined] == least):
                return False
            if a not in halves and b not in halves:
                return True
            if b not in halves or a in halves and scores[a] < scores[b]:
                least, or_equal, a = scores[a], False, halves[a][1]
            else:
                least, or_equal, b = scores[b], True, halves[b][0]
        return self._merged(texts[left] + texts[right]) == [left, right]

    def _next_shorter(self, piece: int) -> int:
        """The longest usable piece that begins this one, or -1."""
        found = self.shorter.get(piece)
        if found is None:
            text = self.texts[piece]
            found = next((self.usable[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.usable), -1)
            self.shorter[piece] = found
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        size = len(text)
        longest = [-1] * size
        for end, i in self.search.iter(text[::-1]):
            start = size - 1 - end
            if longest[start] < 0:  # the longest of an end comes first
                longest[start] = i
        failed = bytearray((size >> 3) + 1)
        texts, fits, ids, at = self.texts, self._fits, [], 0
        piece = longest[0]
        while at < size:
            end = at + len(texts[piece])
            if not failed[end >> 3] >> (end & 7) & 1 and (not ids or fits(ids[-1], piece)):
                ids.append(piece)
                at = end
                if at < size:
                    piece = longest[at]
                continue
            piece = self._next_shorter(piece)
            while piece < 0:  # no way leads on from here
                failed[at >> 3] |= 1 << (at & 7)
                if not ids:
                    raise ValueError("the model has no encoding of this text")
                last = ids.pop()
                at -= len(texts[last])
                piece = self._next_shorter(last)
        return ids

    def stretch_ids(self, stretch: str) -> list[int]:
        """Ids of a text without a cut; characters that are no piece go by their bytes."""
        if all(map(self.usable.__contains__, stretch)):
            return self._backtrack(stretch)
        ids: list[int] = []
        for known, run in groupby(stretch, self.usable.__contains__):
            part = "".join(run)
            ids += self._backtrack(part) if known else [self.byte_ids[b] for b in part.encode()]
        return ids

    def _fit_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.texts) + right
        slot = (key * 2654435761 >> 7) % PAIR_SLOTS
        strange = np.flatnonzero(self.pair_keys[slot] != key)
        result = self.pair_fits[slot]
        if len(strange):
            fresh, back = np.unique(key[strange], return_inverse=True)
            fits = np.array([self._fits(*divmod(k, len(self.texts))) for k in fresh.tolist()])
            result[strange] = fits[back]
            where, row = np.unique(slot[strange], return_index=True)  # one pair for a place
            self.pair_keys[where], self.pair_fits[where] = key[strange][row], result[strange][row]
        return result

    def many_ids(self, stretches: list[str]) -> list[list[int]]:
        """Ids of texts without a cut: the search of _backtrack, one step of all short texts at a time."""
        result: list[list[int] | None] = [None] * len(stretches)
        short = [k for k, text in enumerate(stretches) if len(text) <= SHORT]
        joined = "\0".join(stretches[k] for k in short)
        longest = np.full(len(joined) + 1, -1)
        if short:
            found, last = [-1] * len(joined), len(joined) - 1
            for end, i in self.search.iter(joined[::-1]):
                if found[last - end] < 0:
                    found[last - end] = i
            longest[:-1] = found
        sizes = np.array([len(stretches[k]) for k in short], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        strange = np.concatenate([[0], np.cumsum(longest < 0)])
        plain = strange[begin + sizes] == strange[begin]
        for k in [k for k, text in enumerate(stretches) if len(text) > SHORT] + [short[j] for j in np.flatnonzero(~plain)]:
            result[k] = self.stretch_ids(stretches[k])
        rows, begin, end = np.array(short, np.int64)[plain], begin[plain], (begin + sizes)[plain]
        ends_with, failed = np.full(len(joined) + 1, -1), np.zeros(len(joined) + 1, bool)
        live, at, piece = np.arange(len(rows)), begin.copy(), longest[begin]
        while len(live):
            back = piece < 0
            to = at + np.where(back, 0, self.lengths[piece])
            fits = ~back & ~failed[to]
            ask = np.flatnonzero(fits & (at > begin[live]))
            fits[ask] = self._fit_many(ends_with[at[ask]], piece[ask])
            ends_with[to[fits]] = piece[fits]
            stuck = at[back]
            failed[stuck] = True
            if (stuck == begin[live][back]).any():
                raise ValueError("the model has no encoding of this text")
            last = ends_with[stuck]
            piece = np.where(fits, longest[to], self.shorter_of[piece])
            at = np.where(fits, to, at)
            piece[back], at[back] = self.shorter_of[last], stuck - self.lengths[last]
            more = at < end[live]
            live, at, piece = live[more], at[more], piece[more]
        on_way, at = np.zeros(len(joined) + 1, bool), end.copy()
        live = np.arange(len(rows))
        while len(live):
            on_way[at] = True
            at = at - self.lengths[ends_with[at]]
            more = at > begin[live]
            live, at = live[more], at[more]
        ids = ends_with[on_way].tolist()
        total = np.concatenate([[0], np.cumsum(on_way)])
        first, after = total[begin + 1].tolist(), total[end + 1].tolist()
        for k, a, b in zip(rows.tolist(), first, after):
            result[k] = ids[a:b]
        return result

    def _split(self, text: str | None) -> list[str]:
        """Words that no piece reaches out of."""
        if not text:
            return []
        if not self.by_word or text[0] == " " or "  " in text or SPACE in text:
            return self.cut.findall(self.prefix + text.replace(" ", SPACE))
        return (self.prefix + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offset of each text; null is empty."""
        words = self.words
        if len(words) > REMEMBERED or words.chars > REMEMBERED_CHARS:
            words.start_anew()
        split, last = [self._split(text) for text in texts], [None] if end else []
        counts = np.array([len(parts) + len(last) for parts in split], np.int64)
        met = list(chain.from_iterable(parts + last for parts in split))
        words.learn({word for word in met if word not in words})
        numbers = np.fromiter(map(words.__getitem__, met), np.int64, len(met))
        starts = np.array(words.starts)
        sizes = starts[numbers + 1] - starts[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.array(words.flat)[_places(starts[numbers], sizes, ends)] if len(numbers) else np.zeros(0, np.int32)
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each row of ids."""
        data, at = self.shown_bytes.join(ids, offsets)
        rows = []
        for k in range(len(offsets) - 1):
            own = ids[offsets[k] : offsets[k + 1]]
            raw = data[at[k] : at[k + 1]].tobytes()
            try:
                raw.decode()
                shown = own[:1].tolist() if len(raw) and self.shown[own[0]] else [i for i in own.tolist() if self.shown[i] or i in self.byte_of][:1]
            except UnicodeDecodeError:
                raw, shown = self._decode_each(own.tolist()).encode(), [i for i in own.tolist() if self.shown[i] or i in self.byte_of][:1]
            if self.prefix and shown and shown[0] not in self.byte_of and self.texts[shown[0]].startswith(SPACE):
                raw = raw[1:]
            rows.append(raw)
        return rows

    def _decode_each(self, ids: list[int]) -> str:
        """Runs of bytes that are no UTF-8 show as the replacement character each."""
        parts = []
        for is_byte, run in groupby(ids, self.byte_of.__contains__):
            parts += [_utf8(bytes(self.byte_of[i] for i in run))] if is_byte else [self.shown[i] for i in run]
        return "".join(parts)


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, one for each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def piece_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of each whole text, the end id last.

    A null text counts as empty and gives the end id alone; repeated rows are encoded
    each; other columns are not kept.
    """
    model = _read(model_path)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, ids = codec(model), []
        for block in _blocks(batch.column("text").to_pylist()):
            flat, offsets = own.encode(block, end=True)
            ids += np.split(flat, offsets[1:-1])
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), encode, "doc_id long, ids array<int>")


def piece_texts(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each array of ids; null ids give null."""
    model = _read(model_path)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = codec(model), []
        for row in batch.column("ids"):
            ids = np.array(row.as_py() or [], np.int64)
            texts.append(own.decode(ids, np.array([0, len(ids)]))[0].decode() if row.is_valid else None)
        return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids of each whole text, and digests of the ids and of the text decoded from them.

    Null and empty texts have the end id alone and decode to the empty text.
    """
    model = _read(model_path)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, coded, decoded = codec(model), [], [], []
        for block in _blocks(batch.column("text").to_pylist()):
            ids, offsets = own.encode(block, end=True)
            counts += np.diff(offsets).tolist()
            data, at = own.decimal_bytes.join(ids, offsets)
            coded += [hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip(at, at[1:])]
            decoded += [hashlib.sha256(raw).hexdigest() for raw in own.decode(ids, offsets)]
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.record_batch(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), digest, SCHEMA)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
