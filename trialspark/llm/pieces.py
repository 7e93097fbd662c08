"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

The encoding of a text has a property that makes it linear: for every prefix the last
token of the prefix's own encoding is unique, and a token may follow another exactly
if the two, joined, encode to those two. So one pass of an automaton over the text
finds, for every prefix, the token that ends there and is compatible with the last
token of the prefix before it; the ids are then read off backwards. A pair's
compatibility is decided once, by merging the joined pair, and remembered.

No piece has a space mark behind another character, so texts are cut before each run
of marks and the parts, mostly words, are encoded once and remembered, within a bound.
Characters that are no piece end in the byte pieces of their UTF-8 form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from trialspark.llm.arrays import slices

MARK = "▁"
MAX_REMEMBERED = 250_000
MAX_REMEMBERED_LENGTH = 48
MAX_PAIRS = 500_000

# Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNKNOWN_TEXT = " ⁇ ".encode()


@dataclass
class Vocabulary:
    """Pieces of a byte-fallback BPE model; small and plain, so that it can be shipped to tasks."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bos: int
    eos: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file on the driver; other kinds of model are refused."""
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        spec = model.normalizer_spec
        found = cls(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            [p.type for p in model.pieces],
            model.trainer_spec.bos_id,
            model.trainer_spec.eos_id,
        )
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("not a BPE model with byte fallback")
        if spec.precompiled_charsmap or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts")
        if set(found.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        if any(MARK in piece.lstrip(MARK) for piece in found.pieces):
            raise ValueError("a piece has a space mark inside")
        return found


_coders: list[tuple[list[str], Coder]] = []


def coder_of(vocabulary: Vocabulary) -> Coder:
    """Coder of a vocabulary; a process keeps the last one alone, with what it remembers."""
    if not _coders or _coders[0][0] != vocabulary.pieces:
        _coders[:] = [(vocabulary.pieces, Coder(vocabulary))]
    return _coders[0][1]


class Coder:
    """Encoder and decoder of one vocabulary, with its remembered words and pairs."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        kinds = vocabulary.kinds
        self.size = len(kinds)
        self.bos, self.eos = vocabulary.bos, vocabulary.eos
        self.of_byte = {}
        self.surface: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(vocabulary.pieces, kinds)):
            if kind == _BYTE:
                self.of_byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == _NORMAL:
                self.surface.append(piece.replace(MARK, " ").encode())
            else:
                self.surface.append(_UNKNOWN_TEXT if kind == _UNKNOWN else b"")
        self.kinds = kinds
        self.text = {i: p for i, (p, k) in enumerate(zip(vocabulary.pieces, kinds)) if k == _NORMAL}
        self.starts_with_mark = {i for i, p in self.text.items() if p[0] == MARK}
        self.id = {piece: i for i, piece in self.text.items()}
        self.score = {piece: vocabulary.scores[i] for piece, i in self.id.items()}
        # A character that only occurs inside longer pieces takes part in merges all the same.
        for char in sorted({c for piece in self.id for c in piece} - set(self.id)):
            self.id[char] = self.size + len(self.text)
            self.text[self.id[char]] = char
        self.packed = {i: self._bytes_of(p) if i >= self.size else _pack(i) for i, p in self.text.items()}
        self.length = {i: len(p) for i, p in self.text.items()}
        self.alphabet = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) == 1 or self.merged(piece) == [i]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.marked = _Remembered(lambda word: self._part(MARK + word))
        self.bare = _Remembered(self._part)

    def _bytes_of(self, char: str) -> bytes:
        return b"".join(_pack(self.of_byte[b]) for b in char.encode())

    def merged(self, text: str) -> list[int]:
        """Ids of a short text by merging its best adjacent pair, the leftmost of equals, again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[part] for part in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def _known_run(self, text: str) -> bytes:
        """Ids of characters of the alphabet: the prefix table forwards, the ids backwards."""
        last = [-1] * (len(text) + 1)
        length, pairs = self.length, self.pairs
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length[token]
            if begin:
                previous = last[begin]
                known = pairs.get((previous, token))
                if known is None:
                    known = self.compatible(previous, token)
                if not known:
                    continue
            last[end] = token
        found, end = [], len(text)
        while end:
            token = last[end]
            found.append(self.packed[token])
            end -= length[token]
        found.reverse()
        return b"".join(found)

    def _part(self, text: str) -> bytes:
        if self.alphabet.issuperset(text):
            return self._known_run(text)
        out, run = [], []
        for char in text:
            if char in self.alphabet:
                run.append(char)
                continue
            if run:
                out.append(self._known_run("".join(run)))
                run = []
            out.append(self._bytes_of(char))
        if run:
            out.append(self._known_run("".join(run)))
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        out = [_pack(self.bos)]
        if text:
            newline = b"" if "\n" in self.alphabet else self._bytes_of("\n")
            if not newline or "  " in text or MARK in text or text[0] == " ":
                for part in _PARTS.findall(MARK + text.replace(" ", MARK)):
                    out.append(self.bare[part])
            else:
                marked, bare = self.marked.__getitem__, self.bare
                for number, line in enumerate(text.split("\n")):
                    parts = line.split(" ")
                    if number:
                        out.append(newline)
                        if parts[0]:
                            out.append(bare[parts[0]])
                        del parts[0]
                    out.extend(map(marked, parts))
        out.append(_pack(self.eos))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control pieces have none, and the mark that every text begins with goes."""
        runs: list[list[int]] = [[]]
        for i in ids:
            if self.kinds[i] == _CONTROL:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [run for run in runs if run]
        raw = [b"".join(map(self.surface.__getitem__, run)) for run in runs]
        if runs and runs[0][0] in self.starts_with_mark:
            raw[0] = raw[0][1:]
        return "".join(map(_text_of, raw))


def _text_of(raw: bytes) -> str:
    """Text of UTF-8 bytes; bytes that form no character are replaced one by one."""
    out = []
    while True:
        try:
            out.append(raw.decode())
            return "".join(out)
        except UnicodeDecodeError as error:
            out.append(raw[: error.start].decode() + "\N{REPLACEMENT CHARACTER}")
            raw = raw[error.start + 1 :]


def _pack(i: int) -> bytes:
    return i.to_bytes(4, "little")


class _Remembered(dict):
    """Ids by text. Long texts aren't kept, and a full memory starts anew."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= MAX_REMEMBERED_LENGTH:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


TOKENS = "doc_id long, n_tokens long, ids binary, decoded string"


def tokenize(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each row of ``docs(doc_id, text)``.

    ``ids`` holds the ids with begin and end as little-endian unsigned 32-bit integers,
    ``decoded`` the text they decode to. Null is an empty text (two ids); repeated rows
    and null ids go through unchanged; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [coder.encode_packed(text or "") for text in part.column("text").to_pylist()]
                ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array([coder.decode(i) for i in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def unpacked(ids: str = "ids") -> F.Column:
    """Array of integers from packed ids."""
    steps = F.sequence(F.lit(0), F.floor(F.length(ids) / 4).cast("int") - 1)
    hexed = F.hex(ids)

    def one(k):
        at = k * 8
        order = [F.substring(hexed, at + shift, F.lit(2)) for shift in (7, 5, 3, 1)]
        return F.conv(F.concat(*order), 16, 10).cast("int")

    return F.when(F.length(ids) > 0, F.transform(steps, one)).otherwise(F.array().cast("array<int>"))
