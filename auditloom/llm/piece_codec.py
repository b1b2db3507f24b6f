"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports, at each position, the longest piece that ends there and then the shorter ones along its output links;
each relaxes the best score of its end. Ties keep the longest last piece. A character without a piece of its own
becomes its UTF-8 byte pieces. As no piece holds a space mark after another character, or a line break, text is cut in front of
runs of spaces and at line breaks, which leaves every best path whole, and repeated chunks are looked up.

Every text decodes to itself: a mark is put in front of the text and taken off again, and a literal U+2581 is
spelled in bytes. Null text has null pieces and decodes to null; empty text has none and decodes to empty text. Repeated
rows are encoded alike. Other columns pass through; those that clash with the new ones are replaced.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE, MARK = " ", "▁"
#: The vocabulary file; a parameter of every function that reads one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
CACHED_CHUNKS, LONGEST_CACHED = 1 << 19, 64


@dataclass(frozen=True)
class Vocabulary:
    """Piece texts with their scores and ids, and the ids of the 256 byte pieces."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes_: tuple[int, ...]
    size: int

    def tables(self) -> tuple:
        return self.pieces, self.bytes_, self.size

    @property
    def cuts(self) -> bool:
        """Whether a text may be cut in front of space runs and at line breaks."""
        return not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.pieces)


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver. Its size is the vocabulary's, whatever the corpus."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    spelled = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    plain = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in ids
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return Vocabulary(plain, tuple(spelled[f"<0x{b:02X}>"] for b in range(256)), len(ids))


class Encoder(dict):
    """Ids by chunk, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, number, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), number, score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min(s for _, _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.bytes = vocabulary.bytes_
        self.chunks = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}" if vocabulary.cuts else f"[^{MARK}]+|{MARK}").findall

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(self.viterbi(chunk))
        if len(self) < CACHED_CHUNKS and len(chunk) <= LONGEST_CACHED:
            self[chunk] = ids
        return ids

    def spell(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()]

    def covered(self, text: str) -> list[int]:
        """Viterbi over a text whose every character is a piece: no end is out of reach, so nothing is unknown."""
        best, back = [-np.inf] * len(text) + [0.0], [None] * len(text)  # entry -1 is the start
        for end, found in self.automaton.iter(text):
            reached = best[end - found[0]] + found[2]
            if reached > best[end]:
                best[end], back[end] = reached, found
        ids, at = [], len(text) - 1
        while at >= 0:
            length, number, _ = back[at]
            ids.append(number)
            at -= length
        ids.reverse()
        return ids

    def viterbi(self, chunk: str) -> list[int]:
        if chunk == MARK:
            return self.spell(MARK)
        text = chunk.replace(SPACE, MARK)
        if self.single.issuperset(text):
            return self.covered(text)
        best, back = [0.0] + [-np.inf] * len(text), [(0, -1)] * (len(text) + 1)
        done = 0

        def finish(upto: int) -> None:
            """Offer each character up to there as unknown, where no piece is that character."""
            nonlocal done
            for at in range(done, upto):
                if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)
            done = max(done, upto)

        for end, (length, number, score) in self.automaton.iter(text):
            finish(end)
            reached = best[end + 1 - length] + score
            if reached > best[end + 1]:
                best[end + 1], back[end + 1] = reached, (end + 1 - length, number)
        finish(len(text))
        ids: list[int] = []
        at = len(text)
        while at:
            start, number = back[at]
            ids.extend(reversed(self.spell(text[start:at])) if number < 0 else (number,))
            at = start
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return list(self.stream(text))

    def stream(self, text: str):
        return chain.from_iterable(map(self.__getitem__, self.chunks(SPACE + text))) if text else iter(())


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.table = [b""] * vocabulary.size
        for piece, number, _ in vocabulary.pieces:
            self.table[number] = piece.replace(MARK, SPACE).encode()
        for value, number in enumerate(vocabulary.bytes_):
            self.table[number] = bytes([value])

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "replace")


def _lists(offsets: list[int], flat: array, missing: list[bool]) -> pa.Array:
    values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing, pa.bool_()))


def _with_ids(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder | None) -> dict[str, pa.Array]:
    offsets, flat, missing, same = [0], array("i"), [], []
    for value in batch.column("text"):
        text = value.as_py()
        missing.append(text is None)
        start = len(flat)
        if text:
            flat.extend(encoder.stream(text))
        offsets.append(len(flat))
        if decoder:
            same.append(text is None or decoder.decode(flat[start:]) == text)
    lengths = [None if gone else b - a for a, b, gone in zip(offsets, offsets[1:], missing)]
    out = {"token_ids": _lists(offsets, flat, missing), "n_tokens": pa.array(lengths, pa.int64())}
    return out | ({"round_trip": pa.array(same, pa.bool_())} if decoder else {})


def encode(docs: DataFrame, vocabulary: Vocabulary, verify: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``token_ids`` and ``n_tokens``; ``verify`` adds ``round_trip``, the decoded ids against the text."""
    new = {"token_ids": "array<int>", "n_tokens": "long"} | ({"round_trip": "boolean"} if verify else {})
    plain = docs.select(*[c for c in docs.columns if c not in new])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.tables())  # as large as the vocabulary file

    def run(batches):
        encoder = Encoder(Vocabulary(*shared.value))
        decoder = Decoder(Vocabulary(*shared.value)) if verify else None
        for batch in batches:
            added = _with_ids(batch, encoder, decoder)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    schema = ", ".join([f"`{n}` {t}" for n, t in plain.dtypes] + [f"{n} {t}" for n, t in new.items()])
    return plain.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of ``tokens`` with ``text``, decoded from ``token_ids``."""
    plain = tokens.select(*[c for c in tokens.columns if c != "text"])
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary.tables())

    def run(batches):
        decoder = Decoder(Vocabulary(*shared.value))
        for batch in batches:
            texts = [None if ids.as_py() is None else decoder.decode(ids.as_py()) for ids in batch.column("token_ids")]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return plain.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in plain.dtypes] + ["text string"]))
