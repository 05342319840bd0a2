"""Unigram vocabularies: their pieces and scores, how texts are normalised, and exact best paths.

Any SentencePiece model file will do: ``as_unigram`` makes a unigram model of it, with its pieces and
their scores, which the library can load too.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np

SPACE = "▁"
#: What an unknown character costs beyond the worst piece; a fixed value of the library.
UNKNOWN_PENALTY = 10.0

# Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_WORD = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


#: Scores under this one mark pieces that a model has without having ranked them.
UNRANKED = -1e8


def as_unigram(model: bytes) -> bytes:
    """The model file as one of type unigram. Unranked pieces count as one worse than the worst ranked one."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    read = pb.ModelProto()
    read.ParseFromString(model)
    read.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    ranked = [p.score for p in read.pieces if p.type == NORMAL and p.score > UNRANKED]
    for p in read.pieces:
        if p.type == NORMAL and p.score <= UNRANKED:
            p.score = min(ranked, default=0.0) - 1
    return read.SerializeToString()


class Vocabulary:
    """Pieces in an Aho-Corasick automaton, which names every piece that ends at a position, longest first."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = as_unigram(model)
        read = pb.ModelProto()
        read.ParseFromString(model)
        self.pieces = [p.piece for p in read.pieces]
        kinds = [p.type for p in read.pieces]
        scores = [float(np.float32(p.score)) for p in read.pieces]
        if any(k == USER_DEFINED for k in kinds):
            raise ValueError("user-defined pieces are not supported")
        self.automaton = ahocorasick.Automaton()
        for i, (piece, kind, score) in enumerate(zip(self.pieces, kinds, scores)):
            if kind == NORMAL:
                self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        normal = [p for p, k in zip(self.pieces, kinds) if k == NORMAL]
        self.longest = max(map(len, normal), default=1)
        self.unknown = float(np.float32(min((s for s, k in zip(scores, kinds) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY))
        self.single = {p for p in normal if len(p) == 1}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE} if read.trainer_spec.byte_fallback else {}
        # If a space is known and no piece goes on to one, every word is a path of its own.
        self.words_apart = SPACE in self.single and not any(SPACE in p.lstrip(SPACE) for p in normal)
        spec = read.normalizer_spec
        self._prefix = spec.add_dummy_prefix
        self._library = None
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            from sentencepiece import SentencePieceProcessor

            self._library = SentencePieceProcessor(model_proto=model)
        self._out = [self._surface(p, k) for p, k in zip(self.pieces, kinds)]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def normalized(self, text: str) -> str:
        """The text as the pieces spell it: a space is U+2581, and one stands before the text."""
        if self._library:
            return self._library.normalize(text).replace(" ", SPACE)
        return (SPACE if self._prefix and text else "") + text.replace(" ", SPACE)

    def words(self, normal: str) -> list[str]:
        """Parts whose best paths do not depend on each other."""
        if not normal:
            return []
        if not self.words_apart:
            return [normal]
        parts = normal.split(SPACE)
        if "" in parts[1:]:
            return _WORD.split(normal)
        return [*([parts[0]] if parts[0] else []), *[SPACE + p for p in parts[1:]]]

    def edges(self, text: str):
        """(end, start, score, id) of all pieces in ``text`` and of its unknown characters.

        In the order of ends, and at one end in the order of starts.
        """
        at, single = 0, self.single
        for last, (length, score, piece) in self.automaton.iter(text):
            while at < last:  # characters before this end that no piece ends at or spells alone
                if text[at] not in single:
                    yield at + 1, at, self.unknown, -1
                at += 1
            yield last + 1, last + 1 - length, score, piece
        while at < len(text):
            if text[at] not in single:
                yield at + 1, at, self.unknown, -1
            at += 1

    def ids_of(self, piece: int, char: str) -> list[int]:
        """The id of a piece; an unknown character gives those of its bytes."""
        return [piece] if piece >= 0 else [self.bytes[b] for b in char.encode()]

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids, without the space before it. Invalid UTF-8 becomes U+FFFD."""
        out = self._out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self._prefix and text.startswith(" ") else text


def best_path(vocabulary: Vocabulary, text: str) -> tuple[list[float], list[int], list[int]]:
    """Score, last start and last piece of the best path to each position, in double precision.

    Of equal scores the earliest start wins, that is the longest last piece; so does the library.
    """
    low = float("-inf")
    n = len(text)
    best, back, piece = [low] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    if vocabulary.single.issuperset(text):  # no unknown characters: the automaton names all edges
        for last, (length, score, p) in vocabulary.automaton.iter(text):
            begin = last + 1 - length
            candidate = best[begin] + score
            if candidate > best[last + 1]:
                best[last + 1], back[last + 1], piece[last + 1] = candidate, begin, p
        return best, back, piece
    for end, begin, score, p in vocabulary.edges(text):
        candidate = best[begin] + score
        if candidate > best[end]:
            best[end], back[end], piece[end] = candidate, begin, p
    return best, back, piece
