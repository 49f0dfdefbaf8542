"""SentencePiece encoding and decoding by a merge-type prefix table.

A merge-type vocabulary gives every prefix of a text exactly one last token, whatever follows (as long as the prefix
ends where it does). So encoding needs no merge queue: an Aho-Corasick automaton names all tokens that end at a place,
longest first, and the last token of that prefix is the one that may stand behind the last token of the prefix it leaves
over. Whether two tokens may stand side by side is a test on the two alone: undo their merges, latest first, and see
whether a pair across the border would have been merged earlier. The ids are read from the table backwards.

A stretch is encoded at once: blank marks and what follows them up to the next blank mark. No token has a blank mark
behind another character (checked when the model is loaded), so nothing is merged across these borders. Stretches
seen lately are looked up, in two dictionaries of bounded size.

Each text is encoded on its own: no shuffle, memory bounded by one Arrow batch, its ids and the dictionaries.

Nulls and edge cases: a null or empty text is the end id alone and decodes to an empty text; doc_id may be null; equal
rows give equal rows; other columns are ignored; characters that the vocabulary lacks become their bytes' tokens; texts
are encoded whole, whatever their length; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mark that stands for a blank in the vocabulary.
MARK = "▁"
STRETCH = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: Stretches and token pairs that a worker remembers; results do not depend on it.
REMEMBERED, PAIRS_REMEMBERED, LONGEST_REMEMBERED = 1 << 18, 1 << 19, 64

ENCODED = "doc_id long, ids array<int>, decoded string"


class Remembered(dict):
    """Ids of the stretches seen lately: at most REMEMBERED in here and as many again from before."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part)
        if ids is None:
            ids = self.find(part)
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Tables of a BPE model with byte fallback, identity normalisation and a blank mark before the text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        self.end = self.library.eos_id()
        special = {i for i in ids if self.library.is_unknown(i) or self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unused(i)}
        self.id_of = {self.library.id_to_piece(i).replace(MARK, " "): i for i in ids if i not in special}
        if any(" " in piece.lstrip(" ") or "\n" in piece for piece in self.id_of):
            raise ValueError("a piece holds a blank mark behind another character, or a line break")
        self.piece = {i: p for p, i in self.id_of.items()}
        self.byte = {int(self.library.id_to_piece(i)[3:5], 16): i for i in ids if self.library.is_byte(i)}
        order = {score: k for k, score in enumerate(sorted({self.library.get_score(i) for i in self.piece}, reverse=True))}
        self.rank = {i: order[self.library.get_score(i)] for i in self.piece}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            halves = self._last_merge(piece)
            if len(piece) > 1 and halves is None:
                continue  # no sequence of merges makes this piece, so no text is encoded with it
            if halves:
                self.parts[i] = halves
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.beside: dict[int, bool] = {}
        self.known = Remembered(self.stretch)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes the piece when it is encoded alone."""
        symbols = list(piece)
        last = None
        while len(symbols) > 1:
            found = [(self.rank[i], at, i) for at in range(len(symbols) - 1) if (i := self.id_of.get(symbols[at] + symbols[at + 1])) is not None]
            if not found:
                return None
            _, at, _ = min(found)
            last = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return (self.id_of[last[0]], self.id_of[last[1]]) if last else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when their texts are encoded together.

        `limit`: merges across the border of a lower rank would have come before the merge undone last. Of merges of
        one rank the leftmost comes first, so on the right side an equal rank counts as earlier.
        """
        limit = len(self.rank) + 1
        while True:
            across = self.id_of.get(self.piece[left] + self.piece[right])
            if across is not None and self.rank[across] < limit:
                return False
            undo_left, undo_right = left in self.parts, right in self.parts
            if not undo_left and not undo_right:
                return True
            if undo_left and (not undo_right or self.rank[left] > self.rank[right]):
                limit, left = self.rank[left], self.parts[left][1]
            else:
                limit, right = self.rank[right] + 1, self.parts[right][0]

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which marks are blanks, by its table of last tokens."""
        last, width = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        beside = self.beside
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - length]
            if before >= 0:  # else a start, or behind a character that is no token and merges with nothing
                pair = before << 32 | token
                fits = beside.get(pair)
                if fits is None:
                    if len(beside) >= PAIRS_REMEMBERED:
                        beside.clear()
                    fits = beside[pair] = self.may_follow(before, token)
                if not fits:
                    continue
            last[end + 1], width[end + 1] = token, length
        backwards: list[int] = []
        at = len(text)
        while at:
            if last[at] >= 0:
                backwards.append(last[at])
                at -= width[at]
            else:
                at -= 1
                backwards.extend(self.byte[b] for b in reversed(text[at].encode()))
        return tuple(reversed(backwards))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without the end id."""
        return list(chain.from_iterable(map(self.known.__getitem__, STRETCH.findall(" " + text.replace(MARK, " "))))) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, Codec] = {}


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id) and the text decoded from them. model: path of the model file on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = model or public_tokenizers.path("piece_bpe_32k.model")
        if path not in _codecs:
            _codecs[path] = Codec(path)
        codec = _codecs[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                encoded = [[*codec.encode(cell.as_py() or ""), codec.end] for cell in some.column(1)]
                columns = [some.column(0).cast(pa.int64()), pa.array(encoded, pa.list_(pa.int32())), pa.array([codec.decode(ids) for ids in encoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, one blank between them) and decoded_sha256."""
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
