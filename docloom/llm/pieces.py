"""Operator 4: SentencePiece encoding and decoding by a Viterbi pass over a shared trie.

The distinct marked words of a block are sorted, which lays their trie out
depth first: a word shares its longest common prefix with the one before, and
the forward states of that prefix are reused as they are.

For a byte-pair vocabulary the best path to a position has one state, the last
piece of the prefix's encoding: a piece t may end there if it is its own
encoding and the pair (last piece before t, t) encodes to itself. Exactly one
does, so forward scores are 0 or impossible and back-pointers give the pieces
that merging would give; a unigram vocabulary keeps the summed score instead.
Pieces outside the vocabulary fall back to bytes.

The vocabulary file is read on the driver from a path that is a parameter.
Text is marked as the model does: a mark before the text and for each space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .storage import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLOCK_BYTES = 4 << 20  # text encoded at a time
CACHED_WORDS = 800_000  # encodings kept from one block to the next
RESIDENT_WORDS = 100_000  # and by the process from one partition to the next, until another operator works in it
CACHED_PAIRS = 500_000
CACHED_STEPS = 1_000_000  # in the trie
CACHED_LENGTH = 64  # characters of a word that is kept
NUMBER_BITS = 22  # of a piece's number: vocabulary and code points
UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


_resident: dict[int, Pieces] = {}


class Pieces:
    """A vocabulary: pieces with scores, bytes, and whether merges or summed scores decide."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, merging: bool = True, control: frozenset[int] = frozenset()):
        self.pieces, self.byte_ids, self.unknown, self.merging, self.control = pieces, byte_ids, unknown, merging, control
        special = control | set(byte_ids.values()) | {unknown}
        self.index = {p: i for i, (p, _) in enumerate(pieces) if i not in special}
        self.longest = max(map(len, self.index), default=1)
        self.score = {p: pieces[i][1] for p, i in self.index.items()}
        if any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p) for p in self.index):
            raise ValueError("a piece crosses words; this vocabulary can't be encoded word by word")
        self._prefixes = {p[:i] for p in self.index for i in range(1, len(p) + 1)}
        # nodes of the trie that texts came to: their prefix, the pieces that end there (length, number), the longest first, and where a character leads
        self._node: dict[str, int] = {"": 0}
        self._names, self._ending, self._next = [""], [()], [{}]
        self._noted = 0
        self._pairs: dict[int, bool] = {}  # by two numbers of pieces: whether their texts encode to them
        self._whole: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.reset()

    def __reduce__(self):
        return Pieces, (self.pieces, self.byte_ids, self.unknown, self.merging, self.control)

    def resident(self) -> Pieces:
        """The equal vocabulary that this process already works with, if there is one."""
        K.take_turn("pieces", _resident.clear)
        return _resident.setdefault(hash((tuple(self.pieces), self.merging, self.unknown, self.control)), self)

    def reset(self) -> None:
        self._word: str = ""
        # by position: the best path's score, the start of its last piece, that piece's number, and the node of the trie
        self._scores, self._starts, self._numbers, self._nodes = array("d", [0.0]), array("q", [0]), array("q", [0]), array("q", [0])

    @classmethod
    def read(cls, path: str, merging: bool = True) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        control = frozenset(i for i in range(n) if model.is_control(i) or model.is_unused(i))
        return cls([(names[i], model.get_score(i)) for i in range(n)], byte_ids, model.unk_id(), merging, control)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging; single characters at least."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _number(self, character: str) -> int:
        """The number of a single character, in the vocabulary or after it."""
        found = self.index.get(character)
        return len(self.pieces) + ord(character) if found is None else found

    def _text(self, number: int) -> str:
        return self.pieces[number][0] if number < len(self.pieces) else chr(number - len(self.pieces))

    def _own(self, number: int) -> bool:
        found = self._whole.get(number)
        if found is None:
            piece = self._text(number)
            found = self._whole[number] = len(piece) == 1 or self.merged(piece) == [piece]
        return found

    def _fits(self, a: int, b: int) -> bool:
        if len(self._pairs) > CACHED_PAIRS:
            self._pairs.clear()
        found = self._pairs[a << NUMBER_BITS | b] = self._own(b) and self.merged(self._text(a) + self._text(b)) == [self._text(a), self._text(b)]
        return found

    def _lead(self, node: int, character: str) -> int:
        """The node of the longest prefix of a piece that ends with the character; noted for the next time."""
        text = self._names[node] + character
        while text not in self._prefixes and text:
            text = text[1:]
        found = self._node.get(text)
        if found is None:
            found = self._node[text] = len(self._names)
            self._names.append(text)
            self._ending.append(tuple((len(text) - i, self.index[text[i:]]) for i in range(len(text)) if text[i:] in self.index))
            self._next.append({})
        self._noted += 1
        if self._noted > CACHED_STEPS:
            self._noted = 0
            for x in self._next:
                x.clear()
        self._next[node][character] = found
        return found

    def _extend_merging(self, word: str, begin: int) -> None:
        """States of the prefixes of lengths begin and more: the one piece that ends there in their encodings."""
        starts, numbers, nodes, ending, leads, fitting = self._starts, self._numbers, self._nodes, self._ending, self._next, self._pairs.get
        node = nodes[-1]
        for end in range(begin, len(word) + 1):
            character = word[end - 1]
            before = node
            node = leads[before].get(character)
            if node is None:
                node = self._lead(before, character)
            nodes.append(node)
            for length, number in ending[node]:
                if length < end:
                    fits = fitting(numbers[end - length] << NUMBER_BITS | number)
                    if fits is None:
                        fits = self._fits(numbers[end - length], number)
                else:
                    fits = self._own(number)
                if fits:
                    starts.append(end - length)
                    numbers.append(number)
                    break
            else:  # a character outside the vocabulary
                number = self._number(character)
                if end > 1 and not self._fits(numbers[end - 1], number):
                    raise AssertionError(f"no piece ends at {end} of {word[:end][-40:]!r}")
                starts.append(end - 1)
                numbers.append(number)

    def _extend_scored(self, word: str, begin: int) -> None:
        """States of the prefixes of lengths begin and more: the best sum of scores."""
        scores, starts = self._scores, self._starts
        for end in range(begin, len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                if start < end - 1 and piece not in self.index:
                    continue
                score = scores[start] + self.score.get(piece, -1e3)
                if best is None or score > best[0]:
                    best = (score, start)
            scores.append(best[0])
            starts.append(best[1])
            self._numbers.append(self.index[word[best[1] : end]] if best[1] < end - 1 else self._number(word[end - 1]))

    def encode_next(self, word: str) -> bytes:
        """Packed ids of a word, read along the back-pointers; states shared with the word before are reused."""
        before, starts, numbers = self._word, self._starts, self._numbers
        common, most = 0, min(len(before), len(word))
        if word[:most] == before[:most]:
            common = most
        else:  # the longest common prefix by halving
            while most - common > 1:
                middle = (common + most) // 2
                common, most = (middle, most) if word[common:middle] == before[common:middle] else (common, middle)
        del starts[common + 1 :], numbers[common + 1 :], self._scores[common + 1 :], self._nodes[common + 1 :]
        (self._extend_merging if self.merging else self._extend_scored)(word, common + 1)
        self._word = word
        out, end, known = [], len(word), len(self.pieces)
        while end:
            out.append(numbers[end])
            end = starts[end]
        out.reverse()
        if out and max(out) >= known:
            out = list(chain.from_iterable((x,) if x < known else self._fallback(chr(x - known)) for x in out))
        return array("i", out).tobytes()

    def _fallback(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of each word; sorted, so that common prefixes are met once."""
        self.reset()
        return {w: self.encode_next(w) for w in sorted(words)}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces and their offsets."""
        own = {i: bytes([b]) for b, i in self.byte_ids.items()}
        raw = [own.get(i, b"" if i in self.control else p.replace(MARK, " ").encode()) for i, (p, _) in enumerate(self.pieces)]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def decode_ids(ids: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Texts of the runs ids[bounds[i]:bounds[i + 1]], without the mark before each."""
    data, offsets = tables
    n = (offsets[1:] - offsets[:-1])[ids]
    ends = np.concatenate(([0], np.cumsum(n)))
    raw = data[np.repeat(offsets[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    texts = [raw[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
    return [x[1:] if x.startswith(" ") else x for x in texts]


def _shorten(cache: dict[str, bytes], n: int) -> None:
    """Leave the first n; the first to come are the most frequent."""
    for x in list(cache)[n:]:
        del cache[x]


def _encode(vocabulary: Pieces, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.resident()
        cache, tables = own.cache, own.tables()
        for batch in batches:
            _, sizes = K.utf8(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(sizes, sizes[at] + BLOCK_BYTES, "right")) - 1, at + 1), batch.num_rows)
                rows = batch.slice(at, to - at)
                at = to
                texts = rows.column("text").to_pylist()
                units = [UNITS.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
                new = set(chain.from_iterable(units))
                if len(cache) > CACHED_WORDS:
                    _shorten(cache, CACHED_WORDS // 2)
                new.difference_update(cache)
                cache.update(own.encode_words(new))
                packed = [b"".join(map(cache.__getitem__, x)) for x in units]
                for x in new:
                    if len(x) > CACHED_LENGTH:
                        del cache[x]
                ids = np.frombuffer(b"".join(packed), np.int32)
                bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed])))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                rest = [x for x in rows.schema.names if x != "text"]
                columns = [*(rows.column(x) for x in rest), lists]
                if decoded:
                    back = decode_ids(ids, bounds, tables)
                    columns += [pa.array(back, pa.string()), pa.array([x is None or x == y for x, y in zip(texts, back)])]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "piece_ids", *["decoded", "round_trip"] * decoded])
        _shorten(cache, RESIDENT_WORDS)
        own.reset()
        K.tidy()

    return run


def encode(docs: DataFrame, model: str = MODEL, decoded: bool = False, vocabulary: Pieces | None = None) -> DataFrame:
    """docs (doc_id, text) as (doc_id, piece_ids); with decoded also the decoded text and whether it equals the text.

    Null or empty text: no ids, decoded empty, a round trip. A text that holds
    the mark U+2581 itself decodes to spaces there, which round_trip tells.
    Null doc_id and repeated rows are kept. An empty table gives an empty result;
    other columns are ignored. A text without spaces is one word, whose states
    take 16 bytes a character.
    """
    vocabulary = vocabulary or Pieces.read(model)
    return lean(docs).select("doc_id", "text").mapInArrow(_encode(vocabulary, decoded), "doc_id long, piece_ids array<int>" + ", decoded string, round_trip boolean" * decoded)


def decode(encoded: DataFrame, model: str = MODEL, vocabulary: Pieces | None = None) -> DataFrame:
    """(doc_id, piece_ids) as (doc_id, text). Null ids give a null text; an empty table gives an empty result, other columns are ignored."""
    tables = (vocabulary or Pieces.read(model)).tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("piece_ids").to_pylist()
            ids = np.array(list(chain.from_iterable(x or [] for x in lists)), np.int64)
            texts = decode_ids(ids, np.concatenate(([0], np.cumsum([len(x or []) for x in lists]))), tables)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else y for x, y in zip(lists, texts)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")
