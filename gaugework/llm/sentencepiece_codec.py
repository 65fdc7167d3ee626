"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation is the one with the highest sum of piece scores. Characters are read one by one. A
boundary survives as long as what was read since it can still begin a piece; only surviving boundaries can
stand on the best path, and none is older than the longest piece. Their backpointer paths are followed back, and
what lies before the boundary at which all of them meet is committed as ids and forgotten: at once where a
single boundary survives, else each time a window of the longest piece has been read. Ties go to the longer
last piece. Characters outside the vocabulary become byte pieces, as the model's byte fallback has it, below
every piece's score.

Scores: a unigram model's log likelihoods as the file has them. A merge model has none, only the order in which
its pieces were merged; by Zipf's law the piece of rank r of n has the likelihood 1 / (r H), where H is the sum of
1 / r up to n, which leaves nothing to fit.

Where no piece holds a space sign behind another character (checked for the model at hand), a space sign behind
a word leaves a single boundary: what lies between two such places is committed as a whole, whatever
stands around it. Ids of such stretches that Viterbi has found are remembered up to MEMORY bytes.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Below the score of any path of pieces, for each byte of a character that no piece spells.
FALLBACK = -1e6
#: Bytes of remembered stretches in a worker, about; ids in an Arrow batch that is given out.
MEMORY, GIVEN = 48 << 20, 1 << 19


@dataclass
class Pieces:
    """What encoding needs of a model: pieces with (score, id), the ids of the 256 bytes, flags of its normalizer."""

    score: dict[str, tuple[float, int]]
    byte_ids: list[int]
    text: list[str]
    kind: list[int]
    dummy_prefix: bool
    longest: int = field(init=False)
    splits: bool = field(init=False)

    def __post_init__(self):
        self.longest = max((len(p) for p in self.score), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.score)


def read_pieces(content: bytes) -> Pieces:
    """Pieces of a serialized model with an identity normalizer and byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(content)
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with an identity normalizer decode to the same text")
    normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
    likely = model.trainer_spec.model_type == 1  # a unigram model: its scores are log likelihoods
    whole = sum(1 / r for r in range(1, len(normal) + 1))
    score = {model.pieces[i].piece: (model.pieces[i].score if likely else -math.log(rank * whole), i) for rank, i in enumerate(normal, 1)}
    bytes_ = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
    return Pieces(score, [bytes_[f"<0x{b:02X}>"] for b in range(256)], [p.piece for p in model.pieces], [p.type for p in model.pieces], spec.add_dummy_prefix)


def trie_of(pieces: Pieces) -> dict:
    """Pieces as paths of characters. A node maps characters to steps (the next node, null where no longer piece goes on; the score
    of the piece that ends there, NONE without one; its id)."""
    root: dict = {}
    for piece, hit in pieces.score.items():
        node = root
        for ch in piece[:-1]:
            node = node.setdefault(ch, [{}, NONE, -1])[0]
        node.setdefault(piece[-1], [{}, NONE, -1])[1:] = hit
    open_ = [root]
    while open_:
        node = open_.pop()
        for ch, (after, score, id_) in node.items():
            node[ch] = after or None, score, id_
            open_.append(after)
    return root


NONE = -math.inf
#: The step for a character that begins no piece.
ABSENT = None, NONE, -1


class Viterbi:
    """Takes characters, gives committed ids.

    best and back hold the boundaries since the last commit: their score, and the boundary and the id (or the
    character, for byte pieces) of the step that leads there. live: (trie node, boundary, its score) of what may still
    become a longer piece.
    """

    def __init__(self, pieces: Pieces):
        self.p, self.trie = pieces, trie_of(pieces)
        self._restart()

    def _restart(self) -> None:
        self.best, self.back, self.live, self.due = [0.0], [(0, -1)], [], 2 * self.p.longest

    def feed(self, text: str) -> array:
        out = array("i")
        best, back, live, n, due, root = self.best, self.back, self.live, len(self.best) - 1, self.due, self.trie.get
        for ch in text:
            top, grown = -1e300, []
            for node, start, score in live:  # older boundaries first: of equal scores the longer piece wins
                step = node.get(ch)
                if step is not None:
                    node, s, id_ = step
                    s += score
                    if s > top:
                        top, origin, what = s, start, id_
                    if node is not None:
                        grown.append((node, start, score))
            score = best[n]
            node, s, id_ = root(ch, ABSENT)
            if s == NONE:  # the character is no piece
                s, id_ = FALLBACK * len(ch.encode()), ch
            s += score
            if s > top:
                top, origin, what = s, n, id_
            if node is not None:
                grown.append((node, n, score))
            best.append(top)
            back.append((origin, what))
            live = grown
            n += 1
            if not live:  # only the new boundary survives
                self._path(n, out)
                del best[:n], back[:n]
                best[0], back[0], n = 0.0, (0, -1), 0
            elif n >= due:
                n, live = self._commit(n, live, out)
                due = self.due
        self.live = live
        return out

    def _commit(self, n: int, live: list, out: array) -> tuple[int, list]:
        """Commits up to the last boundary that the paths of all survivors share."""
        paths = {n, *(start for _, start, _ in live)}
        while len(paths) > 1:  # the farthest goes one piece back, until all are at one boundary
            far = max(paths)
            paths.remove(far)
            paths.add(self.back[far][0])
        meet = paths.pop()
        base = self.best[meet]
        if meet:
            self._path(meet, out)
            self.best[:] = [b - base for b in self.best[meet:]]
            self.back[:] = [(0, -1)] + [(max(0, a - meet), what) for a, what in self.back[meet + 1 :]]
        self.due = n - meet + self.p.longest
        return n - meet, [(node, start - meet, score - base) for node, start, score in live]

    def _path(self, at: int, out: array) -> None:
        found = []
        while at > 0:
            at, what = self.back[at]
            if isinstance(what, str):
                found += [self.p.byte_ids[b] for b in reversed(what.encode())]
            else:
                found.append(what)
        found.reverse()
        out.extend(found)

    def finish(self) -> array:
        out = array("i")
        self._path(len(self.best) - 1, out)
        self._restart()
        return out


class Codec:
    def __init__(self, pieces: Pieces, memory: int = MEMORY):
        self.p, self.viterbi, self.memory = pieces, Viterbi(pieces), memory
        self.young: dict[str, bytes] = {}  # remembered stretches, in two generations: the older goes as a whole
        self.old: dict[str, bytes] = {}
        self.held = 0
        #: Set where the ids of a stretch did not give it back. Without such a stretch texts come back: bytes are laid end to end.
        self.broken = False
        first = {i: b for b, i in enumerate(pieces.byte_ids)}
        self.raw = [bytes([first[i]]) if i in first else t.replace(SPACE, " ").encode() if k == 1 else b"" for i, (t, k) in enumerate(zip(pieces.text, pieces.kind))]

    def _stretch(self, text: str) -> bytes:
        """The ids, as int32 bytes, of a stretch whose ends no piece runs over. Remembered without its first space sign."""
        key = text[1:] if text[:1] == SPACE else SPACE + text
        found = self.old.get(key)
        if found is None:
            out = self.viterbi.feed(text)
            out.extend(self.viterbi.finish())
            found = out.tobytes()
            if b"".join(map(self.raw.__getitem__, out)) != text.replace(SPACE, " ").encode():
                self.broken = True
        size = 200 + 2 * len(text) + len(found)
        if size <= self.memory >> 6:
            if self.held + size > self.memory >> 1:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[key] = found
            self.held += size
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = (SPACE if self.p.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.p.splits:
            return np.frombuffer(self._stretch(marked), np.int32)
        head, *words = marked.split(SPACE)  # each word has one space sign before it; an empty one lengthens the run
        if "" not in words:
            parts = list(map(self.young.get, words))
            if None in parts:
                parts = [self.young.get(w) or self._stretch(SPACE + w) if p is None else p for w, p in zip(words, parts)]
        else:
            parts, run = [], SPACE
            for word in words:
                if word:
                    parts.append((run == SPACE and self.young.get(word)) or self._stretch(run + word))
                    run = SPACE
                else:
                    run += SPACE
            if len(run) > 1:
                parts.append(self._stretch(run[1:]))
        if head:
            parts.insert(0, self._stretch(head))
        return np.frombuffer(b"".join(parts), np.int32)

    def returns(self, ids, text: str) -> bool:
        """Whether decoding gives the text back, space signs as spaces."""
        return not self.broken or self.decode(ids) == text.replace(SPACE, " ")

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        out = raw.decode("utf-8", "replace")
        return out[1:] if self.p.dummy_prefix and out[:1] == " " else out


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a Python worker and model, so that what is remembered outlives a task."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.pieces)
    return _codecs[shared.id]


@dataclass
class _Model:
    id: int
    pieces: Pieces


def _share(docs: DataFrame, model_path: str):
    """The model as a broadcast value; it has a few hundred kB and does not grow with the data."""
    import zlib

    with open(model_path, "rb") as f:  # a file of the installation, not an input
        content = f.read()
    return docs.sparkSession.sparkContext.broadcast(_Model(zlib.crc32(content), read_pieces(content)))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array<int>), n_ids, round_trip: one row per row of docs.

    Null text counts as empty and has no ids. round_trip tells whether decoding gave the text back, which
    holds for every text without the space sign U+2581 itself: that decodes to a space. Rows that repeat are encoded
    alike, ties as said above; an empty table gives an empty result; columns other than doc_id and text are
    not looked at. A text of any length is encoded whole, in memory of its own size and that of its ids.
    """
    shared = _share(docs, model_path)

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            first, lists, same, size = 0, [], [], 0

            def out():
                sizes = np.array([len(x) for x in lists], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))
                return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(lists)), ids, pa.array(sizes), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

            for text in batch.column("text"):
                text = text.as_py() or ""
                ids = codec.encode(text)
                lists.append(ids)
                same.append(codec.returns(ids, text))
                size += len(ids)
                if size >= GIVEN:
                    yield out()
                    first, lists, same, size = first + len(lists), [], [], 0
            if lists:
                yield out()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids bigint, round_trip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none."""
    shared = _share(encoded, model_path)

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            texts = [codec.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
