"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The model file is read by its wire format. A text is escaped (a leading space, spaces become U+2581) and cut between characters that are neighbours in no
piece, as nothing merges across; that is before each word start, too, since no piece holds U+2581 after another character (checked on
loading). Each part is encoded by backtracking: at every position the longest piece
(found by an Aho-Corasick automaton over the vocabulary) is tried first; a piece may follow the one before it only if merging their joined text anew gives
exactly these two; a position from which no sequence led to the end is marked in a bitfield and never tried again.
A sequence whose adjacent pieces are all compatible is the one that merging by score gives. Characters outside the
vocabulary become byte pieces. Where pieces tie in score (runs of U+2581), a pair's re-merge decides alone no longer, so a part whose
merge meets tied scores is merged directly.

Defined results: null and empty texts give the end id only; decoding drops control ids, turns U+2581 into spaces, joins byte
pieces into UTF-8 (each invalid byte becomes U+FFFD) and drops the one leading space that encoding added; a very long text is encoded part by part; repeated
rows get equal results, a row each; an empty table gives an empty result; a column of any name beside the two that are read does no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import functions as F

from .common import arrow_function, keeps_cache

SPACE = "▁"
#: Parts kept for reuse by a worker, some 60 MB at most; a full cache starts anew, and other operators' tasks empty it.
CACHE_PARTS = 250_000
#: Parts up to this long are kept.
CACHE_CHARS = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and value (int or bytes)."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """Vocabulary, scores and types of a merge-type (BPE) model with identity normalisation and byte fallback."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix = True
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type model")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only identity normalisation that keeps white space and escapes it is supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (self.NORMAL, self.USER)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or self.USER in self.kinds:
            raise ValueError("a piece crosses a word start, or is user-defined: parts can't be encoded alone")
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.end = next((i for i, p in enumerate(self.pieces) if p == "</s>"), 2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == self.BYTE}
        seen: dict[float, int] = {}
        for i in self.ids.values():
            seen[self.scores[i]] = seen.get(self.scores[i], 0) + 1
        #: Pieces whose score is shared by another, longer than a character.
        self.tied = {p for p, i in self.ids.items() if len(p) > 1 and seen[self.scores[i]] > 1}
        self.ties_are_spaces = all(not p.strip(SPACE) for p in self.tied)
        self.digits = list(map(str, range(len(self.pieces))))
        #: Pieces as decoding shows them; bytes apart.
        self.shown = ["" if k == self.CONTROL else " ⁇ " if k == self.UNKNOWN else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds)]
        self.byte_ids = frozenset(self.bytes.values())
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        #: Neighbouring characters inside any piece, as sorted pairs of code points, the last one beyond all. Between two others nothing ever merges.
        self.neighbours = np.array([*sorted({ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:])}), 2**64 - 1], dtype=np.uint64)
        self.automaton = ahocorasick.Automaton()
        # A piece that merging can't reach is no candidate.
        reachable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        for p in reachable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        #: For each piece the longest other that it begins with, or -1.
        self.shorter = [-1] * len(self.pieces)
        for p in reachable:
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), -1)
        self.lengths = list(map(len, self.pieces))
        self._pairs: dict[int, bool] = {}
        #: A part's ids as decimal digits; with the decoded text where that isn't the part with spaces shown.
        self._cache: dict[str, str | tuple[str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges adjacent symbols, the best score first and the leftmost of equals, until none joins into a piece."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        ids, scores = self.ids, self.scores
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            if (i := ids.get(joined)) is not None:
                heapq.heappush(heap, (-scores[i], a, b, joined))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != len(joined):
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' joined text anew gives exactly them."""
        x, y = self.pieces[a], self.pieces[b]
        if len(self._pairs) >= CACHE_PARTS:
            self._pairs.clear()
        got = self._pairs[a << 20 | b] = self.merge(x + y) == [x, y]
        return got

    def backtrack(self, text: str) -> list[int]:
        """The sequence of pieces of which all neighbours are compatible, for a text of characters that all are pieces."""
        n = len(text)
        lengths, best = [0] * n, [-1] * n  # of the longest piece that starts at each position
        for last, (length, i) in self.automaton.iter(text):
            first = last - length + 1
            if length > lengths[first]:
                lengths[first], best[first] = length, i
        failed = bytearray((n >> 3) + 1)  # bit i: from position i no sequence reaches the end
        pairs, shorter, size = self._pairs, self.shorter, self.lengths
        out: list[int] = []
        at, i, before = 0, best[0], -1
        while True:
            while i >= 0:
                stop = at + size[i]
                if not failed[stop >> 3] >> (stop & 7) & 1:
                    if before < 0:
                        break
                    fits = pairs.get(before << 20 | i)
                    if self.compatible(before, i) if fits is None else fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                if stop == n:
                    return out
                at, before, i = stop, i, best[stop]
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                return [self.ids[p] for p in self.merge(text)]  # not reached for a sound vocabulary
            last = out.pop()
            at -= size[last]
            before, i = out[-1] if out else -1, shorter[last]

    def _part(self, text: str) -> list[int]:
        """Ids of a text without inner cuts."""
        if not self.letters.issuperset(text):  # a character outside the vocabulary stands alone
            return [self.bytes[b] for b in text.encode("utf-8")] if self.bytes else [self.unknown]
        if (SPACE + SPACE in text) if self.ties_are_spaces else self.tied:
            return [self.ids[p] for p in self.merge(text)]
        return self.backtrack(text)

    def _entry(self, part: str) -> str | tuple[str, str]:
        """A part's ids as digits, joined by spaces, and where decoding them gives something else than the part with spaces shown, that too. Byte pieces never run on into the next part."""
        got = self._cache.get(part)
        if got is None:
            ids = self._part(part)
            digits, back = " ".join([self.digits[i] for i in ids]), self._decode(ids)
            got = digits if back == part.replace(SPACE, " ") else (digits, back)
            if len(part) <= CACHE_CHARS:
                if len(self._cache) >= CACHE_PARTS:
                    self._cache.clear()
                self._cache[part] = got
        return got

    def parts(self, text: str) -> list[str]:
        """The escaped text, cut wherever no piece holds both neighbours; so before each word start, too."""
        if not text:
            return []
        text = SPACE * self.prefix + text.replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        both = points[:-1] << np.uint64(32) | points[1:]
        at = np.searchsorted(self.neighbours, both)
        cuts = (np.flatnonzero(self.neighbours[at] != both) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def whole(self, text: str) -> tuple[str, str]:
        """The ids of a text as digits, without an end id, and the text that decoding them gives."""
        parts = self.parts(text)
        get, make = self._cache.get, self._entry
        found = [get(p) or make(p) for p in parts]
        if tuple in set(map(type, found)):
            plain = [(e, p.replace(SPACE, " ")) if isinstance(e, str) else e for e, p in zip(found, parts)]
            digits, back = " ".join([e[0] for e in plain]), "".join([e[1] for e in plain])
        else:
            digits, back = " ".join(found), "".join(parts).replace(SPACE, " ")
        return digits, back[1:] if self.prefix and back.startswith(" ") else back

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without an end id."""
        return list(map(int, self.whole(text or "")[0].split()))

    def decode(self, ids: list[int]) -> str:
        back = self._decode(ids)
        first = next((i for i in ids if self.kinds[i] != self.CONTROL), None)
        return back[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else back

    def _decode(self, ids) -> str:
        shown = self.shown
        if self.byte_ids.isdisjoint(ids):
            return "".join([shown[i] for i in ids])
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_ids:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(shown[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)


def _utf8(raw: bytearray) -> str:
    """Valid sequences become characters, each other byte U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def _forget() -> None:
    _models.clear()


keeps_cache(__name__, _forget)


def load(path: str) -> PieceModel:
    """The model of a path, built once a worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def encoder(path: str, keep: bool = False):
    """An Arrow function of a text column: n_tokens, ids_sha256, decoded_sha256 and, if ``keep``, ids."""
    import pyarrow as pa

    kind = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + ", ids: array<int>" * keep + ">"

    def one(m: PieceModel, text: str | None) -> tuple:
        digits, back = m.whole(text or "")
        digits = f"{digits} {m.end}" if digits else str(m.end)
        row = digits.count(" ") + 1, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()
        return (*row, list(map(int, digits.split(" ")))) if keep else row

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load(path)
        for texts in batches:
            rows = [one(m, t.as_py()) for t in texts]
            columns = list(zip(*rows)) or [()] * (3 + keep)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + keep]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return arrow_function(run, kind, __name__)


def encoded(docs, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False):
    """A row for each document: its id and what ``encoder`` gives. Nothing is shuffled."""
    return docs.select(F.col(id_col).alias("id"), encoder(path, keep)(text_col).alias("e")).select(F.col("id").alias(id_col), "e.*")
