"""Language-model scoring: a log-frequency Bloom filter of quantised n-gram counts, broadcast and probed.

Words and word pairs of the training documents are counted exactly, by 64-bit hashes. A pair's count c is quantised to level 1 + floor(log2 c), a word's by finer steps
(``WORD_STEPS``: every count up to 10, then by a tenth); the filter holds (n-gram, 1) ... (n-gram, level), so probing level after level until one is missing
gives the count back, never too low. Segments of the filter are built where the counts are summed: hash slices own their segments. The model's probability
of a word w after v is (min(c(v w), c(v)) + MU * p(w)) / (c(v) + MU) with p(w) = (c(w) + 1) / (N + V + 1), all counts from probes. The ``COMMON`` most
frequent words are probed once, before all texts, and workers keep their levels; all others are probed where they occur.

Sizes: the filter takes ``BITS_EACH`` bits an entry and holds every word and pair of the training documents at any size. Segments of pairs are gathered and broadcast
while they take at most ``PAIR_BITS`` bits in all; beyond, they stay in their slices, and the documents' pairs go to them by an exchange, but for the most frequent
pairs of each slice (``COMMON`` in all), whose levels are broadcast. The levels probed are the same either way. Segments of words are always broadcast; they grow with the distinct words.

The base score needs exact counts of all words: words outside the common table are looked up by an exchange of (word hash, document) lists with the
count table, slice by slice, and only sums by document come back, packed by slice of the document.

Defined results: null and empty texts have one token, the end; the first word follows the end token; without training documents
N and V are 0; repeated rows get equal results, a row each; ids that repeat with other texts are rows of their own; null ids count as the text "" for the split; ties can't arise;
an empty table gives an empty result; a text of any length is scored whole, and one longer than ``SLICE_BYTES`` needs some 60 times its size in its worker while it is; a column of any name
beside the two that are read does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast, materialize, slice_count, slices, tidied, tidy

MU = 500.0
COMMON = 1 << 17
BITS_EACH, PROBES = 10, 3
#: Up to so many bits the segments of pairs are broadcast; more are probed where they are.
PAIR_BITS = 3 << 28
LEVELS = 40
#: Tokens that a worker counts before it passes the sums on.
FLUSH_TOKENS = 1_000_000
#: Distinct (word, document) that a worker gathers for the exchange before it passes them on.
FLUSH_WORDS = 500_000
#: Pairs that a worker gathers for the exchange before it passes them on.
FLUSH_PAIRS = 1_000_000
#: Bytes of text taken at a time.
SLICE_BYTES = 2 << 20
KEY_BITS = 40
END = b"\xff\xfeend"  # no word: words are valid UTF-8


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


END_HASH = np.uint64(xxhash.xxh64_intdigest(END))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of an Arrow string array without nulls, an end after each text's words, and the tokens of each text."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast("large_binary" if coded.dictionary.type == "large_string" else "binary").to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    real = np.fromiter(map(bool, words), dtype=bool, count=len(words))  # splitting leaves empty strings at the ends
    index = coded.indices.to_numpy(zero_copy_only=False)
    listed = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(listed)), listed)
    keep = real[index] if len(words) else np.zeros(0, dtype=bool)
    index, text = index[keep], text[keep]
    counts = np.bincount(text, minlength=len(listed)).astype(np.int64) + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = hashes[index] if len(words) else 0
    out[ends] = END_HASH
    return out, counts


def pairs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (the end token before a text's first), and the hash of both."""
    before = np.concatenate([[END_HASH], hashes[:-1]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return before, mix(before * np.uint64(0x2545F4914F6CDD1D) + hashes, 1)


def slice_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The slice that owns a hash, from its upper 24 bits."""
    return ((hashes >> np.uint64(KEY_BITS)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pack(counts: dict[int, list], parts: int) -> Iterator:
    """Rows kind, slice, hashes, counts of what was counted; hashes sorted."""
    import pyarrow as pa

    for kind, held in counts.items():
        if not held:
            continue
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        own = slice_of(keys, parts)
        cuts = np.searchsorted(own, np.arange(parts + 1))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            k = keys[a:b]
            if kind == 2:  # pairs only feed the filter: 40 bits within a slice tell them apart well enough
                raw = k.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            else:
                raw = k.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([p], pa.int32()), pa.array([raw], pa.binary()), pa.array([n[a:b].astype(np.uint32).tobytes()], pa.binary())], names=["kind", "slice", "keys", "n"])


def count_ngrams(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """Partial counts of words (kind 1) and pairs (kind 2) by slice, a row for each batch of a worker and slice."""

    def run(batches):
        held: dict[int, list] = {1: [], 2: []}
        n = 0
        for batch in batches:
            for part in slices(batch.column(0), SLICE_BYTES):
                hashes, counts = tokens(part)
                held[1].append(hashes)
                held[2].append(pairs(hashes, counts)[1])
                n += len(hashes)
                if n >= FLUSH_TOKENS:
                    yield from _pack(held, parts)
                    n = 0
        yield from _pack(held, parts)

    return docs.select(text_col).mapInArrow(tidied(run), "kind int, slice int, keys binary, n binary")


def _keys(raw: bytes, kind: int) -> np.ndarray:
    if kind == 1:
        return np.frombuffer(raw, dtype=np.uint64)
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _summed(table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and summed counts of the partial counts in an Arrow table."""
    keys = [_keys(x.as_py(), kind) for x in table.column("keys")]
    n = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("n")]
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, weights=np.concatenate(n), minlength=len(found)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


#: The count that a level stands for: the mean logarithm of the counts that it has.
COUNTS = np.array([0.0, 1.0] + [float(np.sqrt(2.0 ** (k - 1) * (2.0**k - 1))) for k in range(2, LEVELS + 1)])


def word_steps(most: int = 1 << 44) -> np.ndarray:
    """The counts at which a word's level rises: each up to 10, then a tenth more each time."""
    steps = [1]
    while steps[-1] < most:
        steps.append(max(steps[-1] + 1, steps[-1] * 11 // 10))
    return np.array(steps, dtype=np.int64)


WORD_STEPS = word_steps()


def word_level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(WORD_STEPS, counts, side="right").astype(np.int64)


#: The count that a word's level stands for: the mean logarithm of the first and last count that it has.
WORD_COUNTS = np.concatenate([[0.0], np.sqrt(WORD_STEPS[:-1].astype(np.float64) * (WORD_STEPS[1:] - 1)), [float(WORD_STEPS[-1])]])


def positions(keys: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits that stand for (n-gram, level) in segments of so many bits; keys are the low 40 bits of hashes."""
    h = mix(keys, 100 + level)
    step = (h >> np.uint64(32)) | np.uint64(1)
    size = np.asarray(bits, dtype=np.uint64)
    for _ in range(PROBES):
        yield (((h & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64)
        with np.errstate(over="ignore"):
            h = h + step


def build_segment(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None, quantised=level_of) -> tuple[bytes, int]:
    """A slice's segment, and the least count in it: 1 unless ``most_bits`` bounds the segment, which scoring never asks for."""
    levels = quantised(counts)
    floor, room = 1, max(64, most_bits // BITS_EACH) if most_bits else np.inf
    while levels[counts >= floor].sum() > room:
        floor *= 2
    keys, levels = keys[counts >= floor] & np.uint64((1 << KEY_BITS) - 1), levels[counts >= floor]
    bits = max(64, -(-int(levels.sum()) * BITS_EACH // 8) * 8)
    out = np.zeros(bits, dtype=np.uint8)
    order = np.argsort(-levels, kind="stable")
    keys, upto = keys[order], np.cumsum(np.bincount(levels, minlength=1)[::-1])[::-1]  # upto[k]: keys of level k or more
    for level in range(1, len(upto)):
        for at in positions(keys[: upto[level]], level, bits):
            out[at] = 1
    return np.packbits(out).tobytes(), floor


class Filter:
    """Segments side by side."""

    def __init__(self, segments: list[bytes]):
        self.sizes = np.array([8 * len(s) for s in segments], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probes of one level after the other; ``LEVELS`` bounds those of pairs, the steps those of words."""
        out = np.zeros(len(hashes), dtype=np.int64)
        own = slice_of(hashes, len(self.sizes))
        keys = hashes & np.uint64((1 << KEY_BITS) - 1)
        open_ = np.flatnonzero(self.sizes[own] > 0)
        for level in range(1, len(WORD_STEPS) + 1):
            for_now = keys[open_], self.sizes[own[open_]], self.starts[own[open_]]
            there = np.ones(len(open_), dtype=bool)
            for at in positions(for_now[0], level, for_now[1]):
                at = at + for_now[2]
                there &= (self.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            open_ = open_[there]
            out[open_] = level
            if not len(open_):
                break
        return out


def probe(segment: bytes, keys: np.ndarray) -> np.ndarray:
    """The levels of one slice's n-grams, by the low 40 bits of their hashes."""
    return Filter([segment]).levels(keys)


class Model:
    """pairs_ is None where the pairs' segments are too large to broadcast; top and top_levels are then the most frequent pairs (``pair_codes``) with their levels."""

    def __init__(self, words: Filter, pairs_: Filter | None, common: np.ndarray, common_counts: np.ndarray, total: int, distinct: int, top: np.ndarray, top_levels: np.ndarray, parts: int):
        self.words, self.pairs, self.common, self.common_counts = words, pairs_, common, common_counts
        self.total, self.distinct = total, distinct
        self.norm = float(total + distinct + 1)
        self.top, self.top_levels, self.parts = top, top_levels, parts
        #: The common words' levels, by probes like any other's.
        self.common_levels = words.levels(common).astype(np.int32)

    def common_of(self, hashes: np.ndarray) -> np.ndarray:
        """Where common words are in the table, -1 for others."""
        if not len(self.common):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, at, -1)

    def codes(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each word's level; place: common_of(hashes)."""
        out = self.common_levels[place].astype(np.int64) if len(self.common) else np.zeros(len(hashes), dtype=np.int64)
        rare = np.flatnonzero(place < 0)
        distinct, back = np.unique(hashes[rare], return_inverse=True)
        out[rare] = self.words.levels(distinct)[back]
        return out

    def terms(self, levels: np.ndarray, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each token from its pair's level and those of both words."""
        history, c = WORD_COUNTS[history], WORD_COUNTS[word]
        return np.log10((np.minimum(COUNTS[levels], history) + MU * (c + 1) / self.norm) / (history + MU))

    def read(self, hashes: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's level, its predecessor's, the hash of both, and the pair's level, -1 where only its slice knows it."""
        word = self.codes(hashes, place)
        _, both = pairs(hashes, counts)
        starts = np.cumsum(counts) - counts
        history = np.concatenate([[0], word[:-1]]).astype(np.int64)
        end = np.array([END_HASH], dtype=np.uint64)
        history[starts] = self.codes(end, self.common_of(end))[0]
        both[starts] = pairs_after_end(hashes[starts])
        if self.pairs is not None:
            return word, history, both, self.pairs.levels(both)
        level = np.full(len(both), -1, dtype=np.int64)
        if len(self.top):
            own = pair_codes(both, self.parts)
            at = np.minimum(np.searchsorted(self.top, own), len(self.top) - 1)
            level = np.where(self.top[at] == own, self.top_levels[at], -1)
        return word, history, both, level

    def scores(self, hashes: np.ndarray, counts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each text, without the tokens whose pairs only their slices know; place: common_of(hashes)."""
        word, history, _, level = self.read(hashes, counts, place)
        p = np.where(level >= 0, self.terms(np.maximum(level, 0), history, word), 0.0)
        return np.add.reduceat(p, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def pair_codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """What a slice tells pairs apart by: the slice and the low 40 bits."""
    return slice_of(hashes, parts).astype(np.uint64) << np.uint64(KEY_BITS) | hashes & np.uint64((1 << KEY_BITS) - 1)


def pairs_after_end(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(END_HASH * np.uint64(0x2545F4914F6CDD1D) + hashes, 1)


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame, DataFrame, int]:
    """Model of the texts, the table of all words' counts (slice, keys, n), that of the pairs' segments (slice, segment) and the number of slices."""
    import pyarrow as pa

    spark = docs.sparkSession
    parts = slice_count(docs, text_col)
    partial = count_ngrams(docs, text_col, parts)
    most = COMMON // parts + 1

    def reduce_(key, table):
        tidy()  # what the slice before took
        kind, p = key[0].as_py(), key[1].as_py()
        keys, n = _summed(table, kind)
        segment, _ = build_segment(keys, n, quantised=word_level_of if kind == 1 else level_of)
        # counts of counts, by power of two: they tell where the common words begin
        histogram = np.bincount(level_of(n), weights=n > 0, minlength=LEVELS + 1).astype(np.int64) if len(n) else np.zeros(LEVELS + 1, dtype=np.int64)
        if kind == 2 and len(n):  # of pairs only the most frequent, with the levels that the segment gives
            keys = np.sort(keys[np.argpartition(n, -most)[-most:]] if len(n) > most else keys)
            raw = ((np.uint64(p) << np.uint64(KEY_BITS) | keys).tobytes(), probe(segment, keys).tobytes())
        else:
            raw = (keys.tobytes(), n.tobytes())
        return pa.table({"kind": pa.array([kind], pa.int32()), "slice": pa.array([p], pa.int32()), "segment": pa.array([segment], pa.binary()), "total": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([len(n)], pa.int64()), "histogram": pa.array([histogram.tolist()], pa.list_(pa.int64())), "keys": pa.array([raw[0]], pa.binary()), "n": pa.array([raw[1]], pa.binary())})

    schema = "kind int, slice int, segment binary, total long, distinct long, histogram array<long>, keys binary, n binary"
    reduced = materialize(partial.groupBy("kind", "slice").applyInArrow(reduce_, schema))
    sums = reduced.where("kind = 1").agg(F.sum("total"), F.sum("distinct")).first()
    histogram = np.zeros(LEVELS + 1, dtype=np.int64)
    segments: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
    pair_bytes = reduced.where("kind = 2").agg(F.sum(F.length("segment"))).first()[0] or 0
    whole = 8 * pair_bytes <= PAIR_BITS
    for r in reduced.where(F.lit(True) if whole else F.col("kind") == 1).select("kind", "slice", "segment", "histogram").toLocalIterator():  # a row a slice
        segments[r["kind"]][r["slice"]] = bytes(r["segment"])
        if r["kind"] == 1:
            histogram += np.array(r["histogram"])
    # the lowest level from which on all words fit the common table
    above = np.cumsum(histogram[::-1])[::-1]
    level = next((k for k in range(1, LEVELS + 1) if above[k] <= COMMON), LEVELS)
    least = 1 << (level - 1)

    def common(batches):
        for batch in batches:
            for k, n in zip(batch.column(0), batch.column(1)):
                keys, n = np.frombuffer(k.as_py(), dtype=np.uint64), np.frombuffer(n.as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([keys[n >= least].tobytes()], pa.binary()), pa.array([n[n >= least].tobytes()], pa.binary())], names=["keys", "n"])

    words = reduced.where("kind = 1").select("slice", "keys", "n")

    def sorted_table(rows: list) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([np.frombuffer(r[c], dtype=t) for r in rows] or [np.zeros(0, dtype=t)]) for c, t in (("keys", np.uint64), ("n", np.int64)))
        order = np.argsort(keys)
        return keys[order], n[order]

    frequent = sorted_table(words.select("keys", "n").mapInArrow(common, "keys binary, n binary").collect())  # at most COMMON words
    top = sorted_table([] if whole else reduced.where("kind = 2").select("keys", "n").collect())  # COMMON pairs and one a slice at most
    known, joint = (Filter([segments[kind].get(p, b"") for p in range(parts)]) if kind == 1 or whole else None for kind in (1, 2))
    return Model(known, joint, *frequent, int(sums[0] or 0), int(sums[1] or 0), *top, parts), words, reduced.where("kind = 2").select("slice", "segment"), parts


def least_type(x: np.ndarray) -> np.ndarray:
    """x in 2 bytes each, or 4 where those don't do."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)


def of_width(raw: bytes, n: int) -> np.ndarray:
    """What least_type made n numbers of."""
    return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32)


def by_document(ids: np.ndarray, parts: int, **sums: np.ndarray):
    """Rows of sums for documents (i, h), packed by slice of the document."""
    import pyarrow as pa

    own = document_slice(ids[:, 0], ids[:, 1], parts)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(parts + 1))
    some = [(p, m) for p in range(parts) if len(m := order[cuts[p] : cuts[p + 1]])]
    columns = {"slice": pa.array([p for p, _ in some], pa.int32()), "docs": pa.array([ids[m].tobytes() for _, m in some], pa.binary())}
    return pa.table(columns | {c: pa.array([sums[c][m].tobytes() if c in sums else None for _, m in some], pa.binary()) for c in ("base", "known", "score")})


SUMS = "slice int, docs binary, base binary, known binary, score binary"


def pair_sums(doc: DataFrame, held, segments: DataFrame, parts: int) -> DataFrame:
    """What the pairs that only their slices know add to the scores of documents (text, i, h), packed by slice of the document."""
    import pyarrow as pa

    names = ["slice", "docs", "at", "keys", "history", "word"]

    def pack(asked: list, ids: list) -> Iterator[pa.RecordBatch]:
        text, both, history, word = (np.concatenate([x[k] for x in asked]) for k in range(4))
        ids_ = np.concatenate(ids)
        asked.clear()
        ids.clear()
        own = slice_of(both, parts)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(parts + 1))
        for p in range(parts):
            m = order[cuts[p] : cuts[p + 1]]
            if len(m):
                used, at = np.unique(text[m], return_inverse=True)
                raw = both[m].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                blobs = [ids_[used].tobytes(), least_type(at).tobytes(), raw, least_type(history[m]).tobytes(), least_type(word[m]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def ask(batches):
        m = held.value
        asked, ids, n_docs, n_pairs = [], [], 0, 0
        for batch in batches:
            first = 0
            for part in slices(batch.column("text"), SLICE_BYTES):
                k = len(part)
                ids.append(np.stack([batch.column(c).slice(first, k).to_numpy(zero_copy_only=False) for c in ("i", "h")], axis=1))
                first += k
                hashes, counts = tokens(part)
                word, history, both, level = m.read(hashes, counts, m.common_of(hashes))
                open_ = np.flatnonzero(level < 0)
                text = np.repeat(np.arange(n_docs, n_docs + k), counts)[open_]
                asked.append((text, both[open_], history[open_].astype(np.uint32), word[open_].astype(np.uint32)))
                n_docs, n_pairs = n_docs + k, n_pairs + len(open_)
                if n_pairs >= FLUSH_PAIRS:
                    yield from pack(asked, ids)
                    n_docs = n_pairs = 0
        if asked:
            yield from pack(asked, ids)

    def answer(key, rows, table):
        tidy()
        segment = next((x.as_py() for x in table.column("segment")), b"")
        ids, adds = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0)]
        m = held.value
        for k in range(rows.num_rows):
            docs_, at, raw, history, word = (rows.column(c)[k].as_py() for c in names[1:])
            keys = _keys(raw, 2)
            at, history, word = (of_width(x, len(keys)) for x in (at, history, word))
            ids.append(np.frombuffer(docs_, dtype=np.int64).reshape(-1, 2))
            adds.append(np.bincount(at, weights=m.terms(probe(segment, keys), history, word), minlength=len(ids[-1])))
        return by_document(np.concatenate(ids), parts, score=np.concatenate(adds))

    asks = doc.select("text", "i", "h").mapInArrow(tidied(ask), "slice int, docs binary, at binary, keys binary, history binary, word binary")
    return asks.groupBy("slice").cogroup(segments.groupBy("slice")).applyInArrow(answer, SUMS)


def scored(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, n_tokens, n_known, train_tokens, base_score, score. The model learns from ``training``."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    spark = docs.sparkSession
    model, words, segments, parts = fit(training, text_col)
    held = broadcast(spark, model)
    unknown = float(-np.log10(model.norm))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    doc = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0).cast("long")).alias("i"))

    names = ["id", "i", "h", "n_tokens", "n_known", "base", "score", "slice", "docs", "at", "keys", "n"]

    def pack(asked: list, keys: list, empty: list) -> Iterator[pa.RecordBatch]:
        """Rows of the words to look up, with their documents and counts, by slice of the word."""
        word, text, times = (np.concatenate([x[k] for x in asked]) for k in range(3))
        both = np.concatenate(keys)
        asked.clear()
        keys.clear()
        order = np.argsort(word)
        word, text, times = word[order], text[order], times[order]
        cuts = np.searchsorted(slice_of(word, parts), np.arange(parts + 1))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                used, at = np.unique(text[a:b], return_inverse=True)
                blobs = [both[used].tobytes(), at.astype(np.uint32).tobytes(), word[a:b].tobytes(), times[a:b].tobytes()]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def run(batches):
        m = held.value
        logs = np.append(np.log10(m.common_counts + 1.0), 0.0)  # of the exact counts, for the base score
        asked, keys, n_docs, n_words, empty = [], [], 0, 0, []
        for batch in batches:
            first = 0
            for part in slices(batch.column("text"), SLICE_BYTES):
                k = len(part)
                ids, i, h = (batch.column(c).slice(first, k) for c in ("id", "i", "h"))
                first += k
                empty = [pa.nulls(1, ids.type), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                hashes, counts = tokens(part)
                place = m.common_of(hashes)
                starts = np.cumsum(counts) - counts
                known = place >= 0
                base = np.add.reduceat(np.where(known, logs[place], 0.0), starts)
                score = m.scores(hashes, counts, place)
                none = pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([ids, i, h, pa.array(counts), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(base), pa.array(score), pa.nulls(k, pa.int32()), none, none, none, none], names=names)
                # the other words: distinct (word, document) with counts
                rare = np.flatnonzero(~known)
                text = np.repeat(np.arange(k, dtype=np.int64), counts)[rare]
                order = np.lexsort((text, hashes[rare]))
                word, text = hashes[rare][order], text[order]
                new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))) if len(word) else np.zeros(0, dtype=np.int64)
                asked.append((word[new], text[new] + n_docs, np.diff(np.append(new, len(word))).astype(np.uint32)))
                keys.append(np.stack([i.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)], axis=1))
                n_docs, n_words = n_docs + k, n_words + len(new)
                if n_words >= FLUSH_WORDS:
                    yield from pack(asked, keys, empty)
                    n_docs = n_words = 0
        if asked:
            yield from pack(asked, keys, empty)

    schema = f"id {id_type}, i long, h long, n_tokens long, n_known long, base double, score double, slice int, docs binary, at binary, keys binary, n binary"
    passed = materialize(doc.select("id", "text", "i", "h").mapInArrow(tidied(run), schema))
    asked = passed.where("slice is not null").select("slice", "docs", "at", "keys", "n")

    def look_up(key, rows, table):
        """What each document's words of one slice add, packed by slice of the document."""
        tidy()
        keys, n = (np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in table.column(c)] or [np.zeros(0, dtype=t)]) for c, t in (("keys", np.uint64), ("n", np.int64)))
        ids, adds, knows = [], [], []
        for k in range(rows.num_rows):
            docs_, at, asked_, times = (np.frombuffer(rows.column(c)[k].as_py(), dtype=t) for c, t in (("docs", np.int64), ("at", np.uint32), ("keys", np.uint64), ("n", np.uint32)))
            docs_ = docs_.reshape(-1, 2)
            c = np.zeros(len(asked_), dtype=np.int64)
            if len(keys):
                where = np.minimum(np.searchsorted(keys, asked_), len(keys) - 1)
                c = np.where(keys[where] == asked_, n[where], 0)
            ids.append(docs_)
            adds.append(np.bincount(at, weights=np.log10(c + 1.0) * times, minlength=len(docs_)))
            knows.append(np.bincount(at, weights=(c > 0) * times, minlength=len(docs_)).astype(np.int64))
        if not ids:
            ids, adds, knows = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        return by_document(np.concatenate(ids), parts, base=np.concatenate(adds), known=np.concatenate(knows))

    found = asked.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(look_up, SUMS)
    if model.pairs is None:
        found = found.unionAll(pair_sums(doc, held, segments, parts))
    direct = passed.where("slice is null").select("id", "i", "h", "n_tokens", "n_known", "base", "score")

    def own_slice(i: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(document_slice(i.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False), parts), type=pa.int32())

    own_slice.__annotations__ = {"i": pa.Array, "h": pa.Array, "return": pa.Array}
    total = model.total

    def add_up(rows, adds):
        tidy()
        own = np.stack([rows.column(c).to_numpy() for c in ("i", "h")], axis=1).reshape(-1, 2)
        ids = [np.frombuffer(x.as_py(), dtype=np.int64).reshape(-1, 2) for x in adds.column("docs")]
        found, back = np.unique(np.concatenate([own, *ids]), axis=0, return_inverse=True)
        back = back.reshape(-1)
        mine, theirs = back[: len(own)], back[len(own) :]
        times = np.maximum(np.bincount(mine, minlength=len(found)), 1)  # equal rows asked as often; each gets its share
        blobs = lambda c, t: [np.frombuffer(x.as_py(), dtype=t) if x.is_valid else np.zeros(len(i), dtype=t) for x, i in zip(adds.column(c), ids)]
        base, known, score = (np.bincount(theirs, weights=np.concatenate(blobs(c, t) or [np.zeros(0)]), minlength=len(found)) / times for c, t in (("base", np.float64), ("known", np.int64), ("score", np.float64)))
        n = rows.column("n_tokens").to_numpy()
        return pa.table({
            "id": rows.column("id"), "n_tokens": pa.array(n), "n_known": pa.array(rows.column("n_known").to_numpy() + np.rint(known[mine]).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n), total, dtype=np.int64)), "base_score": pa.array(rows.column("base").to_numpy() + base[mine] + n * unknown), "score": pa.array(rows.column("score").to_numpy() + score[mine]),
        })

    direct = direct.withColumn("slice", arrow_udf("int")(own_slice)("i", "h"))
    out = direct.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(add_up, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def document_slice(ids: np.ndarray, hs: np.ndarray, parts: int) -> np.ndarray:
    """The slice of a document, from the hashes of its id and text."""
    with np.errstate(over="ignore"):
        return slice_of(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hs.astype(np.uint64), 5), parts)


def score_report(docs: DataFrame) -> DataFrame:
    training = docs.where(~held_out(F.col("doc_id")))
    s = scored(docs.select("doc_id", "text"), training)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
