"""Suffix-array dedup: removes bytes covered by a string of ``LEAST`` bytes that also starts in a document of smaller id.

1. Every window of LEAST bytes is named by the least hash of the ``GRAM``-byte strings in it: equal windows, equal names. Runs of
   neighbouring windows of one name are the unit of exchange. Names that occur in two rows or more are found by an exchange of names, and
   go into a bit filter of at most ``MAX_BITS`` bits (false positives only add work).
2. The texts of runs whose name is in the filter are sent to the name's slice, equal texts of a worker's batch once, with the places they occur at.
3. In a slice the distinct texts are joined, a suffix array and its Burrows-Wheeler transform are made, and intervals are expanded breadth-first by backward
   extension: level l finds the places where neighbouring suffixes share exactly l characters, and the search stops before level LEAST. What is left
   unmarked shares LEAST characters or more: these groups hold all equal windows, each group's least document id decides.
4. The removed spans go to the slices of their documents and are applied to the texts.

So no group of copies meets as pairs or whole texts: a hot passage is a few texts in its slices, with 12 bytes for each place.

Defined results: null and empty texts have no bytes; texts shorter than LEAST lose none; rows of one id never remove each other's bytes, and repeated
rows get equal results; a null id counts as the largest; ties can't arise: equal ids are one; an empty table gives an empty result; columns of any name pass through; a text of any length
is searched whole, and one longer than ``SLICE_BYTES`` needs some 60 times its size in its worker while it is. As a string, what is left of a text drops the remains of characters that were cut apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast, field, quoted, slice_count, slices, tidied
from .scoring import document_slice, mix, slice_of

LEAST, GRAM = 50, 16
#: Windows of a run at most; longer runs, as of one repeated character, are cut.
RUN_WINDOWS = 192
BITS_EACH, PROBES, MAX_BITS = 12, 2, 1 << 30
#: Bytes of text whose runs a worker gathers before it passes them on.
FLUSH_BYTES = 48 << 20
SLICE_BYTES = 1 << 20
#: Characters that one suffix array is made over, about: a slice is cut by name into so many parts that each stays near it.
ARRAY_SYMBOLS = 150_000
NAME_BITS = 40

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _STEPS[7]
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from those of half the length."""
    with np.errstate(over="ignore"):
        doubled, length, level = _BYTE[raw], 1, 0
        out, done = None, 0
        while True:
            if size & length:  # this power of two is a part of the whole
                if out is None:
                    out, done = doubled, length
                else:
                    n = min(len(out), len(doubled) - done)
                    out = out[:n] * _STEPS[6] + doubled[done : done + n]
                    done += length
            if length * 2 > size:
                break
            doubled = doubled[: len(doubled) - length] * _STEPS[level] + doubled[length:]
            length, level = 2 * length, level + 1
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(32))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def window_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one name inside each text: names, texts' numbers, first bytes (in raw) and numbers of windows. ends: where the texts end in raw."""
    if len(raw) < LEAST:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    names = least_of(gram_hashes(raw), LEAST - GRAM + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    inside = text[: len(names)] == text[LEAST - 1 :]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    # a run stops where the next one starts or the windows leave the text
    stop = np.flatnonzero(new | ~inside)
    after = np.append(stop, len(names))[np.searchsorted(stop, starts, side="right")]
    count = after - starts
    if len(count) and count.max() > RUN_WINDOWS:
        pieces = -(-count // RUN_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, count = np.repeat(starts, pieces) + nth * RUN_WINDOWS, np.minimum(RUN_WINDOWS, np.repeat(count, pieces) - nth * RUN_WINDOWS)
    return names[starts], text[starts], starts, count


def sub_slice(keys: np.ndarray) -> np.ndarray:
    """16 further bits of a name's key: they cut a slice into parts that share no name."""
    return (keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.uint16)


def name_key(names: np.ndarray) -> np.ndarray:
    return mix(names, 7)


def raw_of(part) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array without nulls, side by side, and where each text ends."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = part.type in ("large_string", "large_binary")
    offsets = np.frombuffer(part.buffers()[1], dtype=np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if part.buffers()[2] is not None and len(part) else np.zeros(0, dtype=np.uint8)
    return data, np.cumsum(lengths)


def repeated_names(docs: DataFrame, text_col: str, parts: int) -> list[bytes]:
    """Filter segments, by slice, of the names that occur in two rows or more; at most MAX_BITS in all."""
    import pyarrow as pa

    def pack(held: list) -> Iterator:
        once, more = [], []
        keys = np.sort(np.concatenate(held))  # a name once for each row
        held.clear()
        new = np.append(True, keys[1:] != keys[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(keys)))
        keys = keys[starts]
        own = slice_of(keys, parts)
        cuts = np.searchsorted(own, np.arange(parts + 1))
        for p in range(parts):
            k, t = keys[cuts[p] : cuts[p + 1]], times[cuts[p] : cuts[p + 1]]
            low = [k[mask].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for mask in (t == 1, t > 1)]
            once.append(low[0])
            more.append(low[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch.column(0), SLICE_BYTES):
                raw, ends = raw_of(part)
                names, text, _, _ = window_runs(raw, ends)
                if not len(names):
                    continue
                key = name_key(names)
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                held.append(key[np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))])
                n += len(raw)
                if n >= FLUSH_BYTES:
                    yield from pack(held)
                    n = 0
        if held:
            yield from pack(held)

    def keys_of(column) -> np.ndarray:
        raw = np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(-1, 5)
        out = np.zeros((len(raw), 8), dtype=np.uint8)
        out[:, :5] = raw
        return out.view(np.uint64).reshape(-1)

    def reduce_(key, table):
        once = np.sort(keys_of(table.column("once")))
        again = once[1:][once[1:] == once[:-1]]
        more = keys_of(table.column("more"))
        both = np.unique(np.concatenate([again, more]))
        bits = min(MAX_BITS // parts, max(64, -(-len(both) * BITS_EACH // 8) * 8)) // 8 * 8
        out = np.zeros(bits, dtype=np.uint8)
        for at in places(both, bits):
            out[at] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(out).tobytes() if len(both) else b""], pa.binary())})

    found = docs.select(text_col).mapInArrow(tidied(run), "slice int, once binary, more binary").groupBy("slice").applyInArrow(reduce_, "slice int, bits binary")
    by = {r["slice"]: bytes(r["bits"]) for r in found.toLocalIterator()}
    return [by.get(p, b"") for p in range(parts)]


def places(keys: np.ndarray, bits) -> Iterator[np.ndarray]:
    h = mix(keys & np.uint64((1 << NAME_BITS) - 1), 9)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((h & np.uint64(0xFFFFFFFF)) * np.asarray(bits, dtype=np.uint64) >> np.uint64(32)).astype(np.int64)
        with np.errstate(over="ignore"):
            h = h + step


class NameFilter:
    def __init__(self, segments: list[bytes]):
        self.sizes = np.array([8 * len(s) for s in segments], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        own = slice_of(keys, len(self.sizes))
        there = self.sizes[own] > 0
        some = np.flatnonzero(there)
        for at in places(keys[some], self.sizes[own[some]]):
            at = at + self.starts[own[some]]
            there[some] &= (self.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return there


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of stretches of raw, side by side."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return raw[at]


#: Bytes of texts compared at a time.
COMPARE_BYTES = 1 << 20


def differing(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """Which texts (stretches of raw) differ from their twin, another of them: equal hashes are held against bytes."""
    out = lengths != lengths[twins]
    some = np.flatnonzero((twins != np.arange(len(twins))) & ~out & (lengths > 0))
    ends = np.cumsum(lengths[some])
    first = 0
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARE_BYTES, side="right")))
        own = some[first:last]
        unequal = gather(raw, starts[own], lengths[own]) != gather(raw, starts[twins[own]], lengths[own])
        out[own] = np.logical_or.reduceat(unequal, np.cumsum(lengths[own]) - lengths[own])
        first = last
    return out


def candidate_runs(docs: DataFrame, filter_segments: list[bytes], parts: int) -> DataFrame:
    """Runs whose name is in the filter, by slice. docs: id (long), h (long), text."""
    import pyarrow as pa

    held_filter = broadcast(docs.sparkSession, NameFilter(filter_segments))
    powers = {}

    def prefix_sums(raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if powers.get("n", 0) < n:
            with np.errstate(over="ignore"):
                powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
                powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            powers["n"] = n
        with np.errstate(over="ignore"):
            return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * powers["up"][:n])])

    def pack(held: list, rows: list) -> Iterator:
        """Distinct texts with their hashes, and where they occur."""
        key, hashes, doc, offset, count, start = (np.concatenate([x[i] for x in held]) for i in range(6))
        raw = np.concatenate([x[6] for x in held])
        held.clear()
        ids = np.array(rows, dtype=np.int64).reshape(-1, 2)
        rows.clear()
        own = slice_of(key, parts)
        order = np.lexsort((hashes, key))  # by slice, and texts of a name side by side
        cuts = np.searchsorted(own[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if not len(mine):
                continue
            h = hashes[mine]
            new = np.append(True, h[1:] != h[:-1])
            group = np.cumsum(new) - 1
            odd = differing(raw, start[mine], count[mine] + LEAST - 1, np.flatnonzero(new)[group])
            if odd.any():  # texts of one hash that aren't equal: none of them is merged
                new |= np.isin(group, group[odd])
            first, nth = np.flatnonzero(new), np.cumsum(new) - 1
            lead = mine[first]
            used, which = np.unique(doc[mine], return_inverse=True)
            texts = gather(raw, start[lead], count[lead] + LEAST - 1)
            blobs = [zstandard.compress(texts.tobytes(), 1), sub_slice(key[lead]).tobytes(), count[lead].astype(np.uint16).tobytes(), h[first].tobytes(), ids[used].tobytes(), nth.astype(np.uint32).tobytes(), which.astype(np.uint32).tobytes(), offset[mine].astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["slice", "texts", "subs", "counts", "hashes", "docs", "nth", "which", "offsets"])

    def run(batches):
        seen = held_filter.value
        held, rows, n, taken = [], [], 0, 0
        for batch in batches:
            texts, at = batch.column(2), 0
            for part in slices(texts, SLICE_BYTES):
                ids = np.stack([batch.column(c).slice(at, len(part)).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
                at += len(part)
                raw, ends = raw_of(part)
                names, text, starts, count = window_runs(raw, ends)
                if not len(names):
                    continue
                key = name_key(names)
                some = seen.holds(key)
                key, text, starts, count = key[some], text[some], starts[some], count[some]
                if len(key):
                    sums = prefix_sums(raw)
                    with np.errstate(over="ignore"):
                        hashes = mix((sums[starts + count + LEAST - 1] - sums[starts]) * powers["down"][starts] + count.astype(np.uint64), 3)
                    lengths = count + LEAST - 1
                    own = gather(raw, starts, lengths)
                    begins = np.append(0, ends[:-1])
                    held.append((key, hashes, text + len(rows), starts - begins[text], count, np.cumsum(lengths) - lengths + taken, own))
                    taken += len(own)
                rows.extend(ids.tolist())
                n += len(raw)
                if n >= FLUSH_BYTES:
                    if held:
                        yield from pack(held, rows)
                    rows.clear()
                    n = taken = 0
        if held:
            yield from pack(held, rows)

    return docs.select("id", "h", "text").mapInArrow(tidied(run), "slice int, texts binary, subs binary, counts binary, hashes binary, docs binary, nth binary, which binary, offsets binary")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic suffixes ordered by their first ``depth`` symbols at least; symbols below 512. Prefixes double: 7, 14, 28, 56 ..."""
    n = len(symbols)
    wide = np.concatenate([symbols, np.resize(symbols, 6)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | wide[j : j + n]
    have = 7
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])).astype(np.uint64)
        if int(rank[order[-1]]) == n - 1:
            return order
        key = rank << np.uint64(32) | np.roll(rank, -(have % n))
        have *= 2


def expand_intervals(suffixes: np.ndarray, symbols: np.ndarray, least: int) -> np.ndarray:
    """For each place j in the suffix array whether suffixes j - 1 and j share fewer than ``least`` symbols.

    Level l holds the intervals of strings w of l symbols whose right end was marked last; the intervals of the strings cw are their images
    under backward extension. A right end that isn't marked yet shares exactly l symbols with what stands before it; its interval goes on.
    """
    n = len(suffixes)
    short = np.zeros(n + 1, dtype=bool)
    short[0] = short[n] = True
    transform = symbols[suffixes - 1]  # Burrows-Wheeler; index -1 is cyclic
    back = np.argsort(transform, kind="stable")
    image = np.empty(n, dtype=np.int32)
    image[back] = np.arange(n, dtype=np.int32)
    first = transform[back]
    change = np.append(True, first[1:] != first[:-1])  # where the first symbol changes
    lows, highs = np.array([0], dtype=np.int64), np.array([n], dtype=np.int64)
    owner = None
    for level in range(least):
        size = highs - lows
        total = int(size.sum())
        if not total:
            break
        members = np.repeat(lows - (np.cumsum(size) - size), size)
        members += np.arange(total)
        to = image[members]
        ids = np.repeat(np.arange(len(lows), dtype=np.int32), size)
        if total > n // 8:
            if owner is None:
                owner = np.empty(n, dtype=np.int32)
            owner.fill(-1)
            owner[to] = ids
            at = np.flatnonzero(owner >= 0)
            ids = owner[at]
        else:
            order = np.argsort(to)
            at, ids = to[order].astype(np.int64), ids[order]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (ids[1:] != ids[:-1]) | change[at[1:]])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(at)) - 1
        low, high = at[starts], at[stops] + 1
        open_ = ~short[high]
        low, high = low[open_], high[open_]
        short[high] = True
        lows, highs = low, high
    return short[:n]


def least_documents(texts: np.ndarray, counts: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
    """For each window of distinct texts, side by side, the least document of all texts that hold it. counts: windows of each text."""
    lengths = counts + LEAST - 1
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.zeros(int((lengths + 1).sum()), dtype=np.uint16)  # 0 stands after each text
    at = np.arange(len(texts)) + np.repeat(np.arange(len(counts)), lengths)
    symbols[at] = texts.astype(np.uint16) + 1
    doc = np.repeat(least_doc, lengths + 1)
    suffixes = suffix_array(symbols, LEAST)
    short = expand_intervals(suffixes, symbols, LEAST)
    groups = np.flatnonzero(short)
    lowest = np.minimum.reduceat(doc[suffixes], groups)
    out = np.empty(len(symbols), dtype=np.int64)
    out[suffixes] = np.repeat(lowest, np.diff(np.append(groups, len(suffixes))))
    windows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return out[windows]


def removed_in_slice(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (id, h), first bytes and ends of the stretches that one slice's runs remove. rows: an Arrow table of candidate_runs."""
    names = ("subs", "counts", "hashes", "docs", "nth", "which", "offsets")
    kinds = (np.uint16, np.uint16, np.uint64, np.int64, np.uint32, np.uint32, np.uint32)
    texts, subs, counts, hashes, docs, nth, which, offsets = [], [], [], [], [], [], [], []
    n_texts = n_docs = 0
    for k in range(rows.num_rows):
        one = [np.frombuffer(rows.column(c)[k].as_py(), dtype=t) for c, t in zip(names, kinds)]
        texts.append(np.frombuffer(zstandard.decompress(rows.column("texts")[k].as_py()), dtype=np.uint8))
        subs.append(one[0])
        counts.append(one[1].astype(np.int64))
        hashes.append(one[2])
        docs.append(one[3].reshape(-1, 2))
        nth.append(one[4].astype(np.int64) + n_texts)
        which.append(one[5].astype(np.int64) + n_docs)
        offsets.append(one[6].astype(np.int64))
        n_texts, n_docs = n_texts + len(one[1]), n_docs + len(one[3]) // 2
    texts, subs, counts, hashes, docs, nth, which, offsets = map(np.concatenate, (texts, subs, counts, hashes, docs, nth, which, offsets))
    _, lead, same = np.unique(hashes, return_index=True, return_inverse=True)
    begins, lengths = np.cumsum(counts + LEAST - 1) - (counts + LEAST - 1), counts + LEAST - 1
    odd = differing(texts, begins, lengths, lead[same])
    if odd.any():  # texts of one hash that aren't equal stay apart
        apart = np.isin(same, same[odd])
        same = np.where(apart, len(lead) + np.arange(len(same)), same)
        _, lead, same = np.unique(same, return_index=True, return_inverse=True)
    occurs, doc = same[nth], docs[which, 0]
    least_doc = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, occurs, doc)
    begin = begins[lead]
    counts, subs = counts[lead], subs[lead]
    windows = np.cumsum(counts) - counts
    lowest = np.empty(int(counts.sum()), dtype=np.int64)
    parts = -(-int((counts + LEAST).sum()) // ARRAY_SYMBOLS)
    part = subs.astype(np.int64) * parts >> 16
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[cuts[p] : cuts[p + 1]]
        if len(own):
            n = counts[own]
            found = least_documents(gather(texts, begin[own], n + LEAST - 1), n, least_doc[own])
            lowest[np.repeat(windows[own] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    first = np.cumsum(counts) - counts
    low, high = np.minimum.reduceat(lowest, first), np.maximum.reduceat(lowest, first)
    whole = np.flatnonzero(high[occurs] < doc)
    partly = np.flatnonzero((high[occurs] >= doc) & (low[occurs] < doc))
    size = counts[occurs[partly]]
    place = np.repeat(np.arange(len(partly)), size)
    nth_window = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    hit = lowest[np.repeat(first[occurs[partly]], size) + nth_window] < doc[partly][place]
    place, nth_window = place[hit], nth_window[hit]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (nth_window[1:] != nth_window[:-1] + 1))) if len(place) else np.zeros(0, dtype=np.int64)
    last = np.append(new[1:], len(place)) - 1 if len(place) else new
    where = partly[place[new]]
    start = np.concatenate([offsets[whole], offsets[where] + nth_window[new]])
    end = np.concatenate([offsets[whole] + counts[occurs[whole]] + LEAST - 1, offsets[where] + nth_window[last] + LEAST])
    return docs[which[np.concatenate([whole, where])]], start, end


def spans(docs: DataFrame, parts: int) -> DataFrame:
    """The removed stretches by document slice: slice, docs, which, starts, ends. docs: id, h, text."""
    import pyarrow as pa

    runs = candidate_runs(docs, repeated_names(docs, "text", parts), parts)

    def reduce_(key, table):
        doc, start, end = removed_in_slice(table)
        own = document_slice(doc[:, 0], doc[:, 1], parts)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(parts + 1))
        out: list[tuple] = []
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if len(mine):
                used, which = np.unique(doc[mine], axis=0, return_inverse=True)
                out.append((p, used.tobytes(), which.reshape(-1).astype(np.uint32).tobytes(), start[mine].tobytes(), end[mine].tobytes()))
        columns = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int32() if n == "slice" else pa.binary()) for n, c in zip(("slice", "docs", "which", "starts", "ends"), columns)})

    return runs.groupBy("slice").applyInArrow(reduce_, "slice int, docs binary, which binary, starts binary, ends binary")


def merged_spans(table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Maximal removed runs by document."""
    docs, which, starts, ends, n = [], [], [], [], 0
    for k in range(table.num_rows):
        own, at, a, b = (np.frombuffer(table.column(c)[k].as_py(), dtype=t) for c, t in (("docs", np.int64), ("which", np.uint32), ("starts", np.int64), ("ends", np.int64)))
        docs.append(own.reshape(-1, 2))
        which.append(at.astype(np.int64) + n)
        starts.append(a)
        ends.append(b)
        n += len(own) // 2
    if not docs:
        return {}
    docs, back = np.unique(np.concatenate(docs), axis=0, return_inverse=True)
    which, starts, ends = back.reshape(-1)[np.concatenate(which)], np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((starts, which))
    which, starts, ends = which[order], starts[order], ends[order]
    room = int(ends.max()) + 2  # documents side by side, never touching
    starts, ends = starts + which * room, np.maximum.accumulate(ends + which * room)
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    last = np.append(new[1:], len(starts)) - 1
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for w, a, b in zip(which[new].tolist(), (starts[new] - which[new] * room).tolist(), (ends[last] - which[new] * room).tolist()):
        out.setdefault((int(docs[w, 0]), int(docs[w, 1])), []).append((a, b))
    return out


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def kept_rows(docs: DataFrame, id_col: str, text_col: str, carried: list[str], report: bool) -> DataFrame:
    """row (a struct of the carried columns of docs), n_bytes, n_removed, n_spans, kept_sha256 and, unless ``report``, kept, the text left."""
    import pyarrow as pa

    parts = slice_count(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*map(quoted, carried)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = spans(rows.select("id", "h", "text"), parts)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    new += [] if report else [T.StructField("kept", T.StringType())]
    schema = T.StructType([rows.schema["row"], *new])

    from pyspark.sql.functions import arrow_udf

    def one(i: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(document_slice(i.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False), parts), type=pa.int32())

    one.__annotations__ = {"i": pa.Array, "h": pa.Array, "return": pa.Array}
    marked = rows.withColumn("slice", arrow_udf("int")(one)("id", "h"))

    def apply(left, right):
        runs = merged_spans(right)
        out = []
        for i, h, t in zip(left.column("id").to_pylist(), left.column("h").to_pylist(), left.column("text")):
            raw = t.as_py().encode("utf-8")
            own = runs.get((i, h), [])
            rest = cut(raw, own) if own else raw
            row = len(raw), len(raw) - len(rest), len(own), hashlib.sha256(rest).hexdigest()
            out.append(row if report else (*row, rest.decode("utf-8", "ignore")))
        columns = list(zip(*out)) or [()] * len(new)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([left.column("row"), *(pa.array(c, type=k) for c, k in zip(columns, kinds))], names=["row", *(f.name for f in new)])

    return marked.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(apply, schema)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, then __kept (the text left, as string), __n_bytes, __n_removed, __n_spans and __kept_sha256 (of the bytes left). The id is an integer."""
    d = kept_rows(docs, id_col, text_col, docs.columns, False)
    return d.select("row.*", *(F.col(c).alias(f"__{c}") for c in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")))


def dedup_report(docs: DataFrame) -> DataFrame:
    return kept_rows(docs, "doc_id", "text", ["doc_id"], True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with what is left of their texts, and n_chars to match."""
    # all columns but the text travel as they are; the text comes back as kept
    d = kept_rows(docs, "doc_id", "text", [c for c in docs.columns if c != "text"], False)
    own = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return d.select(*(own.get(c, field(f"{c}")).alias(c) for c in docs.columns))


def suffix_sql() -> str:
    """The report in DuckDB's SQL: every window of every text, as hexadecimal digits."""
    return f"""
        with n as (select doc_id, hex(encode(coalesce(text, ''))) as h, length(hex(encode(coalesce(text, '')))) // 2 as nb from documents),
        w as (select doc_id, i, substr(h, 2 * i + 1, {2 * LEAST}) as s from (select doc_id, h, unnest(range(0, nb - {LEAST - 1})) as i from n where nb >= {LEAST})),
        m as (select s, min(doc_id) as least from w group by s),
        f as (select w.doc_id, w.i from w join m using (s) where m.least < w.doc_id),
        b as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {LEAST} then 0 else 1 end as fresh from f),
        g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from b),
        r as (select doc_id, run, min(i) as a, max(i) + {LEAST} as z from g group by doc_id, run),
        p as (
            select doc_id, z as a, lead(a) over (partition by doc_id order by run) as z from r
            union all select doc_id, 0 as a, min(a) as z from r group by doc_id
        ), k as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, nb) - a)), '' order by a) as rest from p join n using (doc_id) group by doc_id),
        t as (select doc_id, sum(z - a) as removed, count(*) as spans from r group by doc_id)
        select n.doc_id, cast(nb as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
            sha256(unhex(coalesce(rest, h))) as kept_sha256
        from n left join k using (doc_id) left join t using (doc_id)"""
