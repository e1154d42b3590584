"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of rows for hashes of the word, its beginnings and its end. Filters of several widths run over the words; each
filter's largest response in the text (never below 0) goes into a logistic output. Only feature hashes that occur in at least
``MIN_DOCS`` training texts have a row: other words embed as zero, so unknown words add nothing.

Every labelled row is used: a fifth of all labels is held out by the contract, another fifth trains nothing and calibrates a threshold for each
language, all others train. The driver trains a start on at most ``SAMPLE`` rows of each class, those of the smallest hash of their id, and of these, in
the order of that hash, as many whole texts as ``SAMPLE_BYTES`` hold. Where that is not all of them, the start takes ``START_BYTES`` of them, weighted as many as all labels of their class, and ``ROUNDS`` rounds go over all:
rows are dealt by id to parts, each part trains one epoch from the model of the round before, and the parts' moves are averaged (a word row's over the
parts that moved it). Which features are known is counted over all training rows. Scores depend on the text alone; the language only picks the threshold that a score is held against.

Defined results: null and empty texts score like a text without words; labels that are null or whose id has no document are
left out; without both classes among the labels every score is the share of toxic labels (0 if there are none); ids that repeat are scored row by row, and
train once, with their least text; a very long text is scored in parts of ``CHUNK_WORDS`` words; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_function, broadcast, drop_scratch, field, materialize, nested, slices, tidied

#: Labelled rows of each class that the driver trains the start on at most, and bytes of text of both classes together.
SAMPLE, SAMPLE_BYTES = 4000, 48 << 20
#: Bytes of text of the start where rounds over all rows follow: the driver then needs little memory.
START_BYTES = 4 << 20
#: Rounds over all training rows, and the rows and bytes of text that a part of them holds on average.
ROUNDS, PART_ROWS, PART_BYTES = 3, 8000, 8 << 20
#: Slices of the rows of words in which parts' moves are averaged, at most.
MOVE_SLICES = 64
#: Up to this many labels, two numbers each, are broadcast to find their texts.
BROADCAST_LABELS = 1_000_000
#: Bytes of text scored at a time, one text at least.
SLICE_BYTES = 1 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 19, 12, 8, (1, 2, 3)
MIN_DOCS = 8
EPOCHS, BATCH_DOCS, STEP = 6, 32, 0.08
#: Words whose responses are held at a time.
CHUNK_WORDS = 1 << 17
#: A language needs so many calibration rows of each class for a threshold of its own.
CALIBRATION_ROWS = 20
PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&-_"


def hashes(word: str) -> list[int]:
    """Buckets of a word's features."""
    w = word.encode()
    return [zlib.crc32(w) % BUCKETS, zlib.crc32(w[:4], 1) % BUCKETS, zlib.crc32(w[:5], 2) % BUCKETS, zlib.crc32(w[-5:], 3) % BUCKETS]


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers in order, the distinct words' feature buckets, and the number of words of each text of an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.ascii_trim(parts.flatten(), characters=PUNCTUATION).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary.to_pylist()
    table = np.array([hashes(w) for w in distinct], dtype=np.int64).reshape(len(distinct), 4)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), table, counts


class ConvModel:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.offset = np.float32(0)
        self.constant: float | None = None
        #: Each bucket's row; 0, a row of zeros, for buckets that aren't known.
        self.slot = np.zeros(BUCKETS, dtype=np.int32)
        #: Sums of squared gradients of rows, filters, bias, out and offset, while it is trained.
        self.squares: list | None = None

    def keep(self, known: np.ndarray) -> None:
        """Keeps only the rows of known buckets, behind a row of zeros."""
        found = np.flatnonzero(known)
        self.slot[found] = np.arange(1, len(found) + 1)
        self.rows = np.concatenate([np.zeros((1, DIM), dtype=np.float32), self.rows[found]])

    def embedded(self, slots: np.ndarray) -> np.ndarray:
        """Embeddings of words by the rows of their features; the last one is the word beyond a text's end."""
        out = np.zeros((len(slots) + 1, DIM), dtype=np.float32)
        for j in range(slots.shape[1]):
            out[:-1] += self.rows.take(slots[:, j], axis=0)
        return out

    def pooled(self, embedded: np.ndarray, words: np.ndarray, counts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each text's largest responses (texts, filters); with ``where`` also the positions in ``padded`` that they stand at."""
        wide = max(WIDTHS) - 1
        n = len(counts)
        by_offset = [[embedded @ f[o] for o in range(len(f))] for f in self.filters]
        padded, starts = pad_words(words, counts, len(embedded) - 1, wide)
        best = np.zeros((n, len(self.bias)), dtype=np.float32)
        at = np.zeros((n, len(self.bias)), dtype=np.int64) if where else None
        ends = np.append(starts[1:], len(padded))
        first = 0
        while first < n:  # whole texts at a time; a text longer than the chunk goes in pieces
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_WORDS, side="right")))
            lo, hi = int(starts[first]), int(ends[last - 1])
            for a in range(lo, hi, CHUNK_WORDS):
                b = min(hi, a + CHUNK_WORDS)
                for k, tables in enumerate(by_offset):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    response = np.repeat(self.bias[None, own], b - a, axis=0)
                    for o, t in enumerate(tables):
                        tail = padded[a + o : b + o]
                        response[: len(tail)] += t[tail]
                    for j in range(1, len(tables)):  # filters that would reach into the next text
                        beyond = ends[first:last] - j - a
                        response[beyond[(beyond >= 0) & (beyond < b - a)]] = 0
                    if last - first == 1:
                        top = response.max(axis=0)
                        if where:
                            at[first, own] = np.where(top > best[first, own], a + response.argmax(axis=0), at[first, own])
                        best[first, own] = np.maximum(best[first, own], top)
                    else:
                        cuts = (starts[first:last] - a).astype(np.int64)
                        best[first:last, own] = np.maximum(np.maximum.reduceat(response, cuts, axis=0), 0)
                        if where:
                            for i, c in enumerate(cuts):
                                stop = ends[first + i] - a
                                at[first + i, own] = a + c + response[c:stop].argmax(axis=0)
            first = last
        return best, at

    def scores(self, texts) -> np.ndarray:
        """0 to 1 for each text of an Arrow string array without nulls."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        words, table, counts = words_of(texts)
        best, _ = self.pooled(self.embedded(self.slot[table]), words, counts)
        z = best.astype(np.float64) @ self.out.astype(np.float64) + float(self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pad_words(words: np.ndarray, counts: np.ndarray, filler: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers with ``wide`` + 1 fillers after each text, and where each text starts."""
    starts = np.concatenate([[0], np.cumsum(counts + wide + 1)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, dtype=np.int64)
    out = np.full(int((counts + wide + 1).sum()), filler, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) if len(counts) else 0
    out[np.arange(len(words)) + shift] = words
    return out, starts


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to out[at]; rows of one place are summed first."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def coded_texts(texts) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's word numbers, and the distinct words' feature buckets."""
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()).combine_chunks()
    words, table, counts = words_of(texts)
    ends = np.cumsum(counts)
    return [words[e - c : e] for e, c in zip(ends, counts)], table


def texts_with(docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """How many texts each bucket occurs in."""
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for d in docs:
        seen[np.unique(table[np.unique(d)])] += 1
    return seen


def untrained(known: np.ndarray, seed: int = 11) -> ConvModel:
    """A model of the known buckets, with the sums of squared gradients that its steps are scaled by."""
    model = ConvModel(seed)
    model.keep(known)
    model.squares = [np.full_like(model.rows, 1e-6), [np.full_like(f, 1e-6) for f in model.filters], np.full_like(model.bias, 1e-6), np.full_like(model.out, 1e-6), 1e-6]
    return model


def train(texts, toxic: list[int], seed: int = 11, weights: tuple[float, float] = (1.0, 1.0), known: np.ndarray | None = None) -> ConvModel:
    """Adagrad on the log loss, rows weighted by class (not toxic, toxic); known buckets are counted in the texts unless they are given."""
    import pyarrow as pa

    y_all = np.asarray(toxic, dtype=np.float32)
    if not len(y_all) or y_all.min() == y_all.max():
        model = ConvModel(seed)
        model.constant = float(y_all.mean()) if len(y_all) else 0.0
        return model
    w_all = np.asarray(weights, dtype=np.float64)[y_all.astype(int)]
    w_all = (w_all / w_all.mean()).astype(np.float32)
    if not isinstance(texts, pa.ChunkedArray):
        texts = pa.array([t or "" for t in texts], type=pa.large_string())
    docs, table = coded_texts(texts)
    model = untrained(texts_with(docs, table) >= MIN_DOCS if known is None else known, seed)
    table = model.slot[table]
    rng = np.random.default_rng(seed)
    order = np.arange(len(docs))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        descend(model, docs, table, y_all, w_all, order)
    return model


def descend(model: ConvModel, docs: list[np.ndarray], table: np.ndarray, y_all: np.ndarray, w_all: np.ndarray, order: np.ndarray) -> None:
    """One epoch over the texts in the given order; gradients reach the words at which each filter responded most."""
    g_rows, g_filters, g_bias, g_out, g_offset = model.squares
    wide = max(WIDTHS) - 1
    for lo in range(0, len(order), BATCH_DOCS):
        some = order[lo : lo + BATCH_DOCS]
        got, local = np.unique(np.concatenate([docs[i] for i in some]), return_inverse=True)
        own, n = table[got], np.array([len(docs[i]) for i in some])
        embedded = model.embedded(own)
        best, at = model.pooled(embedded, local, n, where=True)
        padded, _ = pad_words(local, n, len(own), wide)
        padded = np.append(padded, [len(own)] * wide)
        z = best @ model.out + model.offset
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_all[some]) * w_all[some] / len(some)
        d_best = np.where(best > 0, error[:, None] * model.out[None, :], 0)
        d_out, d_offset, d_bias = best.T @ error, error.sum(), d_best.sum(axis=0)
        d_embedded = np.zeros_like(embedded)
        for k, f in enumerate(model.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            g, d_f = d_best[:, cols], np.zeros_like(f)
            for o in range(len(f)):
                w = padded[at[:, cols] + o]
                d_f[o] = np.einsum("nfd,nf->df", embedded[w], g)
                add_rows(d_embedded, w.reshape(-1), (g[:, :, None] * f[o].T[None]).reshape(-1, DIM))
            g_filters[k] += d_f * d_f
            f -= STEP * d_f / np.sqrt(g_filters[k])
        used = np.flatnonzero(np.abs(d_embedded[:-1]).sum(axis=1) > 0)
        d_rows = np.zeros((0, DIM), dtype=np.float32)
        if len(used):
            rows, back = np.unique(own[used].reshape(-1), return_inverse=True)
            d_rows = np.zeros((len(rows), DIM), dtype=np.float32)
            add_rows(d_rows, back.reshape(-1), np.repeat(d_embedded[used], own.shape[1], axis=0))
            d_rows[rows == 0] = 0  # unknown words stay zero
            g_rows[rows] += d_rows * d_rows
            model.rows[rows] -= STEP * d_rows / np.sqrt(g_rows[rows])
        g_bias += d_bias * d_bias
        g_out += d_out * d_out
        g_offset += d_offset * d_offset
        model.bias -= STEP * d_bias / np.sqrt(g_bias)
        model.out -= STEP * d_out / np.sqrt(g_out)
        model.offset -= np.float32(STEP * d_offset / np.sqrt(g_offset))
    model.squares[4] = g_offset


def thresholds(scores: np.ndarray, toxic: np.ndarray, langs: list[str | None], weights: tuple[float, float] = (1.0, 1.0)) -> dict[str | None, float]:
    """For each language the score that errs least on its calibration rows, weighted by class, of equals the one nearest to 0.5."""
    out: dict[str | None, float] = {}
    for lang in sorted(set(langs), key=str):
        own = np.array([x == lang for x in langs])
        s, t = scores[own], toxic[own]
        if min(t.sum(), (1 - t).sum()) < CALIBRATION_ROWS:
            continue
        order = np.argsort(s, kind="stable")
        s, t = s[order], t[order]
        candidates = np.unique(np.append((s[1:] + s[:-1]) / 2, 0.5))
        below = np.searchsorted(s, candidates)  # rows that stay below each candidate
        missed, flagged = np.append(0, np.cumsum(t == 1)), np.append(0, np.cumsum(t != 1))
        wrong = np.round(weights[1] * missed[below] + weights[0] * (flagged[-1] - flagged[below]), 6)
        out[lang] = float(candidates[np.lexsort((candidates, np.abs(candidates - 0.5), wrong))[0]])
    return out


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


#: The last model with its thresholds, and a digest of the rows that it was fitted to: equal rows give it again.
_last: list[tuple[tuple, tuple]] = []


def calibrates(id_col: Column) -> Column:
    """Rows that train nothing."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 1


def least_texts(rows: DataFrame) -> DataFrame:
    """One row an id, with its least text."""
    return rows.groupBy("id", "at", "toxic").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "at", "toxic", F.col("r.lang").alias("lang"), F.col("r.text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> tuple[ConvModel, dict]:
    """Model and thresholds by language from all rows whose remainder isn't 0."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(remainder(F.col("id")) != 0)
    # an id with both labels counts as toxic
    ids = materialize(known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("id")))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    found = F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids
    digests = [F.xxhash64("text", "lang", F.col("id").cast("string")).alias("h"), F.xxhash64(F.col("id").cast("string"), F.lit(1), "lang", "text").alias("k")]
    numbers = materialize(rows.select("id", F.octet_length("text").cast("long").alias("n"), *digests).join(found, "id"))
    sums = [F.sum((F.col(c).cast("decimal(38,0)") * (F.col("toxic") + 1))).alias(c) for c in ("h", "k")]
    digest = (*numbers.agg(F.count("*").alias("rows"), F.sum("n"), *sums).first(), SAMPLE, SAMPLE_BYTES, PART_ROWS, PART_BYTES, ROUNDS)
    if not digest[0]:
        return train([], []), {}
    if _last and _last[0][0] == digest:
        return _last[0][1]
    rows = rows.join(found, "id")
    once = numbers.groupBy("id", "at", "toxic").agg(F.min("n").alias("n"))
    totals = {r.toxic: r for r in once.groupBy("toxic").agg(F.count("*").alias("ids"), F.sum((~calibrates(F.col("id"))).cast("long")).alias("training")).collect()}
    chosen, weights = None, []
    for c in (0, 1):  # each a bounded top-k, without a sort of all labels
        own = once.where(F.col("toxic") == c).orderBy("at", "id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.unionAll(own)
        weights.append(max(1.0, totals[c].ids / SAMPLE) if c in totals else 1.0)
    start = least_texts(rows.join(F.broadcast(chosen.select("id")), "id"))
    start = materialize(start.withColumn("n", F.octet_length("text").cast("long")))
    size, n = start.agg(F.sum("n"), F.count("*")).first()
    whole = size <= SAMPLE_BYTES and n == sum(t.ids for t in totals.values())
    upto = F.sum("n").over(Window.orderBy("at", "id"))
    within = start.select("id", upto.alias("upto")).where(F.col("upto") <= (SAMPLE_BYTES if whole else min(SAMPLE_BYTES, START_BYTES))).select("id")  # a window over 2 * SAMPLE rows at most
    table = start.join(F.broadcast(within), "id").orderBy("at", "id").select(F.col("id").cast("string").alias("id"), "toxic", "lang", "text").toArrow().combine_chunks()
    toxic = np.array(table.column("toxic").to_pylist(), dtype=np.int64)
    held = np.array([zlib.crc32(i.encode()) % 5 == 1 for i in table.column("id").to_pylist()], dtype=bool)
    if whole:
        fitted = train(table.column("text").filter(~held), toxic[~held].tolist())
        rest = table.filter(held)
        scores = np.concatenate([fitted.scores(s) for s in slices(rest.column("text"), SLICE_BYTES)]) if rest.num_rows else np.zeros(0)
        by_lang = thresholds(scores, toxic[held], rest.column("lang").to_pylist())
    else:
        packed, known = packed_parts(rows.where(~calibrates(F.col("id"))), digest[0], digest[1])
        fitted = train(table.column("text").filter(~held), toxic[~held].tolist(), weights=tuple(weights), known=known)
        training = [totals[c].training if c in totals else 0 for c in (0, 1)]
        if not min(training):
            fitted.constant = training[1] / max(1, sum(training))
        else:
            if fitted.constant is not None:  # the start holds one class only
                fitted = untrained(known)
            for at in range(ROUNDS):
                one_round(packed, fitted, at)
        drop_scratch(packed)
        by_lang = language_thresholds(rows.where(calibrates(F.col("id"))), fitted)
    fitted.squares = None
    drop_scratch(start)
    _last[:] = [(digest, (fitted, by_lang))]
    return _last[0][1]


def packed_parts(rows: DataFrame, n: int, size: int) -> tuple[DataFrame, np.ndarray]:
    """All training rows as numbers, one row a part, and which buckets occur in ``MIN_DOCS`` of their texts."""
    import pyarrow as pa

    parts = max(1, -(-n // PART_ROWS), -(-size // PART_BYTES))

    def pack(key, table):
        order = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "id", "text", "toxic"))))
        order = [r for i, r in enumerate(order) if not i or r[:2] != order[i - 1][:2]]  # an id's least text
        docs, features = coded_texts(pa.array([r[2] for r in order], type=pa.large_string()))
        seen = texts_with(docs, features)
        buckets = np.flatnonzero(seen).astype(np.int32)
        blobs = [np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs], dtype=np.int32), features.astype(np.int32), np.array([r[3] for r in order], dtype=np.int8)]
        columns = [pa.array([key[0].as_py()], type=pa.int32()), *(pa.array([b.tobytes()], type=pa.binary()) for b in blobs)]
        columns += [pa.array([b.tolist()], type=pa.list_(pa.int32())) for b in (buckets, seen[buckets])]
        return pa.Table.from_arrays(columns, names=["part", "words", "counts", "features", "toxic", "buckets", "texts"])

    dealt = rows.select(F.pmod("at", F.lit(parts)).cast("int").alias("part"), "at", "id", "text", "toxic").repartition(parts, "part")
    kind = "part int, words binary, counts binary, features binary, toxic binary, buckets array<int>, texts array<int>"
    packed = materialize(dealt.groupBy("part").applyInArrow(pack, kind))
    seen = packed.select(F.explode(F.arrays_zip("buckets", "texts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.texts").alias("n")).where(F.col("n") >= MIN_DOCS)
    known = np.zeros(BUCKETS, dtype=bool)
    known[seen.select("buckets").toArrow().column(0).to_numpy()] = True  # at most BUCKETS numbers
    return packed.select("part", "words", "counts", "features", "toxic"), known


def flat(model: ConvModel) -> np.ndarray:
    """All weights but the rows of words, and their squares, in one row."""
    _, g_filters, g_bias, g_out, g_offset = model.squares
    return np.concatenate([x.reshape(-1).astype(np.float64) for x in (*model.filters, model.bias, model.out, np.array([model.offset]), *g_filters, g_bias, g_out, np.array([g_offset]))])


def put_flat(model: ConvModel, values: np.ndarray) -> None:
    """Puts what ``flat`` gave back."""
    _, g_filters, g_bias, g_out, _ = model.squares
    at = 0
    for arrays in ((*model.filters, model.bias, model.out), (*g_filters, g_bias, g_out)):
        for x in arrays:
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        if arrays[-1] is model.out:
            model.offset = np.float32(values[at])
        else:
            model.squares[4] = float(values[at])
        at += 1


def one_round(packed: DataFrame, model: ConvModel, at: int) -> None:
    """Each part's epoch from the model, and the average of their moves: of weights over all parts, of a word's row over the parts that moved it."""
    import copy

    import pyarrow as pa

    held = broadcast(packed.sparkSession, model)
    width = 2 * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, counts, features, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own, base = copy.deepcopy(held.value), held.value
                counts = np.frombuffer(counts, dtype=np.int32)
                words, ends = np.frombuffer(words, dtype=np.int32).astype(np.int64), np.cumsum(counts)
                docs = [words[e - c : e] for e, c in zip(ends, counts)]
                y = np.frombuffer(toxic, dtype=np.int8).astype(np.float32)
                order = np.random.default_rng([at, part]).permutation(len(docs))
                descend(own, docs, own.slot[np.frombuffer(features, dtype=np.int32).reshape(-1, 4)], y, np.ones(len(docs), dtype=np.float32), order)
                moved = np.flatnonzero((own.squares[0] != base.squares[0]).any(axis=1))
                moves = np.hstack([own.rows[moved] - base.rows[moved], own.squares[0][moved] - base.squares[0][moved]])
                found = [(-1, np.zeros(0, dtype=np.int32), flat(own))]
                for s in np.unique(moved % MOVE_SLICES):
                    some = moved % MOVE_SLICES == s
                    found.append((int(s), moved[some].astype(np.int32), moves[some].astype(np.float32)))
                columns = [pa.array([f[0] for f in found], type=pa.int32()), pa.array([part] * len(found), type=pa.int32())]
                columns += [pa.array([f[k].tobytes() for f in found], type=pa.binary()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "part", "slots", "moves"])

    def average(key, table):
        table = table.sort_by("part")  # sums of one order, whatever the order of arrival
        slots, moves = (table.column(c).to_pylist() for c in ("slots", "moves"))
        if key[0].as_py() < 0:
            found, mean = np.zeros(0, dtype=np.int32), np.mean([np.frombuffer(m) for m in moves], axis=0)
        else:
            slots = np.concatenate([np.frombuffer(s, dtype=np.int32) for s in slots])
            moves = np.concatenate([np.frombuffer(m, dtype=np.float32).reshape(-1, width) for m in moves])
            found, back, times = np.unique(slots, return_inverse=True, return_counts=True)
            mean = np.zeros((len(found), width))
            add_rows(mean, back, moves)
            mean = (mean / times[:, None]).astype(np.float32)
        return pa.table({"slice": [key[0].as_py()], "slots": [found.tobytes()], "moves": [mean.tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("slots", pa.binary()), ("moves", pa.binary())]))

    found = packed.mapInArrow(tidied(run), "slice int, part int, slots binary, moves binary").groupBy("slice").applyInArrow(average, "slice int, slots binary, moves binary")
    found = found.toArrow()  # at most a move for each of BUCKETS rows
    for s, slots, moves in zip(*found.columns):
        moves = moves.as_buffer()
        if s.as_py() < 0:
            put_flat(model, np.frombuffer(moves))
        else:
            slots, moves = np.frombuffer(slots.as_buffer(), dtype=np.int32), np.frombuffer(moves, dtype=np.float32).reshape(-1, width)
            model.rows[slots] += moves[:, :DIM]
            model.squares[0][slots] += moves[:, DIM:]


def language_thresholds(rows: DataFrame, model: ConvModel) -> dict[str | None, float]:
    """Thresholds over all calibration rows; a language's scores and labels, no texts, meet in one task."""
    import pyarrow as pa

    squares, model.squares = model.squares, None
    scores = least_texts(rows).withColumn("score", scorer(rows.sparkSession, model)("text")).select("lang", "toxic", "score")

    def one(key, table):
        found = thresholds(table.column("score").to_numpy(), table.column("toxic").to_numpy(), [""] * table.num_rows)
        return pa.table({"lang": table.column("lang").slice(0, len(found)), "threshold": pa.array(list(found.values()), type=pa.float64())})

    out = {r.lang: r.threshold for r in scores.groupBy("lang").applyInArrow(one, "lang string, threshold double").collect()}
    model.squares = squares
    return out


def scorer(spark, model: ConvModel):
    """An Arrow function of a text column: score. The model is a few MB, whatever the input: rows by hash bucket, and filters."""
    import pyarrow as pa

    held = broadcast(spark, model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            parts = [m.scores(s) for s in slices(batch, SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else [], type=pa.float64())

    return arrow_function(run, "double")


def judged_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """row (a struct of all columns of docs), score and flagged (score at or over its language's threshold, 0.5 where none was calibrated)."""
    model, by_lang = fit(docs, labels, id_col, text_col, lang_col)
    out = nested(docs).withColumn("score", scorer(docs.sparkSession, model)(field(text_col)))
    limit = F.lit(0.5)
    for lang, t in by_lang.items():
        limit = F.when(field(lang_col).cast("string").eqNullSafe(F.lit(lang)), F.lit(t)).otherwise(limit)
    return out.withColumn("flagged", F.col("score") >= limit)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The columns of docs, then __score and __flagged."""
    return judged_rows(docs, labels, id_col, text_col, lang_col).select("row.*", F.col("score").alias("__score"), F.col("flagged").alias("__flagged"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = judged_rows(docs.select("doc_id", "text", "lang"), labels)
    return s.select("row.doc_id", (remainder(field("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't flagged."""
    return judged_rows(docs, labels).where(~F.col("flagged")).select("row.*")
