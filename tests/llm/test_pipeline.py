import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from ridgeline.llm import mixing, toxicity

from .test_simhash import plain_groups, plain_print
from .test_suffixes import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    steps, at = [docs], docs
    for _, stage in P.STAGES:
        at = P.materialize(stage(spark, at, FOLDER))
        steps.append(at)
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [sorted(map(tuple, s.collect())) for s in steps]

    flagged = {r.doc_id for r in toxicity.scored(docs, labels).where("__flagged").select("doc_id").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] not in flagged]

    groups = plain_groups([plain_print(r[1]) for r in rows[1]])
    assert rows[2] == [r for i, r in enumerate(rows[1]) if groups[i] == i]

    want = {r[0]: r[1:] for r in plain([(r[0], r[1]) for r in rows[2]])}
    assert [r[0] for r in rows[3]] == [r[0] for r in rows[2]]
    for r in rows[3]:
        assert r[4] == len(r[1])
        if len(r[1].encode()) == want[r[0]][0] - want[r[0]][1]:
            assert hashlib.sha256(r[1].encode()).hexdigest() == want[r[0]][3]

    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_report(steps[3]).collect()}
    assert rows[4] == sorted(r for r in rows[3] for _ in range(copies[r[0]]))

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [(r[0], model.encode(r[1])) for r in rows[4]]
    last = sorted((i, len(x) + 1, hashlib.sha256(" ".join(map(str, [*x, 2])).encode()).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()) for i, x in ids)
    assert rows[5] == last
    assert sorted(map(tuple, P.run(spark, FOLDER).collect())) == last


def test_the_toxicity_stage_trains_on_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic in (0, 1)")
    seen = []
    real = toxicity.one_round
    monkeypatch.setattr(toxicity, "one_round", lambda packed, *a: seen.append(packed.selectExpr("sum(length(counts)) / 4 n", "sum(length(toxic)) m").first()) or real(packed, *a))
    toxicity._last.clear()
    kept = P.reject_toxic(spark, docs, FOLDER)
    want = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 > 1").select("doc_id").distinct().count()
    assert want > 20 and [tuple(s) for s in seen] == [(want, want)] * toxicity.ROUNDS
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    toxicity._last.clear()
