"""The pipeline's stages against brute force, each on its own input."""

import random
import zlib

import pytest

import corpus_pipeline
from gridloom.llm import toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, docs, seen = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        f(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append((before, {r["doc_id"]: r.asDict() for r in docs.collect()}))
    return seen


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    toxic = [i for i, y in labels.items() if y and i in before]
    clean = [i for i, y in labels.items() if not y and i in before]
    assert sum(i not in after for i in toxic) >= 0.6 * len(toxic)  # a small table teaches few entries
    assert sum(i in after for i in clean) >= 0.99 * len(clean)
    assert all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = stages[1]
    assert before.keys() == after.keys()
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    first = {}
    for i in sorted(before):
        for line in (before[i]["text"] or "").split("\n"):
            first.setdefault(brute.lower(line.strip(strip)), i)
    for i, r in before.items():
        kept = [x for x in (r["text"] or "").split("\n") if len(x.strip(strip)) < 10 or first[brute.lower(x.strip(strip))] == i]
        assert after[i]["text"] == "\n".join(kept)


def test_near_duplicates(stages):
    before, after = stages[2]
    want = brute.near_components([(i, r["text"]) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_, c) in want.items() if c == i}


def test_near_duplicates_just_over_the_threshold_in_a_template_group(spark):
    texts = brute.straddling_group(random.Random(11), 5, 160, 40)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute.near_components(list(enumerate(texts)), 5, 80)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in after) == [i for i, (_, c) in want.items() if c == i]


def test_contamination(spark, stages):
    before, after = stages[3]
    bench = [brute.lower(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = [b for b in bench if len(b.split()) >= 5]
    assert not any(b in brute.lower(r["text"]) for r in after.values() for b in bench)
    gone = before.keys() - after.keys()
    assert len(gone) < 0.2 * len(before)


def test_tokens(stages):
    before, after = stages[4]
    enc = brute.tiktoken_encoding()
    assert before.keys() == after.keys()
    assert all(r["n_tokens"] == len(enc.encode_ordinary(before[i]["text"] or "")) for i, r in after.items())


def test_run_gives_the_last_stage(spark, stages):
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: r["ids_sha256"] for i, r in stages[-1][1].items()}


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(None, "a text of more than ten\nletters", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        n = frame.count()
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, frame, SF).count() == n


def test_labels_fit_ignores_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "evilword here" if i % 2 else "fine words here") for i in range(400)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, y)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, lex).collect()}
    assert got == {i: i % 2 for i in range(400)}
