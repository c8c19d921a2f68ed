"""The pipeline's stages on the small tables, each on its own input and all in order."""

import random
import zlib

import corpus_pipeline
import public_tokenizers
import pytest

from tidemark.llm import queries, simhash
from tidemark.llm.common import scratch_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_in_order(spark, docs):
    from tokenizers import Tokenizer

    t, sf = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY)), "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, now, sf).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.count() <= now.count()
        if name == "line_dedup":
            assert after.count() == now.count()
        if name == "simhash":
            prints = [r.fp for r in simhash.fingerprints(after).collect()]
            assert len(set(prints)) == len(prints)
            assert all(bin((a ^ b) & (1 << 64) - 1).count("1") > 2 for k, a in enumerate(prints) for b in prints[:k])
        now = after
    kept = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in now.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    seen = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == seen.get(p.doc_id, 0)
        ids = kept[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        seen[p.doc_id] = p.start + p.length
    assert seen == {k: len(v) for k, v in kept.items()}


def test_run_and_extra_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    strange = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "fine words all the way", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, strange, "/root/testdata/sf0.001").count()
        assert stage(spark, strange.limit(0), "/root/testdata/sf0.001").count() == 0


def test_near_copies_of_few_replaced_words_go(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    rows, family = [], {}
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for copy in range(4):
            changed = list(text)
            for at in rng.sample(range(len(changed)), copy if copy < 3 else 60):
                changed[at] = f"changed{rng.random()}"
            rows.append((len(rows), " ".join(changed), "en", "s", 1))
            family[len(rows) - 1] = k
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t, *_ in rows]
    want = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if family[a] == family[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert got == set(want) and len(got) < 130 and all(4 * k + 3 in got for k in range(60))
    linked = simhash.near_duplicates(df, jaccard=0.8).collect()
    assert {r.doc_id: r.component_id for r in linked} == dict(enumerate(want))
