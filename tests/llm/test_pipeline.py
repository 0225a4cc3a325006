import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import sentence
from test_linededup import brute
from test_mixing import brute_mix
from test_simhash import brute_fingerprint, components

import corpus_pipeline
from simcat.llm import mixing, toxicity
from simcat.llm.common import materialise


def run_stages(spark, docs, sf_dir):
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf_dir), "test-" + name.replace(" ", "-")))
    return kept


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [t.collect() for t in run_stages(spark, docs, sf)]
    raw, clean, lines, single, mixed, coded = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mix sources", "sentencepiece"]
    for t in tables[:-1]:
        assert t[0].asDict().keys() == raw[0].asDict().keys()
    # toxicity: what the model rejects goes, the rest stays as it was
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.fit_and_score(docs, labels).collect()}
    assert sorted(clean) == sorted(r for r in raw if score[r.doc_id] < 0.5)
    # line dedup: every document stays, with its other lines
    want = {d.doc_id: t for d, (_, _, t) in zip(clean, brute([d.text for d in clean], 10))}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    # near-duplicates: the smallest id of each group
    order = sorted(lines, key=lambda r: r.doc_id)
    comp = components([brute_fingerprint(r.text) for r in order])
    assert sorted(single) == sorted(r for i, r in enumerate(order) if comp[i] == i)
    # the mix: what a mix written out in Python draws
    label = {r.vec_id: f"t{r.label}" for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    drawn = brute_mix([(r.doc_id, max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), (r.source, r.lang, label.get(r.doc_id, "none"))) for r in single])
    assert sorted(mixed) == sorted(r for r in single if drawn[r.doc_id][1]) and 0.6 < len(mixed) / len(single) <= 1
    # ids
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in coded)


def test_the_last_stage_decodes_what_it_encoded(spark, sf):
    texts = ["plain words here", "Ünï  ① ﬁne\n日本語", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = {r.doc_id: r for r in corpus_pipeline.tokenise(spark, docs, sf).collect()}
    assert len(coded) == len(texts)
    for i, t in enumerate(texts):
        assert coded[i].decoded == library.decode(np.frombuffer(coded[i].ids, "<u4").tolist()) == library.decode(library.encode(t or ""))


def test_awkward_documents_pass_every_stage(spark, sf):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "x" * 3000, "same\nline", *[sentence(rng, 30) for _ in range(20)], *["copy of " + sentence(random.Random(1), 40)] * 15]
    rows = [(None if i % 9 == 4 else 10**6 + i, t, [None, "en"][i % 2], "s" if i % 3 else None, 1) for i, t in enumerate(texts)] + [(10**6, "again", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = run_stages(spark, docs, sf)
    assert tables[1].count() == len(rows) and tables[2].count() == len(rows)
    assert 20 <= tables[3].count() < len(rows)
    assert tables[-1].count() <= tables[3].count()
    assert [t.count() for t in run_stages(spark, docs.limit(0), sf)] == [0] * 6


def test_further_columns_pass_whatever_their_names(spark, sf):
    names = ["score", "topic", "sampled", "n_tokens", "n_lines", "fp", "t", "row", "digests", "weight"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("*", *[f"doc_id * {i + 2} as `{n}`" for i, n in enumerate(names)])
    for table in run_stages(spark, docs, sf)[:-1]:
        assert table.columns == docs.columns
        assert all(r[n] == r.doc_id * (i + 2) for r in table.collect() for i, n in enumerate(names))


def test_mix_rate_is_the_largest_probability(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    top = max(r.probability for r in mixing.mix(docs, ["source", "lang"], rate=0.5).collect())
    assert abs(top - 0.5) < 1e-9
