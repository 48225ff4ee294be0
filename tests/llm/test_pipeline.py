from collections import defaultdict

import numpy as np
import public_tokenizers
from test_text_models import brute
from tokenizers import Tokenizer

import corpus_pipeline
from seekmill.llm import langid, queries


def test_stages_against_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = langid.train(docs.where(~queries.held_out()))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if not model.decide(*model.measure(t))[3]}
    assert len(kept) >= 0.97 * len(rows)
    last = {t: i for i, t in sorted(kept.items())}
    single = {i: t for t, i in last.items()}
    left = {i for i, c, _ in brute(list(single.items())) if i == c}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(single[i], add_special_tokens=False).ids, 1] for i in left}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    assert {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in got.items()} == want


def test_each_stage_keeps_the_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"
    odd = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, ""), (2, "the cat sat on the mat", "en", "s", 22, 1.0, ""), (2, "the cat sat on the mat", "en", "s", 22, 1.0, ""), (3, "the cat sat on the mat " * 3000, "en", None, 5, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.schema.names == schema_names(schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r["doc_id"] for r in out} == ({2, 3} if rows else set())


def schema_names(schema):
    return [c.split()[0] for c in schema.split(", ")]
