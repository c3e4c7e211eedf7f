"""The last stage of the pipeline returns where each piece stands."""

import random

import sentencepiece

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.common import hard_rows, prose, table
from twinspan.llm.queries import tokenizer_path


def test_encoding_stage_returns_spans(spark):
    rng = random.Random(41)
    given = [*((i, t) for i, t, *_ in hard_rows(rng)), *((100 + i, prose(rng, 80) + " é ﬁ  日本\t x ") for i in range(20))]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    out = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, table(spark, given), SMALL)
    assert out.columns == ["doc_id", "ids", "starts", "ends"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    wanted = []
    for i, text in given:
        pieces = library.encode(text or "", return_type="proto").pieces
        wanted.append((i, [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]))
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(wanted, key=key)
