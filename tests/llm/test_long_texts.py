"""Texts longer than the block that is hashed at once."""

import random

import sentencepiece

from tests.llm import brute
from tests.llm.common import collect, prose, table, words
from twinspan.llm import minhash_dedup, sentencepiece_codec, substring_dedup, symbols
from twinspan.llm.queries import tokenizer_path


def test_passages_tokens_and_near_copies_of_long_texts(spark):
    rng = random.Random(21)
    long = prose(rng, 100_000)
    assert len(long) > symbols.BLOCK
    w = words(long)
    rows = [(1, long), (2, f"{prose(rng, 70)} {' '.join(w[40_000:40_300])} {prose(rng, 70)}"), (3, long + " tail"), (4, prose(rng, 80))]
    docs = table(spark, rows)
    assert collect(substring_dedup.dedup_digests(docs)) == sorted(brute.passages(rows))
    whole = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    model = sentencepiece_codec.model_bytes(tokenizer_path())
    got = {r.doc_id: r.ids for r in sentencepiece_codec.encode_documents(docs, model).collect()}
    assert got == {i: whole.encode(t) for i, t in rows}
    classes = {r.doc_id: r.class_id for r in minhash_dedup.class_ids(docs).collect()}
    assert classes[1] == classes[3] and len(set(classes.values())) == 3
