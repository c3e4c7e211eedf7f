import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tests.llm.common import hard_rows, table
from twinspan.llm import sentencepiece_codec as codec_module
from twinspan.llm.queries import tokenizer_path
from twinspan.llm.sentencepiece_codec import CharacterMap, Codec, digest_documents, encode_documents, model_bytes

LETTERS = [*" \n\t▁aé\0日本😀<s></s>.,　ﬁ\r", "word ", "the ", "0x41", "   "]


@pytest.fixture(scope="module")
def model():
    return model_bytes(tokenizer_path())


def texts(n=1500):
    rng = random.Random(21)
    return ["", " ", "  ", *("".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n))]


def test_ids_spans_and_texts_are_the_library_s(model):
    c = Codec(model)
    given = texts()
    protos = c.whole.encode(given, return_type="proto")
    found = c.encode(given)
    assert [ids for ids, _ in found] == c.whole.encode(given)
    for text, (_, spans), proto in zip(given, found, protos, strict=True):
        assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()
        assert spans == [(p.begin, p.end) for p in proto.pieces]


def test_whole_arrays_normalise_as_the_walk_does(model):
    c = Codec(model)
    assert c.plain and c.by_word
    given = texts(300)
    data = [np.frombuffer(t.encode(), np.uint8) for t in given]
    normal, offsets, source = c.align(np.concatenate(data), np.cumsum([0, *map(len, data)]))
    for k, t in enumerate(given):
        text, places = c.normalise(t)
        assert normal[offsets[k]:offsets[k + 1]].tobytes() == text.encode()
        assert source[offsets[k]:offsets[k + 1]].tolist() == places[:-1].tolist()


def test_a_forgetful_codec_gives_the_same(model, monkeypatch):
    monkeypatch.setattr(codec_module, "REMEMBERED", 5)
    c = Codec(model)
    for t in texts(60):
        assert c.encode([t, t])[1][0] == c.whole.encode(t)


def double_array(entries):
    """A compiled character map of (source, replacement) pairs, laid out as the format asks."""
    replacements, at = b"", {}
    for key, value in entries.items():
        at[key.encode()] = len(replacements)
        replacements += value.encode() + b"\0"
    children, terminal = {b"": set()}, at
    for key in at:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
            children.setdefault(key[:i + 1], set())
    units = [0] * 4096
    used = {0}

    def place(node, index, label):
        labels = sorted(children[node]) + ([0] if node in terminal else [])
        base = next(b for b in range(1, 2048) if all((index ^ b ^ x) not in used and (index ^ b ^ x) < 4096 for x in labels))
        units[index] |= base << 10 | (256 if node in terminal else 0) | label
        spots = {x: index ^ base ^ x for x in labels}
        used.update(spots.values())
        if node in terminal:
            units[spots[0]] = terminal[node] | 1 << 31
        for x in sorted(children[node]):
            place(node + bytes([x]), spots[x], x)

    place(b"", 0, 0)
    trie = np.array(units, "<u4").tobytes()
    return len(trie).to_bytes(4, "little") + trie + replacements


RULES = {"ﬁ": "fi", "ａ": "a", "é": "e", "é": "e", "e": "E", "　": " ", "\t": " ", "日本": "JP", "日": "day", "\x07": ""}


def test_longest_prefix_of_the_character_map():
    rules = CharacterMap(double_array(RULES))
    for text in ("ﬁx", "ée", "日本日", "a", "\x07b", "日x"):
        data = text.encode()
        known = [k for k in RULES if text.startswith(k)]
        best = max(known, key=len, default=None)
        assert rules.longest(data, 0) == (None if best is None else (len(best.encode()), RULES[best].encode()))


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_a_model_with_rules_encodes_as_the_library_does(model, trim, prefix):
    proto = model_pb2.ModelProto.FromString(model)
    proto.normalizer_spec.precompiled_charsmap = double_array(RULES)
    proto.normalizer_spec.remove_extra_whitespaces = trim
    proto.normalizer_spec.add_dummy_prefix = prefix
    changed = proto.SerializeToString()
    c = Codec(changed)
    assert not c.plain
    rng = random.Random(22)
    given = ["".join(rng.choice([*RULES, *LETTERS[:-1], "x"]) for _ in range(rng.randrange(30))) for _ in range(600)]
    given = [t for t in given if "\0" not in t]
    whole = sentencepiece.SentencePieceProcessor(model_proto=changed)
    found = c.encode(given)
    assert [ids for ids, _ in found] == whole.encode(given)
    # Spans go on through the text in order, and what a piece says comes from its span.
    for text, (_, spans) in zip(given, found, strict=True):
        assert all(a <= b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(0 <= a and b <= len(text.encode()) for a, b in spans)


def test_digests(spark, model):
    rows = [*hard_rows(), *((100 + i, t) for i, t in enumerate(texts(80)))]
    given = table(spark, rows).selectExpr("*", "'x' AS ids", "'y' AS n_tokens")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, digest_documents(given, model).collect()), key=key) == sorted(wanted, key=key)
    ids = {(r["doc_id"], tuple(r["ids"])) for r in encode_documents(given, model).collect()}
    assert ids == {(i, tuple(library.encode(t or ""))) for i, t, *_ in rows}
    assert digest_documents(given.limit(0), model).collect() == []


def test_null_texts_in_a_block(model):
    from twinspan.llm.symbols import text_buffers

    c = Codec(model)
    e = c.encode_block(*text_buffers(pa.array([None, "a b", None])))
    assert np.diff(e.offsets).tolist() == [0, len(c.whole.encode("a b")), 0]


def test_words_that_collide_in_simple_hashes():
    """A word of two letters and its complement collide under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    text = "".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits)
    whole = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert [ids for ids, _ in Codec(model_bytes(tokenizer_path())).encode([text, text])] == [whole.encode(text)] * 2
