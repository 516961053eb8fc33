import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavecairn.llm import bpe, common
from wavecairn.llm.queries import op2_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n  x", "aaaaaaaaaaaaaaaaa", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't we'll  \t x", "日本語 текст", "é" * 300, "0123456789" * 50, "!!!??? $$$ ***", "  x", "a\x00b", "x" * 5000]


def expected(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_odd_texts_and_clashing_columns(spark):
    rows = [(k, t, "x", "y", "z") for k, t in enumerate([*ODD, *ODD[:3]])] + [(None, "null id", "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string, start string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect()}
    assert got == {r[0]: expected(r[1]) for r in rows}
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in op2_bpe(spark, sf_dir).collect()}
    tok = Tokenizer.from_file(PATH)
    rows = common.documents(spark, sf_dir).select("doc_id", "text").collect()
    for r, e in zip(rows, tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        back = tok.decode(e.ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_tables_outlive_a_task(definition):
    coder = bpe._encoder(definition)
    coder.encode(["some words to keep"])
    assert bpe._encoder("".join(definition)) is coder and " words" in coder.memo


def test_plain_pattern_cuts_as_the_pattern_does(definition):
    coder, rng = bpe._encoder(definition), np.random.default_rng(1)
    texts = [chr(a) + chr(b) for a in range(128) for b in range(128)]
    texts += ["".join(map(chr, rng.integers(0, 128, 40))) for _ in range(2000)] + ["".join(rng.choice(list(" 'stlvredm\n1!x\x1c"), 40)) for _ in range(5000)]
    original = bpe.regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for t in texts:
        assert coder.plain.findall(t) == coder.pattern.findall(t) == original.findall(t)
    for t in ODD:
        assert coder.pattern.findall(t or "") == original.findall(t or "")


def test_automaton_lists_the_tokens_that_end_at_each_place(definition):
    coder = bpe._encoder(definition)
    for text in ("internationalisation", " straße", "éééx", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語", "\x00\x01 ."):
        spelled, node = text.encode(), 0
        for end, c in enumerate(spelled, 1):
            nxt = coder.trie.get(node << 8 | c)
            node = coder._beyond(node, c) if nxt is None else nxt
            tails = [(end - k, coder.id_of[spelled[k:end]]) for k in range(end) if spelled[k:end] in coder.id_of]
            assert list(coder.fits[node]) == tails


def test_bounds_of_a_worker_do_not_change_results(definition, monkeypatch):
    texts = [t or "" for t in ODD] + ["the same words, the same words; andere Wörter"] * 3
    want = [expected(t) for t in texts]
    for name, value in (("MEMO", 5), ("PAIRS", 0), ("STEPS", 0), ("TOKENS", 3)):
        monkeypatch.setattr(bpe, name, value)
    coder = bpe.Encoder(definition)
    for _ in range(2):
        ids = [x for t in texts for x in coder.encode([t])]
        assert [(len(x) // 4, common.sha(x), common.sha(y)) for x, y in zip(ids, coder.decode(ids), strict=True)] == want


def test_decoding_keeps_texts_apart(definition):
    coder = bpe._encoder(definition)
    first, second = ([np.array([coder.id_of[bytes([b])]], "<u4").tobytes() for b in "é".encode()])
    assert coder.decode([first, second, b"", first + second]) == ["\ufffd".encode()] * 2 + [b"", "é".encode()]
    assert coder.decode([]) == [] and coder.decode([b""]) == [b""]
