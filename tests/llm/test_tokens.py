"""Token counts and BPE coding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webframe.llm import bpe, token_counts
from webframe.llm.merges import load_merges

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
POOL = (
    ["'s", "'re", "'ve", "'ll", "'d", "'", "r", "v", "l", "e", "S", " ", "  ", "\n", "\t", "\r\n", "1", "٣", "!", "!!", "ab", "the", "ing"]
    + ["é", "É", "é", "Σ", "ΑΣ", "İ", "ﬁ", "中文", "🙂", "​", "\x1c", "\x00", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|"]
    + ["ſ", "ß", "Ɤ", "Ᲊ", "՘", "౜", "aaaaaaaa", "!!!!!!!!!!!!!", "----"]
)


def texts(seed, n=4000):
    rng = random.Random(seed)
    mixed = ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(n)]
    words = ["".join(rng.choices("abtheing ", k=rng.randint(0, 60))) for _ in range(n)]
    return [*mixed, *words, *["".join(rng.choices("a ", weights=[9, 1], k=300)) for _ in range(50)], "x" * 5000, ""]


def expected(path, some):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_counts_equal_the_library():
    some = texts(1)
    assert token_counts.text_counter(WORDS).counts(some) == [len(x) for x in expected(WORDS, some)]


def test_counts_do_not_depend_on_table_sizes():
    some = texts(2, 300)
    small = token_counts.TextCounter(WORDS)
    small.words = token_counts.WordCounts(token_counts.Counter(load_merges(WORDS), max_states=5))
    assert small.counts(some) == token_counts.text_counter(WORDS).counts(some)


@pytest.mark.parametrize("chunk", [1, 2, 3, 17, 128])
def test_splitter_scan_equals_one_state_after_the_other(chunk):
    rng = np.random.default_rng(chunk)
    classes = rng.choice(len(token_counts.CLASSES), 2000, p=[.1, .2, .1, .1, .2, .06, .06, .06, .06, .06]).astype(np.uint8)
    step, mark = token_counts.splitter()
    want, state = np.zeros(len(classes) + 1, bool), 0
    for i, c in enumerate([*classes, token_counts.SPACE]):
        said = mark[state, c]
        want[i] |= bool(said & token_counts.HERE)
        want[i - 1] |= bool(said & token_counts.BACK)
        state = step[state, c]
    assert (token_counts.word_starts(classes, chunk) == want[:-1]).all()


def test_state_maps_compose_like_running_on():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 7, (37, 7)).astype(np.uint8)
    want = [maps[0]]
    for m in maps[1:]:
        want.append(m[want[-1]])
    assert (token_counts.prefix_scan(maps) == np.array(want)).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    some = [" ".join(texts(3, 200)), "wörd " * 3000]
    monkeypatch.setattr(token_counts, "PIECE", 500)
    assert token_counts.TextCounter(WORDS).counts(some) == [len(x) for x in expected(WORDS, some)]


def test_encoding_and_decoding_equal_the_library():
    some = texts(4)
    c, tok = bpe.coder(BYTES), Tokenizer.from_file(BYTES)
    want = expected(BYTES, some)
    assert [c.encode(t) for t in some] == want
    assert all(c.decode(x) == tok.decode(x, skip_special_tokens=False) for x in want[::7])
    assert c.decode([128, 200, 300]) == tok.decode([128, 200, 300], skip_special_tokens=False)


def test_pair_test_agrees_with_merging():
    c, tok = bpe.coder(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(5)
    plain = [i for i, s in c.merges.text.items() if s.isalpha() and s.isascii()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        joined = tok.encode(c.merges.text[a] + c.merges.text[b], add_special_tokens=False).ids
        assert c.merges.fits(a, b) == (joined == [a, b])


def test_count_query_columns_on_messy_rows(docs, messy):
    got = sorted(map(tuple, token_counts.token_counts(docs(messy, clash=True), WORDS).collect()), key=str)
    n = [len(x) for x in expected(WORDS, [t or "" for _, t in messy])]
    assert got == sorted(((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(messy, n, strict=True)), key=str)


def test_bpe_query_columns_on_messy_rows(docs, messy):
    out = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    got = sorted(map(tuple, bpe.encode_decode(docs(messy, clash=True), BYTES, out).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x), sha(",".join(map(str, x))), sha(t or ""), x, t or "") for (i, t), x in zip(messy, expected(BYTES, [t or "" for _, t in messy]), strict=True)]
    assert got == sorted(want, key=str)


def test_empty_tables(docs):
    assert token_counts.token_counts(docs([]), WORDS).count() == 0
    assert bpe.encode_decode(docs([]), BYTES).count() == 0


def test_registered_queries_equal_the_library(spark, sf):
    import __spark_entry__ as entry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = expected(WORDS, [t for _, t in rows])
    got = {r.doc_id: r.n_tokens for r in entry.queries()["op1_token_counts"](spark, sf).collect()}
    assert got == {i: len(x) for (i, _), x in zip(rows, counts, strict=True)}
    coded = expected(BYTES, [t for _, t in rows])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op5_bpe"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(t)) for (i, t), x in zip(rows, coded, strict=True)}
