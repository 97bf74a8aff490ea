import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from cribra.llm import bpe, token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read(), P.PATTERN)


def test_matches_rank_merging_on_odd_texts(reference, codec):
    rng = random.Random(7)
    odd = [chr(i) for i in range(1, 0x180)] + list("   　​﻿日本é́😀")
    texts = ["", " ", "\n\n", "a\x1c \x1c1", "it's we'll 'S", "a" * 5000, "-" * 777, "ab" * 400]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 4))) * rng.randint(1, 50)
              for _ in range(2000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode_bytes(ids) == t.encode()


def test_other_patterns_match_whole_texts(reference):
    pattern = r"\S+\s*|\s+"  # a match holds white space after other characters
    with open(PATH, "rb") as f:
        data = f.read()
    own = bpe.codec(data, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("one two  three\n\nfour ", " x", "", "a\tb c"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_offsets_cover_split_characters(codec):
    text = "a 😀é x"
    ids = codec.encode(text)
    spans = codec.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (s, e), i in zip(spans, ids):
        assert codec.token_bytes[i] in text[s:e].encode()
    assert codec.offsets("", []).shape == (0, 2)
    cut = codec.encode("😀")
    assert len(cut) > 1 and codec.decode(cut[:1]) == "�"


def test_operator_handles_nulls_and_extra_columns(make, codec):
    rows = [(1, None, 1, "x"), (2, "", 2, "y"), (None, "a b", 3, "z"), (2, "a b", 4, None)]
    docs = make(rows, "doc_id long, text string, n_tokens int, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    ab = tuple(codec.encode("a b"))
    assert got == {(1, ()), (2, ()), (None, ab), (2, ab)}
    full = bpe.encode(docs, PATH, P.PATTERN, with_offsets=True).collect()
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in full)
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(r.decoded_text for r in back) == ["", "", "a b", "a b"]
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_equals_reference_library(spark, sf, reference):
    from cribra.llm.queries import op5_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _limits(lengths):
    out = []
    for x in sorted(set(lengths)):
        within = [n for n in lengths if n <= x]
        out.append((x, lengths.count(x), len(within), len(lengths) - len(within), sum(within),
                    sum(min(n, x) for n in lengths), len(lengths), sum(lengths)))
    return out


def _rows(df):
    return [(r.length, r.n_docs, r.docs_within, r.docs_over, r.tokens_within, r.truncated_tokens,
             r.total_docs, r.total_tokens) for r in df.orderBy("length").collect()]


def test_limits_against_brute_force(make):
    rng = random.Random(3)
    lengths = [0, 0, 1023, 1024, 1025, 5000] + [rng.randint(0, 9000) for _ in range(400)] + [7] * 300
    df = make([(n,) for n in lengths], "n_tokens long")
    out = token_counts.limits(token_counts.histogram(df))
    assert _rows(out) == _limits(lengths)
    assert token_counts.limits(token_counts.histogram(df.limit(0))).count() == 0


def test_token_count_query(spark, sf, reference):
    from cribra.llm.queries import op2_token_counts

    lengths = [len(reference.encode_ordinary(r.text or ""))
               for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert _rows(op2_token_counts(spark, sf)) == _limits(lengths)
