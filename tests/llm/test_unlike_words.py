"""Words that a weak hash takes for one another: Thue-Morse words and their complements."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayline.llm import _bytes as B, queries
from assayline.llm.near_dup import near_duplicates

from .plain import brute_components, rule_counts


def _pair(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [_pair(1 << k) for k in range(8, 14)]


def test_hashes_differ():
    words = [w for pair in PAIRS for w in pair] + ["", "a", "ab", "a" * 8, "a" * 9, "a" * 128, "a" * 129, "b" + "a" * 128]
    data = " ".join(words).encode()
    raw = np.frombuffer(data, np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    got = B.span_hashes(raw, start, start + size)
    assert len(set(got.tolist())) == len(words)
    # A span's hash is that of its bytes, wherever they stand, folded or not.
    for word, h in zip(words, got):
        shifted = np.frombuffer(f"xyz {word.upper()} end".encode(), np.uint8)
        at = np.array([4])
        assert B.span_hashes(shifted, at, at + len(word), fold=True)[0] == h


@pytest.fixture
def folder(spark, tmp_path):
    rows = []
    for i, (a, b) in enumerate(PAIRS):
        rows += [(10 * i, f"{a} {b}"), (10 * i + 1, f"{b} {a}"), (10 * i + 2, f"{a}\n{b}\n{a}"), (10 * i + 3, f"{a} x {b} x {a} y"), (10 * i + 4, a), (10 * i + 5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), sorted(rows)


def test_token_ids(spark, folder):
    path, rows = folder
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, (i, text) in zip(queries.op1_token_ids(spark, path).orderBy("doc_id").collect(), rows, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_near_duplicates_and_rules(spark, folder):
    path, rows = folder
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert got == want
    rules = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in queries.op9_host_rules(spark, path).collect()}
    assert rules == {i: rule_counts(t) for i, t in rows}
