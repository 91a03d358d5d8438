import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from assayline.llm import bpe_transducer as T, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARAMS = T.BpeParams(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=T.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(PARAMS)


def _ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_equals_library(encoder, library):
    rng = random.Random(3)
    unlike = sorted(encoder.stand_ins) or [0x41]
    alphabets = ["abcdeghinorst ", "the and ing 's't'll \n ", "äöüßéèñ€ ", "日本語中文한국 ", "\U0001f642\U0001f44d\U0001f3fd‍̃", " \t\n\r\x0b\x0c\x85\xa0　", "0123½²", "!?.,;#<|endoftext|>"]
    for _ in range(3000):
        some = "".join(rng.sample(alphabets, rng.randint(1, 3)))
        text = "".join(rng.choice(some) if rng.random() < 0.95 else chr(rng.choice([rng.choice(unlike), rng.randrange(0x80, 0xD800)])) for _ in range(rng.randint(0, 50)))
        assert _ids(encoder, text) == library.encode_ordinary(text), text


def test_long_matches_and_few_states(encoder, library):
    rng = random.Random(4)
    tight = T.Encoder(T.BpeParams(RANKS, public_tokenizers.PATTERN, max_states=50, max_matches=20))
    tight.long_text = 100
    for letters in ("ab", "etaoinshrdlu", "a", "é日a"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert _ids(encoder, text) == _ids(tight, text) == library.encode_ordinary(text)
    words = " ".join("".join(rng.choice("etaoin\U0001ed57") for _ in range(rng.randint(1, 9))) for _ in range(500))
    assert _ids(tight, words) == library.encode_ordinary(words)
    assert len(tight.matches.transducer.whats) < 5000


def test_small_vocabularies():
    """Vocabularies with tokens that don't stand, against plain merging."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        order = [*sorted(tokens), *rng.sample(sorted(more), len(more))]
        ranks = {t: i for i, t in enumerate(order)}
        machine = T.Transducer(ranks, 1 << 10)
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=(1 << 40, 0))
                if best[0] == 1 << 40:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert machine.encode(data).tolist() == [ranks[p] for p in parts]


def test_first_bytes_are_read_in_one_step(encoder, library):
    """Words that begin alike go on from one kept state, whatever has been forgotten meanwhile."""
    rng = random.Random(8)
    machine = T.Transducer(T.read_ranks(RANKS), 60)
    begins = [" enthou", "straße", " xqzéé", "日本語", "ab"]
    for _ in range(2000):
        word = rng.choice(begins) + "".join(rng.choice("aeionrstß") for _ in range(rng.randint(0, 8)))
        match = library.encode_ordinary(word)
        if word.encode() not in machine.merges.ranks:
            assert machine.encode(word.encode()).tolist() == match, word
        assert len(machine.starts) <= 60
    assert machine.starts and all(len(first) <= 6 for first in machine.starts)
    at, ids = next(iter(machine.starts.values()))
    assert at % 256 == 0 and at >> 8 < len(machine.whats)


def test_streaming_decode():
    rng = random.Random(6)
    for _ in range(4000):
        data = bytes(rng.choice([rng.randrange(256), 0xE0, 0x80, 0x9F, 0xF0, 0x90, 0xED, 0xA0, 0xF4, 0xEF, 0xBF, 0xBD, 65]) for _ in range(rng.randint(0, 20)))
        machine, out, at = T.Utf8Machine(), "", 0
        while at < len(data):
            n = rng.randint(1, 5)
            out, at = out + machine.feed(data[at : at + n]), at + n
        assert out + machine.finish() == data.decode("utf-8", "replace")
    decoder = T.Decoder(T.BpeParams(RANKS, public_tokenizers.PATTERN, step_ids=1))
    with pytest.raises(KeyError):
        decoder.decode(np.array([10**6], "<u4"))


def _expected(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_and_edges(spark, tmp_path, library):
    rows = [(1, "Hello  world\n\n'tis 日本語 ��"), (2, None), (3, ""), (None, "null id"), (4, "long text " * 150_000), (4, "x" * 200_000), (5, "same"), (5, "same"), (6, " \U0001ed57׌")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as ids", "'x' as n_tokens", "1 as broken")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_bpe(spark, str(tmp_path)).drop("broken").collect()), key=str)
    assert got == sorted((_expected(library, *r) for r in rows), key=str)
    assert T.decode_bpe(T.encode_bpe(df.limit(0), PARAMS), PARAMS).count() == 0
    plan = T.encode_bpe(df, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_worker_a_task(spark, tmp_path):
    """Encoding and decoding in two steps keeps two Python workers a task, each with tables of its own."""
    rows = [(i, t) for i, t in enumerate(["", None, "ab " * 500, "日本語 \U0001ed57", "x" * 70_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op11_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both, steps = T.bpe_round_trip(df, PARAMS), T.decode_bpe(T.encode_bpe(df, PARAMS), PARAMS)
    assert both.schema == steps.schema and sorted(both.collect()) == sorted(steps.collect())
    assert [r["text"] for r in both.orderBy("doc_id").collect()] == [t or "" for _, t in rows]
