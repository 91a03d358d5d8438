import itertools
import random
import re
import zlib

import numpy as np
import pytest

from assayline.llm import chat_format as chat, id_coder
from assayline.llm.licenses import TEMPLATES, scan_licenses


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_ids_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 50000).astype(np.uint32)
    assert (id_coder.decode(id_coder.encode(ids, 512)) == ids).all()


def test_wide_ids_and_damage():
    ids = np.array([2**32 - 1, 0, 70000] * 40, np.uint32)
    data = bytearray(id_coder.encode(ids, 64))
    assert (id_coder.decode(bytes(data)) == ids).all()
    data[-3] ^= 4
    with pytest.raises(ValueError):
        id_coder.decode(bytes(data))
    with pytest.raises(ValueError, match="short"):
        id_coder.decode(bytes(data[:-1]))
    assert len(id_coder.encode(np.zeros(4096, np.uint32))) < 600


def test_blocks_stand_alone_and_any_ids_return():
    rng = np.random.default_rng(7)
    for ids in (rng.integers(0, 2**32, 70_000), rng.integers(0, 300_000, 300_000), np.repeat(rng.integers(0, 9, 900), 50), np.arange(5000) % 7):
        ids = ids.astype(np.uint32)
        assert (id_coder.decode(id_coder.encode(ids, 300)) == ids).all()
    # A block repeated among others is coded into the same bytes, as it is coded from nothing but itself and the group's table.
    block = rng.integers(0, 50, 256).astype(np.uint32)
    other = rng.integers(0, 50, 256).astype(np.uint32)
    source = id_coder._Reader(id_coder.encode(np.concatenate([block, other, block]), 256))
    source.take(id_coder._HEAD.size)
    n, _, size, _ = id_coder._GROUP.unpack(source.take(id_coder._GROUP.size))
    source.take(size)
    rows = [id_coder._BLOCK.unpack(source.take(id_coder._BLOCK.size)) for _ in range(n)]
    first, _, third = [source.take(row[1]) for row in rows]
    assert first == third


def test_an_id_that_context_foretells_costs_less():
    rng = np.random.default_rng(8)
    follows = rng.integers(0, 2000, 2000)
    chain = np.zeros(60_000, np.uint32)
    for i in range(1, len(chain)):
        chain[i] = follows[chain[i - 1]] if rng.random() < 0.9 else rng.integers(0, 2000)
    assert len(id_coder.encode(chain)) < 0.85 * len(id_coder.encode(rng.permutation(chain)))


@pytest.mark.parametrize("cache_bits", [3, 21])
def test_pieces_have_the_ids_of_whole_texts(cache_bits):
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from assayline.llm.token_output import Encoder, TokenParams

    rng = random.Random(11)
    atoms = ["a", "word", "Zé", "é", "ñ", "×", "÷", "ɐ", "漢", " ", "  ", "\n", "\t", ",", ".", "'", "'s", "'ll", "!?", "12", "x9", "<|endoftext|>", "\xa0", "\x85", "%", "_", "\U0001f600"]
    texts = ["".join(rng.choices(atoms, [9 if x == " " else 1 if x[0] == "<" else 3 for x in atoms], k=rng.randrange(60))) for _ in range(4000)] + [None, ""]
    encoder = Encoder(TokenParams(tokenizer=P.path("byte_bpe_50k.json"), cache_bits=cache_bits))
    # With few places pieces push each other out and are all forgotten now and then; the last part meets pieces known before.
    for half in (texts[:2000], texts[2000:], texts[:2000]):
        ids, counts = encoder.encode(pa.array(half))
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in half]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain.from_iterable(want))


def test_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from assayline.functions.scratch import scratch_path
    from assayline.llm.token_output import TokenParams, ids_round_trip, read_ids, write_ids

    path = P.path("byte_bpe_50k.json")
    texts = ["", None, " a  b   c\n d", "it's  we'll 12 34", "<|endoftext|> x", "a <|endoftext|> b c d", "more words <|endoftext|><|endoftext|> and <|endoftext|>", "plain words between", "tab\t x", "é ñ 漢 字 a", "a\x1c b \x85 c \xa0 d", "x \U0001f600 y", "w " * 9000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "again"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as data", "2 as start").repartition(3)
    params = TokenParams(tokenizer=path, block_ids=256, segment_ids=1000)
    tokenizer = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in ids_round_trip(df, params).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    folder = scratch_path(spark, "test")
    write_ids(df, folder, params)
    assert sum(len(r["ids"]) for r in read_ids(spark, folder).collect()) == start
    assert ids_round_trip(df.limit(0), params).count() == 0


def test_licenses_against_brute_force(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["the", "of", "work", "under", "license", "x1", "größe"]) for _ in range(n))
    docs = [(None, None), (1, ""), (2, "MIT"), (3, "x " * 2000)]
    for i, text in enumerate(TEMPLATES.values()):
        words = text.split()
        docs.append((10 + i, filler(30) + "\n" + text + "\n" + filler(30)))
        docs.append((40 + i, text.upper()))
        docs.append((70 + i, " ".join(words[: max(5, int(len(words) * 0.9))])))
        docs.append((100 + i, " ".join(words[: len(words) // 2])))

    def shingles(text):
        words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    want = {}
    for i, text in docs:
        have = shingles(text)
        for name, template in TEMPLATES.items():
            need = shingles(template)
            if 100 * len(need & have) >= 75 * len(need):
                want[i, name] = len(need & have) / len(need)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as license_id", "2 as m")
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in scan_licenses(df).collect()}
    assert got == pytest.approx(want)
    assert scan_licenses(df.limit(0)).count() == 0 and scan_licenses(df, {"short": "two words"}).count() == 0


def _legal(roles):
    return re.fullmatch("s?(ua)+", "".join(r[0] for r in roles)) is not None


def _least(roles, p):
    """The least cost over all relabellings, merges and insertions of a short conversation."""
    best = 10**9
    for as_ in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        base = sum(0 if a == r else p.relabel if r in chat.ROLES[1:] else p.relabel_unknown for a, r in zip(as_, roles))
        states = {(): 0}
        for a in as_:
            after = {}
            for done, cost in states.items():
                if done and done[-1] == a:
                    after[done] = min(after.get(done, 10**9), cost + p.merge)
                for extra in ((), ("user",), ("assistant",)):
                    new = (*done, *extra, a)
                    ok = all(x == "user" if i == 0 or new[i - 1] in ("system", "assistant") else x == "assistant" for i, x in enumerate(new) if not (i == 0 and x == "system"))
                    if ok:
                        after[new] = min(after.get(new, 10**9), cost + p.insert * len(extra))
            states = after
        for done, cost in states.items():
            for extra in ((), ("assistant",), ("user", "assistant")):
                if _legal((*done, *extra)):
                    best = min(best, base + cost + p.insert * len(extra))
    return best


def test_chat_repair(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "tool", None, "User"]
    rows = [(c, t, rng.choice(roles), f"t{t}") for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "lost"), (900, None, "user", None), (900, 2, "user", "b"), (900, 2, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as _g")
    p = chat.ChatParams()
    costs = []
    for params in (p, chat.ChatParams(whole_turns=1)):
        got = chat.repair_chats(df, params).toPandas().sort_values(["chunk", "seq"])
        assert len(got) == len(rows)
        assert sum(got["cost"]) == sum(
            _least([(r or "").lower() for _, _, r, _ in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))], p)
            for c in {r[0] for r in rows}
        )
        for _, own in got.groupby("conv_id", dropna=False):
            text = "".join(own["piece"])
            assert _legal(re.findall(r"<\|(system|user|assistant)\|>\n", text)) and text.count("<|end|>") == len(re.findall(r"<\|(system|user|assistant)\|>", text))
        costs.append(sorted(map(str, got.sort_values(["chunk", "seq"])[["conv_id", "turn", "role", "repaired_role", "action", "inserted", "cost", "piece"]].values.tolist())))
    assert costs[0] == costs[1]
    assert chat.repair_chats(df.limit(0)).count() == 0


def test_long_conversations_are_repaired_like_whole_ones(spark):
    rng = random.Random(60)
    roles = ["user", "assistant", "system", "tool", None]
    rows = [(c, t, rng.choice(roles), f"t{t}") for c in range(300) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    shown = ["conv_id", "turn", "repaired_role", "action", "inserted", "cost", "piece"]
    whole, cut = (sorted(map(tuple, chat.repair_chats(df, chat.ChatParams(whole_turns=n)).select(*shown).collect())) for n in (12, 11))
    assert whole == cut and len(whole) == len(rows)
