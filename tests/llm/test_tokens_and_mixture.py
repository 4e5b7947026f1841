import random

import numpy as np
import pytest

from quern.llm import mixture, tokens
from quern.llm.bpe import MergeAutomaton, WordCodes, load_ranks, split_words

RANKS = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = [None, "", " ", "\r\n \t x", "a\x1cb\x1d c", "don't 'S's", "<|endoftext|>", "½²٣ 五千", "é̀ ﬀ…", "\U0001f468‍\U0001f469", "a" * 5000, "\x00\x01", "x  　y"]


def plain_bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The textbook loop: merge the pair of the least rank until none is left."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_automaton_of_a_tiny_vocabulary_equals_the_loop():
    labels = [b"a", b"b", b"c", b"aa", b"ab", b"bc", b"aab", b"abc", b"aabc"]
    ranks = {b: i for i, b in enumerate(labels)}
    automaton = MergeAutomaton(labels)
    rng = random.Random(3)
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert automaton.encode_word(word) == plain_bpe(word, ranks)
        assert automaton.decode(automaton.encode_word(word)) == word


def test_encoding_equals_the_library_and_decodes_back(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeft \n\t'\"0129._-éß中́\xa0SL") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(5, ODD[5], "again")], "doc_id long, text string, ids string")
    got = tokens.encode(df, "text", "doc_id")
    assert got.count() == len(texts) + 1
    for r in got.collect():
        t = texts[r.doc_id]
        assert list(r.ids) == (reference.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc_id: r.text for r in tokens.decode(got, "ids", "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    assert all(counts[r.doc_id] == len(r.ids) for r in got.collect())
    assert tokens.encode(df.limit(0), "text", "doc_id").count() == 0


def test_words_give_the_text_back():
    for t in ODD:
        assert "".join(split_words(t or "")) == (t or "")
    assert np.frombuffer(WordCodes(load_ranks(RANKS))[" the"], "<i4").tolist() == [262]


def test_pivot_keeps_the_sum_and_the_expectations():
    rng = np.random.default_rng(1)
    p = rng.random(60)
    total = np.zeros(60)
    for i in range(3000):
        out, held = mixture.pivot(p, rng.random(60))
        assert out.sum() == pytest.approx(p.sum())
        assert sum(0 < x < 1 for x in out) <= 1
        total += out
    assert np.abs(total / 3000 - p).max() < 0.06


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaab"), rng.randint(1, 60)) for i in range(4000)] + [(9000, "c", 50), (9001, None, 10), (9002, "unlisted", 10), (9003, "a", 0)]
    df = spark.createDataFrame(docs + docs[:50], "doc_id long, source string, n_tokens long").repartition(7)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.45, 2), ("c", 0.05, 8), ("none", 0.2, 3), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    mixed, shares = mixture.mix(df, targets, fan_in=3)
    got = {r.source: r for r in shares.collect()}
    assert got["none"].mixed_docs == 0 and got["zero"].actual_share == 0
    assert got["c"].most_copies <= 8
    small, _ = mixture.mix(df, targets, total=20_000)
    assert {r.doc_id for r in small.collect()} <= {d[0] for d in docs}
    big, big_shares = mixture.mix(df.where("source <> 'c'"), targets)
    for r in big_shares.where("target_share > 0").collect():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.01) and r.most_copies <= r.max_repeats
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, mixture.mix(df.where("source <> 'c'"), targets)[0].collect()))
    none, none_shares = mixture.mix(df.limit(0), targets)
    assert none.count() == 0 and none_shares.count() == 5


def test_vocabularies_of_one_size_are_told_apart(spark, tmp_path):
    import base64

    from quern.llm import tokens

    def ranks(name, merges):
        words = [bytes([i]) for i in range(256)] + merges
        (tmp_path / name).write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate(words)))
        return str(tmp_path / name)

    df = spark.createDataFrame([(1, "abc")], "k int, text string").coalesce(1)
    for name, merges, ids in (("a", [b"ab"], [256, 99]), ("b", [b"bc"], [97, 256])):
        assert tokens.encode(df, "text", "k", ranks(name, merges)).first().ids == ids
