"""Token files, token counts and packing against the libraries themselves."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from sievewright.llm import common, encode, packing, token_counts, token_files

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "The", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "é", "ß", "Ö", "İ", "ı", "Σ", "ς", "²", "½", "7", "12", "!", "##", "_", "-", "\xa0", "\x1c", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "\0", "—", "ª", "ǅ", "٣", "\x85", "don't", " 'x", "word.", "word,", "K"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path):
    rng, tok, enc = random.Random(1), Tokenizer.from_file(path), encode.Encoder(path, keep=50)
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert enc.encode([t])[0] == array(enc.code, tok.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 70_001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    for start, n in ((0, len(ids)), (0, 0), (13, 1), (65_530, 20), (len(ids) - 3, 3)):
        assert (token_files.unpack(data, bits, start, n) == ids[start : start + n]).all()


def test_token_files(spark, docs, no_docs, texts):
    tok = Tokenizer.from_file(BYTES)
    path = common.scratch(spark, "tokens")
    token_files.write(docs, path, BYTES, 2, block_ids=700, shards=3)
    got = sorted(token_files.documents(spark, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    assert [r.doc_id for r in got] == sorted(texts, key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    whole = tok.encode(texts[22], add_special_tokens=False).ids
    assert token_files.token_range(spark, path, 22, 1000, 7).tolist() == whole[1000:1007]
    none = tok.encode(texts[None], add_special_tokens=False).ids
    assert token_files.token_range(spark, path, None).tolist() == [*none, 2] and token_files.token_range(spark, path, 22, 10**9).tolist() == []
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = token_files.blocks_of(spark, path, 22)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(low,22)" in plan and "GreaterThanOrEqual(high,22)" in plan  # pushed to the files' statistics
    with pytest.raises(KeyError):
        token_files.token_range(spark, path, 999)
    path = common.scratch(spark, "tokens")
    token_files.write(no_docs, path, BYTES, 2)
    assert token_files.documents(spark, path).count() == 0


def unigram(pieces):
    tok = Tokenizer(models.Unigram(pieces, 0, False))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    return tok


def test_counts_are_the_librarys():
    pieces = token_counts.vocabulary(PIECES)
    tok, counter, rng = unigram(pieces), token_counts.Counter(pieces, keep=100), random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice([*PARTS, "tion", "qqq", "<unk>", "▁"]) for _ in range(rng.randint(0, 14)))
        assert counter.texts([t])[0][1] == len(tok.encode(t).ids), repr(t)
    long = "日本ing<unk>tion" * 40
    assert counter.texts([long])[0][1] == len(tok.encode(long).ids) == counter.long_word(long)


def test_ties_and_unknown_runs():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    counter, tok = token_counts.Counter(pieces), unigram(pieces)
    for t in ("ab", "abab", "azzb", "zz", "z a b", "ba"):
        assert counter.texts([t])[0][1] == len(tok.encode(t).ids), t


def test_count_tokens(docs, no_docs, texts):
    tok = unigram(token_counts.vocabulary(PIECES))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert got == {i: len(tok.encode(t or "").ids) for i, t in texts.items()}
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(4)
    for _ in range(50):
        sizes, cap = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))], 40
        free, want = [cap] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            want[i] = next(b for b, f in enumerate(free) if f >= sizes[i])
            free[want[i]] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, cap) == want


def test_plan_covers_all_and_wastes_less_than_a_sequence():
    rng = random.Random(5)
    for _ in range(50):
        sizes, cap = [rng.choice([1, 3, 17, 64, 65, 200, 640]) for _ in range(rng.randint(0, 40))], 64
        held, used = {}, {}
        for d, start, n, b, offset in packing.plan(sizes, cap):
            held.setdefault(d, []).append((start, n))
            used.setdefault(b, []).append((offset, n))
        assert all(sorted(held[d])[0][0] == 0 and sum(n for _, n in held[d]) == s for d, s in enumerate(sizes))
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= cap
        assert sum(cap - sum(n for _, n in p) for p in used.values()) < cap


def test_pack_documents(docs, no_docs, texts):
    tok = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    got = packing.pack_documents(docs, WORDS, 1, capacity=128, group_bytes=3000).collect()
    seen = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens, bytes(r.ids)) == (zlib.crc32(part), len(ids[r.doc_id]), part.tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    assert packing.pack_documents(no_docs, WORDS, 1).count() == 0
