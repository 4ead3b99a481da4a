"""Encoding, token files and packing: exact round trips and brute force."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartograph.llm import packing, wavelet
from cartograph.llm.tokens import Encoder, encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}


def whole(f, text):
    t = Tokenizer.from_file(public_tokenizers.path(f))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


WHOLE = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " \n ", " ", "　", " ", "\x1c", "\x85", "a", "It's", "'", "Σ",
                                 "ΑΣ", "é", "é", "́", "12", "?!", "...", "ß", "İ", "<|endoftext|>", "語"]) | st.text(max_size=4),
                max_size=14))
def test_pieces_equal_whole_texts(f, parts):
    text = "".join(parts)
    WHOLE[f].encode_special_tokens = True
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert ENCODERS[f].batch([text])[0].tolist() == WHOLE[f].encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (1000, 2), (200_000, 50257)])
def test_wavelet_matrix(n, sigma):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, sigma, n).astype(np.uint32)
    m = wavelet.Matrix(wavelet.build(tokens, np.array([3, 9]), np.array([n // 2, n])))
    assert (m.tokens() == tokens).all() and m.doc_ids.tolist() == [3, 9]
    for i in rng.integers(0, n, 20) if n else []:
        t = int(tokens[i])
        assert m.access(int(i)) == t
        assert m.rank(t, int(i)) == (tokens[:i] == t).sum() and m.rank(t) == (tokens == t).sum()
        assert m.select(t, int((tokens[:i] == t).sum())) == i
    assert m.rank(sigma + 70000) == 0
    with pytest.raises(IndexError):
        m.select(1 << 20, 0)


EDGE = [(4, "b text", 1), (2, None, 2), (2, "", 3), (None, "null id", 4), (9, "word " * 5000, 5), (2, "same", 6), (2, "same", 7)]


def test_token_files_round_trip(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, start int")
    got = sorted(wavelet.round_trip(df, public_tokenizers.path(FILES[0])).collect(), key=lambda r: r.start)
    docs = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(docs)
    sizes = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    want = []
    for i, t, _ in docs:
        ids = np.array(whole(FILES[0], t), "<u4")
        want.append((-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes())))
    assert sizes == sorted(want)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == [None, 2, 2, 2, 2, 4, 9]
    assert wavelet.round_trip(df.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_token_query_matches_whole_texts(spark):
    from cartograph.llm.queries import op5_token_files
    got = {r.doc_id: r for r in op5_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for d in docs:
        ids = np.array(whole(FILES[0], d.text), "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(got, ids_of):
    """``got`` pieces against the ids of every document."""
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    return docs, used


def test_packing_query(spark):
    from cartograph.llm.queries import op10_packing
    got = op10_packing(spark, "/root/testdata/sf0.001").collect()
    docs, used = check_packing(got, None)
    total = 0
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(whole(FILES[1], d.text), "<u4")
        parts = sorted(docs[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048))
        for r in parts:
            own = ids[r.start:r.start + 2048]
            assert r.length == len(own) and r.ids_crc32 == zlib.crc32(own.tobytes())
        total += len(ids)
    assert len(used) <= 1.02 * total / 2048 + 2


def test_packing_edges_and_sequences(spark):
    df = spark.createDataFrame([r for r in EDGE if r[2] != 7], "doc_id long, text string, offset int")
    packed = packing.pack(df, public_tokenizers.path(FILES[1]))
    got = packed.pieces.collect()
    docs, used = check_packing(got, None)
    assert sorted(len(v) for v in docs.values()) == [1, 1, 3, 3]
    seqs = {r.sequence_id: r for r in packing.pack(df.where("doc_id = 9 or doc_id = 4"), public_tokenizers.path(FILES[1])).sequences().collect()}
    assert sum(len(r.ids) // 2 for r in seqs.values()) == 5001 + len(whole(FILES[1], "b text"))
    assert packing.pack(df.limit(0), public_tokenizers.path(FILES[1])).pieces.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_length_and_packs_well(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 2048])
    counts = {}
    for _ in range(rng.choice([1, 50, 3000])):
        n = min(cap, max(1, int(rng.lognormvariate(5, 1.2)) if cap == 2048 else rng.randint(1, cap)))
        counts[n] = counts.get(n, 0) + rng.choice([1, 1, 2, 900])
    patterns = packing.plan(counts, cap)
    seen = {}
    for times, lengths in patterns:
        assert times > 0 and sum(lengths) <= cap and sum(3 * n > cap for n in lengths) <= 2
        for n in lengths:
            seen[n] = seen.get(n, 0) + times
    assert seen == counts
    assert len(patterns) <= 6 * cap + 6
    assert sum(t for t, _ in patterns) <= 1.3 * sum(n * c for n, c in counts.items()) / cap + sum(
        c for n, c in counts.items() if 2 * n > cap) + 2


MARKED = [(1, "a <|endoftext|> b"), (2, "one<|startoftext|>two, 3\n<|endoftext|>"), (3, "A <|ENDOFTEXT|> b <|endoftext|"),
          (4, "  <|endoftext|>  x"), (5, "plain words, no marker"), (6, "<|endoftext|>" * 1500), (7, None)]


def plain(f, text):
    return Tokenizer.from_file(public_tokenizers.path(f)).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "It's", "<|", "|>", "é", "12", "?!", "<|endoftext|>", "<|startoftext|>",
                                 "<|EndOfText|>", "語"]), max_size=12))
def test_operators_encode_as_the_plain_call(f, parts):
    text = "".join(parts)
    assert encoder(public_tokenizers.path(f)).batch([text, "next"])[0].tolist() == plain(f, text)


def test_markers_in_token_files_and_packing(spark):
    df = spark.createDataFrame(MARKED, "doc_id long, text string")
    start = 0
    got = {r.doc_id: r for r in wavelet.round_trip(df, public_tokenizers.path(FILES[0])).collect()}
    for i, t in MARKED:
        ids = np.array(plain(FILES[0], t), "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = packing.pack(df, public_tokenizers.path(FILES[1])).pieces.collect()
    for i, t in MARKED:
        ids = np.array(plain(FILES[1], t), "<u4")
        assert [(r.length, r.ids_crc32) for r in pieces if r.doc_id == i] == [(len(ids), zlib.crc32(ids.tobytes()))]


def test_sequences_with_repeated_and_null_ids(spark):
    rows = [(1, "word " * 3000)] * 3 + [(None, "first null"), (None, "second null"), (1, "other text"), (2, None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path(FILES[1]))
    got = [(np.frombuffer(r.ids, "<u2").tolist(), r.pieces) for r in packed.sequences().collect()]
    assert all(len(ids) <= packing.CAPACITY for ids, _ in got)
    want = sorted(ids[k:k + 2048] for ids in (plain(FILES[1], t) for _, t in rows) for k in range(0, len(ids), 2048))
    cut = []
    for ids, pieces in got:
        at = [p.offset for p in pieces] + [len(ids)]
        cut += [ids[a:b] for a, b in zip(at, at[1:])]
    assert sorted(cut) == want and sorted(p.doc_id or 0 for _, q in got for p in q) == [0, 0, 1, 1, 1, 1, 1, 1, 1, 2]
