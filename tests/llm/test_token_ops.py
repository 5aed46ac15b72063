"""Token memo, packing, token store, top-k: round trips and brute force."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward, frame, prose
from orrery.llm import packing, queries, token_store, tokens, topk
from tokenizers import Tokenizer

BYTE, WORDS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
ODD = ["", " a", "a ", "a  b", "x\n\ny", "Don't stop, İstanbul. ΑΣ ΣΑΣ, été.", "a b", "<|endoftext|> hi", "tab\there", ",", ". .", "ß. ñ,", "A,\nB.", "1,2 3.", "\0x y", "你好, 世界。", "ﬁne, x", "ʰa, ª, º.", "é É,", "x.,", "word,,"]


@pytest.mark.parametrize("path,style", [(BYTE, "byte"), (WORDS, "word")])
def test_memo_equals_the_tokenizer(path, style, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 4000)
    texts = [*ODD, *(t or "" for _, t, *_ in awkward()), prose(5, 300)]
    model = Tokenizer.from_file(path)
    got = tokens.TokenIds(path, style).of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path,style", [(BYTE, "byte"), (WORDS, "word")])
def test_any_order_of_texts_equals_the_tokenizer(path, style, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 60_000)
    rng = np.random.default_rng(7)
    parts = ["a", "The", "Z", "é", "e\u0301", "İ", "ß", "ı", "\u0307", "\u0338", "Σ", "ﬁ", "Ⅷ", "１", "9", ".", ",", "!", "'s", "’", "\n", " ", " ", "  ", "\t", "\xa0", "\u2009", "\u3000", "\x1c", "\u200b", "中", "한", "अ", "ि", "𝐀", "😀", "<|endoftext|>", "|", "-", "\0", "\x85", "Å", "x", "ing"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(6000)]
    texts += ["İ", "İ,", "i\u0307,", "İ.", "x\u0338,", "x ,", "İ İ,"]
    model, ids = Tokenizer.from_file(path), tokens.TokenIds(path, style)
    for _ in range(2):
        rng.shuffle(texts)
        want = [np.array(x.ids, "<u4").tobytes() for x in model.encode_batch(texts, add_special_tokens=False)]
        assert [x for i in range(0, len(texts), 500) for x in ids.of(texts[i : i + 500])] == want


def _best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [40, 101, 60, 15, 101, 99][seed], 500).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, seen = {}, {}
    for length, rank, n, first, offset in packing.plan(counts, 100):
        for k in range(n):
            seen.setdefault(length, []).append(rank + k)
            filled.setdefault(first + k, []).append((offset, length))
    assert all(sorted(seen[x]) == list(range(counts[x])) for x in counts)
    rooms = []
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100
        rooms.append(100 - at)
    assert sorted(rooms) == _best_fit(lengths, 100)


def test_pieces_are_packed_without_gaps(spark):
    rows = awkward()
    out = packing.pack(frame(spark, rows), BYTE, capacity=64).collect()
    model = Tokenizer.from_file(BYTE)
    whole = {}
    for i, t, *_ in rows:
        whole.setdefault(i, []).append([*model.encode(t or "", add_special_tokens=False).ids, 2])
    for i, copies in whole.items():
        mine = [r for r in out if r.doc_id == i]
        ids = copies[0]
        n = -(-len(ids) // 64)
        assert len(mine) == n * len(copies)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 64 or r.piece == 0
        if i != 2:
            assert sorted((r.piece, r.start, r.length) for r in mine)[-1][1] + sorted((r.piece, r.start, r.length) for r in mine)[-1][2] == len(ids)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == len(_best_fit([r.length for r in out], 64))


def test_place_over_many_shards(spark):
    df = packing.pieces(frame(spark, [(i, prose(i, 1 + i % 7)) for i in range(200)]), BYTE)
    a = packing.place(df, shard_rows=5).collect()
    assert len({(r.sequence_id, r.offset) for r in a}) == 200


@pytest.mark.parametrize("n", [0, 1, 31, 5000, 16_384, 40_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 5000
    coder = token_store.Coder(token_store.scaled(np.bincount(ids, minlength=5000) if n else np.ones(5000)))
    data = b"".join(token_store.dump_segment(coder, [None, 5], [0, n], ids))
    names, lengths, back = token_store.load_segment(coder, data)
    assert names == [None, 5] and lengths.tolist() == [0, n] and (back == ids).all()
    if n > 4000:
        assert len(data) < 2 * n
        with pytest.raises(token_store.Broken):
            token_store.load_segment(coder, data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_one_symbol_and_frequencies():
    coder = token_store.Coder(token_store.scaled(np.array([0, 7, 0])))
    ids = np.ones(1000, np.int64)
    assert (token_store.load_segment(coder, b"".join(token_store.dump_segment(coder, [1], [1000], ids)))[2] == 1).all()
    f = token_store.scaled(np.array([10**9, 1, 0, 3]))
    assert f.sum() == 1 << token_store.SCALE and f[1] >= 1 and f[2] == 0


def test_store_reads_back_all_ids(spark):
    rows = awkward()
    docs = frame(spark, rows)
    folder = token_store.scratch(spark, "tokens")
    manifest = token_store.write_store(docs, WORDS, folder, segment_tokens=5000)
    assert manifest.count() > 2
    got = sorted(token_store.read_store(spark, folder, manifest, with_ids=True).collect(), key=lambda r: r.start)
    model = Tokenizer.from_file(WORDS)
    want = sorted(((i, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want):
        assert r.start == at and r.n_tokens == len(ids)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(ids)


def _top(vectors, k):
    ints = [(i, np.floor(1024 * np.asarray(v, float)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, w in ints:
        if q % 100 == 0:
            best = sorted(((int(v @ w), i) for i, v in ints if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [40, 8192])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(301)]
    rows += [(400 + i, [0.5] * 8) for i in range(20)] + [(500, [0.5] * 8), (600, None), (601, [1.0, None] * 4), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.5] * 8), (700, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), block_rows=blocks, query_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == _top(rows, 10)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (101, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 100")).collect()] == [(100, 1, 101, 1024 * 1024)]
    none = df.where("false")
    assert topk.top_k(none, none).count() == 0
    empty = frame(spark, [])
    assert packing.pack(empty, BYTE).count() == 0 and token_store.store_and_read(empty, WORDS).count() == 0


def _top_of_rows(vectors, k=10):
    """Brute force by row in whole numbers; every row but the query's own is a candidate."""
    ints = [(i, [math.floor(Fraction(c) * 1024) for c in v]) for i, v in vectors]
    long = 2**63
    out = []
    for at, (q, w) in enumerate(ints):
        if q % 100 == 0:
            scored = [(sum(a * b for a, b in zip(v, w)), i) for j, (i, v) in enumerate(ints) if j != at]
            out += [(q, r + 1, i, min(max(s, -long), long - 1)) for r, (s, i) in enumerate(sorted(scored, key=lambda c: (-c[0], c[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [8, 8192])
@pytest.mark.parametrize("case", ["twins", "large", "vast"])
def test_top_k_of_twins_and_of_large_components(spark, case, blocks):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(195, 230)]
    if case == "twins":
        rows += [(200, [3.0, 0.0, 0.0, 1.0]), rows[5], rows[5], (201, [1.0] * 4), (201, [1.0] * 4), (300, [2.0] * 4), (300, [2.0] * 4)]
    elif case == "large":
        rows += [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(290, 320)]
    else:
        rows += [(230 + i, [s * 10.0**e, 0.0, -1.0, 2.0]) for i, (s, e) in enumerate((s, e) for s in (1, -1) for e in (15, 16, 30, 200, 300, 308))] + [(300, [1e15, 1.0, 2.0, 3.0]), (400, [-1e308, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), block_rows=blocks, query_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == _top_of_rows(rows)


def test_packing_leaves_no_memo_in_idle_workers(spark):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert packing.pieces(docs, BYTE).count() >= 20

    def left(batches):
        from orrery.llm import tokens

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._kept)] * n), pa.array([sum(len(x.memo) for x in tokens._kept.values())] * n)], ["kept", "memo"])

    rows = spark.range(1).coalesce(1).mapInArrow(left, "kept long, memo long").collect()
    assert [(r.kept > 0, r.memo) for r in rows] == [(True, 0)]
