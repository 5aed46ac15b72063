"""Substring dedup, Jaccard join, line dedup, mix, quality, against brute force and on awkward tables."""

import hashlib
import random
import re

import pytest
from fixtures import awkward, frame, jaccard_components, prose, repeats, shingles
from orrery.llm import line_dedup, mixing, ngram_join, quality, suffix_dedup
from pyspark.sql import functions as F

import numpy as np


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_repeats_equal_brute_force(spark, rows):
    found = suffix_dedup.drop_repeats(frame(spark, rows)).collect()
    known = [(i, (t or "").encode()) for i, t, *_ in rows if i is not None]
    assert sorted(tuple(r) for r in found if r.doc_id is not None) == repeats(known)
    loose = next(r for r in found if r.doc_id is None)
    assert loose.n_removed == 0 and loose.kept_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()


@pytest.mark.parametrize("crowd", [0, 20_000])
def test_shared_passages_by_both_ways(spark, crowd):
    r = random.Random(3)
    common = prose(9, 30)
    docs = [(i, f"{prose(10 + i, r.randint(5, 30))} {common[: r.randint(40, len(common))]} {prose(50 + i, 10)}") for i in range(25)] + [(30, "ab" * 400), (31, "ab" * 200 + "c"), (32, common[:50]), (33, common[:49])]
    found = suffix_dedup.drop_repeats(frame(spark, docs), crowd=crowd, modulus=16)
    assert sorted(tuple(x) for x in found.collect()) == repeats([(i, t.encode()) for i, t in docs])


def test_structured_and_long_texts(spark):
    thue = bytes(bin(i).count("1") & 1 for i in range(2048))
    other = bytes(1 - x for x in thue)
    text = lambda b: "".join("ab"[x] for x in b)
    docs = [(1, text(thue)), (2, text(other)), (3, text(thue[:1024]) + "x"), (4, text(other[:1024])), (5, "a" * 6000), (6, "a" * 5000 + "b"), (7, "ab" * 2500), (8, "é" * 900), (9, "é" * 700 + "中" * 300), (10, ""), (11, "a" * 49)]
    found = suffix_dedup.drop_repeats(frame(spark, docs), modulus=64)
    assert sorted(tuple(x) for x in found.collect()) == repeats([(i, t.encode()) for i, t in docs])


def test_slices_smaller_than_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECES", 8)
    docs = [(i, prose(i % 7, 200) + prose(100 + i, 20)) for i in range(40)]
    found = suffix_dedup.drop_repeats(frame(spark, docs).repartition(5), modulus=16, bucket_bytes=1000, crowd=3000)
    assert sorted(tuple(x) for x in found.collect()) == repeats([(i, t.encode()) for i, t in docs])


def test_no_documents(spark):
    assert suffix_dedup.drop_repeats(frame(spark, [])).collect() == []


def test_suffix_ranks_order_suffixes():
    text = np.frombuffer(("abracadabra" * 9 + "mississippi" * 9).encode(), np.uint8)
    for depth in (3, 8, 13, 50):
        rank, raw = suffix_dedup.suffix_ranks(text, depth), text.tobytes()
        keys = [raw[i : i + depth] for i in range(len(raw) - depth)]
        assert [rank[i] for i in sorted(range(len(keys)), key=keys.__getitem__)] == sorted(rank[: len(keys)])
        assert len(set(keys)) == len(set(rank[: len(keys)].tolist()))


def test_kept_text_is_returned(spark):
    docs = [(1, prose(1, 50)), (2, "head " + prose(1, 50) + " tail")]
    got = {r.doc_id: r.kept for r in suffix_dedup.drop_repeats(frame(spark, docs), with_text=True).collect()}
    assert bytes(got[1]).decode() == docs[0][1] and bytes(got[2]) == b"head  tail"


def _near(seed, base, share):
    r = random.Random(seed)
    words = base.split()
    for _ in range(int(len(words) * share)):
        words[r.randrange(len(words))] = prose(r.random(), 1)
    return " ".join(words)


@pytest.mark.parametrize("small", [2, 12])
def test_components_equal_brute_force(spark, small):
    base = prose(1, 120)
    docs = [(i, _near(i, base, (i % 9) / 100)) for i in range(60)] + [(100 + i, _near(i, prose(2, 60 + i), 0.01)) for i in range(15)] + [(200, "one two three"), (201, "ONE two three"), (202, "one two"), (203, prose(1, 119)), (204, "a b c d e f g h"), (205, "a b c d e f g h i")]
    found = ngram_join.jaccard_components(frame(spark, docs), small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == jaccard_components(docs)


def test_awkward_components(spark, rows):
    found = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    want = jaccard_components([(i, t) for i, t, *_ in rows if i is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (len(shingles(rows[0][1])), 1)


@pytest.mark.parametrize("small,block", [(2, 1 << 20), (12, 1 << 20), (2, 1500)])
def test_links_equal_brute_force(spark, small, block):
    base = prose(1, 120)
    docs = [(i, _near(i, base, (i % 9) / 100)) for i in range(60)] + [(100 + i, _near(i, prose(2, 60 + i), 0.01)) for i in range(8)] + [(200, base.upper()), (201, base), (201, base), (202, "one two"), (203, "ONE two"), (204, None)]
    sets = [shingles(t) for _, t in docs]
    want = sorted((i, sum(1 for q, b in enumerate(sets) if p != q and a and b and 100 * len(a & b) >= 80 * len(a | b))) for p, ((i, _), a) in enumerate(zip(docs, sets)))
    found = ngram_join.jaccard_components(frame(spark, docs), small=small, block=block).collect()
    assert sorted((r.doc_id, r.n_links) for r in found) == want


def test_frequent_tokens_sign_in_combinations():
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64))
    rare = np.zeros(ngram_join.CELLS, np.uint8)
    one, _, alone = ngram_join.signatures(hashes, rare)
    assert len(one) == alone == 21
    many, at, alone = ngram_join.signatures(hashes, np.full(ngram_join.CELLS, 2, np.uint8))
    assert alone == 0 and len(many) > 21 and (at == 0).all()


@pytest.mark.parametrize("level", [0, 2, 9])
def test_linked_sets_share_a_signature(level):
    rng = np.random.default_rng(level)
    table = np.full(ngram_join.CELLS, level, np.uint8)
    table[rng.random(ngram_join.CELLS) < 0.3] = 0
    for n in (4, 5, 9, 20, 31, 33, 120, 127, 500):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(rng.integers(0, n // 5 + 1))
            y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 5 - cut + 1))), dtype=np.uint64)])
            if 100 * (n - cut) >= 80 * (len(y) + cut) and len(y) > 3 and n > 3:
                a, b = ngram_join.signatures(np.sort(x), table)[0], ngram_join.signatures(np.sort(y), table)[0]
                assert len(np.intersect1d(a, b)) or set(x) == set(y)


def _lines(docs, min_docs=10):
    """Brute force of the template tree."""
    import re

    def keys(line):
        tokens = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", line)) if x]
        n, lead, rest = len(tokens), tuple(tokens[:3]), tokens[3:]
        cut = [len(rest) * s // 4 for s in range(5)]
        runs = [tuple(rest[a:b]) for a, b in zip(cut, cut[1:])]
        words = sum(x != "<*>" for x in tokens)
        long = {("long", n, lead, *runs)} if words >= 8 else set()
        if n < 4:
            return {("short", n, lead)} if words else set()
        return {(n, lead, 4, *runs)} | {(n, lead, s, *runs[:s], *runs[s + 1 :]) for s in range(4)} | long

    seen = {}
    for at, (i, text, *_) in enumerate(docs):
        for k in set().union(*map(keys, text.split("\n"))) if text is not None else ():
            seen.setdefault(k, []).append(i)
    often = {k: min((x for x in v if x is not None), default=None) for k, v in seen.items() if len(v) >= (2 if k[0] == "long" else min_docs)}
    out = []
    for i, text, *_ in docs:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not any(k in often and (i is None or (often[k] is not None and often[k] < i)) for k in keys(x))]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_equal_brute_force(spark, rows):
    found = line_dedup.drop_recurring_lines(frame(spark, rows))
    assert found.columns == [*frame(spark, rows).columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr)
    assert got == sorted(_lines(rows), key=repr)
    assert sum(x[3] for x in got) == 11 + sum(x[3] for x in got if x[0] in (2, 3, None))


def test_names_like_results_are_replaced(spark):
    docs = frame(spark, [(1, "a b c d"), (2, None)]).withColumn("n_lines", F.lit("x")).withColumn("n_dropped", F.lit(7))
    out = line_dedup.drop_recurring_lines(docs).orderBy("doc_id")
    assert out.columns.count("n_lines") == 1 and [(r.n_lines, r.n_dropped) for r in out.collect()] == [(1, 0), (0, 0)]


def test_clean_lines_stay(spark):
    docs = [(i, prose(i, 40) + f"\nof {prose(4000 + i, 1)}\n" + prose(1000 + i, 8)) for i in range(30)]
    assert line_dedup.drop_recurring_lines(frame(spark, docs)).agg(F.sum("n_dropped")).first()[0] == 0


def test_long_lines_of_two_documents_go(spark):
    passage = prose(70, 60)
    docs = [(1, prose(71, 20) + "\n" + passage), (2, prose(72, 20) + "\n" + passage), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "13 2 3 4 5 6 7 8 9 10 11 12"), (5, "only five words of it"), (6, "only five words of it")]
    for rest in ({}, {"min_docs": None}):
        got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_recurring_lines(frame(spark, docs), long_docs=2, **rest).collect()}
        assert got == {i: (t, 0) for i, t in docs} | {2: (prose(72, 20), 1)}


def test_mix_properties(spark, rows):
    out = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size, taken, target = {}, {}, {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 16
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_quotas_are_the_highest_quotients(spark):
    votes = [53, 24, 23, 0, 7, 7, 7]
    df = spark.createDataFrame([(i, float(v), 30.0) for i, v in enumerate(votes)], "p int, v double, n double")
    got = {r.p: r.quota for r in mixing._apportion(df, [], "v", "n", [F.col("p")]).collect()}
    want = dict.fromkeys(range(7), 0)
    for _ in range(30):
        want[max(want, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == want


def test_quotas_in_many_shards(spark):
    docs = [(i, prose(i, 50), "a" if i % 3 else "b") for i in range(60)]
    out = mixing.mix_sources(frame(spark, docs), shard_words=300, block_words=8).collect()
    for s in ("a", "b"):
        assert abs(sum(r.taken for r in out if r.source == s) - next(r.target for r in out if r.source == s)) <= 8


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in wins if wins.count(w) > 1} if len(wins) < 3000 else set()
    cover = {j for i, w in enumerate(wins) if w in twice for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_order(spark, rows):
    more = [*rows, (60, " ".join(["abc"] * 40), "a"), (61, "SHOUT LOUD " * 5 + prose(6, 5).upper(), "a"), (62, " ".join(f"{w}%%%" for w in prose(7, 50).split()), "a"), (63, (prose(8, 25) + "\n") * 4, "a")]
    found = quality.quality_cascade(frame(spark, more)).collect()
    assert sorted(tuple(r)[:6] for r in found if r.doc_id is not None) == sorted((i, *_base(t)) for i, t, *_ in more if i is not None)
    kept = {r.doc_id: (r.kept, r.rejected_by) for r in found}
    assert kept[10][0] and kept[11][0] and not kept[62][0] and kept[62][1] != "base" and kept[60][1] == "base" and kept[63][1] == "base"
    texts = [t for _, t, *_ in more]
    first = quality.measured(frame(spark, list(enumerate(texts))), {"never": lambda p: False, "always": lambda p: True})
    assert first == ["always", "never"]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.drop_repeats(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert line_dedup.drop_recurring_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert quality.quality_cascade(none).count() == 0


def test_repeated_ids_with_unlike_texts_and_null_ids(spark):
    base = prose(31, 100)
    near = base.rsplit(" ", 2)[0] + " changed end"
    docs = [(1, prose(32, 90)), (1, base), (5, near), (None, prose(33, 80)), (None, prose(33, 80) + " tail"), (9, prose(34, 70))]
    got = sorted(((r.doc_id, r.n_links, r.component_id) for r in ngram_join.jaccard_components(frame(spark, docs)).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (1, 1, 1), (5, 1, 1), (None, 1, None), (None, 1, None), (9, 0, 9)], key=repr)


def test_copies_in_a_slice_give_one_row_a_phrase(spark):
    text = prose(77, 400)
    docs = [(i, text) for i in range(200)]
    slices = suffix_dedup._sliced(frame(spark, docs).select(F.col("doc_id").alias("id"), "text").coalesce(1))
    phrases = suffix_dedup._phrases(slices, 50, 64)
    assert phrases.count() == phrases.select("d1", "d2").distinct().count() > 1
    found = suffix_dedup.drop_repeats(frame(spark, docs), modulus=64).collect()
    assert sorted(tuple(r) for r in found) == repeats([(i, text.encode()) for i, text in docs])
