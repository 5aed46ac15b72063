"""Exact Jaccard self-join on word shingles with token-combination prefixes, and its link components.

A set's tokens are its distinct k-word shingles (64-bit hashes), in one global order: rare before frequent,
then by hash. How frequent a token is comes from a sketch of fixed size that counts every set of the
corpus; any sketch gives right results, a good one short buckets. Tokens whose count stands out fall into
frequent classes: a token of class c signs not alone but in combinations of c tokens of its class and
hash group. A prefix is extended until its coverage (tokens of class 1, and for each group of class c its
tokens less c - 1) exceeds the number of tokens that may be missing at the threshold. Then two sets that
link share a signature: of the prefix that ends first, too few tokens can be missing to break them all.
Groups are as many as fit the set's size class, and a set near the top of its class signs for the next too.

Equal sets are one node. Buckets of up to `small` nodes give their pairs, which a position filter and a
count filter thin out: what the prefixes share and what lies beyond them must reach the needed overlap.
Larger buckets give stars: each node with the bucket's most central node. Pairs that remain are verified on
the texts. After the stars' links are components, nodes of large buckets that are in different components
and pass the filters are paired, their shared signatures counted, the rest verified, and the components are final. So no group of copies is
expanded into all its pairs, and no pair that could add a link between components is left out.
Links are counted whole: a pair that shares a small bucket is verified, and nodes of large buckets are counted
against each other inside their component, block by block, without rows for the pairs.

Nulls: a null or wordless text has an empty set and links with nothing; a null id is ordinary, but no
component's id unless all are null. Repeated rows are documents each, ties of ids too. An empty table gives an empty
result. A long text is hashed whole, in a slice of its own. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, run_hashes, staged, summed, text_slices, word_hashes, word_spans
from .graph import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CELLS = 1 << 19
_U = np.uint64


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of all rows, sorted within a row, and where each row's end."""
    n = len(bounds) - 1
    raw = _LOWER[raw]
    start, end, row = word_spans(raw, bounds)
    words = word_hashes(raw, start, end)
    runs = run_hashes(words, k)
    whole = np.flatnonzero(row[: len(runs)] == row[k - 1 :]) if len(runs) else np.zeros(0, np.int64)
    hashes, rows = [runs[whole]], [row[whole]]
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < k)):
        hashes.append(mix64(run_hashes(words[first[i] : first[i] + count[i]], int(count[i])) + _U(count[i])))
        rows.append(np.array([i]))
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.cumsum(np.bincount(r[new], minlength=n))


def set_ids(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set; equal sets have equal ids."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(hashes ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mix64(total[ends] - total[first] + (ends - first).astype(_U) * _U(0x2545F4914F6CDD1D)).view(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for counts within the sketch's noise; above it, one level for each doubling."""
    mean = counts.mean() if len(counts) else 0.0
    bar = mean + 6 * np.sqrt(mean) + 16
    return np.where(counts < bar, 0, np.minimum(15, 1 + np.log2(np.maximum(counts, 1) / bar))).astype(np.uint8)


def signatures(hashes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, positions, tokens of class 1 in the prefix) of one set at Jaccard 0.8."""
    n = len(hashes)
    if n < 4:
        return np.zeros(0, _U), np.zeros(0, np.int64), 0
    lv = level[hashes & _U(len(level) - 1)]
    order = np.lexsort((hashes, lv))
    h, lv = hashes[order], lv[order]
    need = n // 5 + 1
    rare = int(np.count_nonzero(lv == 0))
    single = min(rare, need)
    sigs, at = [mix64(h[:single] ^ _U(0x1F83D9ABFB41BD6B))], [np.arange(single)]
    if single < need:
        size = n.bit_length() - 1
        for p in (size, size + 1) if 5 * n >= 4 << (size + 1) else (size,):
            groups = max(1, (1 << p) >> 3)
            held: dict[tuple[int, int], list[int]] = {}
            cover = single
            for i in range(single, n):
                c = 2 if lv[i] < 7 else 3
                g = held.setdefault((c, int(h[i] >> _U(40)) % groups), [])
                g.append(i)
                cover += len(g) >= c
                if cover >= need:
                    break
            for (c, _), g in held.items():
                if len(g) >= c:
                    combos = np.array(list(itertools.combinations(g, c)))
                    total = np.full(len(combos), (p * 4 + c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, _U)
                    for j in range(c):
                        total = mix64(total + h[combos[:, j]])
                    sigs.append(total)
                    at.append(np.full(len(combos), rare))
    return np.concatenate(sigs), np.concatenate(at), single


def _scan(docs: DataFrame, schema: str, each) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(text_slices(batches, "text"))

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Staged (doc_id, t, sid, n) of every row, and the sketches of the partitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "t", "sid", "n", "sketch"]

    def each(slices):
        sketch, key = np.zeros(CELLS, "<i4"), None
        for batch, raw, bounds in slices:
            hashes, ends = shingle_sets(raw, bounds, k)
            sketch += np.bincount((hashes & _U(CELLS - 1)).astype(np.int64), minlength=CELLS).astype("<i4")
            key = batch.schema.field(0).type
            n = np.diff(ends, prepend=0)
            sid = pa.array(set_ids(hashes, ends), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sid, pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary())], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([sketch.tobytes()], pa.binary())], names)

    return staged(_scan(docs, f"doc_id {kind}, t long, sid long, n long, sketch binary", each), "sets")


def _signed(docs: DataFrame, k: int, level: np.ndarray) -> DataFrame:
    """Staged (sid, n, alone, sig, pos); rows without sig carry a node's size and its class-1 prefix."""

    def each(slices):
        for _, raw, bounds in slices:
            hashes, ends = shingle_sets(raw, bounds, k)
            first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = set_ids(hashes, ends)
            sid, n, alone, sig, pos = [], [], [], [], []
            for i in np.unique(ids, return_index=True)[1]:
                if ends[i] - first[i] < 4:
                    continue
                s, at, one = signatures(hashes[first[i] : ends[i]], level)
                sid.append(np.full(len(s) + 1, ids[i]))
                n.append(np.full(len(s) + 1, ends[i] - first[i]))
                alone.append(np.full(len(s) + 1, one))
                sig.append(np.concatenate([s.view(np.int64), [0]]))
                pos.append(np.concatenate([at, [-1]]))
            if sid:
                where = np.concatenate(pos)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sid)), pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(alone), pa.int32()), pa.array(np.concatenate(sig), mask=where < 0), pa.array(where, pa.int32())], ["sid", "n", "alone", "sig", "pos"])

    return staged(_scan(docs, "sid long, n int, alone int, sig long, pos int", each), "signed")


def _reaches(a: str, b: str, rem_a: str, rem_b: str) -> str:
    """Whether an overlap of at most rem can reach Jaccard 0.8 for sizes a and b: overlap >= 4/9 (a + b)."""
    return f"9 * least({rem_a}, {rem_b}) >= 4 * ({a} + {b}) and 5 * {a} >= 4 * {b} and 5 * {b} >= 4 * {a}"


def _filtered(docs: DataFrame, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of docs whose id may be in wanted: a Bloom filter of fixed size, one hash; false hits only cost time."""

    def mark(batches):
        field = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(field, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([field.tobytes()], pa.binary())], ["field"])

    key = F.xxhash64("doc_id")
    field = np.zeros(bits // 8, np.uint8)
    for r in wanted.select(key.alias("h")).coalesce(4).mapInArrow(mark, "field binary").toLocalIterator():
        field |= np.frombuffer(r.field, np.uint8)

    def sift(batches):
        for b in batches:
            h = b.column(3).to_numpy() & (bits - 1)
            yield b.filter(pa.array((field[h >> 3] >> (h & 7)) & 1 == 1)).select([0, 1, 2])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "t", "text", key.alias("h")).mapInArrow(sift, f"doc_id {kind}, t long, text string")


def _spoken(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, text): for each node one text that has its set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "t")).alias("_f")
    speak = staged(sets.where("sid is not null").groupBy("sid").agg(first).join(nodes, F.col("sid") == F.col("node"), "left_semi").select("sid", "_f.doc_id", F.col("_f.t").alias("_t")), "speakers")
    rows = _filtered(docs, speak).withColumnRenamed("doc_id", "_id")
    return rows.join(speak.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("_t"))).select("sid", "text").dropDuplicates(["sid"])


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Staged pairs (a, b) whose sets have Jaccard 0.8 or more."""
    pairs = staged(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    spoken = _spoken(docs, sets, nodes)
    # speakers and pairs grow with the corpus: they are never broadcast, however few there are
    right = pairs.hint("merge").join(spoken.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    both = right.hint("merge").join(spoken.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def one(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return shingle_sets(raw, np.array([0, len(raw)]), k)[0]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last or mine is None:
                    last, mine = a, one(ta.as_py())
                other = one(tb.as_py())
                same = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * same >= 80 * (len(mine) + len(other) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return staged(both.mapInArrow(check, "a long, b long"), "links")


def _share_enough(pairs: DataFrame, bucket: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shared signatures, counted exactly, and the tokens beyond the class-1 prefixes can reach the needed overlap."""
    pairs = staged(pairs, "crossing")
    mine, other = bucket.select(F.col("sid").alias("a"), "sig"), bucket.select(F.col("sid").alias("b"), "sig")
    counted = pairs.hint("merge").join(mine, "a").join(other.hint("merge"), ["b", "sig"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    both = counted.join(nodes.toDF("a", "na", "alone_a"), "a").join(nodes.toDF("b", "nb", "alone_b"), "b")
    return both.where("9 * s >= least(4 * (na + nb) - 9 * (na - alone_a), 4 * (na + nb) - 9 * (nb - alone_b))").select("a", "b")


def shared_counts(rows: np.ndarray, hashes: np.ndarray, n: int, m: int) -> np.ndarray:
    """How many hashes each of sets 0 .. n - 1 shares with each of sets m ..; (row, hash) are all distinct."""
    width = int(rows.max()) + 1 if len(rows) else n
    same = np.zeros((n, width - m), np.float32)
    _, token, count = np.unique(hashes, return_inverse=True, return_counts=True)
    token = (np.cumsum(count > 1) - 1)[token[keep := count[token] > 1]]
    rows = rows[keep]
    order = np.argsort(token, kind="stable")
    token, rows = token[order], rows[order]
    step = max(64, (1 << 22) // max(1, width))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        i, j = np.searchsorted(token, [lo, lo + step])
        held = np.zeros((width, step), np.float32)
        held[rows[i:j], token[i:j] - lo] = 1
        same += held[:n] @ held[m:].T
    return same


def _links_inside(docs: DataFrame, sets: DataFrame, inside: DataFrame, k: int, block: int) -> DataFrame:
    """(s, n): rows whose set links with the node's, of inside (sid, n, root, size), within its root.

    A root's nodes fall into blocks of about `block` shingles by their hash; every pair of blocks is one group.
    """
    total = inside.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.ceil(F.sum("n") / block).cast("int").alias("blocks")).where("nodes > 1").select(F.col("root").alias("r"), "blocks")
    dealt = staged(inside.join(total, F.col("root") == F.col("r")).select("sid", "root", "size", "blocks", F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks")).cast("int").alias("own")), "dealt")
    texts = _spoken(docs, sets, dealt.select(F.col("sid").alias("node"))).withColumnRenamed("sid", "_s")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = dealt.hint("merge").join(texts, F.col("sid") == F.col("_s")).select("sid", "root", "size", "own", "text", other.alias("other"))
    spread = spread.select("sid", "size", "own", "text", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("sid", "ascending")]).combine_chunks()
        own, sizes = table["own"].to_numpy(), table["size"].to_numpy()
        n = int(np.searchsorted(own, own[0], "right"))
        m = n if table["i"][0].as_py() != table["j"][0].as_py() else 0
        hashes, counts = [], []
        for _, raw, bounds in text_slices(iter(table.select(["text"]).to_batches()), "text"):
            h, ends = shingle_sets(raw, bounds, k)
            hashes.append(h)
            counts.append(np.diff(ends, prepend=0))
        counts = np.concatenate(counts)
        if m == len(own):
            return pa.table({"s": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        same = shared_counts(np.repeat(np.arange(len(own)), counts), np.concatenate(hashes), n, m)
        link = 100 * same >= 80 * (counts[:n, None] + counts[None, m:] - same)
        if not m:
            np.fill_diagonal(link, False)
            return pa.table({"s": table["sid"], "n": pa.array(link @ sizes, pa.int64())})
        return pa.table({"s": table["sid"], "n": pa.array(np.concatenate([link @ sizes[m:], sizes[:n] @ link]), pa.int64())})

    return spread.groupBy("root", "i", "j").applyInArrow(count, "s long, n long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, small: int = 12, block: int = 1 << 20, with_first: bool = False, with_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, n_links (other rows whose set is equal or links), component_id (least id that links reach).

    with_first adds t, the hash of the row's text, and first (no, id, t): the least row that links reach, by id,
    null ids last, then by t; null for sets without words. Without with_links n_links is not counted and left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    every = _sets(docs, k)
    level = levels(summed(every, "sketch", CELLS, kind="<i4"))
    sets = every.where("sketch is null").select("doc_id", "t", "sid", "n")
    signed = _signed(docs, k, level)
    rows = signed.where("sig is not null").select("sig", "sid", "n", "pos")
    nodes = signed.where("sig is null").select("sid", "n", "alone").dropDuplicates(["sid"])
    shared = rows.groupBy("sig").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("sig")
    bucket = staged(rows.join(shared, "sig").dropDuplicates(["sig", "sid"]), "buckets")
    central = F.max(F.struct((-F.col("pos") / F.col("n")).alias("r"), "sid", "n", "pos")).alias("p")
    sizes = bucket.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), central)
    placed = staged(bucket.join(sizes.select("sig", "size", F.col("p.sid").alias("psid"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")), "sig"), "placed")
    few, many = placed.where(F.col("size") <= small), placed.where(F.col("size") > small)

    pair = F.expr("explode(flatten(transform(m, (x, i) -> transform(filter(m, (y, j) -> j > i), y -> struct(x.sid as a, y.sid as b, x.n as na, y.n as nb, least(x.n - x.pos, y.n - y.pos) as rem)))))")
    lists = few.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "pos"))).alias("m")).select(pair.alias("q")).select("q.*").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    counted = lists.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("rem").alias("rem"), F.count(F.lit(1)).alias("s")).where(_reaches("na", "nb", "rem", "rem"))
    crowd = many.groupBy("sid").agg(F.count(F.lit(1)).alias("crowd"))
    about = nodes.join(crowd, "sid", "left").select("sid", "alone", F.coalesce("crowd", F.lit(0)).alias("crowd"))
    known = counted.join(about.toDF("a", "alone_a", "crowd_a"), "a").join(about.toDF("b", "alone_b", "crowd_b"), "b")
    thin = known.where("9 * (s + least(crowd_a, crowd_b)) >= least(4 * (na + nb) - 9 * (na - alone_a), 4 * (na + nb) - 9 * (nb - alone_b))")
    stars = many.where("sid <> psid").where(_reaches("n", "pn", "n - pos", "pn - ppos")).select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")).distinct()
    links = _verified(docs, sets, thin.select("a", "b").union(stars).distinct(), k)
    roots = staged(components(links), "roots")

    rest = many.where("sid <> psid").join(roots, F.col("sid") == F.col("node"), "left").select("sig", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    least = rest.groupBy("sig").agg(F.min("n").alias("least"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("sig", "least")
    able = rest.join(least, "sig").where("9 * (n - pos) >= 4 * (n + least)").drop("least")
    mixed = able.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("sig")
    able = staged(able.join(mixed, "sig", "left_semi"), "able")
    other = able.select("sig", *(F.col(c).alias(f"{c}_") for c in ("sid", "n", "pos", "root")))
    cross = able.join(other, "sig").where("sid < sid_ and root <> root_").where(_reaches("n", "n_", "n - pos", "n_ - pos_")).select(F.col("sid").alias("a"), F.col("sid_").alias("b")).distinct()
    more = _verified(docs, sets, _share_enough(cross, bucket, nodes), k)
    all_links = links.union(more).distinct()
    roots = staged(components(all_links), "roots")

    row = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "t")
    own = sets.where("sid is not null").groupBy("sid").agg(F.min(row if with_first else "doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    rooted = staged(own.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "least", "size", F.coalesce("root", "sid").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(best, "root").select("sid", "component", "size")
    if with_links:
        degree = _degrees(docs, sets, nodes, rooted, crowd, all_links, k, block)
        named = named.join(degree, F.col("sid") == F.col("s"), "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("size") - 1)
    named = staged(named.withColumnRenamed("sid", "_s"), "named")
    out = sets.join(named, F.col("sid") == F.col("_s"), "left")
    least = F.col("component.id") if with_first else F.col("component")
    links = (F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),) if with_links else ()
    first = ("t", F.col("component").alias("first")) if with_first else ()
    return out.select("doc_id", F.col("n").alias("n_shingles"), *links, F.coalesce(F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(least), F.col("doc_id")).alias("component_id"), *first)


def _degrees(docs: DataFrame, sets: DataFrame, nodes: DataFrame, rooted: DataFrame, crowd: DataFrame, all_links: DataFrame, k: int, block: int) -> DataFrame:
    """(s, links): how many rows of other nodes each node links with."""
    crowded = crowd.select(F.col("sid").alias("c")).distinct()
    near = rooted.join(crowded, F.col("sid") == F.col("c"), "left_semi").select("sid", "root", "size")
    inside = near.join(nodes.select(F.col("sid").alias("_s"), "n"), F.col("sid") == F.col("_s")).select("sid", "n", "root", "size")
    ends = all_links.join(crowded.toDF("ca"), F.col("a") == F.col("ca"), "left").join(crowded.toDF("cb"), F.col("b") == F.col("cb"), "left").where("ca is null or cb is null").select("a", "b")
    weights = rooted.select(F.col("sid").alias("w"), "size")
    known = ends.union(ends.select("b", "a")).join(weights, F.col("b") == F.col("w")).select(F.col("a").alias("s"), F.col("size").alias("n"))
    return known.union(_links_inside(docs, sets, inside, k, block)).groupBy("s").agg(F.sum("n").alias("links"))
