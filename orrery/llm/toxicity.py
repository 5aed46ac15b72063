"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms to plain letters, lower case, marks beyond accents dropped, homoglyphs to their
Latin letters, digits and signs to the letters they stand for, other signs to spaces. Lexicon entries are beginnings of
folded words; words of fewer than SHORT letters are entries only as a whole. They are learned from labelled rows: beginnings
that at least `support` toxic documents have and clean ones hardly. Where words part, a beginning ends: longer ones with
the same holders say more, so these and the words themselves are all there is to try, however long a word is. Support counts
unlike documents, by two minimum hashes, so words that merely come along in copies of one document are not taken. An entry's
weight is its smoothed log odds. Exception phrases are words that clean documents use and that begin like an entry, and pairs
of neighbouring words with an entry that clean documents use; what they cover counts for no entry. The score is a logistic
function of the summed weights over the logarithm of the length, fitted on the same rows.

Learning uses at most `max_rows` labelled rows, those with the least hash of the id, and never rows that
`held_out` marks. Their words are counted in the executors; entries, exceptions and one number a row come to the driver.
Scoring reads every whole text, however long.

Nulls: a null text is empty; a null id is ordinary and held out by the hash of no text; labels that are
null or of null ids are left out. Repeated rows are scored each, equal texts alike. Without labels of both kinds every
score is 0. Empty tables give empty results. Other columns pass through; where one is named like a result, the result
takes its place.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

#: Letters of other scripts that look like Latin ones, and signs that stand for letters. i, l and 1 are one.
_LOOKS = {
    "a": "аα@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еε3", "g": "ɡ9", "h": "һн", "i": "іιıl1!|", "j": "ј", "k": "кκ", "m": "м",
    "n": "ոη", "o": "оο0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ",
}


def _table() -> dict[int, str]:
    out = {ord(sign): letter for letter, signs in _LOOKS.items() for sign in signs}
    out |= {c: " " for c in range(128) if not chr(c).isalnum() and c not in out}
    out |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return out


_FOLD = _table()


#: Words of fewer letters are entries only as a whole.
SHORT = 3


def fold(text: str) -> str:
    """Folded words with one space before and after each text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """weights: beginnings of words, or a whole short word with a space behind it; exceptions: words and pairs of words."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -50.0
    slope: float = 0.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for x, w in self.weights.items():
            found.add_word(f" {x}", (len(x) + 1, w, ()))
        for x in self.exceptions:
            found.add_word(f" {x} ", (len(x) + 2, None, (0, *(i + 1 for i, c in enumerate(x) if c == " "))))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, folded: str, matcher) -> dict[int, float]:
        """Where entries stand that no exception covers, with their largest weight."""
        best: dict[int, float] = {}
        covered: set[int] = set()
        for end, (size, w, starts) in matcher.iter(folded):
            at = end - size + 1
            if w is None:
                covered.update(at + i for i in starts)
            elif w > best.get(at, -math.inf):
                best[at] = w
        return {at: w for at, w in best.items() if at not in covered} if covered else best

    def density(self, text: str, matcher) -> float:
        """Summed weights of the hits over the logarithm of the length."""
        if not len(matcher):
            return 0.0
        folded = fold(text)
        found = self.hits(folded, matcher)
        return sum(found.values()) / math.log2(8 + folded.count(" ")) if found else 0.0

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * density))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _sketches(words: set[str]) -> tuple[int, int]:
    """Two minimum hashes of a document's words: copies of one document have few of them."""
    found = [(zlib.crc32(w.encode()), zlib.adler32(w.encode()) * 2654435761 % (1 << 32)) for w in words]
    return min((a for a, _ in found), default=0), min((b for _, b in found), default=0)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, y, word, a, b): the distinct folded words of each document, with its sketches."""
    for batch in batches:
        for doc, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = sorted(set(fold(text or "").split()))
            n, (a, b) = len(words), _sketches(set(words))
            yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([y] * n, pa.int32()), pa.array(words, pa.string()), pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64())], ["doc", "y", "word", "a", "b"])


def beginnings(words: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    """(word, beginning) for words (word, whether toxic documents have it) that share their first SHORT letters: toxic words themselves and where two of them part."""
    toxic = sorted(w for w, y in words if y)
    nodes = {w if len(w) >= SHORT else f"{w} " for w in toxic}
    for a, b in zip(toxic, toxic[1:], strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if n >= SHORT:
            nodes.add(a[:n])
    sizes = sorted({len(x) for x in nodes if x[-1] != " "})
    out = [(w, w[:n]) for w, _ in words for n in sizes if n <= len(w) and w[:n] in nodes]
    return out + [(w, f"{w} ") for w, _ in words if f"{w} " in nodes]


def _entries(able: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Of nested beginnings (text, toxic holders, clean holders) the most frequent, then the longest, with its weight."""
    taken: dict[str, float] = {}
    nested: set[str] = set()
    for x, n, neg in sorted(able, key=lambda e: (-e[1], -len(e[0]), e[0])):
        if x in nested or any(x[:i] in taken for i in range(1, len(x))):
            continue
        taken[x] = math.log((n + 0.5) / (neg + 0.5) * (n_neg + 1) / (n_pos + 1))
        nested.update(x[:i] for i in range(1, len(x)))
    return taken


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([1e-6, 1e-3]), a.T @ (y - p) - np.array([0, 1e-3]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8000, support: int = 6) -> Lexicon:
    """The lexicon from labelled rows that are not held out."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))
    picked = marks.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    rows = staged(texts.select("text", F.col("y").cast("int").alias("y")).where("y in (0, 1)").distinct().select(F.monotonically_increasing_id().alias("doc"), "text", "y"), "labelled")
    words = staged(rows.mapInArrow(_document_words, "doc long, y int, word string, a long, b long"), "words")
    clean, toxic = F.sum(F.expr("if(y = 0, 1, 0)")), F.sum("y")
    every = words.groupBy("word").agg(clean.alias("clean"), toxic.alias("toxic"))
    usual = "clean >= 3 and toxic < 19 * clean"
    every = staged(every, "counts")

    def part(table: pa.Table) -> pa.Table:
        found = beginnings(list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
        return pa.table({"_word": pa.array([x for x, _ in found], pa.string()), "x": pa.array([x for _, x in found], pa.string())})

    rare = every.where(f"not ({usual})").select("word", (F.col("toxic") > 0).alias("bad"), F.substring("word", 1, SHORT).alias("start"))
    named = rare.groupBy("start").applyInArrow(lambda t: part(t.select(["word", "bad"])), "_word string, x string")
    held = words.join(named, F.col("word") == F.col("_word")).select("doc", "y", "a", "b", "x").distinct()
    unlike = F.least(*(F.count_distinct(F.when(F.col("y") == 1, F.col(c))) for c in ("a", "b")))
    able = held.groupBy("x").agg(toxic.alias("n"), clean.alias("neg"), unlike.alias("unlike")).where((F.col("n") >= support) & (F.col("n") >= 19 * F.col("neg")) & (F.col("unlike") >= support))
    total = rows.agg(F.coalesce(toxic, F.lit(0)).alias("pos"), F.coalesce(clean, F.lit(0)).alias("neg")).first()
    lexicon = Lexicon(_entries([(r.x, r.n, r.neg) for r in able.collect()], total.pos, total.neg) if total.pos and total.neg else {})
    if not lexicon.weights:
        return lexicon
    starts = tuple(x for x in lexicon.weights if x[-1] != " ")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if w.startswith(starts)], pa.string())], ["word"])

    lexicon.exceptions = sorted(r.word for r in every.where(usual).select("word").mapInArrow(alike, "word string").collect()) if starts else []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = fold(text or ""), set()
                for at in lexicon.hits(folded, match):
                    word, _, behind = folded[at + 1 :].partition(" ")
                    before, after = folded[:at].split()[-1:], behind.split(" ", 1)[:1]
                    found.update([f"{x} {word}" for x in before] + [f"{word} {x}" for x in after if x])
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([y] * len(found), pa.int32())], ["pair", "y"])

    harmless = rows.select("text", "y").mapInArrow(pairs, "pair string, y int").groupBy("pair").agg(clean.alias("clean"), toxic.alias("toxic")).where("clean >= 3 and toxic < clean")
    lexicon.exceptions += sorted(r.pair for r in harmless.collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t or "", match) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "y"])

    seen = rows.select("text", "y").mapInArrow(measure, "x double, y int").toArrow()
    lexicon.bias, lexicon.slope = _logistic(seen.column(0).to_numpy(), seen.column(1).to_numpy().astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    at, names = docs.columns.index(text_col), [*docs.columns, "score", "predicted"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for batch in batches:
            got = np.array([lexicon.score(lexicon.density(x.as_py() or "", match)) for x in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names)

    return docs.mapInArrow(each, f"{fields}score double, predicted int")
