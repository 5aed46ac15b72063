"""Quality rules as a short-circuit cascade.

A sample of the documents gives each rule's cost (seconds a document) and selectivity (share rejected);
the rules then run by falling rejection per cost, and a document leaves the cascade at its first
rejection. The order changes the time, never the verdict: a document is kept if no rule rejects it.

Nulls: a null text has no words and is rejected by the base rules; a null id is ordinary. Repeated rows
are judged one by one, ties alike. An empty table gives an empty result. A long text is judged whole, in a
slice of its own. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import operator
import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import run_hashes, text_slices, word_hashes, word_spans

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(raw: np.ndarray, bounds: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base columns for the rows of one slice."""
    n = len(bounds) - 1
    start, end, row = word_spans(raw, bounds)
    head = (raw & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    out = {"n_words": np.bincount(row, minlength=n), "n_symbols": _sums(bounds, _SYMBOL[raw])}
    out["word_chars"] = np.bincount(row, points[end] - points[start], n).astype(np.int64)
    hashes = word_hashes(raw, start, end)
    runs = run_hashes(hashes, window)
    whole = row[: len(runs)] == row[window - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order = at[np.lexsort((runs[at], row[at]))]
    same = (row[order[1:]] == row[order[:-1]]) & (runs[order[1:]] == runs[order[:-1]])
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, bool)
    cover = np.zeros(len(row) + window + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + window, -1)
    out["n_repeat_words"] = np.bincount(row, np.cumsum(cover)[: len(row)] > 0, n).astype(np.int64)
    dup = np.zeros(n, np.int64)
    text = raw.tobytes()
    for i in np.flatnonzero(_sums(bounds, raw == 10)):
        lines = [x for x in text[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    return out


class Page:
    """What the rules see of a document: its text, its base counts, and its words, found when first asked for."""

    def __init__(self, text: str, base: dict[str, int]) -> None:
        self.text, self.base = text, base

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text)


#: Rules of the cascade: name -> whether a page is rejected. Every rule is the same at all lengths.
Rule = Callable[[Page], bool]


def _few_distinct(page: Page) -> bool:
    """Distinct words grow about as the square root of all: fewer than 2.5 times that root are too few."""
    distinct = len(set(page.words))
    return 4 * distinct * distinct < 25 * len(page.words)


RULES: dict[str, Rule] = {
    "symbols": lambda p: 10 * p.base["n_symbols"] > p.base["n_words"],
    "word_length": lambda p: not 2 * p.base["n_words"] <= p.base["word_chars"] <= 14 * p.base["n_words"],
    "dup_lines": lambda p: 10 * p.base["n_dup_lines"] > 3 * (p.text.count("\n") + 1),
    "shouting": lambda p: 10 * sum(len(w) > 1 and w.isupper() for w in p.words) > 3 * len(p.words),
    "stutter": lambda p: 10 * sum(map(operator.eq, p.words, p.words[1:])) > 3 * len(p.words),
    "few_distinct": _few_distinct,
}


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def _bases(counts: dict[str, np.ndarray], i: int) -> dict[str, int]:
    return {k: int(v[i]) for k, v in counts.items()}


def measured(rows: DataFrame, rules: dict[str, Rule]) -> list[str]:
    """Rule names by falling share rejected per second, measured by one task on the rows; only the sums come to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, took = dict.fromkeys(rules, 0), dict.fromkeys(rules, 1e-9)
        for batch, raw, bounds in text_slices(batches, "text"):
            counts = base_counts(raw, bounds)
            for i in range(batch.num_rows):
                base = _bases(counts, i)
                if base_failed(base["n_words"], base["n_repeat_words"]):
                    continue
                text = batch.column(0)[i].as_py() or ""
                for name, rule in rules.items():
                    began = time.perf_counter()
                    hits[name] += rule(Page(text, base))
                    took[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(rules), pa.string()), pa.array([hits[x] / took[x] for x in rules], pa.float64())], ["rule", "worth"])

    worth: dict[str, float] = {}
    for r in rows.select("text").mapInArrow(measure, "rule string, worth double").collect():
        worth[r.rule] = worth.get(r.rule, 0.0) + r.worth
    return sorted(rules, key=lambda x: -worth.get(x, 0.0))


def quality_cascade(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """id, the base counts, base_failed, kept, and the rule that rejected (null if none did).

    sample_rows bounds the sample that only orders the rules.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = measured(rows.limit(sample_rows), rules)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in BASE)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, bounds in text_slices(batches, "text"):
            counts = base_counts(raw, bounds)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            by: list[str | None] = ["base" if x else None for x in failed]
            texts = batch.column(1)
            for i in np.flatnonzero(~failed):
                page = Page(texts[i].as_py() or "", _bases(counts, i))
                by[i] = next((x for x in names if rules[x](page)), None)
            kept = [x is None for x in by]
            cols = [pa.array(counts[c].astype(np.int64)) for c in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(failed), pa.array(kept), pa.array(by, pa.string())], ["doc_id", *BASE, "base_failed", "kept", "rejected_by"])

    return rows.mapInArrow(judged, f"doc_id {kind}, {fields}, base_failed boolean, kept boolean, rejected_by string")
