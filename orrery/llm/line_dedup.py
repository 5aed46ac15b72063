"""Line dedup with a log-template tree of fixed depth, in DataFrame operations alone.

The tree parses a line by its token count, then by its first LEAD tokens; tokens that hold a digit are
variable fields and read as <*>. Below a leaf, a template is the whole of the other tokens or, from
LEAD + 1 tokens on, all but one of PARTS equal runs of them, the run left out being the variable field; three
quarters of a line's tokens at least are fixed. A template recurs from so many documents on:

* `min_docs`: templates of the tree, that is of lines of more than LEAD tokens, whole or with a run left out;
* `short_docs`: whole lines of up to LEAD tokens;
* `long_docs`: whole lines of at least `long_words` words, fields not counted.

None leaves a kind out. Recurring lines are dropped from all documents but the one with the smallest id.
Lines without any word, blank or of fields alone, stay in the last two kinds.

Counting is one aggregation with partial sums in the map tasks, so a line that all documents share is no
hot key; the way back is a plain equi-join, which adaptive execution can split. Templates are told apart by
64-bit hashes.

Nulls: a null text stays null; a row with a null id counts as a document but is nobody's first, and its
recurring lines are dropped. Repeated rows and ties of ids count each, and rows with the smallest id keep their
lines. Empty texts and tables stay as they are; a long text costs in proportion to its length. Other columns pass
through; where one is named like a result, the result takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

LEAD, PARTS = 3, 4
#: Kinds of keys: the tree at min_docs, whole short lines, whole long lines.
KINDS = ("tree", "short", "long")
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
_GAP = r"[\x20\x09-\x0D]+"


def line_templates(text: Column, long_words: int, kinds: tuple[str, ...] = ("tree",)) -> Column:
    """For each line of a text the array of its template keys; of several kinds, a key's two low bits tell which."""
    masked = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, _FIELD, "<*>")).otherwise(x))
    tokens = F.transform(masked, lambda x: F.split(F.trim(x, F.lit(" \t\n\x0b\x0c\r")), _GAP))

    def leaf(t: Column) -> Column:
        rest = F.greatest(F.size(t) - LEAD, F.lit(0))
        runs = [F.xxhash64(F.array_join(F.slice(t, F.floor(rest * s / PARTS).cast("int") + LEAD + 1, (F.floor(rest * (s + 1) / PARTS) - F.floor(rest * s / PARTS)).cast("int")), " ")) for s in range(PARTS)]
        words = () if kinds == ("tree",) else (F.size(F.filter(t, lambda x: ~x.isin("<*>", ""))).alias("words"),)
        return F.struct(F.size(t).alias("n"), F.xxhash64(F.array_join(F.slice(t, 1, LEAD), " ")).alias("lead"), *(r.alias(f"r{s}") for s, r in enumerate(runs)), *words)

    def keys(b: Column) -> Column:
        runs = [b[f"r{s}"] for s in range(PARTS)]
        none = F.array().cast("array<bigint>")

        def key(kind: str, part: int) -> Column:
            hashed = F.xxhash64(b["n"], b["lead"], F.lit(part), *runs[:part], *runs[part + 1 :])
            return hashed if len(kinds) == 1 else hashed.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(KINDS.index(kind)))

        found = []
        if "tree" in kinds:
            whole, less = key("tree", PARTS), [key("tree", s) for s in range(PARTS)]
            found.append(F.when(b["n"] <= LEAD, none).otherwise(F.array(whole, *less)))
        if "short" in kinds:
            found.append(F.when((b["n"] <= LEAD) & (b["words"] > 0), F.array(key("short", PARTS))).otherwise(none))
        if "long" in kinds:
            found.append(F.when(b["words"] >= long_words, F.array(key("long", PARTS))).otherwise(none))
        return F.concat(*found) if len(found) > 1 else found[0]

    return F.transform(F.transform(tokens, leaf), keys)


def line_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long_words: int = 8, kinds: tuple[str, ...] = ("tree",)) -> DataFrame:
    """Staged (_id, _t, _keys) of every row: its id, the hash of its text, the template keys of each line."""
    return staged(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), line_templates(F.col(text_col), long_words, kinds).alias("_keys")), "templates")


def recurring_lines(keyed: DataFrame, bars: dict[str, int]) -> DataFrame:
    """(_id, _t, _gone): the numbers of the lines that rows lose to templates of at least bars[kind] documents."""
    counted = keyed.select("_id", F.explode(F.array_distinct(F.flatten("_keys"))).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    kind = F.col("_key").bitwiseAND(F.lit(3))
    bar = F.lit(next(iter(bars.values()))) if len(bars) == 1 else F.coalesce(*(F.when(kind == KINDS.index(k), F.lit(n)) for k, n in bars.items()))
    recurring = counted.where(F.col("_n") >= bar).select(F.col("_key"), "_first")
    at = keyed.select("_id", "_t", F.posexplode("_keys").alias("_line", "_lk")).select("_id", "_t", "_line", F.explode("_lk").alias("_key"))
    hits = at.join(recurring, "_key").where(F.col("_id").isNull() | (F.col("_first") < F.col("_id")))
    return hits.groupBy("_id", "_t").agg(F.collect_set("_line").alias("_gone"))


def without(lines: Column, gone: Column) -> Column:
    """The text of the lines whose numbers are not in gone, in time linear in both."""
    # the outer transform of one element binds the lines, which would else be split again for each of them
    def joined(bound: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(bound) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(bound, i)), "\n")

    return F.transform(F.array(lines), joined)[0]


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int | None = 10, short_docs: int | None = 10, long_docs: int | None = 2, long_words: int = 8) -> DataFrame:
    """docs with recurring lines out of text_col, plus n_lines and n_dropped."""
    bars = {k: n for k, n in zip(KINDS, (min_docs, short_docs, long_docs), strict=True) if n is not None}
    gone = recurring_lines(line_keys(docs, id_col=id_col, text_col=text_col, long_words=long_words, kinds=tuple(bars)), bars)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text_col).alias("_rt"))
    both = wide.join(gone, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rt") == F.col("_t")), "left")
    lines = F.split(F.col("_row")[text_col], "\n", -1)
    kept = without(lines, F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_row")[text_col]).otherwise(kept)
    return both.select(*((text if c == text_col else F.col("_row")[c]).alias(c) for c in names), F.when(F.col("_row")[text_col].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"))
