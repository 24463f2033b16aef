"""Operator 9: quality rules. A threshold table compiled into Spark column expressions; no user functions.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; repeated rows give equal rows; an empty
table gives an empty one; columns of the input other than the id and the text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word definition, symbols, common function words of the four languages.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by at this from or an "
    "de la le les des et un une du en que qui dans pour par sur est pas au "
    "der die und das den von zu mit dem ein eine auf für als nicht ist im "
    "el los las y se del con por su para al lo es una como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; a bound of None doesn't hold. ``value`` is a SQL expression over the measures of :func:`measured`."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The base rule, whose verdict no other rule overturns.
BASE = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeats", "CASE WHEN n_words > 0 THEN 100D * n_repeat_words / n_words ELSE 0D END", high=50),
)
#: Ratios are a word (or a line that has words).
TABLE = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=2, high=15),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", high=0.25),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", low=0.04),
    Rule("same_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("loud", "n_loud / greatest(n_words, 1)", high=0.25),
)


def _repeats(hashes: Column) -> Column:
    """Words inside 3-word windows found twice or more: equal windows are brought together by a sort of (hash, position), then positions are merged."""
    windows = F.slice(
        F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))),
        F.lit(1),
        F.greatest(F.size(hashes) - 2, F.lit(0)),
    )

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.transform(
            F.array(pairs),
            lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))),
        )[0]
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = F.transform(F.array(at), lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x))[0]
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(steps)

    return F.transform(F.array(windows), covered)[0].cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measures of each text; one pass, no exchange."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col),
        text.alias("_t"),
        F.array_remove(F.split(text, WORD_GAP), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "").alias("_l"),
    ).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    stop = list(dict.fromkeys(STOP_WORDS))
    symbols = F.col("_t")
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    has_symbols = F.col("_t").rlike("[" + SYMBOLS.replace("&", "\\&") + "]")
    return split.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(has_symbols, F.length("_t") - F.length(symbols)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("_h")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_loud"),
    )


def passes(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        v = F.expr(r.value)
        if r.low is not None:
            ok = ok & (v >= r.low)
        if r.high is not None:
            ok = ok & (v <= r.high)
    return ok


def judged(docs: DataFrame, table: tuple[Rule, ...] = TABLE, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row."""
    m = measured(docs, id_col, text_col).withColumn("base_failed", ~passes(base))
    return m.withColumn("kept", ~F.col("base_failed") & passes(table))
