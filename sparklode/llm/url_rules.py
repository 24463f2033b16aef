"""URL filters: given rules by host and path, and for the rest association rules of URL tokens, mined by Spark's FP-growth.

A labelled URL is a transaction of its tokens and its verdict. Itemsets that are frequent enough give rules "these tokens, then this
verdict" with a confidence and a support; rules below the thresholds go, and so does a rule that is no surer of its verdict than one with
a token less. The rules left are an inverted index from token to rule: a URL's distinct tokens are joined to it, and a rule
matches where as many tokens met as it has. Of those that match the surest decides, then the better supported, the longer, and the
verdict by name. URLs that no rule matches get the verdict most labelled URLs have.

Everything is DataFrame and SQL functions. What is compared to rules are distinct URLs, so a URL on many pages is matched once.

Defined results. A null URL, or one without ``://``, has an empty host and path, no rule, no tokens, and so the usual verdict. Without
labels, or with none on these pages, the usual verdict is "allow". Labels of repeated ids count each; a label whose quality and toxic are
both null counts for "allow". URLs of any length are matched whole, and labelled ones mined whole: as itemsets double with
each token, FP-growth takes URLs of up to ``MOST_TOKENS`` frequent tokens; where some have more, all are mined level by level instead, without
the itemsets that can't give a rule that is kept (:func:`by_levels`). Repeated pages give equal rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import Tables

ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS, MOST_TOKENS = 0.01, 0.5, 5, 16
#: Rules are broadcast up to this many; more are joined by shuffle.
FEW = 50_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query; the longest that fits decides.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def lowered(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages with ``host`` and ``path``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return pages.withColumns({"host": lowered(whole[0]), "path": whole[1]})


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Pages (with ``host`` and ``path``) with ``rule`` and ``ruling`` of the longest rule that fits, or nulls."""
    text, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        text, ruling = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(ruling)
    return pages.withColumns({"rule": text, "ruling": ruling})


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a row with ``host``, ``path`` and a URL: parts of the host (the last ones as ``tld``), words of the path, what kind they are of, and names in the query."""
    names = F.split("host", r"\.")
    host = F.transform(F.filter(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    words = F.filter(F.split(lowered(F.col("path")), r"[/._\-]+"), lambda x: x != "")
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("path:#")).otherwise(F.concat(F.lit("path:"), w))
    after = F.coalesce(F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(after, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    top = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("tld:"), F.element_at(names, -1))))
    return F.array_distinct(F.concat(top, host, F.transform(words, kind), keys))


def labelled(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", doc_id: str = "doc_id") -> DataFrame:
    """(url, label): pages joined to labels by id; poor or toxic ones are to be blocked."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.select(F.col(doc_id).alias("_id"), F.when(bad, BLOCK).otherwise(ALLOW).alias("label"))
    return pages.select(page_id, "url").join(marks, F.col(page_id) == F.col("_id")).select("url", "label")


def by_growth(rows: DataFrame, total: int, min_support: float, min_confidence: float) -> DataFrame:
    """(tokens, label, confidence, support) of all rules, from (_t, label), by FP-growth."""
    baskets = rows.select(F.concat("_t", F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.startswith(F.get("consequent", F.lit(0)), F.lit("label=")) & (F.round(F.col("support") * total) >= MIN_ROWS))
    return rules.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.get("consequent", F.lit(0)), "=", -1).alias("label"), "confidence", "support")


def by_levels(bags: DataFrame, total: int, least: int, min_confidence: float) -> DataFrame:
    """The same from (items, label, w: how many URLs), but for rules that are no surer than one with a token less, and all of whose URLs
    that one has, or that has no exception.

    Sets of k + 1 tokens are made of sets of k that a URL holds. A set goes on only if it is frequent with a label, has fewer URLs than each
    set with a token less (or else its rules, and those of all sets above it, are no surer than with that token left out), and has URLs of
    both labels (or else its rule is sure, and none above it is surer). So tokens that always come together, as in copies, don't multiply.
    """
    tables = Tables(bags.sparkSession)
    held = tables.keep(bags.withColumn("bag", F.monotonically_increasing_id()), "url-bags")
    of = held.select("bag", "label", "w", F.explode("items").alias("_x")).select("bag", "label", "w", F.array("_x").alias("set"))
    last, found = None, []
    for k in range(1, 1 + (held.agg(F.max(F.size("items"))).head()[0] or 0)):
        of = tables.keep(of, "url-sets")
        sums = of.groupBy("set").agg(F.sum("w").alias("m"), *(F.sum(F.when(F.col("label") == v, F.col("w")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)))
        sums = sums.filter(F.greatest(ALLOW, BLOCK) >= least)
        if last is not None:
            part = sums.select("set", "m", F.explode("set").alias("_x")).select("set", "m", F.array_except("set", F.array("_x")).alias("_part"))
            fewer = part.join(last.select(F.col("set").alias("_part"), F.col("m").alias("_m")), "_part").filter("m < _m").groupBy("set").agg(F.count("*").alias("_parts")).filter(F.col("_parts") == k)
            sums = sums.join(fewer.select("set"), "set")
        sums = tables.keep(sums, "url-counts")
        for v in (ALLOW, BLOCK):
            found.append(sums.filter(F.col(v) >= least).select(F.col("set").alias("tokens"), F.lit(v).alias("label"), (F.col(v) / F.col("m")).alias("confidence"), (F.col(v) / F.lit(float(total))).alias("support")))
        last = sums.filter((F.col(ALLOW) < F.col("m")) & (F.col(BLOCK) < F.col("m")))
        if last.isEmpty():
            break
        on = of.join(last.select("set"), "set").select("bag", "label", "w", "set", F.slice("set", 1, k - 1).alias("head"), F.element_at("set", -1).alias("end"))
        other = on.select("bag", "head", F.col("end").alias("_end"))
        of = on.join(other, ["bag", "head"]).filter("end < _end").select("bag", "label", "w", F.concat("set", F.array("_end")).alias("set"))
    return reduce(DataFrame.unionByName, found).filter(F.col("confidence") >= min_confidence)


def mined(known: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, label, confidence, support) of the rules kept, from (url, label); each holds on at least ``MIN_ROWS`` labelled URLs."""
    rows = with_parts(known).select(tokens().alias("_t"), "label")
    total = rows.count()
    # Tokens that FP-growth keeps, and the most of them that a URL has.
    bags = rows.groupBy(F.array_sort("_t").alias("_t"), "label").agg(F.count("*").alias("w"))
    often = bags.select(F.explode("_t").alias("_x"), "w").groupBy("_x").agg(F.sum("w").alias("_n")).filter(F.col("_n") >= ceil(min_support * total)).select("_x")
    bags = bags.select("_t", "label", "w", F.explode("_t").alias("_x")).join(often, "_x").groupBy("_t", "label", "w").agg(F.array_sort(F.collect_list("_x")).alias("items"))
    if (bags.agg(F.max(F.size("items"))).head()[0] or 0) <= MOST_TOKENS:
        rules = by_growth(rows, total, min_support, min_confidence)
    else:
        rules = by_levels(bags.select("items", "label", "w"), total, max(ceil(min_support * total), MIN_ROWS), min_confidence)
    inside = rules.select("label", "confidence", F.explode("tokens").alias("_x"), "tokens").select("label", F.array_except("tokens", F.array("_x")).alias("_part"), "tokens", "confidence")
    shorter = rules.select(F.col("label").alias("_l"), F.col("tokens").alias("_s"), F.col("confidence").alias("_c"))
    weak = inside.join(shorter, (F.col("label") == F.col("_l")) & (F.col("_part") == F.col("_s")) & (F.col("_c") >= F.col("confidence"))).select("label", "tokens").distinct()
    return rules.join(weak, ["label", "tokens"], "left_anti").select("tokens", "label", "confidence", "support")


def usual(known: DataFrame) -> str:
    """The verdict of most labelled URLs; "allow" without any, or as many of each."""
    row = known.agg(F.count_if(F.col("label") == BLOCK), F.count("*")).head()
    return BLOCK if 2 * row[0] > row[1] else ALLOW


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of those of the distinct ``urls`` (with ``host`` and ``path``) that some rule matches."""
    index = rules.select(F.col("tokens").alias("_rule"), F.size("tokens").alias("_n"), "label", "confidence", "support", F.explode("tokens").alias("_token"))
    if rules.count() <= FEW:
        index = F.broadcast(index)
    seen = urls.select("url", F.explode(tokens()).alias("_token"))
    hits = seen.join(index, "_token").groupBy("url", "_rule", "label").agg(F.count("*").alias("_met"), F.max("_n").alias("_n"), F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    best = F.max(F.struct("confidence", "support", "_n", "label"))
    return hits.filter("_met = _n").groupBy("url").agg(best["label"].alias("verdict"))


def judged(pages: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, by_tokens) of every page; ``by_tokens`` is the method's own verdict, also where a rule decides."""
    spark = pages.sparkSession
    rows = ruled(with_parts(pages.select("page_id", "url")), rules)
    verdicts = matched(with_parts(pages.select("url").filter("url IS NOT NULL").distinct()), mined(known, min_support, min_confidence))
    other = spark.range(1).select(F.lit(usual(known)).alias("_usual"))
    out = rows.join(verdicts.withColumnRenamed("verdict", "_mined"), "url", "left").crossJoin(F.broadcast(other))  # one row
    own = F.coalesce("_mined", "_usual")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), own.alias("by_tokens"))
