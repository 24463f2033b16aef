"""Content index: bodies stored once, trigram postings, freshness, and a plan of what must be read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = ["path", "size", "modified", "created", "extractor"]
EMPTY, OWNER, SHARED, TOO_LARGE = 0, 1, 2, 3


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (digest, utf8_bytes, content_id, members): equal texts are one body, named by its smallest id."""
    text = F.col("text")
    return docs.filter(text.isNotNull()).groupBy(F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("utf8_bytes")).agg(F.min("doc_id").alias("content_id"), F.count("*").alias("members"))


def states(docs: DataFrame, largest: int) -> DataFrame:
    """(doc_id, digest, state): 0 no text, 1 owns its body's postings, 2 shares them, 3 too large to index."""
    text = F.col("text")
    d = docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("bytes"))
    own = d.filter("bytes > 0").groupBy("digest").agg(F.min("doc_id").alias("owner"))
    return d.join(own, "digest", "left").select(
        "doc_id", "digest", F.when(F.coalesce(F.col("bytes"), F.lit(0)) == 0, EMPTY).when(F.col("bytes") > largest, TOO_LARGE).when(F.col("doc_id") == F.col("owner"), OWNER).otherwise(SHARED).alias("state")
    )


def gram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, 21 bits a letter."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])


def postings(docs: DataFrame, id_col: str = "doc_id", wanted: list[int] | None = None) -> DataFrame:
    """(tri, id): the inverted index of the lower-case texts, or its part for some trigrams.

    Trigrams are cut in numpy: the same with array functions takes five times as long, as each letter is a string there.
    """
    keep = None if wanted is None else np.array(sorted(wanted), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [gram_codes(t) if t else np.zeros(0, np.int64) for t in b.column(1).to_pylist()]
            if keep is not None:
                codes = [np.intersect1d(c, keep, assume_unique=True) for c in codes]
            n = [len(c) for c in codes]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], ["tri", "id"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.lower("text").alias("text")).mapInArrow(run, f"tri long, id {kind}")


def literal_grams(literal: str) -> list[int]:
    return gram_codes(literal.lower()).tolist()


def candidates(index: DataFrame, literal: str) -> DataFrame:
    """Ids that have all trigrams of the literal; may hold ids without the literal, never misses one with it."""
    wanted = literal_grams(literal)
    if not wanted:
        return index.select("id").distinct()
    return index.filter(F.col("tri").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def store_postings(index: DataFrame, at: str, buckets: int = 64, spread: int = 64) -> None:
    """Write postings in buckets of trigrams, sorted by trigram and id: Parquet keeps such ids as gaps, and its statistics skip the rest of
    a bucket. A bucket, and with it a frequent trigram, is dealt to ``spread`` keys by the ids; small ones are put together again by Spark."""
    dealt = index.withColumn("bucket", _bucket(F.col("tri"), buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "tri", "id").write.partitionBy("bucket").option("parquet.writer.version", "v2").option("parquet.block.size", 4 << 20).mode("overwrite").parquet(at)


def _bucket(tri: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tri), F.lit(buckets)).cast("int")


def stored_postings(spark: SparkSession, at: str, literal: str, buckets: int = 64) -> DataFrame:
    """The postings of a literal's trigrams: only their buckets are read."""
    index = spark.read.parquet(at)
    wanted = literal_grams(literal)
    if not wanted:
        return index.select("tri", "id")
    numbers = spark.createDataFrame([(w,) for w in wanted], "tri long").select(_bucket(F.col("tri"), buckets)).distinct()
    return index.filter(F.col("bucket").isin([r[0] for r in numbers.collect()]) & F.col("tri").isin(wanted)).select("tri", "id")


def found(docs: DataFrame, index: DataFrame | None, literal: str) -> DataFrame:
    """Documents with the literal: candidates of the index, then the text itself. Without an index the trigrams of the literal are looked for."""
    if index is None:
        index = postings(docs, wanted=literal_grams(literal) or None)
    return docs.join(candidates(index, literal), docs["doc_id"] == F.col("id"), "left_semi").filter(F.contains(F.lower("text"), F.lit(literal.lower())))


def stale(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files whose fingerprint the index doesn't have: new, or changed."""
    same = None
    for c in FINGERPRINT:
        test = files[c].eqNullSafe(meta[c])
        same = test if same is None else same & test
    return files.join(meta.select(FINGERPRINT), same, "left_anti")


def orphans(body: DataFrame, meta: DataFrame) -> DataFrame:
    """Bodies that no document names."""
    return body.join(meta.filter(F.col("content_id").isNotNull()).select("content_id").distinct(), "content_id", "left_anti")


def read_plan(files: DataFrame, meta: DataFrame, hits: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Files with ``skip``: fresh ones that have no text, or own postings that miss the literal. All others must be read."""
    m = meta.select("path", F.col("size").alias("m_size"), F.col("modified").alias("m_modified"), "state", "content_id")
    if legacy is not None:
        old = legacy.select("path", F.col("size").alias("l_size"), F.col("modified").alias("l_modified"), F.col("state").alias("l_state"), F.col("content_id").alias("l_content"))
        m = m.join(old, "path", "full").select("path", F.coalesce("m_size", "l_size").alias("m_size"), F.coalesce("m_modified", "l_modified").alias("m_modified"), F.coalesce("state", "l_state").alias("state"), F.coalesce("content_id", "l_content").alias("content_id"))
    h = hits.select(F.col("id").alias("content_id"), F.lit(True).alias("hit")).distinct()
    rows = files.join(m, "path", "left").join(h, "content_id", "left")
    fresh = (F.col("size") == F.col("m_size")) & (F.col("modified") == F.col("m_modified"))
    skip = F.coalesce(fresh, F.lit(False)) & ((F.col("state") == EMPTY) | (F.col("state") == OWNER) & F.col("hit").isNull())
    return rows.withColumn("skip", F.coalesce(skip, F.lit(False)))


def covered(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """Legacy rows that no fresh current row covers; the legacy index may go once there are none."""
    return legacy.join(current.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def diagnostics(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("documents"), F.count_distinct("digest").alias("bodies"), F.count_if(F.col("state") == SHARED).alias("shared"))


def name_postings(files: DataFrame) -> DataFrame:
    """(name, n, ids): the rows of each name."""
    return files.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node_id")).alias("ids"))


#: Names in a block, and longs of 64 bits in its signature.
NAMES, LONGS = 16, 4


def _bits(gram: Column) -> tuple[Column, Column]:
    """(which long, its bit) of a gram."""
    at = F.pmod(F.xxhash64(gram), F.lit(64 * LONGS)).cast("int")
    return (at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)


def signature(names: DataFrame, block: int = NAMES) -> DataFrame:
    """(block, b0, b1, b2, b3): 256 bits of the hashed one-, two- and three-letter parts of each run of names, by node id. A block without all bits of a literal has no name with it."""
    low = F.lower("name")
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.array(F.substring(low, i, F.lit(1)), F.substring(low, i, F.lit(2)), F.substring(low, i, F.lit(3))))
    n = names.select(F.floor(F.col("node_id") / block).alias("block"), F.explode(F.array_distinct(F.flatten(short))).alias("gram"))
    which, bit = _bits(F.col("gram"))
    return n.groupBy("block").agg(*(F.coalesce(F.bit_or(F.when(which == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(LONGS)))


def blocks_with(signatures: DataFrame, literal: str) -> DataFrame:
    """Blocks that may have a name with the literal, by one comparison of bits a long."""
    low = literal.lower()
    parts = {low[i : i + k] for k in (1, 2, 3) for i in range(len(low) - k + 1)}
    keep = F.lit(True)
    for gram in sorted(parts):
        which, bit = _bits(F.lit(gram))
        of = F.get(F.array(*(F.col(f"b{k}") for k in range(LONGS))), which)
        keep = keep & (of.bitwiseAND(bit) != 0)
    return signatures.filter(keep).select("block")


def names_with(names: DataFrame, signatures: DataFrame, literal: str, block: int = NAMES) -> DataFrame:
    """Names with a literal: only those of the blocks left are compared."""
    may = blocks_with(signatures, literal).withColumnRenamed("block", "_block")
    return names.join(may, F.floor(F.col("node_id") / block) == F.col("_block"), "left_semi").filter(F.contains(F.lower("name"), F.lit(literal.lower())))


# Extensions and names by how worthwhile they are to index in the background.
STRUCTURED = "doc docx key numbers odt pages pdf pptm pptx rtf rtfd webarchive xlsm xlsx".split()
FOLDER_DOCUMENTS = "pages numbers key rtfd".split()
PLAIN = (
    "txt text md markdown rst adoc csv tsv log json jsonl yaml yml toml xml plist strings ini cfg conf config properties env sql graphql "
    "html htm css scss sass less svg c cc cpp cxx h hh hpp m mm swift rs go py pyi rb php java kt kts scala js jsx mjs cjs ts tsx vue svelte "
    "sh bash zsh fish ps1 bat cmd tex bib srt vtt ass ssa rtf"
).split()
COMMON_NAMES = "readme license licence copying notice authors changelog makefile dockerfile gemfile rakefile podfile".split()
DEFERRED_FOLDERS = ".build .cache .gradle build caches deriveddata dist node_modules out target".split()
ARCHIVE_ENDS = ".tar.gz .tar.bz2 .tar.xz .tgz .tbz .tbz2 .txz .zip .tar .gz .bz2 .xz".split()


def tier(files: DataFrame, cap: int = 16 << 20) -> DataFrame:
    """``tier``: structured, preferred (up to ``cap`` bytes), or NULL for archives, what lies in build and cache folders, and the rest."""
    from sparklode.functions.paths import extension

    name, ext = F.lower("name"), F.lower(extension(F.col("name")))
    deferred = F.exists(F.split(F.lower("path"), "/"), lambda c: c.isin(DEFERRED_FOLDERS))
    for end in ARCHIVE_ENDS:
        deferred = deferred | name.endswith(end)
    structured = F.when(F.col("is_dir"), ext.isin(FOLDER_DOCUMENTS)).otherwise(ext.isin(STRUCTURED))
    preferred = ~F.col("is_dir") & (ext.isin(PLAIN) | name.isin(COMMON_NAMES)) & (F.col("size") <= cap)
    return files.withColumn("tier", F.when(deferred, None).when(structured, "structured").when(preferred, "preferred"))
