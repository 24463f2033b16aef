"""Text of documents, and listings of folders.

Extraction reads binary files with Spark and works on Arrow batches; formats without a parser at hand give NULL, and callers may add
their own to :data:`EXTRACTORS`.
"""

from __future__ import annotations

import bz2
import gzip
import html
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import paths

SNIFF = 8192
# Extensions by how their text is found.
MARKUP = frozenset("html htm xhtml xml svg webarchive".split())
OPEN_XML = {"xlsx": r"xl/(sharedStrings|worksheets/[^/]+|comments[^/]*)\.xml", "xlsm": r"xl/(sharedStrings|worksheets/[^/]+|comments[^/]*)\.xml", "pptx": r"ppt/(slides|notesSlides|comments)/[^/]+\.xml", "pptm": r"ppt/(slides|notesSlides|comments)/[^/]+\.xml", "docx": r"word/(document|footnotes|endnotes|comments)\.xml", "odt": r"content\.xml"}
ARCHIVES = frozenset("zip jar tar tgz tbz txz".split())
STREAMS = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress}
NO_PARSER = frozenset("pdf rtf rtfd doc pages numbers key png jpg jpeg gif heic tiff".split())
_BROKEN = (OSError, EOFError, ValueError, KeyError, NotImplementedError, RuntimeError, zlib.error, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError)

#: extension -> (bytes, limit) -> text or None; for formats that need a library.
EXTRACTORS: dict[str, Callable[[bytes, int], str | None]] = {}


def decoded(data: bytes) -> str | None:
    """Text of plain bytes: by its mark if there are NULs (else binary), then UTF-8, CP1252, Latin-1, which takes any bytes: nothing is left for a further code."""
    if b"\0" in data[:SNIFF]:
        for mark, code in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if data.startswith(mark):
                try:
                    return data.decode(code)
                except UnicodeDecodeError:
                    return None
        return None
    for code in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return None


def visible(markup: str) -> str:
    markup = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", markup)
    return html.unescape(re.sub(r"<[^>]*>", " ", markup))


def extension(name: str) -> str:
    tail = name.rsplit("/", 1)[-1]
    stem, dot, ext = tail.rpartition(".")
    return ext.lower() if dot and stem else ""


def _members(data: bytes, ext: str) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    if ext in ("zip", "jar"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, lambda i=i: z.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, lambda m=m: t.extractfile(m).read()


def extracted(name: str, data: bytes, limit: int = 0, inside: bool = False) -> str | None:
    """Text of one file; None if it has none, is over ``limit`` bytes (0: no limit), is damaged, or has no parser. Archives in archives stay closed."""
    ext = extension(name)
    if limit and len(data) > limit or not data:
        return None
    try:
        if ext in EXTRACTORS:
            return EXTRACTORS[ext](data, limit)
        if ext in NO_PARSER:
            return None
        if ext in OPEN_XML:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                found = [i for i in z.infolist() if re.fullmatch(OPEN_XML[ext], i.filename)]
                if limit and any(i.file_size > limit for i in found):
                    return None
                return "\n".join(visible(z.read(i).decode("utf-8", "replace")) for i in found) or None
        if ext in ARCHIVES or name.lower().endswith((".tar.gz", ".tar.bz2", ".tar.xz")):
            if inside:
                return None
            parts = []
            for member, size, read in _members(data, ext if ext in ("zip", "jar") else "tar"):
                if limit and size > limit:
                    return None
                if extension(member) in ARCHIVES or extension(member) in STREAMS:
                    continue
                if (text := extracted(member, read(), limit, True)) is not None:
                    parts.append(text)
            return "\n".join(parts) or None
        if ext in STREAMS:
            if inside:
                return None
            data = STREAMS[ext](data)
            return None if limit and len(data) > limit else extracted(name.rpartition(".")[0], data, limit, True)
        text = decoded(data)
        return visible(text) if text is not None and ext in MARKUP else text
    except _BROKEN:
        return None


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content; columns that aren't used are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def texts(binary: DataFrame, limit: int = 0) -> DataFrame:
    """(path, text) of binary files. Files over the limit are dropped before their contents are read."""
    rows = binary.filter(F.col("length") <= limit) if limit else binary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extracted(p, d or b"", limit) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "text"])

    return rows.select("path", "content").mapInArrow(run, "path string, text string")


def stable_non_text(binary: DataFrame) -> DataFrame:
    """Files that are surely no text: empty, or with a NUL near the start."""
    head = F.substring("content", 1, SNIFF)
    return binary.withColumn("non_text", (F.col("length") == 0) | F.contains(F.hex(head), F.lit("00")) & F.exists(F.sequence(F.lit(1), F.octet_length(head)), lambda i: F.substring(head, i, F.lit(1)) == F.lit(b"\0")))


def scanned(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """A folder tree as files with the flags that searches need. Only metadata is read."""
    rows = binary_files(spark, path).select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.select(
        F.xxhash64("path").alias("node_id"), "path", paths.name(F.col("path")).alias("name"), F.lit(False).alias("is_dir"), "size", "modified", F.col("modified").alias("created"),
        paths.is_hidden(F.col("path")).alias("hidden"), paths.in_package(F.col("path")).alias("in_package"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("text"),
    )


def exact_scan(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted paths with what is there now; ``present`` is false for tombstones."""
    return wanted.select("path").distinct().join(listing, "path", "left").withColumn("present", F.col("node_id").isNotNull()).withColumn("is_complete", F.lit(True))
