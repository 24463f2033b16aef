"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def parent(path: Column) -> Column:
    p = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def extension(file_name: Column) -> Column:
    """Lower-case text after the last dot; '' for dot files, and for names that end in a dot."""
    return F.lower(F.regexp_extract(file_name, r"^.+\.([^./]+)$", 1))


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"^(.+)\.[^./]+$", "$1")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies below it."""
    return (path == root) | F.startswith(path, F.when(root == "/", "/").otherwise(F.concat(root, F.lit("/"))))


def ancestors(path: Column, self_too: bool = True) -> Column:
    """The path and all folders above it, without the root; longest last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.size(parts) if self_too else F.size(parts) - 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def canonical(path: Column) -> Column:
    """Aliases of the data volume, of private folders and of the no-follow prefix resolved."""
    p = F.regexp_replace(path, r"^/\.nofollow(?=/)", "")
    p = F.regexp_replace(p, r"^/System/Volumes/Data(?=/(Applications|Library|Users|Volumes|opt|private|usr|cores|home)(/|$))", "")
    return F.regexp_replace(p, r"^/private(?=/(var|tmp|etc)(/|$))", "")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: F.startswith(c, F.lit(".")) & ~c.isin(".", ".."))


# Extensions of packages, and of folders that hold a document.
PACKAGES = "app bundle framework plugin kext xcodeproj xcworkspace playground photoslibrary rtfd pages numbers key".split()
CONTENT_FOLDERS = "pages numbers key rtfd".split()


def in_package(path: Column) -> Column:
    """Some folder above is a package."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: extension(c).isin(PACKAGES))
