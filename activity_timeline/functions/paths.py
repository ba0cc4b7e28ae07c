"""Column expressions for absolute POSIX paths and for text inside XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy_path(path: Column) -> Column:
    """One slash between parts, no '.' parts, no slash at the end; exactly two in front stay."""
    joined = F.concat(F.when(path.rlike("^//(?!/)"), "/").otherwise(""),
                      F.regexp_replace(path, "/+", "/"))
    joined = F.regexp_replace(joined, r"(/\.)+(?=/|$)", "")
    return F.regexp_replace(joined, "(?<=.)/$", "")


def file_uri(path: Column) -> Column:
    """file:// address of an absolute path, percent-encoded as UTF-8."""
    absolute = F.when(path.startswith("/"), tidy_path(path)).otherwise(
        F.raise_error(F.concat(F.lit("not an absolute path: "), path)))
    coded = F.url_encode(absolute)
    # url_encode writes the form variant; these four differ in a path
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(form), F.lit(plain))
    return F.concat(F.lit("file://"), coded)


def file_name(path: Column) -> Column:
    return F.substring_index(tidy_path(path), "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def xml_text(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
