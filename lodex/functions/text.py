"""Lines, tokens, names, one-liners and source slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def lines_of(text: Column) -> Column:
    """Lines without the empty piece after a last line break."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Line breaks, and one more unless the text is empty."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text == "", 0).otherwise(1)


def numbered_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select(path, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).select(path, (F.col("pos") + 1).alias("line_no"), "line")


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda x: x != "")


def one_liner(text: Column, most: int = 100) -> Column:
    """Cut to `most` characters, the last three dots if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def file_one_liner(path: Column, docstring: Column) -> Column:
    """The docstring cut short, or the file's name as capitalised words."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    words = F.filter(F.split(name, r"[_\-. ]+"), lambda w: w != "")
    return F.coalesce(one_liner(docstring), F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " "))


def visibility(name: Column) -> Column:
    """Names like __x are private, _x protected, all others public, __x__ too."""
    return F.when(name.startswith("__") & name.endswith("__"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both kept)."""
    return F.array_join(F.slice(lines_of(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def numbered_source(text: Column, start: Column, end: Column) -> Column:
    """The slice with a line number before each line."""
    part = F.slice(lines_of(text), start, F.greatest(end - start + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda line, k: F.format_string("  %4d | %s", (start + k).cast("int"), line)), "\n")


def signature(params: Column, returns: Column) -> Column:
    """(T1, T2)->R: each parameter's annotation, or its name without one; self and cls left out, and nothing for no return type."""
    shown = F.transform(F.filter(params, lambda p: ~p["name"].isin("self", "cls")), lambda p: F.coalesce(p["annotation"], p["name"]))
    return F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")->"), F.coalesce(returns, F.lit("")))


def holds_block(text: Column, block: Column) -> Column:
    """Whether the block stands in the text, blanks around it apart."""
    return text.contains(F.regexp_replace(block, r"^\s+|\s+$", ""))
