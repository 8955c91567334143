"""Files of any layout in one plan: the layout is data.

A file is one row, its text. The line of its header, the header's cells and the column
that each cell stands for are expressions over that row, so that a folder of any number
of layouts is scanned once, without a join and without a look at it from the driver.

A header's cells are matched to columns one to one and greedily. Every pair of cell and
column has a score, the best of the column's aliases; pairs are taken by falling score,
then by place in the header, then by the order of the columns, and a pair is passed over
where its cell or its column is taken. Last come the weak aliases, in order: a column
that is still free gets the free cell with the highest score, if that is certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

# The points of a cell that equals an alias, holds it (and more by its share
# of the cell), is held by it, or has most of its words; the share; the least and the certain.
EQUAL, HOLDS, BY_SHARE, HELD, WORDS, BY_WORDS = 100, 70, 40, 50, 40, 30
MOST_WORDS, LEAST, CERTAIN = 0.75, 50, 100


def plain(header: Column) -> Column:
    return X.header(F.coalesce(header, F.lit("")))


def points(cell: Column, alias: Column) -> Column:
    """How well a plain cell says an alias."""
    words = F.array_distinct(F.split(alias, " "))
    share = F.size(F.array_intersect(words, F.split(cell, " "))) / F.size(words)
    return (
        F.when((cell == "") | (alias == ""), 0)
        .when(cell == alias, EQUAL)
        .when(F.contains(cell, alias), HOLDS + F.floor(BY_SHARE * F.length(alias) / F.length(cell)).cast("int"))
        .when(F.contains(alias, cell), HELD)
        .when(share >= MOST_WORDS, F.floor(WORDS + BY_WORDS * share).cast("int"))
        .otherwise(0)
    )


def _words(aliases: dict[str, tuple[str, ...]]) -> Column:
    return F.array(*[F.array(*map(F.lit, words)) for words in aliases.values()])


def _best(cell: Column, words: Column) -> Column:
    return F.array_max(F.transform(words, lambda a: points(cell, a)))


def placed(headers: Column, aliases: dict[str, tuple[str, ...]], weak: dict[str, tuple[str, ...]] | None = None) -> Column:
    """For each column of ``aliases``, in order, the place (from 0) of its cell in an
    array of headers, or -1."""
    names = [*aliases]
    cells = F.transform(headers, plain)

    def pairs(cell: Column, at: Column) -> Column:
        return F.transform(_words(aliases), lambda words, field: F.struct((-_best(cell, words)).alias("s"), at.alias("at"), field.alias("field")))

    every = F.array_sort(F.filter(F.flatten(F.transform(cells, pairs)), lambda p: p["s"] <= -LEAST))
    taken = lambda fields, places: F.struct(fields.alias("fields"), places.alias("places"))
    none = F.array().cast("array<int>")

    def take(so_far: Column, pair: Column) -> Column:
        gone = F.array_contains(so_far["fields"], pair["field"]) | F.array_contains(so_far["places"], pair["at"])
        return F.when(gone, so_far).otherwise(taken(F.array_append(so_far["fields"], pair["field"]), F.array_append(so_far["places"], pair["at"])))

    def places(so_far: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda f: F.get(so_far["places"], F.array_position(so_far["fields"], f).cast("int") - 1))
        return F.transform(at, lambda p: F.coalesce(p, F.lit(-1)))

    out = F.aggregate(every, taken(none, none), take, places)
    for name, words in (weak or {}).items():
        out = F.element_at(F.transform(F.array(out), _certain(cells, F.array(*map(F.lit, words)), names.index(name))), 1)
    # never null, or Spark infers a filter from what reads it and works all out again for that, below an aggregate even
    return F.coalesce(out, F.array().cast("array<int>"))


def _certain(cells: Column, words: Column, field: int):
    """Fills the place of a free column with the free cell that says a weak alias best."""

    def fill(found: Column) -> Column:
        said = F.transform(cells, lambda c, i: F.struct((-_best(c, words)).alias("s"), i.alias("at")))
        first = F.array_min(F.filter(said, lambda p: (p["s"] <= -CERTAIN) & ~F.array_contains(found, p["at"])))
        return F.transform(found, lambda p, i: F.when((i == field) & (p < 0), F.coalesce(first["at"], F.lit(-1))).otherwise(p))

    return fill


def resolved(spark: SparkSession, headers: list[str], aliases: dict, weak: dict | None = None) -> dict[str, str]:
    """Column to header, of one list of headers."""
    if not headers:
        return {}
    row = spark.range(1).select(placed(F.array(*map(F.lit, headers)), aliases, weak).alias("p")).first()
    return {name: headers[p] for name, p in zip(aliases, row["p"], strict=True) if p >= 0}


def cells_of(line: Column) -> Column:
    """The cells of a line of comma-separated values; a quoted one loses its quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"|[^,]*)'), 1)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"((?s).*)"$', "$1"), '""', '"')
    return F.transform(found, lambda c: F.when(c.rlike(r'^\s*"'), bare(c)).otherwise(c))


def named_apart(cells: Column) -> Column:
    """Headers, where an equal one came before with a number behind."""
    before = lambda i: F.slice(cells, 1, i)
    number = lambda c, i: F.size(F.filter(before(i), lambda x: x == c))
    return F.transform(cells, lambda c, i: F.when(number(c, i) > 0, F.concat_ws(".", c, number(c, i).cast("string"))).otherwise(c))


def whole_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``path, value`` of the CSV files under a folder, unified outputs left out."""
    found = spark.read.option("recursiveFileLookup", True).option("encoding", encoding).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.upper(F.substring_index("path", "/", -1))
    return found.where(~name.startswith("UNIFIED_") & name.endswith(".CSV"))


def headed(files: DataFrame, words: tuple[str, ...], scan: int = 40) -> DataFrame:
    """``path, head_no, headers, lines``: of each file the first of its leading lines that
    has two of the words, or its first line, and the lines behind that."""
    lines = F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")
    says = lambda line: sum((F.contains(F.upper(line), F.lit(w.upper())).cast("int") for w in words), F.lit(0)) >= 2
    first = F.array_position(F.transform(F.slice("all", 1, scan), says), F.lit(True)).cast("int")
    found = files.select("path", lines.alias("all")).select("path", "all", F.greatest(first, F.lit(1)).alias("n"))
    body = F.slice("all", F.col("n") + 1, F.size("all"))
    return found.select("path", (F.col("n") - 1).alias("head_no"), named_apart(cells_of(F.get("all", F.col("n") - 1))).alias("headers"), body.alias("lines"))


def rows_of(files: DataFrame, aliases: dict, weak: dict | None, words: tuple[str, ...]) -> DataFrame:
    """``path, line_no``, the columns of ``aliases``, missing ones null, and ``places``, for
    every line behind a header. Blank lines, and lines with more cells than the header, are
    left out."""
    heads = headed(files, words).select("path", "head_no", "headers", "lines", placed(F.col("headers"), aliases, weak).alias("places"))
    lines = heads.select("path", "head_no", F.size("headers").alias("width"), "places", F.posexplode("lines").alias("nth", "line")).where("trim(line) <> ''")
    rows = lines.select("path", (F.col("head_no") + 1 + F.col("nth")).alias("line_no"), "width", "places", cells_of(F.col("line")).alias("cells")).where(F.size("cells") <= F.col("width"))
    return rows.select("path", "line_no", *[F.get("cells", F.nullif(F.col("places")[k], F.lit(-1))).alias(n) for k, n in enumerate(aliases)], "places")
