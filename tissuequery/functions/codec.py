"""Names: coefficient columns, conditions, files. The only place that knows `$` and `#`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_kind(term: Column) -> Column:
    """intercept, lr, tfl or tf; the ligand-receptor mark is looked for first."""
    return F.when(term.isin("beta0", "beta_0"), "intercept").when(term.contains("$"), "lr").when(term.contains("#"), "tfl").otherwise("tf")


def displayed_kind(term: Column) -> Column:
    """The kind that reports show: the ligand-TF mark is looked for first."""
    return F.when(term.contains("#"), "ligand-tf").when(term.contains("$"), "ligand-receptor").otherwise("tf")


def term_parts(term: Column) -> tuple[Column, Column]:
    """The two names of a term without its prefix, split at the first mark; the second is null for plain terms."""
    bare = F.regexp_replace(term, "^beta_", "")
    mark = F.when(bare.contains("$"), "$").when(bare.contains("#"), "#")
    at = F.when(mark.isNotNull(), F.locate("$", bare)).otherwise(0)
    at = F.when(mark == "#", F.locate("#", bare)).otherwise(at)
    first = F.when(mark.isNull(), bare).otherwise(F.substring(bare, F.lit(1), at - 1))
    return first, F.when(mark.isNotNull(), F.substring(bare, at + 1, F.length(bare)))


def gene_of_file(path: Column) -> Column:
    """The target gene of a coefficient file: its stem less the suffix, else empty."""
    return F.regexp_extract(path, r"([^/]*)_betadata\.[^./]*$", 1)


def sanitized_condition(label: Column) -> Column:
    """A condition's name as a directory: other characters become `_`, runs are one, 64 at most, trimmed."""
    out = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9\-_.]", "_"), "_+", "_")
    out = F.regexp_replace(F.regexp_replace(F.substring(out, 1, 64), "^_+|_+$", ""), r"^\.+|\.+$", "")
    return F.when(out == "", "group").otherwise(out)


def condition_or_missing(label: Column) -> Column:
    return F.coalesce(F.when(F.trim(label) != "", F.trim(label)), F.lit("_na"))


def pair_parts(pair: Column, mark: str) -> tuple[Column, Column]:
    """`a$b` or `a#b` as trimmed names; null unless both are there."""
    at = F.locate(mark, pair)
    a, b = F.trim(F.substring(pair, F.lit(1), at - 1)), F.trim(F.substring(pair, at + 1, F.length(pair)))
    whole = (at > 0) & (a != "") & (b != "")
    return F.when(whole, a), F.when(whole, b)


def sanitized_filename(name: Column) -> Column:
    return F.translate(name, "/\\: ", "____")


def sanitized_float(value: Column) -> Column:
    return F.translate(F.format_string("%.6f", value), "-.", "mp")


def half_up(value: Column, digits: int) -> Column:
    """Rounded at so many decimals, halves away from zero."""
    m = 10.0**digits
    return F.round(value * m) / m


def finite_or_zero(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def name_hash(name: Column) -> Column:
    """The 32-bit hash h = 33 h + byte from 5381 on, of an ASCII name."""
    return F.aggregate(F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long")), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32))


def as_label(value: Column) -> Column:
    """Any value as text; null is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))
