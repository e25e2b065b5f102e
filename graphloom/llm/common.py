"""Helpers shared by the text operators: scratch tables, salted joins, tokens."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scratch import discard, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words are maximal runs of anything but these bytes; bytes.split() without arguments uses the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Cells that a hot key is spread over. Only keys with many rows fill more than a few of them.
SALTS = 128


def release(df: DataFrame) -> None:
    """Lets Spark delete shuffle files of finished jobs, which it does once the driver refers to them no more."""
    import gc

    gc.collect()
    df.sparkSession._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, made unlike every column of df; Spark does not tell capitals from small letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row_each(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row of df for each value of the keys, nulls being alike: the one that is least as JSON."""
    row, text, *names = fresh(df, "row", "json", *(f"key{i}" for i in range(len(keys))))
    whole = F.struct(*(df[c] for c in df.columns))
    rows = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), whole.alias(row), F.to_json(whole).alias(text))
    return rows.groupBy(*names).agg(F.min_by(row, text).alias(row)).select(f"{row}.*")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast path of lower()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def salt_of(column: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("salt")), F.lit(salts)).cast("int")


def unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def with_group(df: DataFrame, key: str, row: str, aggs: dict[str, tuple[str, str]], salts: int = SALTS) -> DataFrame:
    """df with one column per aggregate of its group, without ever gathering a group in one task.

    aggs: new column -> (function, column), with function one of min, max, sum, count. Rows are dealt by
    (key, salt of row); partial results per cell meet per key (at most `salts` of them), and go back to the cells.
    """
    again = {"count": "sum"}
    cells = df.withColumn("_salt", salt_of(F.col(row), salts))
    keys = [key, "_salt"]
    parts = cells.groupBy(*keys).agg(*(getattr(F, f)(c).alias(n) for n, (f, c) in aggs.items()))
    totals = parts.groupBy(key).agg(*(getattr(F, again.get(f, f))(n).alias(n) for n, (f, _) in aggs.items()))
    back = parts.select(*keys).join(totals, key)
    return cells.join(back, keys).drop("_salt")


def looked_up(df: DataFrame, key: str, row: str, table: DataFrame, salts: int = SALTS) -> DataFrame:
    """df joined with a table that has each key once (inner), without ever gathering a hot key's rows in one task.

    The table goes to the cells (key, salt of row) that df has, `salts` for each key at most.
    """
    (salt,) = fresh(df, "_salt")
    cells = df.withColumn(salt, salt_of(F.col(row), salts))
    back = cells.select(key, salt).distinct().join(table, key)
    return cells.join(back, [key, salt]).drop(salt)


def slices(batches, rows: int = 500):
    """Record batches of fewer rows, so that what is made of a batch's texts stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words_of(text: str | None) -> list[str]:
    """The same words of one Python string; for tests."""
    return re.findall(WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
