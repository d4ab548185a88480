"""Small builders for inline tables."""

from __future__ import annotations

from datetime import date


def day(text):
    return date.fromisoformat(text)


def frame(spark, schema, rows):
    """Inline table; text in a date column is read as a date."""
    kinds = [part.split()[1] for part in schema.split(",")]
    fixed = [
        tuple(day(v) if k == "date" and isinstance(v, str) else v for v, k in zip(row, kinds))
        for row in rows
    ]
    return spark.createDataFrame(fixed, schema)


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def dates(df, col="rdate"):
    return sorted(str(r[col]) for r in df.select(col).collect())
