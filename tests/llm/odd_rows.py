"""Rows with columns that operators might mistake for their own."""


def clashing(df, **columns):
    """The rows with more columns, named like some that operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "size", "digest", "n", "fp", "label", "host", "path", "rule", "draw", "row", "evidence", "site_posterior", "posterior",
                 "site_host", "host_n", "epochs", "whole", "bin", "last", "pairs", "place", "run"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df
