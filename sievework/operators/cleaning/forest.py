"""Iterative imputation with random forests from Spark's ML library."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from sievework.functions.columns import as_double, numeric_columns, quoted
from sievework.session import materialize, remove_step, write_step

_TOLERANCE = 1e-3


def forest_impute(df: DataFrame, trees: int = 50, rounds: int = 10, depth: int = 8) -> DataFrame:
    """Fill every numeric column that has gaps from all other numeric columns.

    Gaps start at the column mean.  Each round refits the columns in order of
    their number of gaps and replaces the filled cells by predictions, until
    they move less than a thousandth of the largest known value.

    The table is written once, with a row key.  A round's state holds only the
    gap columns of the rows that have a gap, by that key, so what a round writes
    follows the gaps, not the table; rows without gaps train the forests from
    where they lie.  Each state is written to the shared folder, which keeps
    plans short and survives lost executors, and the one before it is deleted.
    """
    names = numeric_columns(df)
    row = df.agg(
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.max(F.abs(as_double(df, c))).alias(f"a{i}") for i, c in enumerate(names)],
    ).first()
    usable = [i for i in range(len(names)) if row[f"m{i}"] is not None]
    gaps = sorted((i for i in usable if row[f"n{i}"] > 0), key=lambda i: row[f"n{i}"])
    if not gaps or len(usable) < 2:
        filled = {names[i]: F.coalesce(as_double(df, names[i]), F.lit(row[f"m{i}"])) for i in gaps}
        return df.select([filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])

    names_of = {c: f"c{k}" for k, c in enumerate(df.columns)}  # no name of the table can clash inside
    holes = [quoted(names[i]).isNull() for i in gaps]
    table = materialize(
        df.select(
            *[quoted(c).alias(names_of[c]) for c in df.columns],
            *[as_double(df, names[i]).alias(f"x{i}") for i in usable],
            reduce(or_, holes).alias("open"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "forest",
    )
    cells = [f"x{i}" for i in usable]
    whole = table.filter(~F.col("open")).select(cells)
    # What is known of the rows with gaps; a round's guesses are joined to it by the row key.
    holed = table.filter("open").select("row", *cells)
    guessed = holed.select("row", *[F.coalesce(f"x{i}", F.lit(row[f"m{i}"])).alias(f"g{i}") for i in gaps])
    guessed, written = write_step(guessed, "forest-round")
    largest = max(row[f"a{i}"] for i in usable)
    fixed = [f"x{i}" for i in usable if i not in gaps]
    for _ in range(rounds):
        state = holed.join(guessed, "row").select(
            "row",
            *fixed,
            *[F.col(f"g{i}").alias(f"x{i}") for i in gaps],
            *[F.col(f"x{i}").isNull().alias(f"hole{i}") for i in gaps],
            *[F.col(f"g{i}").alias(f"old{i}") for i in gaps],
        )
        for i in gaps:
            assembler = VectorAssembler(inputCols=[c for c in cells if c != f"x{i}"], outputCol="features")
            forest = RandomForestRegressor(
                featuresCol="features",
                labelCol=f"x{i}",
                predictionCol="guess",
                numTrees=trees,
                maxDepth=depth,
                featureSubsetStrategy="all",
                seed=0,
            )
            known = whole.unionByName(state.filter(~F.col(f"hole{i}")).select(cells))
            model = forest.fit(assembler.transform(known))
            state = model.transform(assembler.transform(state))
            state = state.withColumn(f"x{i}", F.when(F.col(f"hole{i}"), F.col("guess")).otherwise(F.col(f"x{i}")))
            state = state.drop("features", "guess")
        superseded = written
        now = state.select("row", *[F.col(f"x{i}").alias(f"g{i}") for i in gaps], *[f"old{i}" for i in gaps])
        guessed, written = write_step(now, "forest-round")
        remove_step(df.sparkSession, superseded)  # only this loop read it
        moved = guessed.agg(
            F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(f"g{i}") - F.col(f"old{i}"))) for i in gaps])
        ).first()[0]
        guessed = guessed.select("row", *[f"g{i}" for i in gaps])
        if moved < _TOLERANCE * largest:
            break
    filled = {names[i]: F.col(f"g{i}") for i in gaps}
    kept = {c: F.col(f"x{i}") for i, c in enumerate(names) if i in gaps}
    rest = table.filter(~F.col("open")).select([kept.get(c, F.col(names_of[c])).alias(c) for c in df.columns])
    done = table.filter("open").join(guessed, "row").select([filled.get(c, F.col(names_of[c])).alias(c) for c in df.columns])
    return rest.unionByName(done)
