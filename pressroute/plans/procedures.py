"""Reports as procedures: a SQL script with parameters whose result takes the place of the last one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pressroute.session import shared_folder


def run_procedure(spark: SparkSession, name: str, select: str, parameters: dict[str, tuple[str, object]]) -> DataFrame:
    """Runs ``select`` (with ``?`` for each parameter, in order) and keeps its result under ``name``.

    ``parameters`` gives each session variable's type and value. One script declares them, fills a new table through
    ``EXECUTE IMMEDIATE`` with parameter markers, so that no value becomes part of the text, and points the view
    ``name`` at it. Readers see the old result or the new one, never a mixture; a run that fails leaves the old
    one. Tables of earlier runs are dropped once nothing points at them.
    """
    fresh = f"{name}_run_{uuid.uuid4().hex}"
    for variable, (kind, value) in parameters.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} {kind}")
        spark.sql(f"SET VAR {variable} = CAST(:value AS {kind})", args={"value": value})
    text = f"CREATE TABLE {fresh} USING parquet LOCATION '{shared_folder(spark, name)}' AS {select}".replace("'", "''")
    using = f" USING {', '.join(parameters)}" if parameters else ""
    spark.sql(f"""
        BEGIN
            EXECUTE IMMEDIATE '{text}'{using};
            CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fresh};
        END""")
    for table in spark.catalog.listTables(pattern=f"{name}_run_*"):
        if table.name != fresh:
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    return spark.table(name)
