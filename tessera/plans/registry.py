"""All registered queries and the SQL that says the same.

A query is one function from a dialect to SQL over {table} names. Spark runs it with the Parquet tables put in; DuckDB gets
its own spelling of it over the same names. A few are written for Spark step by step instead (``snapshots.STEPWISE``, ``slots.STEPWISE``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import minhash

from . import cleaning, collisions, languages, ledgers, relational, rollups, scheduling, shaping, shards, slots, snapshots, study, unicode_queries, windows
from .dialect import Duck, Spark
from .packing_queries import PACKING_QUERIES, PACKING_SQL
from .python_queries import PYTHON_QUERIES, PYTHON_SQL
from .token_queries import TOKEN_QUERIES, TOKEN_SQL

TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\}")


def spark_query(text: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    sql = text(Spark())
    names = sorted(set(TABLE.findall(sql)))
    hashed = "least_hashes(" in sql
    filled = "".join(f"{{{x}}}" if i % 2 else x.replace("{", "{{").replace("}", "}}") for i, x in enumerate(re.split(TABLE.pattern, sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if hashed:
            minhash.register(spark)
        tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
        return spark.sql(filled, **tables)

    return run


TEXTS = {name: f for module in (cleaning, shards, collisions, study, ledgers, relational, rollups, windows, languages, scheduling, slots, unicode_queries, shaping, snapshots) for name, f in module.QUERIES.items()}
QUERIES = {name: spark_query(f) for name, f in TEXTS.items()} | PYTHON_QUERIES | PACKING_QUERIES | unicode_queries.ARTICLES | TOKEN_QUERIES | snapshots.STEPWISE | slots.STEPWISE
SQL = {name: TABLE.sub(r"\1", f(Duck())) for name, f in TEXTS.items()} | PYTHON_SQL | PACKING_SQL | unicode_queries.ARTICLES_SQL | TOKEN_SQL
