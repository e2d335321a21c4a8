"""One declarative statement for two engines: Spark SQL to run, DuckDB SQL to check against.

A statement names tables as ``{events}`` and the few expressions whose spelling differs as
``{us}`` and so on; everything else is standard SQL that Catalyst plans as it likes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK = {
    "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "sha": "sha2({0}, 256)",
    "p95": "percentile_disc(0.95) WITHIN GROUP (ORDER BY {0})",
    "last": "last_value({0}) IGNORE NULLS",
    "regex": "regexp_extract({0}, '{1}', 1)",
    "newest": "max_by({0}, struct(us, event_id))",
    "digits": "CAST(conv(substr({0}, 1, 12), 16, 10) AS BIGINT)",
    "xor": "bit_xor({0})",
    "q": "percentile({0}, {1})",
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "mask": "regexp_replace({0}, '[0-9]+', '#')",
    "lines": "explode(split({0}, '\\n'))",
    "listed": "array_join(array_sort(collect_set({0})), ',')",
}
DUCK = {
    "us": "epoch_us(ts)",
    "sha": "sha256({0})",
    "p95": "quantile_disc({0}, 0.95)",
    "last": "last_value({0} IGNORE NULLS)",
    "regex": "regexp_extract({0}, '{1}', 1)",
    "newest": "max_by({0}, row(us, event_id))",
    "digits": "CAST(concat('0x', substr({0}, 1, 12)) AS BIGINT)",
    "xor": "bit_xor({0})",
    "q": "quantile_cont({0}, {1})",
    "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "mask": "regexp_replace({0}, '[0-9]+', '#', 'g')",
    "lines": "unnest(string_split({0}, chr(10)))",
    "listed": "string_agg(DISTINCT {0}, ',' ORDER BY {0})",
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        raise KeyError(f"no such table or expression: {key}")


def _spell(text: str, words: dict[str, str], tables: Callable[[str], str]) -> str:
    import re

    def one(m: re.Match) -> str:
        name, _, args = m[1].partition(":")
        if name in TABLES:
            return tables(name)
        return _Names(words)[name].format(*args.split("~")) if args else words[name]

    return re.sub(r"\{([^{}]+)\}", one, text)


def statement(text: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(query, oracle) of one statement; the query reads only the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_spell(text, SPARK, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return run, _spell(text, DUCK, lambda t: t)
