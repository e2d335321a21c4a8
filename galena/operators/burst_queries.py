"""Template bursts in the documents' lines: a document is a second of its source, forty seconds are a window, a line's id is its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bursts
from .queries import MASKED, TEMPLATES


def log_template_bursts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("source", F.lit("")).alias("service"), (F.col("doc_id") * 1_000_000).alias("us"), F.posexplode(F.split("text", "\n")).alias("i", "line"), "doc_id")
    lines = docs.where("trim(line) <> ''").withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")))
    got = bursts.log_bursts(lines.select("service", "us", "id", "line"), 40_000_000, most_chars=5000, floor=0.05)
    return got.withColumns({"deformation": F.round("deformation", 6), "score": F.round("score", 6)})


#: The templates are learned from lines of at most 5000 characters, here as in the rule.
LEARNED = TEMPLATES.replace("WHERE trim(line) <> ''", "WHERE trim(line) <> '' AND length(trim(line)) <= 5000")
QUERIES = {
    "log_template_bursts": (
        log_template_bursts,
        f"""WITH RECURSIVE leaders AS MATERIALIZED ({LEARNED}),
x AS MATERIALIZED (SELECT coalesce(source, '') AS service, doc_id // 40 AS tick, regexp_replace({MASKED}, '\\s+', ' ', 'g') AS template, length(trim(line)) <= 5000 AS good FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
g AS (SELECT service, tick, count(*) FILTER (WHERE good) AS records, count(*) FILTER (WHERE NOT good) AS unclear FROM x GROUP BY service, tick),
p AS (SELECT service, unnest(range(min(tick), max(tick) + 1)) AS tick FROM g GROUP BY service),
s AS (SELECT *, CASE WHEN unclear > 0 THEN 'INSUFFICIENT' WHEN before < 3 THEN 'WARMING' WHEN records < 5 THEN 'INSUFFICIENT' ELSE 'EVALUATED' END AS status
      FROM (SELECT p.service, p.tick, coalesce(records, 0) AS records, coalesce(unclear, 0) AS unclear,
                   (SELECT count(*) FROM g y WHERE y.service = p.service AND y.tick < p.tick AND y.unclear = 0 AND y.records >= 5) AS before FROM p LEFT JOIN g ON g.service = p.service AND g.tick = p.tick)),
c AS (SELECT x.service, x.tick, l.leader, count(*) AS n FROM x JOIN leaders l ON l.source = x.service AND l.template = x.template WHERE good GROUP BY ALL),
b AS (SELECT c.service, leader, sum(n) / 40.0 / 3 AS base FROM c JOIN s ON s.service = c.service AND s.tick = c.tick AND status = 'WARMING' AND records >= 5 GROUP BY c.service, leader),
d AS (SELECT c.service, c.tick, c.leader, n, greatest(n / 40.0 - coalesce(base, 0), 0) / greatest(coalesce(base, 0), 0.05) AS deformation FROM c JOIN s ON s.service = c.service AND s.tick = c.tick AND status = 'EVALUATED' LEFT JOIN b ON b.service = c.service AND b.leader = c.leader),
f AS (SELECT DISTINCT ON (service, tick) *, least(deformation / 10, 1) AS score FROM d WHERE n >= 5 AND deformation >= 2 ORDER BY service, tick, least(deformation / 10, 1) DESC, deformation DESC, n DESC, leader)
SELECT s.service, s.tick, CASE WHEN status <> 'EVALUATED' THEN status WHEN f.leader IS NULL THEN 'CLEAR' ELSE 'BREACH' END AS status, records, f.leader, f.n, round(deformation, 6) AS deformation, round(score, 6) AS score
FROM s LEFT JOIN f ON f.service = s.service AND f.tick = s.tick""",
    )
}
