"""OpenTelemetry JSON envelopes to observations: metrics, aggregate metrics, logs and spans.

An envelope is one JSON text.  Each reader is a parse with a fixed schema and explodes, all
inside the JVM, without a shuffle.  Attributes merge with the precedence record, scope,
resource.  An envelope that can't be parsed, or has a span that ends before it starts, is rejected as a whole.
``keep`` names columns of the raw rows that are handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ATTRIBUTES = "attributes array<struct<key string, value struct<stringValue string, boolValue boolean, intValue string, doubleValue double>>>"
POINT = f"{ATTRIBUTES}, timeUnixNano string, asDouble double, asInt string, count string, sum double"
AGGREGATE = f"struct<dataPoints array<struct<{POINT.replace('attributes array', 'attributes: array')}>>>"
METRIC = f"name string, unit string, gauge {AGGREGATE}, sum {AGGREGATE}, histogram {AGGREGATE}, exponentialHistogram {AGGREGATE}, summary {AGGREGATE}"
LOG = f"{ATTRIBUTES}, timeUnixNano string, observedTimeUnixNano string, severityText string, body struct<stringValue string>"
SPAN = f"{ATTRIBUTES}, traceId string, spanId string, name string, startTimeUnixNano string, endTimeUnixNano string, status struct<code string>"


def _schema(resources: str, scopes: str, records: str, record: str) -> str:
    return f"{resources} array<struct<resource struct<{ATTRIBUTES}>, {scopes} array<struct<scope struct<{ATTRIBUTES}>, {records} array<struct<{record}>>>>>>"


def _once(value: Column) -> Column:
    """``value`` as a generator's output, so that it is computed once for a row, however often what follows reads it."""
    return F.explode(F.array(value))


def _pairs(*sources: Column) -> Column:
    lists = [F.coalesce(s, F.array().cast("array<struct<key string, value struct<stringValue string, boolValue boolean, intValue string, doubleValue double>>>")) for s in sources]
    return F.transform(F.concat(*lists), lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["boolValue"].cast("string"), a["value"]["intValue"], a["value"]["doubleValue"].cast("string")).alias("value")))


def _last_wins(pairs: Column) -> Column:
    last = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(last, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def attr_merge(*sources: Column) -> Column:
    """One map of attributes of increasing precedence; a value is the first kind that is set, as text."""
    return _last_wins(_pairs(*sources))


def _records(raw: DataFrame, payload: str, resources: str, scopes: str, records: str, record: str, sound: Callable[[Column], Column] | None = None) -> DataFrame:
    """The records of envelopes that are ``sound`` (asked of the list of resources), as _r, _s and _x; an envelope is parsed once."""
    parsed = raw.withColumn("_e", _once(F.from_json(payload, _schema(resources, scopes, records, record))))
    if sound is not None:
        parsed = parsed.where(F.coalesce(sound(F.col(f"_e.{resources}")), F.lit(True)))
    r = parsed.withColumn("_r", F.explode(f"_e.{resources}")).withColumn("_s", F.explode(f"_r.{scopes}")).withColumn("_x", F.explode(f"_s.{records}"))
    return r.drop("_e")


def _merged(rows: DataFrame, record: str) -> DataFrame:
    """``rows`` with their ``attributes``, merged once."""
    listed = rows.withColumn("_a", _once(_pairs(F.col("_r.resource.attributes"), F.col("_s.scope.attributes"), F.col(f"{record}.attributes"))))
    return listed.withColumn("attributes", _once(_last_wins(F.col("_a"))))


def _nano(text: Column) -> Column:
    return text.cast("decimal(20,0)")


def _us(nano: Column) -> Column:
    return F.floor(_nano(nano) / 1000).cast("long")


def scalar_metrics(raw: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Gauges and sums: service, signal, us, value, unit, attributes."""
    m = _records(raw, payload, "resourceMetrics", "scopeMetrics", "metrics", METRIC)
    p = m.withColumn("_p", F.explode(F.concat(*[F.coalesce(F.col(f"_x.{k}.dataPoints"), F.array().cast(f"array<struct<{POINT}>>")) for k in ("gauge", "sum")])))
    out = _merged(p, "_p").select(*keep, "attributes", F.col("_x.name").alias("signal"), _us(F.col("_p.timeUnixNano")).alias("us"), F.coalesce("_p.asDouble", F.col("_p.asInt").cast("double")).alias("value"), F.col("_x.unit").alias("unit"))
    return out.withColumn("service", F.col("attributes")["service.name"]).where("service IS NOT NULL AND value IS NOT NULL")


def aggregate_metrics(raw: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Histograms and summaries, as a row ``.count`` and a row ``.sum`` for each point."""
    m = _records(raw, payload, "resourceMetrics", "scopeMetrics", "metrics", METRIC)
    kinds = ("histogram", "exponentialHistogram", "summary")
    p = m.withColumn("_p", F.explode(F.concat(*[F.coalesce(F.col(f"_x.{k}.dataPoints"), F.array().cast(f"array<struct<{POINT}>>")) for k in kinds])))
    both = F.array(
        F.struct(F.concat("_x.name", F.lit(".count")).alias("signal"), F.col("_p.count").cast("double").alias("value"), F.lit("count").alias("unit")),
        F.struct(F.concat("_x.name", F.lit(".sum")).alias("signal"), F.col("_p.sum").alias("value"), F.col("_x.unit").alias("unit")),
    )
    out = _merged(p, "_p").withColumn("_o", F.explode(both)).select(*keep, "attributes", _us(F.col("_p.timeUnixNano")).alias("us"), "_o.*")
    return out.withColumn("service", F.col("attributes")["service.name"]).where("service IS NOT NULL AND value IS NOT NULL")


def logs(raw: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Log records: service, us (observed time if there is no other), severity, body, ref."""
    x = _records(raw, payload, "resourceLogs", "scopeLogs", "logRecords", LOG)
    out = _merged(x, "_x").select(*keep, "attributes", _us(F.coalesce("_x.timeUnixNano", "_x.observedTimeUnixNano")).alias("us"), F.col("_x.severityText").alias("severity"), F.col("_x.body.stringValue").alias("body"))
    return out.withColumn("service", F.col("attributes")["service.name"]).withColumn("ref", F.sha2(F.concat_ws("|", "service", F.col("us").cast("string"), "body"), 256)).where("service IS NOT NULL AND us IS NOT NULL")


def spans(raw: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Spans of envelopes in which all end no earlier than they start: service, name, us, duration_ms, failed, trace_id, span_id."""
    def sound(resources: Column) -> Column:
        all_spans = F.flatten(F.transform(resources, lambda r: F.flatten(F.transform(r["scopeSpans"], lambda s: s["spans"]))))
        return F.forall(all_spans, lambda s: F.coalesce(_nano(s["endTimeUnixNano"]) >= _nano(s["startTimeUnixNano"]), F.lit(False)))

    x = _records(raw, payload, "resourceSpans", "scopeSpans", "spans", SPAN, sound)
    start, end = _nano(F.col("_x.startTimeUnixNano")), _nano(F.col("_x.endTimeUnixNano"))
    out = _merged(x.where(end >= start), "_x").select(*keep, "attributes", F.col("_x.name").alias("name"), _us(start).alias("us"), ((end - start).cast("double") / 1e6).alias("duration_ms"), (F.col("_x.status.code") == "STATUS_CODE_ERROR").alias("failed"), F.col("_x.traceId").alias("trace_id"), F.col("_x.spanId").alias("span_id"))
    return out.withColumn("service", F.col("attributes")["service.name"]).where("service IS NOT NULL")


def _attribute(key: str, text: str = "NULL", number: str = "NULL") -> str:
    return f"named_struct('key', '{key}', 'value', named_struct('stringValue', CAST({text} AS STRING), 'intValue', CAST({number} AS STRING)))"


def envelopes(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """An envelope of ``signal`` for each row of ``events``, as a collector would send it."""
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    nano = f"concat(CAST({us} AS STRING), '000')"
    end = f"concat(CAST({us} + CAST(round(value * 1000) AS BIGINT) AS STRING), '000')"
    resource = f"named_struct('attributes', array({_attribute('service.name', 'event_type')}, {_attribute('env', "'low'")})) AS resource"
    scope = f"named_struct('attributes', array({_attribute('env', "'mid'")})) AS scope"
    user = _attribute("user.id", number="user_id")
    high = _attribute("env", "'high'")
    own = f"CASE WHEN event_id % 2 = 0 THEN array({user}, {high}) ELSE array({user}) END"
    points = f"array(named_struct('attributes', {own}, 'timeUnixNano', {nano}, 'asDouble', CASE WHEN event_id % 3 > 0 THEN value END, 'asInt', CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) END, 'count', CAST(user_id AS STRING), 'sum', value))"
    record = {
        "scalar": f"named_struct('name', 'value', 'unit', 'ms', 'gauge', named_struct('dataPoints', {points}))",
        "aggregate": f"named_struct('name', 'value', 'unit', 'ms', 'histogram', named_struct('dataPoints', {points}))",
        "logs": f"named_struct('attributes', {own}, 'observedTimeUnixNano', {nano}, 'severityText', event_type, 'body', named_struct('stringValue', props))",
        "spans": f"named_struct('attributes', {own}, 'traceId', sha1(CAST(user_id AS STRING)), 'spanId', CAST(event_id AS STRING), 'name', event_type, 'startTimeUnixNano', CASE WHEN event_id % 10 = 0 THEN {end} ELSE {nano} END, 'endTimeUnixNano', CASE WHEN event_id % 10 = 0 THEN {nano} ELSE {end} END, 'status', named_struct('code', CASE WHEN event_type = 'error' THEN 'STATUS_CODE_ERROR' END))",
    }[signal]
    names = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "spans": ("resourceSpans", "scopeSpans", "spans")}.get(signal, ("resourceMetrics", "scopeMetrics", "metrics"))
    tree = f"to_json(named_struct('{names[0]}', array(struct({resource}, array(struct({scope}, array({record}) AS {names[2]})) AS {names[1]})))) AS payload"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", tree)


def _env(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("service", "us", *columns, F.col("attributes")["env"].alias("env"), F.col("attributes")["user.id"].cast("long").alias("user_id"))


#: What the merge gives: the record's value where it has one, else the scope's.
_ENV_SQL = "CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'mid' END AS env, user_id"

QUERIES = {
    "otlp_scalar_metrics": (
        lambda spark, sf: _env(scalar_metrics(envelopes(spark, sf, "scalar")), "signal", "value", "unit"),
        f"SELECT event_type AS service, epoch_us(ts) AS us, 'value' AS signal, CASE WHEN event_id % 3 > 0 THEN value ELSE CAST(event_id AS DOUBLE) END AS value, 'ms' AS unit, {_ENV_SQL} FROM events",
    ),
    "otlp_aggregate_metrics": (
        lambda spark, sf: _env(aggregate_metrics(envelopes(spark, sf, "aggregate")), "signal", "value", "unit"),
        f"SELECT event_type AS service, epoch_us(ts) AS us, 'value.count' AS signal, CAST(user_id AS DOUBLE) AS value, 'count' AS unit, {_ENV_SQL} FROM events UNION ALL SELECT event_type, epoch_us(ts), 'value.sum', value, 'ms', {_ENV_SQL} FROM events",
    ),
    "otlp_logs": (
        lambda spark, sf: _env(logs(envelopes(spark, sf, "logs")), "severity", "body", "ref"),
        f"SELECT event_type AS service, epoch_us(ts) AS us, event_type AS severity, props AS body, sha256(concat_ws('|', event_type, CAST(epoch_us(ts) AS VARCHAR), props)) AS ref, {_ENV_SQL} FROM events",
    ),
    "otlp_spans": (
        lambda spark, sf: _env(spans(envelopes(spark, sf, "spans")), "name", F.round("duration_ms", 3).alias("duration_ms"), F.coalesce("failed", F.lit(False)).alias("failed"), "span_id"),
        f"SELECT event_type AS service, epoch_us(ts) AS us, event_type AS name, round(CAST(round(value * 1000) AS BIGINT) / 1000.0e0, 3) AS duration_ms, event_type = 'error' AS failed, CAST(event_id AS VARCHAR) AS span_id, {_ENV_SQL} FROM events WHERE event_id % 10 <> 0 OR round(value * 1000) = 0",
    ),
}
