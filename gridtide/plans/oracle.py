"""SQL twins of the registered queries, for an engine other than Spark.

They are written row by row, without the library's shortcuts: the model twin
joins weather to single readings and groups once, interpolation uses a plain
``lead`` over the whole table.
"""

from __future__ import annotations

READINGS = "SELECT user_id AS id, ts, value AS consumption, event_id, event_type FROM events"

WEATHER = """
    SELECT h, CAST(h AS DATE) AS day, hour(h) AS hour,
           CAST(20 + (dayofyear(h) * 7 + hour(h) * 3) % 80 AS DOUBLE) AS temperature
    FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events)
    WHERE (dayofyear(h) * 24 + hour(h)) % 11 <> 0
"""

CELSIUS = "((temperature - 32) * 5 / 9)"

ADJUSTED = f"""
    SELECT event_id, r.id, CAST(r.ts AS DATE) AS day, hour(r.ts) AS hour, temperature, factor,
           CAST(r.consumption AS DECIMAL(10, 2)) * factor + 7 AS adjusted
    FROM (
      SELECT r.*, temperature,
             CAST(CASE WHEN {CELSIUS} < 5 THEN 0.6 WHEN {CELSIUS} < 16 THEN 0.8
                       WHEN {CELSIUS} > 24 THEN 0.6 ELSE 1.0 END AS DECIMAL(2, 1)) AS factor
      FROM ({READINGS}) r
      LEFT JOIN ({WEATHER}) w ON CAST(r.ts AS DATE) = w.day AND hour(r.ts) = w.hour
    ) r
"""

# Some hours with a temperature that is no number, some with a second row without one.
GAPS = f"""
    SELECT day, hour, CASE WHEN hour % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE temperature END AS temperature
    FROM ({WEATHER})
    UNION ALL SELECT day, hour, NULL FROM ({WEATHER}) WHERE hour % 5 = 0
"""


def _adjusted_gaps(drop: bool) -> str:
    weather, how = (f"SELECT * FROM ({GAPS}) WHERE temperature IS NOT NULL", "JOIN") if drop else (GAPS, "LEFT JOIN")
    return f"""
    SELECT event_id, r.id, CAST(r.ts AS DATE) AS day, hour(r.ts) AS hour, temperature,
           CAST(r.consumption AS DECIMAL(10, 2)) * CAST(
             CASE WHEN temperature IS NULL OR isnan(temperature) THEN 1.0 WHEN {CELSIUS} < 5 THEN 0.6
                  WHEN {CELSIUS} < 16 THEN 0.8 WHEN {CELSIUS} > 24 THEN 0.6 ELSE 1.0 END
             AS DECIMAL(2, 1)) + 7 AS adjusted
    FROM ({READINGS}) r {how} ({weather}) w ON CAST(r.ts AS DATE) = w.day AND hour(r.ts) = w.hour
    """


KEY = "concat_ws('-', id, year(day), dayofyear(day), hour)"
LINE = "concat_ws(',', id, strftime(ts, '%Y-%m-%d %H:%M:%S'), consumption)"
TS_MS = "epoch_us(ts) // 1000"


def _to_3(x: str) -> str:
    return f"floor({x} * 1000 + 0.5) / 1000"


def _model(shifted_day: str, known_only: bool = False, adjusted: str = ADJUSTED) -> str:
    where = "WHERE temperature IS NOT NULL" if known_only else ""
    return f"""
    SELECT id, CAST(day AS DATE) AS day, hour, CAST(sum(adjusted) AS DOUBLE) / count(*) AS expected,
           count(*) AS n
    FROM (SELECT id, {shifted_day} AS day, hour, adjusted
          FROM ({adjusted}), (VALUES (1), (2), (3)) lags(k) {where})
    GROUP BY ALL
    """


LITERAL = _model("day - 1")
MINUS_DAYS = _model("day - k")
TRAILING = _model("day + k")

# Number text: two decimals, then without trailing zeros and without a leading zero.
NUMBER = (
    "regexp_replace(regexp_replace(regexp_replace(printf('%.2f', expected), '0+$', ''), "
    "'\\.$', '.0'), '^0\\.', '.')"
)


def _shown(model: str) -> str:
    return f"SELECT {KEY} AS key, {_to_3('expected')} AS expected, n FROM ({model})"


def _published(model: str) -> str:
    return f"SELECT id, day, hour, CAST(printf('%.2f', expected) AS DOUBLE) AS expected FROM ({model})"


# Of two models one after the other the second one counts.
LAST_WINS = f"""
    SELECT coalesce(b.id, a.id) AS id, coalesce(b.day, a.day) AS day,
           coalesce(b.hour, a.hour) AS hour, coalesce(b.expected, a.expected) AS expected
    FROM ({_published(TRAILING)}) a FULL JOIN ({_published(MINUS_DAYS)}) b
      ON a.id = b.id AND a.day = b.day AND a.hour = b.hour
"""


def _joined(model: str, how: str = "JOIN") -> str:
    return f"""
    SELECT r.*, m.expected, CAST(r.ts AS DATE) AS day, hour(r.ts) AS hour FROM ({READINGS}) r
    {how} ({model}) m ON r.id = m.id AND CAST(r.ts AS DATE) = m.day AND hour(r.ts) = m.hour
    """


def _detected(model: str) -> str:
    return f"""
    SELECT event_id, id, {TS_MS} AS ts_ms, consumption, {_to_3('expected')} AS expected
    FROM ({_joined(model)}) WHERE consumption > expected
    """


def _rendered(value: str, key: str = "") -> str:
    return f"SELECT {key} {value} AS value FROM ({_joined(_published(TRAILING))}) WHERE consumption > expected"


TS_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
MESSAGE = (
    f"{KEY} || ', consumption=Consumption{{id=' || id || ', measurementTimestamp=' || "
    "strftime(ts, '%a %b %d %H:%M:%S UTC %Y') || ', consumption=' || consumption || '} expected=' "
    "|| expected"
)

DAMAGED = f"""
    SELECT CASE WHEN event_type = 'error' THEN 'meter' ELSE CAST(id AS VARCHAR) END AS id_text,
           CASE WHEN event_type = 'signup' THEN '2024-02-30 25:61:00' ELSE {TS_TEXT} END AS ts_text,
           * FROM ({READINGS})
"""


CUT_LINES = f"""
    SELECT CASE event_type WHEN 'error' THEN concat_ws(',', id, {TS_TEXT})
                           ELSE concat_ws(',', id, {TS_TEXT}, 'n/a') END AS value
    FROM ({READINGS}) WHERE event_type IN ('error', 'signup')
"""


def _count_text(n: str) -> str:
    cases = []
    for power, unit in reversed(list(enumerate(["k", "M", "G", "T", "P", "E"], start=1))):
        size, tenth = 1000**power, 1000**power // 10
        cases.append(
            f"WHEN abs({n}) >= {size} THEN CASE WHEN abs({n}) // {tenth} < 100 "
            f"AND (abs({n}) // {tenth}) % 10 <> 0 "
            f"THEN (abs({n}) // {size}) || '.' || ((abs({n}) // {tenth}) % 10) "
            f"ELSE CAST(abs({n}) // {size} AS VARCHAR) END || '{unit}'"
        )
    sign = f"CASE WHEN {n} < 0 THEN '-' ELSE '' END"
    return f"{sign} || CASE {' '.join(cases)} ELSE CAST(abs({n}) AS VARCHAR) END"


def _byte_text(n: str) -> str:
    cases = []
    for power, unit in reversed(list(enumerate(["KB", "MB", "GB", "TB"], start=1))):
        shown = f"regexp_replace(printf('%.2f', round({n} / {float(1024**power)}, 2)), '\\.?0+$', '')"
        cases.append(f"WHEN {n} >= {1024**power} THEN {shown} || ' {unit}'")
    return f"CASE {' '.join(cases)} ELSE {n} || ' Bytes' END"


def _dense(chain: str) -> str:
    """Each pair of neighbours, four times; ``chain`` is the window's partition clause."""
    return f"""
    SELECT r.*, i FROM (
      SELECT *, lead({TS_MS}) OVER w AS next_ms, lead(event_id) OVER w AS next_event,
             lead(consumption) OVER w AS next_consumption
      FROM ({READINGS}) WINDOW w AS ({chain} ORDER BY ts, event_id)
    ) r, range(4) steps(i) WHERE next_event IS NOT NULL
    """


def _dense_shown(chain: str) -> str:
    return f"""
    SELECT id, {TS_MS} + (i * (next_ms - {TS_MS})) // 4 AS ts_ms,
           event_id + (i * (next_event - event_id)) // 4 AS event_id,
           consumption + i * (next_consumption - consumption) / 4 AS consumption, event_type
    FROM ({_dense(chain)})
    """


DENSE_BY_ID = _dense_shown("PARTITION BY id")

# The same on the line texts, whose times have whole seconds.
SECONDS = "epoch_us(ts) // 1000000"


def _dense_lines(readings: str) -> str:
    return f"""
    SELECT id, strftime(make_timestamp(((start_s * 1000 + (i * (next_s - start_s) * 1000) // 4)
                        // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts_text,
           consumption + i * (next_consumption - consumption) / 4 AS consumption
    FROM (SELECT id, {SECONDS} AS start_s, lead({SECONDS}) OVER w AS next_s, consumption,
                 lead(consumption) OVER w AS next_consumption
          FROM ({readings}) WINDOW w AS (PARTITION BY id ORDER BY ts, event_id)), range(4) steps(i)
    WHERE next_s IS NOT NULL
    """


CENTS = "CAST(sum(CAST(round(consumption * 100) AS BIGINT)) AS BIGINT)"

TUMBLING = f"""
    SELECT id, epoch_us(date_trunc('day', ts)) // 1000 AS start_ms, count(*) AS n, {CENTS} AS cents
    FROM ({READINGS}) GROUP BY id, date_trunc('day', ts)
"""

SLIDING = f"""
    SELECT id, epoch_us(start) // 1000 AS start_ms, count(*) AS n, {CENTS} AS cents
    FROM (SELECT *, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS start
          FROM ({READINGS}), range(6) hours(k))
    GROUP BY id, start
"""

ALARMS = f"""
    SELECT event_id, id, epoch_us(ts + to_minutes(CAST(floor(consumption) AS BIGINT))) // 1000 AS alarm_ms
    FROM ({READINGS}) WHERE consumption > 5 AND floor(consumption) <= 60
"""

DOCUMENT_LINES = r"""
    SELECT source, doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS value
    FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)
"""

COUNT = "CAST(round(consumption * 100) AS BIGINT) * event_id * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END"

ORACLE: dict[str, str] = {
    "csv_scan": f"""
        SELECT id, ({SECONDS}) * 1000 AS ts_ms, consumption FROM ({READINGS})""",
    "line_scan": f"SELECT {LINE} AS value FROM ({READINGS})",
    "parse_lines": f"""
        SELECT id, ts_text, ({SECONDS}) * 1000 AS ts_ms, consumption FROM ({DAMAGED})
        WHERE event_type NOT IN ('error', 'signup')""",
    "rejected_lines": f"""
        SELECT concat_ws(',', id_text, ts_text, consumption) AS value,
               CASE event_type WHEN 'error' THEN 'bad id' ELSE 'bad timestamp' END AS reason
        FROM ({DAMAGED}) WHERE event_type IN ('error', 'signup')""",
    "composite_keys": f"""
        SELECT event_id, concat_ws('-', id, year(ts), dayofyear(ts), hour(ts)) AS key,
               year(ts) AS year, dayofyear(ts) AS day_of_year, hour(ts) AS hour,
               id AS key_id, strftime(ts, '%Y-%m-%d') AS key_date
        FROM ({READINGS})""",
    "weather_parts": f"""
        SELECT epoch_us(h) // 1000000 AS timestamp, year(h) AS year, dayofyear(h) AS day_of_year,
               hour(h) AS hour, {CELSIUS} AS celsius FROM ({WEATHER})""",
    "count_texts": f"""
        SELECT event_id, n, {_count_text('n')} AS shown
        FROM (SELECT event_id, {COUNT} AS n FROM ({READINGS}))""",
    "byte_texts": f"""
        SELECT doc_id, {_byte_text('size')} AS shown, {_byte_text('scaled')} AS shown_scaled
        FROM (SELECT doc_id, strlen(text) AS size, strlen(text) * doc_id AS scaled FROM documents)""",
    "weather_join": f"""
        SELECT event_id, temperature, CAST(factor AS DOUBLE) AS factor,
               CAST(adjusted AS DOUBLE) AS adjusted FROM ({ADJUSTED})""",
    "hourly_partials": f"""
        SELECT concat_ws('-', id, year(ts), dayofyear(ts), hour(ts)) AS key,
               CAST(sum(CAST(consumption AS DECIMAL(10, 2))) AS DOUBLE) AS total, count(*) AS n
        FROM ({READINGS}) GROUP BY key""",
    "model_literal": _shown(LITERAL),
    "model_minus_days": _shown(MINUS_DAYS),
    "model_trailing": _shown(TRAILING),
    "model_known_weather": _shown(_model("day + k", known_only=True)),
    "model_text": f"SELECT {KEY} || ',' || {NUMBER} AS value FROM ({TRAILING})",
    "model_file": f"SELECT {KEY} AS key, expected FROM ({_published(TRAILING)})",
    "model_last_wins": f"SELECT {KEY} AS key, expected FROM ({LAST_WINS})",
    "model_rejects": """
        SELECT CASE k WHEN 1 THEN CAST(id AS VARCHAR) WHEN 2 THEN id || '-2014-010-9,2.5'
                      ELSE 'm' || id || ',1.5' END AS value,
               CASE k WHEN 1 THEN 'bad expected value' ELSE 'bad key' END AS reason
        FROM (SELECT DISTINCT user_id AS id FROM events), (VALUES (1), (2), (3)) kinds(k)""",
    "model_gaps_neutral": _shown(_model("day + k", adjusted=_adjusted_gaps(drop=False))),
    "model_gaps_drop": _shown(_model("day + k", adjusted=_adjusted_gaps(drop=True))),
    "join_gaps_neutral": f"""
        SELECT event_id, CAST(adjusted AS DOUBLE) AS adjusted FROM ({_adjusted_gaps(drop=False)})""",
    "join_gaps_drop": f"""
        SELECT event_id, CAST(adjusted AS DOUBLE) AS adjusted FROM ({_adjusted_gaps(drop=True)})""",
    "model_increments": _shown(TRAILING),
    "model_double": f"""
        SELECT {KEY} AS key, floor(expected * 1000 + 0.4123) / 1000 AS expected, n FROM ({TRAILING})""",
    "weather_csv": f"SELECT epoch_us(h) // 1000000 AS timestamp, temperature FROM ({WEATHER})",
    "threshold_anomalies": f"""
        SELECT event_id, id, {TS_MS} AS ts_ms, consumption FROM ({READINGS}) WHERE consumption > 5""",
    "threshold_lines": f"SELECT {LINE} AS value FROM ({READINGS}) WHERE consumption > 5",
    "detect_literal": _detected(LITERAL),
    "detect_minus_days": _detected(MINUS_DAYS),
    "detect_trailing": _detected(TRAILING),
    "expected_for_all": f"""
        SELECT event_id, consumption, {_to_3('expected')} AS expected
        FROM ({_joined(TRAILING, 'LEFT JOIN')})""",
    "detect_fanout": f"""
        SELECT event_id, consumption, expected
        FROM ({_joined(_published(TRAILING) + ' UNION ALL ' + _published(MINUS_DAYS))})
        WHERE consumption > expected""",
    "detect_lookup": f"""
        SELECT event_id, consumption, expected FROM ({_joined(LAST_WINS)})
        WHERE consumption > expected""",
    "detect_stored": f"""
        SELECT event_id, consumption, {_to_3('expected')} AS expected
        FROM ({_joined(TRAILING)}) WHERE consumption > expected""",
    "render_bracket": _rendered(f"'[' || concat_ws(',', id, {TS_TEXT}, consumption, expected) || ']'"),
    "render_tuple": _rendered(f"'(' || concat_ws(',', {KEY}, id, {TS_TEXT}, consumption) || ')'"),
    "render_message": _rendered(MESSAGE, f"{KEY} AS key,"),
    "densify_none": f"SELECT event_id, id, consumption FROM ({READINGS})",
    "densify_multiply": f"SELECT event_id, id, consumption FROM ({READINGS}), range(8)",
    "densify_interpolate": DENSE_BY_ID,
    "densify_global": _dense_shown(""),
    "densify_lines": _dense_lines(READINGS),
    "densify_segments": DENSE_BY_ID,
    "densify_integer": f"""
        SELECT id, event_id + (i * (next_event - event_id)) // 4 AS event_id, consumption
        FROM ({_dense('PARTITION BY id')})""",
    "densify_permissive": _dense_lines(f"{READINGS} WHERE event_type NOT IN ('error', 'signup')"),
    "densify_rejects": f"SELECT value, 'bad field 2' AS reason FROM ({CUT_LINES})",
    "threshold_rejects": f"SELECT value, 'bad consumption' AS reason FROM ({CUT_LINES})",
    "densify_custom": f"""
        SELECT id, event_id, CASE WHEN i * 2 < 4 THEN consumption ELSE next_consumption END AS consumption
        FROM ({_dense('PARTITION BY id')})""",
    "replay_slots": f"""
        SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS slot
        FROM ({READINGS})""",
    "replay_records": f"""
        SELECT CAST({TS_MS} AS VARCHAR) AS key, {LINE} AS value FROM ({READINGS}), range(2)""",
    "marker_tap": f"""
        SELECT 'timer' AS topic, CAST({TS_MS} AS VARCHAR) AS key,
               'GENERATED: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') ||
               lpad(CAST(({TS_MS}) % 1000 AS VARCHAR), 3, '0') || 'Z' AS value
        FROM ({READINGS})
        WHERE {LINE} = (SELECT {LINE} FROM ({READINGS}) ORDER BY ts DESC, event_id DESC LIMIT 1)""",
    "ingest_metrics": f"""
        SELECT n AS records, {_count_text('n')} AS shown FROM (SELECT count(*) * 8 AS n FROM events)""",
    "ingest_written": f"""
        SELECT n AS records, {_count_text('n')} AS shown,
               (s // 3600) || 'h ' || (s // 60) || 'm ' || s || 's' AS duration, n AS written
        FROM (SELECT count(*) * 8 AS n, (max({TS_MS}) - min({TS_MS})) // 1000 AS s FROM events)""",
    "ingest_duration": f"""
        SELECT n AS records, {_count_text('n')} AS shown,
               (s // 3600) || 'h ' || (s // 60) || 'm ' || s || 's' AS duration
        FROM (SELECT count(*) AS n, (max({TS_MS}) - min({TS_MS})) // 1000 AS s FROM events)""",
    "dataset_preview": f"""
        SELECT source, coalesce(string_agg(value, chr(10) ORDER BY doc_id, line_no)
                                FILTER (WHERE length(value) > 0), '') AS preview
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS place
              FROM ({DOCUMENT_LINES})) WHERE place <= 5 GROUP BY source""",
    "dataset_catalog": f"""
        SELECT 'source=' || source AS dataset_name, size, {_byte_text('size')} AS shown_size, preview
        FROM (SELECT source, CAST(sum(strlen(value) + 1) AS BIGINT) AS size,
                     coalesce(string_agg(value, chr(10) ORDER BY doc_id, line_no)
                              FILTER (WHERE place <= 5 AND length(value) > 0), '') AS preview
              FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS place
                    FROM ({DOCUMENT_LINES})) GROUP BY source)""",
    "tumbling_daily": TUMBLING,
    "sliding_6h": SLIDING,
    "late_readings": f"""
        SELECT event_id, id FROM (
          SELECT *, max(measured) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING) AS seen
          FROM (SELECT *, ts - to_minutes(CAST(floor(consumption) AS BIGINT)) AS measured
                FROM ({READINGS})))
        WHERE measured < seen - to_hours(1)""",
    "join_within_hour": ALARMS,
    "join_hot_key": f"""
        WITH keyed AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE id + 1 END AS meter FROM ({READINGS}))
        SELECT a.event_id, b.event_id AS alarm_id, a.meter FROM keyed a JOIN keyed b
          ON a.meter = b.meter AND b.ts >= a.ts AND b.ts <= a.ts + to_minutes(20)
        WHERE b.consumption > 100""",
    "readings_sql": f"""
        SELECT event_type, count(*) AS n, max(consumption) AS top FROM ({READINGS}) GROUP BY event_type""",
    "user_job": f"SELECT {LINE} AS value FROM ({READINGS}), range(2) WHERE consumption > 5",
    "stream_threshold": f"SELECT {LINE} AS value FROM ({READINGS}) WHERE consumption > 5",
    "stream_totals": f"""
        SELECT n AS records, {_count_text('n')} AS shown FROM (SELECT count(*) AS n FROM events)""",
    "stream_detect": _rendered(f"'[' || concat_ws(',', id, {TS_TEXT}, consumption, expected) || ']'"),
    "stream_static_join": _rendered(f"'(' || concat_ws(',', {KEY}, id, {TS_TEXT}, consumption) || ')'"),
    "stream_interpolate": DENSE_BY_ID,
    "stream_interpolate_log": DENSE_BY_ID,
    # A batch is judged by the newest time of all batches before it.
    "stream_late": f"""
        WITH arrived AS (
          SELECT event_id, ts - to_minutes(CAST(floor(consumption) AS BIGINT)) AS ts,
                 CAST(event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS INTEGER) AS batch
          FROM ({READINGS})
        ), tops AS (SELECT batch, max(ts) AS top FROM arrived GROUP BY batch)
        SELECT event_id, batch,
               coalesce(ts < (SELECT max(top) FROM tops t WHERE t.batch < a.batch) - to_hours(1), false) AS late
        FROM arrived a""",
    "stream_rejects": f"""
        SELECT concat_ws(',', id_text, ts_text, consumption) AS value,
               CASE WHEN event_type NOT IN ('error', 'signup') THEN id END AS id,
               CASE event_type WHEN 'error' THEN 'bad id' WHEN 'signup' THEN 'bad timestamp' END AS reason
        FROM ({DAMAGED})""",
    "stream_detect_rejects": f"""
        SELECT '[' || concat_ws(',', id, {TS_TEXT}, consumption, expected) || ']' AS value, NULL AS reason
        FROM ({_joined(_published(TRAILING))})
        WHERE consumption > expected AND event_type NOT IN ('error', 'signup')
        UNION ALL
        SELECT concat_ws(',', id_text, ts_text, consumption),
               CASE event_type WHEN 'error' THEN 'bad id' ELSE 'bad timestamp' END
        FROM ({DAMAGED}) WHERE event_type IN ('error', 'signup')""",
    "stream_replay": f"""
        SELECT event_id, slot, CAST(slot AS INTEGER) AS batch FROM (
          SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)
                           // (SELECT (count(*) + 3) // 4 FROM events) AS slot
          FROM ({READINGS}))""",
    "stream_tumbling": f"""
        SELECT * FROM ({TUMBLING})
        WHERE start_ms + 86400000 <= (SELECT max({TS_MS}) - 7200000 FROM events)""",
    "stream_join": ALARMS,
    "stream_sql": f"SELECT event_type, id, consumption FROM ({READINGS}) WHERE consumption > 100",
}
