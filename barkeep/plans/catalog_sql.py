"""DuckDB SQL that says the same as each registered query."""

from __future__ import annotations

from barkeep.functions.times import DAY, HOUR, INTERVALS, LIMITED_INTERVALS, MINUTE
from barkeep.plans import fetch
from barkeep.plans.bindings import COMMA, EXTRA, HEADER, NOW_BARS, NOW_ITEMS, REPEATED, SWAPPED, TORN, TRADFI
from barkeep.plans.rules import FETCHES, FLOORS, KEEPS_UNKNOWN, UNIVERSES, line_rules

FLOOR = 1420070400000

TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, CAST(round(value * 100) AS BIGINT) AS px, event_id FROM events)"


def _bars(interval: int, name: str = "bars") -> str:
    key = "ts_ms * 1000000 + event_id"
    return f"{name} AS (SELECT symbol, ts_ms - ts_ms % {interval} AS open_time, arg_min(px, {key}) AS open, max(px) AS high, min(px) AS low, arg_max(px, {key}) AS close, CAST(sum(px) AS BIGINT) AS volume FROM ticks GROUP BY ALL)"


BARS = f"{TICKS}, {_bars(HOUR)}"
_PLAIN = f"n % {TORN} <> 0 AND n % {REPEATED} <> 0 AND n % {EXTRA} <> 0 AND n % {COMMA} <> 0"
RAW = f"""{BARS},
text AS (SELECT symbol AS file, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n, concat_ws(',', {HEADER}) AS line FROM bars),
placed AS (
  SELECT file, CASE WHEN n % {TORN} = 0 THEN substr(line, 1, 20) WHEN n % {REPEATED} = 0 THEN line WHEN n % {EXTRA} = 0 THEN line || ',0' WHEN n % {COMMA} = 0 THEN line || ',' ELSE line END AS value,
    2 * n + CASE WHEN {_PLAIN} AND n % {SWAPPED} = 0 THEN 3 ELSE 0 END AS pos FROM text
  UNION ALL SELECT file, line, 2000000000 + n FROM text WHERE n % {TORN} <> 0 AND n % {REPEATED} = 0
  UNION ALL SELECT DISTINCT file, '{HEADER}', 0 FROM text),
raw AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) AS line_no, value FROM placed)"""


def _fields(value: str) -> str:
    return f"(CASE WHEN {value} LIKE '%,' OR {value} = '' THEN string_split({value}, ',')[:-2] ELSE string_split({value}, ',') END)"


def _ts(field: str) -> str:
    return f"(CASE WHEN regexp_full_match({field}, '[0-9]{{1,19}}') THEN TRY_CAST({field} AS BIGINT) END)"


SPLIT = f"""{RAW},
clean AS (SELECT file, line_no, regexp_replace(value, '\\r$', '') AS value FROM raw),
split AS (SELECT *, {_fields('value')} AS fields FROM clean WHERE value <> '' OR line_no = 1)"""
PARSED = f"""{SPLIT},
timed AS (SELECT *, {_ts('fields[1]')} AS ts FROM split WHERE line_no > 1),
parsed AS (SELECT *, len(fields) >= 6 AND ts IS NOT NULL AS accepted, len(fields) >= 6 AND ts IS NOT NULL AND (len(fields) <> 6 OR value LIKE '%,') AS salvaged,
  CASE WHEN len(fields) <> 6 OR value LIKE '%,' THEN array_to_string(fields[1:6], ',') ELSE value END AS line FROM timed)"""
UNIQUE = f"""{PARSED},
ordered AS (SELECT *, coalesce(ts < lag(ts) OVER (PARTITION BY file ORDER BY line_no), false) AS out_of_order,
  row_number() OVER (PARTITION BY file, ts ORDER BY line_no) = 1 AS is_first FROM parsed WHERE accepted),
deltas AS (SELECT file, ts, lag(ts) OVER (PARTITION BY file ORDER BY ts) AS prev_ts, ts - lag(ts) OVER (PARTITION BY file ORDER BY ts) AS delta FROM ordered WHERE is_first)"""
REPORT = f"""{UNIQUE},
counted AS (SELECT file, count(*) FILTER (accepted) AS total_records, count(*) FILTER (NOT accepted) AS malformed, count(*) FILTER (salvaged) AS salvaged FROM parsed GROUP BY file),
kept AS (SELECT file, count(*) FILTER (NOT is_first) AS duplicates, count(*) FILTER (out_of_order) AS out_of_order FROM ordered GROUP BY file),
gapped AS (SELECT file, count(*) FILTER (delta <> {HOUR}) AS gaps, CAST(coalesce(sum(delta // {HOUR} - 1) FILTER (delta > {HOUR}), 0) AS BIGINT) AS missing_bars, min(prev_ts) FILTER (delta <> {HOUR}) AS first_gap_ts FROM deltas GROUP BY file),
report AS (SELECT file, total_records, malformed, salvaged, coalesce(duplicates, 0) AS duplicates, coalesce(out_of_order, 0) AS out_of_order, coalesce(gaps, 0) AS gaps, coalesce(missing_bars, 0) AS missing_bars, first_gap_ts,
  false AS read_failed, malformed + salvaged + coalesce(duplicates, 0) + coalesce(out_of_order, 0) > 0 AS needs_repair FROM counted LEFT JOIN kept USING (file) LEFT JOIN gapped USING (file))"""
TAILS = f"""{SPLIT},
ended AS (SELECT *, line_no < max(line_no) OVER (PARTITION BY file) AS terminated FROM split),
last AS (SELECT file, max(line_no) AS last_line, arg_max({_ts('fields[1]')}, line_no) AS ts FROM ended WHERE terminated AND len(fields) = 6 AND {_ts('fields[1]')} IS NOT NULL GROUP BY file),
tails AS (SELECT file, coalesce(last_line, 1) AS last_line, coalesce(ts, {FLOOR}) AS resume_ts, n_lines - coalesce(last_line, 1) AS lines_cut FROM (SELECT file, max(line_no) AS n_lines FROM raw GROUP BY file) LEFT JOIN last USING (file))"""
FUNDING = """funding AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS symbol, epoch_us(o_orderdate) // 1000 AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS rate, o_orderkey AS pos FROM orders),
stored AS (SELECT * FROM funding WHERE pos % 2 = 0 AND ts < 800000000000),
incoming AS (SELECT * FROM funding WHERE pos % 2 = 1),
lasts AS (SELECT symbol, max(ts) AS last_ts FROM stored GROUP BY symbol)"""
STATIC = f"{FUNDING}, static AS (SELECT i.* FROM incoming i LEFT JOIN lasts USING (symbol) WHERE ts > coalesce(last_ts, 0))"
INSTRUMENTS = f"""quoted AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDC' ELSE 'BTC' END AS quote_asset FROM part),
instruments AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, 'P' || p_partkey || '_' || quote_asset AS name, CASE WHEN p_size % 6 = 0 THEN 'F' || p_size END AS inst_family,
  CASE WHEN p_partkey % 5 = 0 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type, quote_asset, CASE WHEN p_size % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS settle_asset,
  CASE WHEN p_partkey % 7 = 0 THEN 'SETTLING' ELSE 'TRADING' END AS status, p_partkey % 7 <> 0 AS is_trading,
  CASE WHEN p_size % 5 = 0 THEN 0 ELSE 700000000000 + CAST(p_size AS BIGINT) * {DAY} END AS list_time, CASE WHEN p_size % 4 = 0 THEN 850000000000 + CAST(p_size AS BIGINT) * {DAY} ELSE 0 END AS delivery_time,
  [p_type, p_brand] AS tags FROM quoted)"""
STORE = """store AS (SELECT CAST(l_partkey AS VARCHAR) AS symbol, epoch_us(l_shipdate) // 1000 AS ts FROM lineitem
  UNION ALL SELECT CAST(l_suppkey + 1000000 AS VARCHAR), epoch_us(l_shipdate) // 1000 FROM lineitem WHERE l_suppkey <= 20)"""
REQUESTED = """requested AS (SELECT CAST(l_partkey AS VARCHAR) AS symbol FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 11 = 0
  UNION SELECT CAST(l_suppkey + 1000000 AS VARCHAR) FROM lineitem WHERE l_suppkey <= 10)"""
MANIFEST = f"{TICKS}, listed AS (SELECT DISTINCT symbol, ts_ms - ts_ms % {DAY} AS date_ts FROM ticks)"
STAGED = f"""{BARS},
back AS (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) - 1 AS back FROM bars),
staged AS (SELECT symbol, CAST(back // 100 + 1 AS INTEGER) AS batch_no, CAST(99 - back % 100 AS INTEGER) AS pos, open_time, close FROM back WHERE back // 100 + 1 <> 3)"""
ALL_MASTER = f"{INSTRUMENTS}, {STORE}, {REQUESTED}, prices AS (SELECT symbol, max(ts) AS last_ts FROM store GROUP BY symbol)"
DELETED = f"{ALL_MASTER}, deleted AS (SELECT symbol FROM instruments WHERE NOT is_trading UNION SELECT symbol FROM store WHERE symbol NOT IN (SELECT symbol FROM instruments))"


def _has_tag(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"len(list_filter(tags, lambda t: contains(t, '{p}'))) > 0" for p in parts) + ")"


def _universe_sql() -> str:
    wheres = []
    for (exchange, data), rule in UNIVERSES.items():
        terms = ["true"]
        terms += [f"quote_asset = '{rule['quote']}'"] if "quote" in rule else []
        terms += [f"settle_asset = '{rule['settle']}'"] if "settle" in rule else []
        terms += [f"(quote_asset = '{rule['either']}' OR settle_asset = '{rule['either']}')"] if "either" in rule else []
        terms += [f"contract_type = '{rule['contract']}'"] if "contract" in rule else []
        terms += [f"contains(name, '{rule['name']}')"] if "name" in rule else []
        terms += [f"NOT {_has_tag(TRADFI)}"] if "no_tradfi" in rule else []
        wheres.append(f"SELECT '{exchange}' AS exchange, '{data}' AS data, symbol FROM instruments WHERE {' AND '.join(terms)}")
    return f"WITH {INSTRUMENTS} " + " UNION ALL ".join(wheres)


def _resolve_sql() -> str:
    rules = ", ".join(f"('{e}', {str(k).lower()})" for e, k in KEEPS_UNKNOWN.items())
    return f"""WITH {ALL_MASTER} SELECT exchange, delete_delisted, r.symbol,
      CASE WHEN i.symbol IS NULL THEN CASE WHEN delete_delisted THEN 'delete' WHEN keep THEN 'update' ELSE 'drop' END WHEN is_trading OR NOT delete_delisted THEN 'update' ELSE 'delete' END AS action
      FROM requested r LEFT JOIN instruments i ON r.symbol = i.symbol, (VALUES {rules}) AS k(exchange, keep), (VALUES (true), (false)) AS f(delete_delisted)"""


def _plan_sql() -> str:
    completed = NOW_ITEMS - NOW_ITEMS % HOUR - HOUR
    ends = {"delivery": f"CASE WHEN NOT coalesce(is_trading, true) AND delivery_time > 0 THEN delivery_time ELSE {NOW_ITEMS - MINUTE} END", "now": str(NOW_ITEMS), "completed": str(completed)}
    parts = []
    for exchange, (start_by, end_by) in FETCHES.items():
        last = f"coalesce(last_ts, {FLOORS[exchange]})"
        starts = {"last": last, "listing": f"greatest({last}, CASE WHEN list_time > 0 THEN list_time ELSE {last} END)", "bootstrap": f"coalesce(last_ts, {NOW_ITEMS - fetch.FIRST_BARS * HOUR})", "next_bar": f"{last} + {HOUR}", "probe": f"coalesce(last_ts, listed, CASE WHEN list_time > 0 THEN list_time END, {FLOORS[exchange]})"}
        parts.append(f"SELECT '{exchange}' AS exchange, symbol, {starts[start_by]} AS start_ms, {ends[end_by]} AS end_ms, {last} > {completed} AS future_bar FROM resolved")
    resolved = f"resolved AS (SELECT r.symbol, CASE WHEN r.symbol LIKE '%3' THEN NULL ELSE last_ts END AS last_ts, is_trading, list_time, delivery_time, coalesce((SELECT min(ts) FROM store s WHERE s.symbol = r.symbol), {NOW_ITEMS - DAY}) AS listed FROM requested r LEFT JOIN prices USING (symbol) LEFT JOIN instruments USING (symbol))"
    return f"WITH {ALL_MASTER}, {resolved}, plans AS ({' UNION ALL '.join(parts)}) SELECT exchange, symbol, start_ms, end_ms, start_ms > end_ms AS nothing_new, future_bar FROM plans"


def _chunk_sql() -> str:
    monthly, daily = fetch.MONTHLY_WINDOW, fetch.DAILY_WINDOW
    return f"""WITH RECURSIVE {ALL_MASTER},
    plan AS (SELECT symbol, min(ts) AS begins FROM store GROUP BY symbol),
    steps AS (SELECT symbol, '' AS kind, begins AS from_ms, begins AS to_ms FROM plan
      UNION ALL SELECT symbol, CASE WHEN to_ms < {NOW_ITEMS - fetch.RECENT} AND kind <> 'daily' THEN 'monthly' ELSE 'daily' END, to_ms,
        least(to_ms + CASE WHEN to_ms < {NOW_ITEMS - fetch.RECENT} AND kind <> 'daily' THEN {monthly} ELSE {daily} END, {NOW_ITEMS}) FROM steps WHERE to_ms < {NOW_ITEMS})
    SELECT symbol, kind, from_ms, to_ms FROM steps WHERE kind <> ''"""


def _interval_sql() -> str:
    return "CASE minutes " + " ".join(f"WHEN {m} THEN '{label}'" for m, label in INTERVALS.items()) + " END"


def _line_rules_sql() -> str:
    rows = ", ".join(f"('{e}', '{d}', {r.n_fields}, {str(r.allow_more).lower()}, {str(r.salvage).lower()}, {r.interval_ms})" for (e, d), r in line_rules().items())
    return f"WITH {RAW} SELECT file, exchange, data, n_fields, allow_more, salvage, CAST(interval_ms AS BIGINT) AS interval_ms FROM (SELECT DISTINCT file FROM raw), (VALUES {rows}) AS r(exchange, data, n_fields, allow_more, salvage, interval_ms)"


def _supported_sql() -> str:
    sizes = ", ".join(map(str, [*INTERVALS, 7]))
    limited = " ".join(f"WHEN '{e}' THEN minutes IN ({', '.join(map(str, own))})" for e, own in LIMITED_INTERVALS.items())
    return f"""WITH {TICKS}, asked AS (SELECT event_id, (['binance', 'okx', 'mexc'])[event_id % 3 + 1] AS exchange, ([{sizes}])[event_id % 16 + 1] AS minutes FROM ticks)
      SELECT *, CASE exchange {limited} ELSE minutes <> 7 END AS supported FROM asked"""


def _prune_sql() -> str:
    kinds = ", ".join(f"('{k}', {v})" for k, v in fetch.SPANS.items())
    return f"""WITH {MANIFEST}, resume AS (SELECT symbol, min(ts_ms) + {20 * DAY} AS last_ts FROM ticks WHERE symbol <> 'click' GROUP BY symbol)
      SELECT kind, symbol, date_ts FROM listed LEFT JOIN resume USING (symbol), (VALUES {kinds}) AS k(kind, span) WHERE last_ts IS NULL OR date_ts + span > last_ts"""


_sentence = "total_records || ' records, ' || malformed || ' malformed, ' || salvaged || ' salvaged, ' || duplicates || ' duplicates, ' || out_of_order || ' out of order, ' || gaps || ' gaps, ' || missing_bars || ' missing'"
_float = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close", "volume"))

ORACLES: dict[str, str] = {
    "scan_candles": f"WITH {BARS} SELECT * FROM bars",
    "scan_funding": f"WITH {FUNDING} SELECT symbol, ts AS funding_time, rate AS funding_rate FROM funding",
    "scan_report": f"WITH {BARS} SELECT symbol, CASE WHEN length(symbol) % 3 = 1 THEN 0 ELSE count(*) END AS n_rows, CASE WHEN length(symbol) % 3 = 1 THEN 0 ELSE CAST(sum(close) AS BIGINT) END AS sum_close, 0 AS n_corrupt, CASE WHEN length(symbol) % 3 = 1 THEN 'no column volume' END AS reason FROM bars GROUP BY symbol",
    "scan_raw_lines": f"WITH {RAW} SELECT * FROM raw",
    "scan_symbols_file": f"WITH {REQUESTED} SELECT * FROM requested",
    "scan_instruments": f"WITH {INSTRUMENTS} SELECT * EXCLUDE (tags), array_to_string(tags, '|') AS tags FROM instruments",
    "manifest_flatten": f"WITH {MANIFEST} SELECT symbol, date_ts, symbol || '/' || date_ts || '.zip' AS url FROM listed",
    "store_inventory": f"WITH {STORE} SELECT DISTINCT symbol FROM store",
    "clean_lines": f"WITH {RAW} SELECT file, line_no, value FROM raw WHERE line_no % 10 <> 0",
    "split_fields": f"WITH {SPLIT} SELECT file, line_no, len(fields) AS n_fields, array_to_string(fields, '|') AS fields FROM split",
    "valid_timestamp": f"WITH {RAW}, odd AS (SELECT file, line_no, {_fields('v')}[1] AS field FROM (SELECT file, line_no, CASE WHEN line_no % 5 = 0 THEN '-' || value WHEN line_no % 7 = 0 THEN '1234567' || value ELSE value END AS v FROM raw)) SELECT *, {_ts('field')} AS ts FROM odd",
    "valid_records": f"WITH {PARSED} SELECT file, line_no, ts FROM parsed WHERE accepted",
    "malformed_rows": f"WITH {PARSED} SELECT file, line_no, value FROM parsed WHERE NOT accepted",
    "salvage_rows": f"WITH {PARSED} SELECT file, line_no, value, line FROM parsed WHERE salvaged",
    "canonical_header": f"WITH {BARS} SELECT DISTINCT symbol AS file, '{HEADER}' AS header FROM bars",
    "out_of_order": f"WITH {UNIQUE} SELECT file, line_no, ts FROM ordered WHERE out_of_order",
    "dedup_first": f"WITH {UNIQUE} SELECT file, line_no, ts, is_first FROM ordered",
    "gaps": f"WITH {UNIQUE} SELECT file, prev_ts, ts, delta, greatest(delta // {HOUR} - 1, 0) AS missing FROM deltas WHERE delta <> {HOUR}",
    "gap_stats": f"WITH {BARS}, d AS (SELECT symbol, lag(open_time) OVER w AS prev_ts, open_time - lag(open_time) OVER w AS delta FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)) SELECT symbol, count(*) AS n_rows, count(*) FILTER (delta <> {HOUR}) AS gaps, CAST(coalesce(sum(delta // {HOUR} - 1) FILTER (delta > {HOUR}), 0) AS BIGINT) AS missing_bars, min(prev_ts) FILTER (delta <> {HOUR}) AS first_gap_ts FROM d GROUP BY symbol",
    "file_report": f"WITH {REPORT} SELECT * FROM report",
    "verify_summary": f"WITH {REPORT} SELECT count(*) FILTER (NOT (needs_repair OR gaps > 0)) AS files_ok, count(*) FILTER (needs_repair OR gaps > 0) AS files_with_issues FROM report",
    "verify_verdict": f"WITH {REPORT} SELECT coalesce(bool_or(needs_repair), false) AS any_unresolved FROM report",
    "gap_report_text": f"WITH {REPORT} SELECT file, {_sentence} || CASE WHEN gaps > 0 THEN ' (first gap after ' || strftime(make_timestamp(first_gap_ts * 1000), '%Y-%m-%d %H:%M') || ')' ELSE '' END AS text FROM report",
    "repair_rows": f"WITH {REPORT}, lines AS (SELECT file, ts, line FROM ordered WHERE is_first UNION ALL SELECT DISTINCT file, NULL, '{HEADER}' FROM raw) SELECT file, row_number() OVER (PARTITION BY file ORDER BY ts NULLS FIRST) AS line_no, line FROM lines WHERE file IN (SELECT file FROM report WHERE needs_repair)",
    "repair_versions": f"WITH {REPORT}, dirty AS (SELECT file FROM report WHERE needs_repair), lines AS (SELECT file, ts, line FROM ordered WHERE is_first UNION ALL SELECT DISTINCT file, NULL, '{HEADER}' FROM raw) SELECT file, row_number() OVER (PARTITION BY file ORDER BY ts NULLS FIRST) AS line_no, line AS value FROM lines WHERE file IN (FROM dirty) UNION ALL SELECT file, line_no, value FROM raw WHERE file NOT IN (FROM dirty)",
    "trim_torn_tail": f"WITH {TAILS} SELECT * FROM tails",
    "resume_point": f"WITH {TAILS} SELECT file, resume_ts FROM tails",
    "verify_rules": _line_rules_sql(),
    "symbol_from_path": "SELECT DISTINCT '/store/futures/' || event_type || CASE WHEN length(event_type) > 5 THEN '_fr.csv' ELSE '.csv' END AS path, event_type AS symbol FROM events",
    "legacy_seconds_guard": f"WITH {TAILS}, r AS (SELECT file AS symbol, CASE WHEN length(file) > 5 THEN resume_ts // 1000 ELSE resume_ts END AS last_ts FROM tails) SELECT *, length(CAST(last_ts AS VARCHAR)) < 13 AS is_legacy FROM r",
    "resample_bars": f"WITH {BARS} SELECT * FROM bars",
    "sort_bars": f"WITH {BARS} SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS rec_no FROM bars",
    "t6_records": f"WITH {BARS} SELECT symbol, open_time + {HOUR} AS close_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rec_no, {_float}, CAST(0 AS DOUBLE) AS f_val FROM bars",
    "fixed_scale_format": f"WITH {BARS} SELECT symbol, open_time, CAST(CAST(close AS DECIMAL(38,8)) AS VARCHAR) AS close_text, CAST(CAST(volume AS DECIMAL(38,10)) AS VARCHAR) AS volume_text FROM bars",
    "listing_date": f"WITH {TICKS}, {_bars(DAY)} SELECT symbol, min(open_time) AS listed FROM bars GROUP BY symbol UNION ALL SELECT DISTINCT 'no-' || symbol, {NOW_BARS - DAY} FROM bars",
    "bootstrap_window": f"WITH {TICKS}, {_bars(5 * MINUTE)} SELECT symbol, open_time, close FROM bars WHERE open_time >= {NOW_BARS - 5000 * 5 * MINUTE}",
    "align_down": f"WITH {TICKS} SELECT event_id, ts_ms // {4 * HOUR} * {4 * HOUR} AS aligned FROM ticks",
    "align_up": f"WITH {TICKS} SELECT event_id, (ts_ms // {4 * HOUR} + 1) * {4 * HOUR} AS aligned FROM ticks",
    "last_completed_bar": f"WITH {TICKS} SELECT event_id, (ts_ms // {HOUR} - 1) * {HOUR} AS completed, ts_ms - {MINUTE} AS minute_ago FROM ticks",
    "interval_label": f"WITH {TICKS}, m AS (SELECT event_id, ([{', '.join(map(str, INTERVALS))}])[event_id % {len(INTERVALS)} + 1] AS minutes FROM ticks) SELECT *, {_interval_sql()} AS label FROM m",
    "supported_intervals": _supported_sql(),
    "universe_filter": _universe_sql(),
    "exclude_tradfi": f"WITH {INSTRUMENTS} SELECT symbol FROM instruments WHERE NOT {_has_tag(TRADFI)}",
    "split_active": f"WITH {INSTRUMENTS} SELECT symbol, CASE WHEN is_trading THEN 'update' ELSE 'delete' END AS action FROM instruments",
    "derive_inst_family": f"WITH {INSTRUMENTS} SELECT CASE WHEN contract_type = 'PERPETUAL' THEN symbol || '-' || quote_asset || '-SWAP' ELSE name END AS symbol, coalesce(inst_family, CASE WHEN contract_type = 'PERPETUAL' THEN symbol || '-' || quote_asset ELSE name END) AS family FROM instruments",
    "resolve_requested": _resolve_sql(),
    "delisted_on_disk": f"WITH {ALL_MASTER} SELECT DISTINCT symbol FROM store WHERE symbol NOT IN (SELECT symbol FROM instruments WHERE is_trading)",
    "end_bound": f"WITH {ALL_MASTER} SELECT r.symbol, CASE WHEN NOT is_trading AND delivery_time > 0 THEN delivery_time ELSE {NOW_ITEMS} END AS end_ms FROM requested r LEFT JOIN instruments USING (symbol)",
    "start_bound": f"WITH {ALL_MASTER} SELECT p.symbol, greatest(last_ts, CASE WHEN list_time > 0 THEN list_time ELSE last_ts END) AS start_ms FROM prices p LEFT JOIN instruments USING (symbol)",
    "active_semi": f"WITH {ALL_MASTER} SELECT symbol FROM requested WHERE symbol IN (SELECT symbol FROM instruments WHERE is_trading)",
    "union_instruments": f"WITH {INSTRUMENTS} SELECT symbol, status, is_trading FROM instruments WHERE is_trading UNION ALL SELECT symbol, status, is_trading FROM instruments WHERE NOT is_trading OR symbol LIKE '%9'",
    "delete_set": f"WITH {DELETED} SELECT symbol FROM deleted",
    "purge_delisted": f"WITH {DELETED} SELECT symbol, count(*) AS n_rows, max(ts) AS last_ts FROM store WHERE symbol NOT IN (SELECT symbol FROM deleted) GROUP BY symbol",
    "purge_versions": f"WITH {FUNDING}, {INSTRUMENTS} SELECT symbol, count(*) AS n_rows, max(ts) AS last_ts FROM (FROM stored UNION ALL FROM incoming) WHERE symbol IN (SELECT symbol FROM instruments WHERE is_trading) GROUP BY symbol",
    "append_static": f"WITH {STATIC} SELECT * FROM static",
    "append_monotonic": f"WITH {STATIC}, m AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM static) SELECT * EXCLUDE (top) FROM m WHERE top IS NULL OR ts > top",
    "append_archives": f"WITH {STATIC}, tops AS (SELECT symbol, pos // 5000 AS file_no, max(ts) AS top FROM incoming GROUP BY ALL) SELECT s.*, pos // 5000 AS file_no FROM static s WHERE ts > coalesce((SELECT max(top) FROM tops t WHERE t.symbol = s.symbol AND t.file_no < s.pos // 5000), 0)",
    "append_counts": f"WITH {STATIC} SELECT symbol, count(*) AS n_appended FROM static GROUP BY symbol",
    "take_until_known": f"WITH {FUNDING}, known AS (SELECT symbol, max(ts) AS last_ts FROM stored WHERE pos % 4 = 0 GROUP BY symbol), p AS (SELECT i.*, -(ts // {DAY}) AS page, max(CAST(ts <= coalesce(last_ts, 0) AS INTEGER)) OVER (PARTITION BY symbol ORDER BY -(ts // {DAY}), pos ROWS UNBOUNDED PRECEDING) AS seen FROM incoming i LEFT JOIN known USING (symbol)) SELECT * EXCLUDE (seen) FROM p WHERE seen = 0",
    "union_bulk_recent": f"WITH {STATIC} SELECT * FROM stored UNION ALL SELECT * FROM static",
    "batch_name": f"WITH {TICKS} SELECT event_id, 'batch_' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS name, CAST(event_id % 100000 AS INTEGER) AS number, CAST(NULL AS INTEGER) AS other FROM ticks",
    "merge_staged_batches": f"WITH {STAGED} SELECT symbol, batch_no, pos, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS seq FROM staged",
    "recover_batches": f"WITH {STAGED}, h AS (SELECT symbol, max(batch_no) AS last_batch, count(DISTINCT batch_no) AS n_batches FROM staged WHERE symbol <> 'click' GROUP BY symbol) SELECT *, CASE WHEN last_batch > 3 THEN '3' ELSE '' END AS missing FROM h",
    "recover_staged": f"WITH {STAGED} SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS seq FROM staged",
    "archive_intake": f"WITH {BARS}, l AS (SELECT symbol, max(open_time) AS last FROM bars WHERE open_time < {NOW_BARS - 15 * DAY} GROUP BY symbol) SELECT symbol, open_time AS ts, close FROM bars LEFT JOIN l USING (symbol) WHERE open_time > coalesce(last, 0)",
    "manifest_prune": _prune_sql(),
    "fetch_plan": _plan_sql(),
    "chunk_ranges": _chunk_sql(),
}
