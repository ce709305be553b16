"""DuckDB SQL for the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

from tracelane.functions.text import CAUSAL_TERMS
from tracelane.operators.mentions import STOP_WORDS

_KEY = "concat(user_id, '-', strftime(ts, '%Y-%m-%d'))"
_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
DAILY = f"""log AS (SELECT event_id AS source_row, {_KEY} AS case_id, event_type AS activity, epoch_us(ts) AS ts_us, CAST(NULL AS BIGINT) AS start_us,
  'R' || ({_K} % 10) AS resource, 'D' || ({_K} % 4) AS department FROM events)"""
DAILY_START = DAILY.replace("CAST(NULL AS BIGINT) AS start_us", "epoch_us(ts) - CAST(round(value * 60000000) AS BIGINT) AS start_us")
USER = "log AS (SELECT event_id AS source_row, CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, epoch_us(ts) AS ts_us, CAST(NULL AS BIGINT) AS start_us FROM events)"
CONV = """log AS (SELECT turn AS source_row, CAST(conv_id AS VARCHAR) AS case_id, role AS activity, epoch_us(TIMESTAMP '2024-01-01') + turn * 3600000000 AS ts_us, CAST(NULL AS BIGINT) AS start_us
  FROM conversations)"""
TOPICS = r"""log AS (SELECT turn AS source_row, CAST(conv_id AS VARCHAR) AS case_id, CASE WHEN role = 'user' AND regexp_matches(text, '^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)')
    THEN regexp_extract(text, '^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)', 1) || '_' || regexp_extract(text, '^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)', 2) ELSE role END AS activity,
    epoch_us(TIMESTAMP '2024-01-01') + turn * 3600000000 AS ts_us, CAST(NULL AS BIGINT) AS start_us FROM conversations)"""
ORDER = """log AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS source_row, CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS activity,
  epoch_us(l_shipdate) AS ts_us, epoch_us(o_orderdate) AS start_us, CAST(l_suppkey AS VARCHAR) AS resource, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EV = """ev0 AS (SELECT *, row_number() OVER c - 1 AS pos, lag(activity) OVER c AS prev_activity, lag(ts_us) OVER c AS prev_us,
    row_number() OVER (PARTITION BY case_id, activity ORDER BY ts_us, source_row) - 1 AS occurrence FROM log WINDOW c AS (PARTITION BY case_id ORDER BY ts_us, source_row)),
  ev AS (SELECT *, ts_us - prev_us AS gap_us, CASE WHEN prev_us IS NULL THEN NULL ELSE greatest(coalesce(start_us, ts_us) - prev_us, 0) END AS wait_us, ts_us - start_us AS proc_us FROM ev0)"""
CASES = """cs AS (SELECT case_id, array_to_string(list(activity ORDER BY ts_us, source_row), ' → ') AS trace_text, list(activity ORDER BY ts_us, source_row) AS trace, count(*) AS n_events,
    max(ts_us) - min(ts_us) AS duration_us, min(ts_us) AS start_us, max(ts_us) AS end_us FROM log GROUP BY case_id),
  cases AS (SELECT *, trace[1] AS first_activity, trace[-1] AS last_activity FROM cs), tot AS (SELECT count(*) AS n FROM cases)"""
VARIANTS = """v0 AS (SELECT trace_text, trace, count(*) AS case_count, sum(duration_us) / count(*) / 3.6e9 AS mean_h, quantile_cont(duration_us, 0.5) / 3.6e9 AS median_h, min(case_id) AS least,
    any_value(last_activity) AS last_activity FROM cases GROUP BY ALL),
  v1 AS (SELECT *, row_number() OVER (ORDER BY case_count DESC, mean_h, least) AS rank FROM v0),
  v AS (SELECT *, 100.0 * case_count / n AS pct, 100.0 * sum(case_count) OVER (ORDER BY rank) / n AS cum_pct FROM v1, tot)"""
VARIANTS = VARIANTS.replace("GROUP BY ALL", "GROUP BY trace_text, trace")
COMPLETION = """ends AS (SELECT last_activity, count(*) AS n, count(*) / any_value(t.n) AS share FROM cases, tot t GROUP BY last_activity),
  own AS (SELECT last_activity FROM ends WHERE share >= 0.02),
  dom AS (SELECT * FROM v ORDER BY (last_activity NOT IN (SELECT last_activity FROM own)), rank LIMIT 1),
  done AS (SELECT last_activity FROM own UNION SELECT last_activity FROM dom)"""
R = lambda x, name: f"round({x}, 4) AS {name}"
MEAN = lambda x: f"sum({x}) / count({x}) / 3.6e9"
Q = lambda x, p: f"quantile_cont({x}, {p}) / 3.6e9"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_FRAME = "SELECT case_id, source_row, activity, pos, prev_activity, gap_us, wait_us, proc_us, occurrence FROM ev"
_BIG = "CAST({} AS BIGINT) AS {}".format


def _bottlenecks(log: str, weights: tuple, high: float, medium: float, support: int, more: str = "") -> str:
    names = ("median_wait", "p90_wait", "processing", "case_coverage", "wait_share")
    sources = ("median_wait_h", "p90_wait_h", "median_proc_h", "case_coverage", "wait_share")
    parts = ", ".join(f"CASE WHEN ok THEN coalesce(CASE WHEN max({s}) FILTER (ok) OVER () - min({s}) FILTER (ok) OVER () >= 1e-12 THEN ({s} - min({s}) FILTER (ok) OVER ()) / (max({s}) FILTER (ok) OVER () - min({s}) FILTER (ok) OVER ()) END, 0) END AS c_{n}" for n, s in zip(names, sources, strict=True))
    w = [f"(CASE WHEN has_proc THEN {x} ELSE 0 END)" if n == "processing" else str(x) for n, x in zip(names, weights, strict=True)]
    exact = f"({' + '.join(f'{a} * c_{n}' for a, n in zip(w, names, strict=True))}) / ({' + '.join(w)})"
    return _with(
        log, EV, CASES,
        "w AS (SELECT quantile_cont(wait_us, 0.9) AS p90, sum(wait_us) / 3.6e9 AS total, max(proc_us IS NOT NULL) AS has_proc FROM ev)",
        f"""st AS (SELECT activity, count(*) AS frequency, count(DISTINCT case_id) AS affected_cases, count(DISTINCT CASE WHEN wait_us > p90 THEN case_id END) AS long_wait_cases, {MEAN('wait_us')} AS mean_wait_h,
          {Q('wait_us', 0.5)} AS median_wait_h, {Q('wait_us', 0.9)} AS p90_wait_h, {Q('wait_us', 0.95)} AS p95_wait_h, {Q('proc_us', 0.5)} AS median_proc_h, sum(wait_us) / 3.6e9 AS sum_h FROM ev, w GROUP BY activity)""",
        f"st2 AS (SELECT *, affected_cases / n AS case_coverage, sum_h / total AS wait_share, frequency >= {support} AND median_wait_h IS NOT NULL AS ok FROM st, w, tot)",
        f"sc AS (SELECT *, {parts} FROM st2)", f"ex AS (SELECT *, CASE WHEN ok THEN {exact} END AS exact FROM sc)",
    ) + f"""SELECT activity, frequency, affected_cases, long_wait_cases, {R('mean_wait_h', 'mean_wait_h')}, {R('median_wait_h', 'median_wait_h')}, {R('p90_wait_h', 'p90_wait_h')}, {R('p95_wait_h', 'p95_wait_h')},
      {R('wait_share', 'wait_share')}, round(exact, 3) AS score, CASE WHEN exact >= {high} THEN 'HIGH' WHEN exact >= {medium} THEN 'MEDIUM' WHEN exact IS NOT NULL THEN 'LOW' ELSE 'NOT_SCORED' END AS indicator,
      CASE WHEN ok THEN NULL WHEN median_wait_h IS NULL THEN 'No waiting time (only occurs as first event)' ELSE 'Fewer than {support} events' END AS not_scored_reason{more} FROM ex"""  # fmt: skip


_EDGES = f"""SELECT prev_activity || '→' || activity AS id, prev_activity AS source, activity AS target, count(*) AS frequency, count(DISTINCT case_id) AS cases,
  {R('100.0 * count(DISTINCT case_id) / any_value(n)', 'case_pct')}, {R(MEAN('gap_us'), 'mean_h')}, {R(Q('gap_us', 0.5), 'median_h')}, {R(Q('gap_us', 0.9), 'p90_h')} FROM ev, tot WHERE prev_activity IS NOT NULL GROUP BY prev_activity, activity"""
_ACTIVITY = f"""activity, count(*) AS frequency, count(DISTINCT case_id) AS cases, {R('100.0 * count(DISTINCT case_id) / any_value(n)', 'case_pct')}, {R(MEAN('wait_us'), 'mean_wait_h')}, {R(Q('wait_us', 0.5), 'median_wait_h')},
  {R(Q('wait_us', 0.9), 'p90_wait_h')}, {R('avg(pos)', 'mean_pos')}, count(*) FILTER (occurrence > 0) AS repeats"""
_PROC = f"{R(MEAN('proc_us'), 'mean_proc_h')}, {R(Q('proc_us', 0.5), 'median_proc_h')}"
_OUTCOMES = """SELECT case_id, CASE WHEN last_activity NOT IN (SELECT last_activity FROM done) THEN 'incomplete_case' ELSE 'alternative_outcome' END AS type, last_activity AS activity, end_us AS ts_us
  FROM cases WHERE last_activity NOT IN (SELECT last_activity FROM done) OR last_activity <> (SELECT last_activity FROM dom)"""
_LONG = """lim AS (SELECT prev_activity, activity, count(*) AS n, quantile_cont(gap_us, 0.25) AS q1, quantile_cont(gap_us, 0.75) AS q3 FROM ev WHERE prev_activity IS NOT NULL GROUP BY ALL),
  slow AS (SELECT ev.case_id, ev.activity, ts_us, gap_us FROM ev JOIN lim USING (prev_activity, activity) WHERE lim.n >= 20 AND gap_us > greatest(q3 + 3 * (q3 - q1), 3.6e9))"""
_CASE_METRICS = f"""count(*) AS total_cases, count(d.last_activity) AS completed_cases, count(*) - count(d.last_activity) AS incomplete_cases, {R(MEAN('duration_us'), 'mean_duration_h')},
  {R(Q('duration_us', 0.5), 'median_duration_h')}, {R(Q('duration_us', 0.9), 'p90_duration_h')}, {R(Q('duration_us', 0.95), 'p95_duration_h')},
  {R('sum(duration_us) FILTER (d.last_activity IS NOT NULL) / count(d.last_activity) / 3.6e9', 'completed_mean_duration_h')},
  {R('quantile_cont(duration_us, 0.5) FILTER (d.last_activity IS NOT NULL) / 3.6e9', 'completed_median_duration_h')}, {R('sum(n_events) / count(*)', 'mean_events_per_case')}, {_BIG('sum(n_events)', 'total_events')},
  min(start_us) AS first_event_us, max(end_us) AS last_event_us FROM cases LEFT JOIN done d ON d.last_activity = cases.last_activity"""
_RAW = """k AS (SELECT *, CAST(case_id AS BIGINT) * 10 + source_row AS k FROM log),
  raw0 AS (SELECT k * 2 AS source_row, CASE WHEN k % 17 = 0 THEN '' ELSE case_id END AS case_id, CASE WHEN k % 19 = 0 THEN '' ELSE activity END AS activity,
    CASE WHEN k % 23 = 0 THEN NULL ELSE l_shipdate END AS ts, o_orderdate AS began, resource, k % 29 = 0 AS malformed, k FROM k),
  raw AS (SELECT * FROM raw0 UNION ALL SELECT source_row + 1, case_id, activity, ts, began, resource, malformed, k FROM raw0 WHERE source_row % 26 = 0),
  m0 AS (SELECT *, CASE WHEN malformed THEN 'malformed_row' WHEN case_id = '' THEN 'missing_case_id' WHEN activity = '' THEN 'missing_activity' WHEN ts IS NULL THEN 'invalid_timestamp'
    WHEN ts < TIMESTAMP '1970-01-01' OR ts > TIMESTAMP '2030-01-02' OR began > ts THEN 'impossible_timestamp' END AS early FROM raw),
  m AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early, case_id, activity, ts, began, resource, k ORDER BY source_row) > 1 THEN 'duplicate' END) AS issue FROM m0)"""
_SPELLED = """s AS (SELECT activity, CASE source_row % 7 WHEN 0 THEN upper(activity) WHEN 1 THEN '  ' || activity || ' ' WHEN 2 THEN upper(activity[1]) || activity[2:] || '_' ELSE activity END AS original FROM log)"""
_STEPS = """dv AS (SELECT case_id, 'loop' AS type FROM ev WHERE activity = prev_activity UNION ALL SELECT case_id, 'rework' FROM ev WHERE occurrence > 0 AND activity <> prev_activity
  UNION ALL SELECT case_id, 'long_transition' FROM slow UNION ALL SELECT case_id, type FROM out)"""

_TOP5 = lambda column, name: f"(SELECT string_agg({column} || ':' || c, ', ' ORDER BY c DESC, {column}) FROM (SELECT {column}, count(*) AS c FROM cases GROUP BY 1 ORDER BY c DESC, {column} LIMIT 5)) AS {name}"
_OVERVIEW = f"""(SELECT count(*) FROM v) AS unique_variants, (SELECT {R('sum(pct)', 'x')} FROM v WHERE rank <= 10) AS top10_coverage_pct, (SELECT trace_text FROM v WHERE rank = 1) AS most_common,
      (SELECT count(*) FROM v WHERE case_count = 1) AS singletons, (SELECT count(DISTINCT activity) FROM log) AS unique_activities"""
_RATE = "(SELECT 100.0 * count(*) FILTER (trace_text = (SELECT trace_text FROM dom)) / count(*) FROM cases)"
_ISSUE_COUNTS = ", ".join(f"count(*) FILTER (issue = '{x}') AS {x}" for x in ("malformed_row", "missing_case_id", "missing_activity", "invalid_timestamp", "impossible_timestamp", "duplicate"))
_QUALITY = """q AS (SELECT count(*) FILTER (source_row % 7 = 0) AS bad FROM m WHERE issue IS NULL), c AS (SELECT case_id, count(*) AS n FROM m WHERE issue IS NULL GROUP BY case_id), s1 AS (SELECT count(*) AS singles FROM c WHERE n = 1),
  sp AS (SELECT upper(activity) AS k, CASE WHEN source_row % 5 = 0 THEN lower(activity) ELSE activity END AS spelling FROM m WHERE issue IS NULL),
  lb AS (SELECT k, first(spelling ORDER BY n DESC, spelling) AS label FROM (SELECT k, spelling, count(*) AS n FROM sp GROUP BY k, spelling) GROUP BY k),
  mg AS (SELECT k, string_agg(DISTINCT spelling, '/' ORDER BY spelling) AS s, count(DISTINCT spelling) AS kinds FROM sp GROUP BY k)"""
_FACTS = f"""ov AS (SELECT {_CASE_METRICS}),
  f AS (SELECT 'overview.total_cases' AS fact_id, total_cases AS value, 'cases' AS unit FROM ov UNION ALL SELECT 'overview.completed_cases', completed_cases, 'cases' FROM ov
    UNION ALL SELECT 'overview.mean_duration_h', mean_duration_h, 'hours' FROM ov UNION ALL SELECT 'overview.median_duration_h', median_duration_h, 'hours' FROM ov UNION ALL SELECT 'overview.p95_duration_h', p95_duration_h, 'hours' FROM ov
    UNION ALL SELECT 'overview.unique_variants', count(*), '' FROM v UNION ALL SELECT 'overview.conformance_rate_pct', {_RATE}, '%'
    UNION ALL SELECT 'variant.V' || rank || '.case_count', case_count, 'cases' FROM v WHERE rank <= 8 UNION ALL SELECT 'variant.V' || rank || '.pct', pct, '%' FROM v WHERE rank <= 8
    UNION ALL SELECT 'activity.' || activity || '.' || x, y, u FROM bt)"""

_FOLD = lambda x: rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\s_\-]+', ' ', 'g'))"
_LABELS = f"lb AS (SELECT max(activity) AS activity, {_FOLD('activity')} AS key FROM log GROUP BY 2 HAVING {_FOLD('activity')} <> '')"
_TURNS = rf"""tx AS (SELECT conv_id, turn, {_FOLD(r"regexp_replace(text, '[^\p{L}\p{N}_\s-]', ' ', 'g')")} AS key FROM conversations)"""
_TELLING = lambda: f"length(word) >= 4 AND word NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"
_SHEET = lambda log: f"""bs AS ({_bottlenecks(log, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10)}),
  bt AS (SELECT activity, unnest(['score', 'median_wait_h', 'long_wait_cases']) AS x, unnest([score, median_wait_h, long_wait_cases]) AS y, unnest(['', 'hours', 'cases']) AS u FROM
      (SELECT * FROM bs WHERE score IS NOT NULL ORDER BY score DESC, activity LIMIT 8)), {_FACTS}"""  # noqa: E731

ORACLE_SQL: dict[str, str] = {
    "activity_mentions_exact": _with(TOPICS, _LABELS, _TURNS) + """SELECT conv_id, turn, activity FROM tx JOIN lb ON contains(' ' || tx.key || ' ', ' ' || lb.key || ' ')
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(activity) DESC, activity) = 1""",
    "activity_candidates": _with(TOPICS, _LABELS, _TURNS, f"bs AS ({_bottlenecks(TOPICS, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 1)})",
      "lw AS (SELECT DISTINCT activity, unnest(string_split(key, ' ')) AS word FROM lb)", "tw AS (SELECT DISTINCT conv_id, turn, unnest(string_split(key, ' ')) AS word FROM tx)",
      f"sh AS (SELECT DISTINCT conv_id, turn, activity FROM tw JOIN lw USING (word) WHERE {_TELLING()})")
    + """SELECT conv_id, turn, activity, coalesce(score, 0) AS score, CAST(row_number() OVER p AS INTEGER) AS place FROM sh LEFT JOIN bs USING (activity)
      WINDOW p AS (PARTITION BY conv_id, turn ORDER BY coalesce(score, 0) DESC, activity) QUALIFY row_number() OVER p <= 3""",
    "events_page_after": _with(DAILY, EV) + "SELECT case_id, pos, wait_us FROM ev WHERE activity = 'view' ORDER BY wait_us DESC NULLS LAST, case_id, pos LIMIT 40 OFFSET 80",
    "report_findings_sql": _with(DAILY, EV, CASES, VARIANTS, COMPLETION, _SHEET(DAILY), """b3 AS (SELECT * FROM bs WHERE score IS NOT NULL ORDER BY score DESC, activity LIMIT 3)""",
      """fd AS (SELECT 'bottleneck.' || activity AS finding, lower(indicator) AS severity, ['activity.' || activity || '.score', 'activity.' || activity || '.median_wait_h', 'activity.' || activity || '.long_wait_cases'] AS ids,
        'activity' AS kind, activity AS first FROM b3 WHERE indicator IN ('HIGH', 'MEDIUM') UNION ALL SELECT 'variants', 'low', ['overview.conformance_rate_pct', 'overview.unique_variants', 'variant.V1.pct'], 'variant', 'V1'
        WHERE (SELECT count(*) FROM f WHERE fact_id = 'overview.conformance_rate_pct' AND value IS NOT NULL) > 0)""")
    + "SELECT finding, severity, (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest(ids) AS x, unnest(range(len(ids))) AS i) WHERE x IN (SELECT fact_id FROM f WHERE value IS NOT NULL)) AS evidence, kind, first, CAST(NULL AS VARCHAR) AS second FROM fd",
    "evidence_resolution": _with(CONV, EV, CASES, VARIANTS, COMPLETION, _SHEET(CONV), """c AS (SELECT conv_id || '-' || turn AS finding, turn, text, ['variant.V' || turn || '.pct', 'activity.' || text[1:2] || '.score', 'activity.assistant.score', 'overview.total_cases'] AS ids
        FROM conversations WHERE role = 'assistant')""",
      "e AS (SELECT finding, turn, text, CASE WHEN turn % 4 = 1 THEN ids[2:2] WHEN turn % 4 = 3 THEN list_reverse(ids) ELSE ids END AS ids FROM c)",
      "p AS (SELECT finding, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM e)",
      "k AS (SELECT p.*, f.fact_id IS NOT NULL AS known FROM p LEFT JOIN (SELECT fact_id FROM f WHERE value IS NOT NULL) f ON f.fact_id = p.id)",
      "g AS (SELECT finding, string_agg(id, ', ' ORDER BY place) FILTER (known) AS kept, string_agg(id, ', ' ORDER BY place) FILTER (NOT known) AS lost FROM k GROUP BY finding)",
      rf"""w AS (SELECT finding, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text || CASE WHEN turn % 3 = 0 THEN ' Caused by delay.' ELSE '' END), '{"|".join(CAUSAL_TERMS)}'))), ', ') AS said FROM e)""")
    + """SELECT finding, 'kept' AS flag, kept AS detail FROM g WHERE kept IS NOT NULL UNION ALL SELECT finding, 'unknown_evidence', lost FROM g WHERE lost IS NOT NULL
      UNION ALL SELECT finding, 'dropped', '' FROM g WHERE kept IS NULL UNION ALL SELECT finding, 'causal_wording', said FROM w JOIN g USING (finding) WHERE kept IS NOT NULL AND said <> ''""",

    "event_frame_daily": _with(DAILY, EV) + _FRAME,
    "event_frame_start": _with(DAILY_START, EV) + _FRAME,
    "event_frame_order": _with(ORDER, EV) + "SELECT case_id, source_row, activity, pos, prev_activity, gap_us, wait_us, occurrence FROM ev",
    "traces_daily": _with(DAILY, CASES) + "SELECT case_id, trace_text, n_events, duration_us, first_activity, last_activity FROM cases",
    "variants_daily": _with(DAILY, CASES, VARIANTS) + f"SELECT trace_text, 'V' || rank AS variant_id, case_count, {R('mean_h', 'mean_duration_h')}, {R('median_h', 'median_duration_h')}, {R('pct', 'pct')}, {R('cum_pct', 'cum_pct')} FROM v",
    "variant_coverage": _with(DAILY, CASES, VARIANTS) + f"""SELECT count(*) AS unique_variants, arg_min(trace_text, rank) AS most_common, {R('max(pct)', 'most_common_pct')}, {R('sum(pct) FILTER (rank <= 10)', 'top10_coverage_pct')},
      least(count(*) FILTER (cum_pct < 80) + 1, count(*)) AS variants_for_80pct, count(*) FILTER (case_count = 1) AS singletons FROM v""",
    "completion_activities": _with(DAILY, CASES, VARIANTS, COMPLETION) + f"SELECT last_activity, n, {R('share', 'share')} FROM ends WHERE share >= 0.02",
    "dominant_path_conv": _with(CONV, CASES, VARIANTS, COMPLETION) + "SELECT trace_text, 'V' || rank AS variant_id, case_count FROM dom",
    "case_metrics": _with(DAILY, CASES, VARIANTS, COMPLETION) + f"SELECT {_CASE_METRICS}",
    "dfg_edges": _with(DAILY, EV, CASES) + _EDGES,
    "dfg_nodes": _with(DAILY_START, EV, CASES) + f"""SELECT a.*, coalesce(s, 0) AS start_count, coalesce(e, 0) AS end_count, coalesce(s, 0) > 0 AS is_start, coalesce(e, 0) > 0 AS is_end FROM (SELECT {_ACTIVITY}, {_PROC} FROM ev, tot GROUP BY activity) a
      LEFT JOIN (SELECT first_activity AS activity, count(*) AS s FROM cases GROUP BY 1) USING (activity) LEFT JOIN (SELECT last_activity AS activity, count(*) AS e FROM cases GROUP BY 1) USING (activity)""",
    "dfg_start_end": _with(DAILY, CASES) + f"""SELECT activity, count(*) FILTER (edge = 's') AS start_count, count(*) FILTER (edge = 'e') AS end_count, {R("100.0 * count(*) FILTER (edge = 's') / any_value(n)", 'start_pct')},
      {R("100.0 * count(*) FILTER (edge = 'e') / any_value(n)", 'end_pct')} FROM (SELECT first_activity AS activity, 's' AS edge FROM cases UNION ALL SELECT last_activity, 'e' FROM cases), tot GROUP BY activity""",
    "dfg_filtered": _with(CONV, EV, CASES, f"e AS ({_EDGES})", "ke AS (SELECT * FROM e WHERE round(100.0 * cases / (SELECT n FROM tot), 2) >= 20)") + """SELECT 'edge' AS kind, id, frequency, cases FROM ke
      UNION ALL SELECT 'node', activity, count(*), count(DISTINCT case_id) FROM ev WHERE activity IN (SELECT source FROM ke UNION SELECT target FROM ke) GROUP BY activity""",
    "activity_metrics": _with(USER, EV, CASES) + f"SELECT {_ACTIVITY} FROM ev, tot GROUP BY activity",
    "transition_metrics": _with(USER, EV) + f"SELECT prev_activity AS source, activity AS target, count(*) AS frequency, {R(MEAN('gap_us'), 'mean_h')}, {R(Q('gap_us', 0.5), 'median_h')}, {R(Q('gap_us', 0.9), 'p90_h')} FROM ev WHERE prev_activity IS NOT NULL GROUP BY ALL",
    "bottlenecks": _bottlenecks(DAILY, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10),
    "bottlenecks_start": _bottlenecks(DAILY_START, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10, f", {R('median_proc_h', 'median_proc_h')}"),
    "bottlenecks_reweighted": _bottlenecks(DAILY_START, (0.5, 0.1, 0.1, 0.2, 0.1), 0.7, 0.35, 500),
    "slow_transitions": _with(DAILY, EV) + f"""SELECT prev_activity AS source, activity AS target, count(*) AS frequency, {R(Q('gap_us', 0.5), 'median_h')}, {R(Q('gap_us', 0.9), 'p90_h')},
      {R('100.0 * sum(gap_us) / (SELECT sum(wait_us) FROM ev)', 'wait_share_pct')} FROM ev WHERE prev_activity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY quantile_cont(gap_us, 0.5) DESC, 1, 2 LIMIT 10""",
    "loops": _with(DAILY, EV) + "SELECT case_id, activity, pos FROM ev WHERE activity = prev_activity",
    "rework": _with(DAILY, EV) + "SELECT case_id, activity, pos, prev_activity FROM ev WHERE occurrence > 0 AND activity <> prev_activity",
    "case_outcomes": _with(CONV, CASES, VARIANTS, COMPLETION) + _OUTCOMES,
    "long_transitions": _with(USER, EV, _LONG) + f"SELECT case_id, activity, ts_us, {R('gap_us / 3.6e9', 'hours')} FROM slow",
    "deviation_summary_sql": _with(CONV, EV, CASES, VARIANTS, COMPLETION, _LONG, f"out AS ({_OUTCOMES})", _STEPS) + f"SELECT type, count(*) AS occurrences, count(DISTINCT case_id) AS cases, {R('100.0 * count(DISTINCT case_id) / any_value(n)', 'case_pct')} FROM dv, tot GROUP BY type",
    "conformance_rate": _with(CONV, CASES, VARIANTS, COMPLETION) + f"SELECT {R('100.0 * count(*) FILTER (trace_text = (SELECT trace_text FROM dom)) / count(*)', 'conformance_rate_pct')} FROM cases",
    "resources": _with(DAILY_START, EV, CASES) + f"""SELECT * FROM (SELECT resource, count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT activity) AS activities, {R(MEAN('wait_us'), 'mean_wait_h')}, {R(Q('wait_us', 0.5), 'median_wait_h')},
      {R(MEAN('proc_us'), 'mean_proc_h')}, {R('100.0 * count(*) FILTER (occurrence > 0) / count(*)', 'rework_rate_pct')} FROM ev GROUP BY resource)
      JOIN (SELECT resource, {R(MEAN('duration_us'), 'mean_case_duration_h')} FROM (SELECT DISTINCT resource, case_id FROM ev) JOIN cases USING (case_id) GROUP BY resource) USING (resource)""",
    "resource_top_activities": _with(DAILY, "a AS (SELECT resource, activity, row_number() OVER (PARTITION BY resource ORDER BY count(*) DESC, activity) AS p FROM log GROUP BY resource, activity)") + """SELECT resource,
      string_agg(activity, ', ' ORDER BY p) FILTER (p <= 3) AS top, any_value(d.department) AS department FROM a JOIN (SELECT resource, mode(department ORDER BY department) AS department FROM log GROUP BY resource) d USING (resource) GROUP BY resource""",
    "normalize_labels": _with(DAILY, _SPELLED) + "SELECT activity, count(*) AS n_events, count(DISTINCT original) AS n_spellings FROM s GROUP BY activity",
    "label_merges": _with(DAILY, _SPELLED) + "SELECT activity, string_agg(original, '|' ORDER BY original) AS spellings FROM (SELECT DISTINCT activity, original FROM s) GROUP BY activity",
    "reject_cascade": _with(ORDER, _RAW) + "SELECT source_row, issue FROM m WHERE issue IS NOT NULL",
    "validation_report": _with(ORDER, _RAW, "c AS (SELECT case_id, count(*) AS n FROM m WHERE issue IS NULL GROUP BY case_id)") + "SELECT count(*) AS total_rows, count(*) FILTER (issue IS NULL) AS valid_rows, count(issue) AS invalid_rows, "
    + ", ".join(f"count(*) FILTER (issue = '{x}') AS {x}" for x in ("malformed_row", "missing_case_id", "missing_activity", "invalid_timestamp", "impossible_timestamp", "duplicate"))
    + ", (SELECT count(*) FROM c) AS total_cases, (SELECT count(*) FROM c WHERE n = 1) AS single_event_cases FROM m",
    "count_cases_filters": _with(CONV, EV, CASES) + f"""SELECT count(*) AS count, max(tot.n) AS total_cases, {R('100.0 * count(*) / max(tot.n)', 'pct')} FROM cases, tot
      WHERE list_contains(trace, 'assistant') AND duration_us BETWEEN 2 * 3.6e9 AND 20 * 3.6e9 AND case_id IN (SELECT case_id FROM ev WHERE occurrence > 0 AND activity <> prev_activity)""",
    "variant_cases_page": _with(DAILY, CASES, VARIANTS) + f"SELECT case_id, 'V1' AS variant_id, {R('duration_us / 3.6e9', 'duration_h')}, n_events FROM cases WHERE trace_text = (SELECT trace_text FROM v WHERE rank = 1) ORDER BY duration_us DESC, case_id LIMIT 20 OFFSET 5",
    "events_drilldown": _with(DAILY, EV) + f"SELECT case_id, pos, {R('wait_us / 3.6e9', 'wait_h')} FROM ev WHERE prev_activity = 'view' AND activity = 'purchase' ORDER BY wait_us DESC NULLS LAST, case_id, pos LIMIT 50",
    "case_detail": _with(CONV, EV) + "SELECT case_id, pos, activity, ts_us, prev_activity, wait_us FROM ev WHERE case_id = '7'",
    "deviations_page": _with(CONV, EV) + "SELECT case_id, 'rework' AS type, activity, ts_us FROM ev WHERE occurrence > 0 AND activity <> prev_activity ORDER BY case_id, ts_us LIMIT 100 OFFSET 10",
    "formula_escape": "SELECT conv_id, turn, CASE WHEN turn % 6 = 4 THEN '' ELSE '''' END || ['=', '+', '-', '@', 'x', chr(9)][turn % 6 + 1] || text AS safe FROM conversations",
    "causal_terms": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text || CASE WHEN turn % 3 = 0 THEN ' Due to this, because of that.' ELSE ' It results from the LAZY way.' END), '"
    + "|".join(CAUSAL_TERMS) + "'))), '|') AS terms FROM conversations",
    "overview": _with(DAILY, EV, CASES, VARIANTS, COMPLETION, f"cm AS (SELECT {_CASE_METRICS})") + f"""SELECT cm.*, {_OVERVIEW}, TRUE AS resources_available, FALSE AS processing_time_available,
      {_TOP5('first_activity', 'start_activities')}, {_TOP5('last_activity', 'end_activities')} FROM cm""",
    "conformance_sql": _with(DAILY, EV, CASES, VARIANTS, COMPLETION) + f"""SELECT {R(_RATE, 'conformance_rate_pct')}, (SELECT count(DISTINCT case_id) FROM ev WHERE occurrence > 0 AND activity <> prev_activity) AS cases_rework,
      (SELECT count(DISTINCT case_id) FROM ev WHERE activity = prev_activity) AS cases_loop""",
    "data_quality": _with(ORDER, _RAW, _QUALITY) + f"""SELECT count(*) AS total_rows, count(*) FILTER (issue IS NULL) AS valid_rows, count(issue) AS invalid_rows, {_ISSUE_COUNTS}, (SELECT count(*) FROM c) AS total_cases,
      (SELECT singles FROM s1) AS single_event_cases, (SELECT bad FROM q) AS unreadable_amounts,
      (SELECT string_agg(w, ' ' ORDER BY w) FROM (SELECT bad || ' amounts are no numbers and count as missing.' AS w FROM q WHERE bad > 0
        UNION ALL SELECT singles || ' cases have a single event and so no transition.' FROM s1 WHERE singles > 0)) AS warnings,
      (SELECT string_agg(label || '=' || s, ',' ORDER BY label || '=' || s) FROM mg JOIN lb USING (k) WHERE kinds > 1) AS merges FROM m""",
    "rejected_export": _with(ORDER, _RAW) + """SELECT source_row, issue, CASE issue WHEN 'malformed_row' THEN 'The row has another number of fields than the header.' WHEN 'missing_case_id' THEN 'No case is named.'
      WHEN 'missing_activity' THEN 'No activity is named.' WHEN 'invalid_timestamp' THEN 'No time can be read from ''not a date''.' WHEN 'duplicate' THEN 'An earlier row has the same values.'
      ELSE CASE WHEN began > ts THEN 'It starts after its end.' ELSE '''' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN ts < TIMESTAMP '1970-01-01' THEN ''' lies before 1970.' ELSE ''' has not come yet.' END END END AS detail,
      CASE WHEN NOT malformed THEN case_id END AS case_id, CASE WHEN NOT malformed THEN CAST(k AS VARCHAR) END AS "Line", CASE WHEN malformed THEN case_id || ' | ' || k END AS raw_fields FROM m WHERE issue IS NOT NULL""",
    "event_records": _with(DAILY_START.replace(" FROM events", ", value FROM events"), EV) + """SELECT case_id, activity, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 <> 0 THEN strftime(make_timestamp(ts_us), '.%f') ELSE '' END || '+00:00' AS timestamp,
      prev_activity, round(wait_us / 3.6e9, 2) AS wait_h, round(gap_us / 3.6e9, 2) AS gap_h, resource, department, round(value, 2) AS amount, source_row FROM ev""",
    "variants_page": _with(DAILY, CASES, VARIANTS) + f"SELECT 'V' || rank AS variant_id, trace_text, case_count, {R('pct', 'pct')} FROM v WHERE rank BETWEEN 6 AND 25",
    "tool_activity_stats": f"SELECT activity, frequency, affected_cases AS cases, median_wait_h, p90_wait_h, score, indicator, long_wait_cases, wait_share FROM ({_bottlenecks(DAILY, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10)}) WHERE activity = 'purchase'",
    "tool_transition_stats": _with(DAILY, EV) + f"SELECT prev_activity AS source, activity AS target, count(*) AS frequency, {R(MEAN('gap_us'), 'mean_h')}, {R(Q('gap_us', 0.5), 'median_h')}, {R(Q('gap_us', 0.9), 'p90_h')} FROM ev WHERE prev_activity = 'view' AND activity = 'purchase' GROUP BY ALL",
    "tool_bottlenecks": f"""SELECT * FROM (SELECT 'activity' AS kind, activity AS name, median_wait_h AS median_h, score FROM ({_bottlenecks(DAILY, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10)}) WHERE score IS NOT NULL ORDER BY score DESC, activity LIMIT 3)
      UNION ALL SELECT * FROM ({_with(DAILY, EV)} SELECT 'transition', prev_activity || '→' || activity, {R(Q('gap_us', 0.5), 'm')}, NULL FROM ev WHERE prev_activity IS NOT NULL GROUP BY prev_activity, activity HAVING count(*) >= 10
        ORDER BY quantile_cont(gap_us, 0.5) DESC, prev_activity, activity LIMIT 5)""",
    "tool_resource_stats": _with(DAILY, EV) + f"""SELECT resource, count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT activity) AS activities, {R(Q('wait_us', 0.5), 'median_wait_h')},
      {R('100.0 * count(*) FILTER (occurrence > 0) / count(*)', 'rework_rate_pct')} FROM ev WHERE resource = 'R3' GROUP BY resource""",
    "fact_sheet_sql": _with(CONV, EV, CASES, VARIANTS, COMPLETION, f"""bt AS (SELECT activity, unnest(['score', 'median_wait_h', 'long_wait_cases']) AS x, unnest([score, median_wait_h, long_wait_cases]) AS y, unnest(['', 'hours', 'cases']) AS u FROM
      (SELECT * FROM ({_bottlenecks(CONV, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10)}) WHERE score IS NOT NULL ORDER BY score DESC, activity LIMIT 8))""", _FACTS, f"""st AS (SELECT prev_activity || '→' || activity AS t, {R(Q('gap_us', 0.5), 'median_h')},
      {R(Q('gap_us', 0.9), 'p90_h')} FROM ev WHERE prev_activity IS NOT NULL GROUP BY prev_activity, activity HAVING count(*) >= 10 ORDER BY quantile_cont(gap_us, 0.5) DESC, prev_activity, activity LIMIT 6)""")
    + """SELECT fact_id, round(value, 4) AS value, unit FROM f UNION ALL SELECT 'transition.' || t || '.median_h', median_h, 'hours' FROM st UNION ALL SELECT 'transition.' || t || '.p90_h', p90_h, 'hours' FROM st""",
    "facts_shown": _with(CONV, EV, CASES, VARIANTS, COMPLETION, f"""bt AS (SELECT activity, unnest(['score', 'median_wait_h', 'long_wait_cases']) AS x, unnest([score, median_wait_h, long_wait_cases]) AS y, unnest(['', 'hours', 'cases']) AS u FROM
      (SELECT * FROM ({_bottlenecks(CONV, (0.3, 0.2, 0.1, 0.2, 0.2), 0.6, 0.35, 10)}) WHERE score IS NOT NULL ORDER BY score DESC, activity LIMIT 8))""", _FACTS, f"""st AS (SELECT prev_activity || '→' || activity AS t, {R(Q('gap_us', 0.5), 'median_h')},
      {R(Q('gap_us', 0.9), 'p90_h')} FROM ev WHERE prev_activity IS NOT NULL GROUP BY prev_activity, activity HAVING count(*) >= 10 ORDER BY quantile_cont(gap_us, 0.5) DESC, prev_activity, activity LIMIT 6)""")
    + r"""SELECT fact_id, regexp_replace(regexp_replace(format('{:,.2f}', value), '(\.\d*?)0+$', '\1'), '\.$', '') || CASE WHEN unit IN ('', '%') THEN unit ELSE ' ' || unit END AS shown,
      regexp_extract(fact_id, '^[^.]+') AS kind, CASE WHEN fact_id LIKE 'overview.%' THEN NULL ELSE split_part(regexp_extract(fact_id, '^[^.]+\.(.*)\.[^.]+$', 1), '→', 1) END AS first,
      CASE WHEN fact_id LIKE 'transition.%' THEN split_part(regexp_extract(fact_id, '^[^.]+\.(.*)\.[^.]+$', 1), '→', 2) END AS second
      FROM (SELECT fact_id, round(value, 4) AS value, unit FROM f UNION ALL SELECT 'transition.' || t || '.median_h', median_h, 'hours' FROM st UNION ALL SELECT 'transition.' || t || '.p90_h', p90_h, 'hours' FROM st)""",
    "numbers_in_text": r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^\w.])(\d[\d,]*(?:\.\d+)?)', 1)) AS x FROM documents),
  p AS (SELECT DISTINCT doc_id, CASE WHEN f LIKE '%.00' THEN f[:-4] WHEN f LIKE '%.%0' THEN f[:-2] ELSE f END AS x FROM (SELECT doc_id, printf('%.2f', CAST(replace(x, ',', '') AS DOUBLE)) AS f FROM n))
SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY x), '') AS numbers FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""",
    "overview_conv": _with(CONV, CASES, VARIANTS, COMPLETION, f"cm AS (SELECT {_CASE_METRICS})") + f"""SELECT total_cases, completed_cases, total_events, mean_duration_h, median_duration_h, (SELECT count(*) FROM v) AS unique_variants,
      (SELECT count(DISTINCT activity) FROM log) AS unique_activities, (SELECT {R('sum(pct)', 'x')} FROM v WHERE rank <= 10) AS top10_coverage_pct, (SELECT trace_text FROM v WHERE rank = 1) AS most_common,
      (SELECT count(*) FROM v WHERE case_count = 1) AS singletons, (SELECT {R('100.0 * count(*) FILTER (trace_text = (SELECT trace_text FROM dom)) / count(*)', 'x')} FROM cases) AS conformance_rate_pct FROM cm""",
}
