"""The driver's queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise import options
from tallywise.operators import costdiff, grouping, pricing, records, status
from tallywise.plans.scale import checkpoint_dir
from tallywise.render import grid, views
from tallywise.sources import prices
from tallywise.sources.lines import numbered_lines, text_files
from tallywise.sources.status import parse_status
from tallywise.sources.tables import table
from tallywise.sources.transcripts import parse_lines

#: Digits to which money is given, since the order of a sum may differ.
DIGITS = 6
#: Prices have ten decimals; less than half of the last one keeps sums off the ties of rounding.
NUDGE = 2.5e-11
TZ = "America/New_York"
#: Sample intervals (epoch seconds, half-open) for overlap ratios: weekends of a month.
INTERVALS = tuple((1759536000 + 604800 * k, 1759536000 + 604800 * k + 172800) for k in range(4))


def _money(*cols: str):
    return lambda d: d.withColumns({c: _cents(F.col(c)) for c in cols})


def _cents(c: Column) -> Column:
    return F.round(c + NUDGE, DIGITS)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return records.zero_fill(table(spark, d, "token_records").where("model is null or model <> '<synthetic>'"))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(_tokens(spark, d), table(spark, d, "price_catalog"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return records.usable(table(spark, d, "transcript_lines"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    return status.valid(table(spark, d, "status_snapshots"))


_KEY, _ORDER = ("message_id", "request_id"), ("batch_id", "row_id")


def usable_records(spark, d):
    return _lines(spark, d).select("row_id", "model")


def dedup_keep_max(spark, d):
    return records.keep_max(_lines(spark, d).select("row_id", "batch_id", "output_tokens", *_KEY), _KEY, "output_tokens", _ORDER).select("row_id", "output_tokens")


def dedup_stats(spark, d):
    return records.dedup_counts(_lines(spark, d).select("row_id", "batch_id", "output_tokens", *_KEY), _KEY, "output_tokens", _ORDER)


def dedup_partial_key(spark, d):
    kept = records.keep_max(_lines(spark, d).select("row_id", "batch_id", "output_tokens", *_KEY), _KEY, "output_tokens", _ORDER)
    return kept.where("message_id is null or request_id is null").select("row_id")


def ts_probe_coalesce(spark, d):
    t = table(spark, d, "transcript_lines")
    return t.select("row_id", F.unix_micros(records.first_time(["line_timestamp", "created_at", "updated_at"])).alias("us"))


def ts_repair(spark, d):
    t = table(spark, d, "transcript_lines").select("row_id", "file_path", "line_no", records.parse_time(F.col("line_timestamp")).alias("ts"), "delivered_at")
    return records.repair_times(t, "file_path", ["line_no", "row_id"], "ts", "delivered_at").select("row_id", F.unix_micros("ts").alias("us"))


def filter_date_range(spark, d):
    return records.select_records(table(spark, d, "token_records"), first="2025-10-01", last="2025-12-24 18:00:00", tz=TZ).select("record_id")


def filter_substring(spark, d):
    return records.select_records(table(spark, d, "token_records"), project="ATLAS", model="Loom").select("record_id")


def records_meta(spark, d):
    m = records.metadata(table(spark, d, "token_records"))
    return m.select(F.unix_micros("earliest").alias("earliest"), F.unix_micros("latest").alias("latest"), "projects", "models", "sessions")


def record_names(spark, d):
    return records.names(table(spark, d, "token_records"))


def path_parts(spark, d):
    p = F.col("file_path")
    return table(spark, d, "transcript_lines").select("row_id", records.project_of(p).alias("project"), records.session_agent_of(p).alias("x")).select("row_id", "project", "x.*")


def tool_combinations(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return per.groupBy(records.tool_combination(F.col("f")).alias("combination")).agg(F.count(F.lit(1)).alias("orders"))


def price_lookup_tiers(spark, d):
    return pricing.match_models(_tokens(spark, d), table(spark, d, "price_catalog")).select("model", "tier", "matched")


def unpriced_models(spark, d):
    return pricing.unpriced(_tokens(spark, d), table(spark, d, "price_catalog"))


def cost_lines(spark, d):
    x = _priced(spark, d)
    return x.select("record_id", *[F.round(c, 10).alias(c) for c in ("input_cost", "output_cost", "cache_creation_cost", "cache_read_cost", "total_cost")])


def _breakdown(*dims: str, tz: str = "UTC"):
    def run(spark, d):
        return _money(*grouping.COSTS)(grouping.breakdown(_priced(spark, d), dims, tz))

    return run


def group_empty_totals(spark, d):
    return grouping.breakdown(_priced(spark, d).where("record_id < 0"), ("day", "model"))


def group_line_sorted(spark, d):
    return grouping.in_order(grouping.breakdown(_priced(spark, d), ("line",), cols=("output_tokens",)), descending=True)


def display_tokens(spark, d):
    return grouping.with_display(grouping.breakdown(_tokens(spark, d), ("project",), cols=grouping.COUNTERS)).select("level", "parent", "all_input", "all_tokens")


def chart_series_auto(spark, d):
    return grouping.series(_priced(spark, d), F.col("output_tokens"))


def chart_series_groups(spark, d):
    b = grouping.breakdown(_priced(spark, d), ("day", "model"))
    return b.where(F.col("level") == grouping.PARENT).select(F.col("parent").alias("label"), _cents(F.col("total_cost")).alias("value"))


def status_counts(spark, d):
    return status.rejected(table(spark, d, "status_snapshots"))


def reset_segments(spark, d):
    return status.cumulative(_status(spark, d)).select("snap_id", "segment")


def cumulative_totals(spark, d):
    c = status.cumulative(_status(spark, d))
    return c.select("snap_id", _cents(F.col("cum_total_cost_usd")).alias("cum_cost"), F.col("cum_total_duration_ms").alias("cum_ms"), F.col("cum_total_lines_added").alias("cum_added"))


def session_summary(spark, d):
    return _money("total_cost_usd")(status.sessions(_status(spark, d)))


def by_project(spark, d):
    return _money("total_cost_usd")(status.by_project(status.sessions(_status(spark, d))))


def by_day(spark, d):
    return _money("total_cost_usd")(status.by_day(status.sessions(_status(spark, d)), TZ))


def session_totals(spark, d):
    return _money("total_cost_usd")(status.totals(status.sessions(_status(spark, d))))


def cumulative_cost(spark, d):
    return _money("total_cost_usd", "cumulative")(status.cumulative_cost(status.sessions(_status(spark, d))))


def action_changes(spark, d):
    a = status.actions(_status(spark, d))
    return a.select("snap_id", "session_id", _cents(F.col("cost_delta")).alias("cost_delta"), "five_hour_used_percentage", "seven_day_used_percentage", "flushed")


def _windows(kind: str):
    def run(spark, d):
        return _money("total_cost_usd", "est_budget")(status.windows(_status(spark, d), kind, INTERVALS))

    return run


def windows_range_filter(spark, d):
    w = status.windows(_status(spark, d), "5h", INTERVALS)
    return status.windows_in_range(w, "2025-10-01 12:00", "2025-12-01", TZ).select("window_start", "window_end", "sessions")


def status_filters(spark, d):
    return status.select_status(_status(spark, d), first="2025-10-01", tz=TZ, model="loom", project="srv").select("snap_id")


def promo_overlap(spark, d):
    t = table(spark, d, "token_records").where("record_timestamp is not null").select("record_id", F.unix_seconds("record_timestamp").alias("s"))
    return t.select("record_id", F.round(status.overlap_ratio(F.col("s"), F.col("s") + 18_000, INTERVALS), 9).alias("ratio"))


def _reported(spark: SparkSession, d: str) -> DataFrame:
    return status.sessions(_status(spark, d)).select("session_id", "total_cost_usd")


def _computed(spark: SparkSession, d: str, id_: Column) -> DataFrame:
    return _priced(spark, d).where("session_id is not null").groupBy(id_.alias("session_id")).agg(F.sum("total_cost").alias("total_cost"))




def _diff(d):
    return _money("total_cost_usd", "computed_cost", "diff")(d).withColumn("diff_pct", F.round(F.col("diff_pct") + NUDGE, 3))



def cost_diff_exact(spark, d):
    return _diff(costdiff.cost_diff(_reported(spark, d), _computed(spark, d, F.col("session_id"))))


def cost_diff_prefix(spark, d):
    short = F.when(F.ascii(F.substring("session_id", 1, 1)) % 2 == 0, F.substring("session_id", 1, 6)).otherwise(F.concat("session_id", F.lit("-x")))
    return _diff(costdiff.cost_diff(_reported(spark, d), _computed(spark, d, short)))


def cost_diff_totals(spark, d):
    t = costdiff.diff_totals(costdiff.cost_diff(_reported(spark, d), _computed(spark, d, F.col("session_id"))))
    return _money("reported", "computed", "diff", "diff_pct")(t)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """The lines of log files as the readers see them, under the number of the raw line."""
    t = table(spark, d, "raw_lines").select(F.col("raw_id").alias("line"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))
    return t.where("body <> ''").withColumns({"file_path": F.lit("/logs/projects/-home-dev/raw.jsonl"), "modified_at": F.lit(None).cast("timestamp")})


def raw_status_rows(spark, d):
    """The status lines that have every required field in the right type."""
    r = parse_status(_raw(spark, d)).where("ok")
    return r.select("snap_id", "ts", "session_id", "project_dir", "model_id", "total_cost_usd", "total_duration_ms", "total_lines_added", "total_lines_removed", "context_window_size")


def raw_status_counts(spark, d):
    """Loaded and malformed lines."""
    return parse_status(_raw(spark, d)).agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("malformed"))


def raw_usage_rows(spark, d):
    """Usage records from lines; a line with a field of the wrong type is dropped whole."""
    r = records.usable(parse_lines(_raw(spark, d)))
    return r.select(F.col("line").alias("raw_id"), "request_id", "message_id", "model", F.unix_micros("record_timestamp").alias("us"), "input_tokens", "output_tokens", F.coalesce("cache_creation_tokens", F.lit(0)).alias("cache_creation_tokens"))


def _text_rows(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(n, x) for n, x in enumerate(text.split("\n"))], "n int, line string")


def report_usage_csv(spark, d):
    """The CSV of a report as written, line by line."""
    rows = [r.asDict() for r in grouping.in_order(grouping.breakdown(_priced(spark, d), ("month", "model"))).collect()]
    return _text_rows(spark, grid.to_csv(views.breakdown_grid(rows, "Month / Model", "off")))


def report_status_csv(spark, d):
    """The CSV of the sessions' view as written."""
    rows = [r.asDict() for r in status.sessions(_status(spark, d)).orderBy("session_id").collect()]
    g = views.status_grid(rows, "session", mode="off")
    g.headers = grid.long_headers(g)
    return _text_rows(spark, grid.to_csv(g))


def report_json(spark, d):
    """A JSON report read back."""
    rows = [r.asDict() for r in grouping.in_order(grouping.breakdown(_priced(spark, d), ("model", "month"))).collect()]
    doc = json.loads(views.breakdown_json(rows, {}, {}))
    flat = [(p["label"], c["label"], c["inputTokens"], c["outputTokens"]) for p in [*doc["data"], doc["totals"]] for c in [{**p, "label": None}, *p["children"]]]
    return spark.createDataFrame(flat, "label string, child string, input_tokens long, output_tokens long")


def line_numbers(spark, d):
    """Bodies written as text files, one for each fifty log files, listed and read with the numbers of their lines."""
    t = table(spark, d, "raw_lines").where("file_id is not null and body is not null")
    t = t.select(F.floor(F.col("file_id") / 50).cast("long").alias("part"), "file_id", "line_no", "raw_id", F.regexp_replace("body", r"[\r\n]+", " ").alias("body"))
    root = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    t.repartition("part").sortWithinPartitions("part", "file_id", "line_no", "raw_id").select("part", "body").write.partitionBy("part").option("compression", "none").text(root)
    lines = numbered_lines(spark, text_files(spark, root, ".txt"))
    return lines.select(F.regexp_extract("file_path", r"part=(\d+)", 1).cast("long").alias("part"), "line", "body")


def range_shortcut(spark, d):
    """The hours before a wall time."""
    first, last = options.date_range(None, None, {"5hto": "2025-10-05 12:00"})
    return records.select_records(_tokens(spark, d), "record_timestamp", first, last, options.zone(TZ)).select("record_id")


def catalog_overlay(spark, d):
    """A user's catalog over another; its entries replace those of the same name."""
    base = table(spark, d, "price_catalog")
    own = base.where("length(model) % 2 = 0").withColumns({p: F.col(p) * 2 for p in pricing.PRICES}).unionByName(base.limit(1).select(F.lit("new").alias("model"), *[F.lit(1.0).alias(p) for p in pricing.PRICES]))
    return pricing.overlay(base, own).select("model", *[F.round(F.col(p) * 1e6, 4).alias(p) for p in pricing.PRICES])


def live_catalog(spark, d):
    """Names of a live list brought to catalog names; only given providers, entries with a price, and the first of a name count."""
    rows = table(spark, d, "price_catalog").collect()  # a fixed table
    live = {f"some/{r['model']}-v{i}:0": {"input_cost_per_token": r["input_cost_per_token"], "output_cost_per_token": 1} for i, r in enumerate(rows)}
    live |= {f"other/{r['model']}": {"input_cost_per_token": 9.0} for r in rows} | {f"some/zz-{r['model']}": {"input_cost_per_token": "x"} for r in rows}
    got = prices.normalise_live(live, ["some/"])
    return spark.createDataFrame([(k, *map(float, v)) for k, v in sorted(got.items())], prices.SCHEMA)


_GROUPS = {
    "group_day": ("day",), "group_month": ("month",), "group_session": ("session",), "group_project": ("project",), "group_model": ("model",),
    "group_subagent": ("subagent",), "group_tool": ("tool",), "group_line": ("line",), "group_two_level_cube": ("day", "model"),
    "group_project_hour": ("project", "hour"), "group_same_twice": ("model", "model"),
}


def queries() -> dict:
    fs = (
        usable_records, dedup_keep_max, dedup_stats, dedup_partial_key, ts_probe_coalesce, ts_repair, filter_date_range, filter_substring, records_meta,
        record_names, path_parts, tool_combinations, price_lookup_tiers, unpriced_models, cost_lines, group_empty_totals, group_line_sorted, display_tokens,
        chart_series_auto, chart_series_groups, status_counts, reset_segments, cumulative_totals, session_summary, by_project, by_day, session_totals,
        cumulative_cost, action_changes, windows_range_filter, status_filters, promo_overlap, cost_diff_exact, cost_diff_prefix, cost_diff_totals,
        raw_status_rows, raw_status_counts, raw_usage_rows, report_usage_csv, report_status_csv, report_json, line_numbers, range_shortcut, catalog_overlay, live_catalog,
    )
    out = {f.__name__: f for f in fs}
    out |= {k: _breakdown(*v) for k, v in _GROUPS.items()}
    out["group_tz"] = _breakdown("hour", tz=TZ)
    return out | {f"data_driven_windows_{k}": _windows(k) for k in ("1h", "5h", "1w")}


# SQL ------------------------------------------------------------------------

_USABLE = """
usable AS (SELECT * FROM transcript_lines WHERE (record_type IS NULL OR record_type IN ('message', 'user', 'assistant'))
  AND model IS NOT NULL AND model <> '<synthetic>' AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL),
kept AS (
  SELECT row_id, output_tokens, message_id, request_id FROM usable WHERE message_id IS NULL OR request_id IS NULL
  UNION ALL
  SELECT row_id, output_tokens, message_id, request_id FROM usable WHERE message_id IS NOT NULL AND request_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY message_id, request_id ORDER BY coalesce(output_tokens, 0) DESC, batch_id DESC, row_id DESC) = 1)
"""


def _parsed(c: str) -> str:
    s = rf"upper(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
    iso = rf"regexp_full_match({s}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})?')"
    cut = rf"regexp_replace({s}, '(\.\d{{6}})\d+', '\1')"
    num = rf"regexp_full_match({s}, '[+-]?\d{{1,18}}(\.\d+)?')"
    x = f"CAST({s} AS DOUBLE)"
    sec = f"(CASE WHEN {x} > 1e12 THEN {x} / 1000 ELSE {x} END)"
    return (
        f"coalesce(CASE WHEN {iso} THEN epoch_us(try_cast({cut} AS TIMESTAMPTZ)) END, "
        f"CASE WHEN {num} THEN CASE WHEN abs({sec}) < 2.5e11 THEN CAST(round({sec} * 1e6) AS BIGINT) END END)"
    )


_PRICED = r"""
tok AS (
  SELECT * REPLACE (coalesce(cache_creation_tokens, 0) AS cache_creation_tokens, coalesce(cache_read_tokens, 0) AS cache_read_tokens)
  FROM token_records WHERE model IS NULL OR model <> '<synthetic>'),
nm AS (SELECT DISTINCT model AS n, regexp_replace(model, '[-@]\d{8}$', '') AS s FROM tok WHERE model <> ''),
hits AS (
  SELECT n, c.*, CASE WHEN c.model = n THEN 1 WHEN c.model = s THEN 2 WHEN lower(c.model) IN (lower(n), lower(s)) THEN 3
    WHEN contains(lower(n), lower(c.model)) OR contains(lower(c.model), lower(n)) THEN 4 END AS tier
  FROM nm, price_catalog c),
matched AS (
  SELECT * FROM hits WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n ORDER BY tier, length(model) DESC, model DESC) = 1),
priced AS (
  SELECT t.*, coalesce(t.input_tokens, 0) * coalesce(m.input_cost_per_token, 0) AS input_cost,
    coalesce(t.output_tokens, 0) * coalesce(m.output_cost_per_token, 0) AS output_cost,
    t.cache_creation_tokens * coalesce(m.cache_creation_cost_per_token, 0) AS cache_creation_cost,
    t.cache_read_tokens * coalesce(m.cache_read_cost_per_token, 0) AS cache_read_cost,
    input_cost + output_cost + cache_creation_cost + cache_read_cost AS total_cost
  FROM tok t LEFT JOIN matched m ON m.n = t.model)
"""


def _key(dimension: str, tz: str = "UTC") -> str:
    t = f"(record_timestamp AT TIME ZONE '{tz}')"
    return {
        "day": f"strftime({t}, '%Y-%m-%d')", "hour": f"strftime({t}, '%Y-%m-%d %H:00')", "month": f"strftime({t}, '%Y-%m')", "session": "session_id",
        "project": "project", "model": r"regexp_replace(regexp_replace(model, '^claude-', ''), '-\d{8}$', '')",
        "subagent": "CASE WHEN agent_id = '' THEN '(main)' ELSE agent_id END", "tool": "CASE WHEN tool_names = '' THEN '(text)' ELSE tool_names END",
        "line": "'#' || line_no",
    }[dimension]


def _sums() -> str:
    n = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in grouping.COUNTERS)
    return n + ", " + ", ".join(f"round(sum({c}) + {NUDGE}, {DIGITS}) AS {c}" for c in grouping.COSTS)


def _group_sql(dims: tuple[str, ...], tz: str = "UTC") -> str:
    null = "CAST(NULL AS VARCHAR)"
    k = [_key(x, tz) for x in dims]
    parts = [f"SELECT 3 AS level, {null} AS parent, {null} AS child, {_sums()} FROM priced", f"SELECT 1, {k[0]}, {null}, {_sums()} FROM priced GROUP BY {k[0]}"]
    if len(k) == 2:
        parts += [f"SELECT 2, {null}, {k[1]}, {_sums()} FROM priced GROUP BY {k[1]}", f"SELECT 0, {k[0]}, {k[1]}, {_sums()} FROM priced GROUP BY {', '.join(dict.fromkeys(k))}"]
    return f"WITH {_PRICED} " + " UNION ALL ".join(parts)


_PCT = "CASE WHEN {c} IS NOT NULL THEN greatest(0, least(255, CAST(round({c}) AS INT))) END AS {c}"
_STATUS = f"""
st AS (
  SELECT snap_id, ts, session_id, coalesce(project_dir, '') AS project_dir, coalesce(display_name, '') AS display_name, model_id,
    coalesce(client_version, '') AS client_version, total_cost_usd AS cost, total_duration_ms AS ms, coalesce(total_api_duration_ms, 0) AS api,
    coalesce(total_lines_added, 0) AS added, coalesce(total_lines_removed, 0) AS removed,
    {_PCT.format(c='context_used_percentage')}, {_PCT.format(c='five_hour_used_percentage')}, {_PCT.format(c='seven_day_used_percentage')},
    five_hour_resets_at, seven_day_resets_at
  FROM status_snapshots
  WHERE snap_id IS NOT NULL AND ts IS NOT NULL AND session_id IS NOT NULL AND total_cost_usd IS NOT NULL AND total_duration_ms IS NOT NULL),
lagged AS (
  SELECT *, lag(cost) OVER w AS pc, lag(ms) OVER w AS pm FROM st WINDOW w AS (PARTITION BY session_id ORDER BY ts, snap_id)),
marked AS (
  SELECT *, CASE WHEN (pc > 1e-4 OR pm > 100) AND (cost < pc - 1e-4 OR ms + 100 < pm) THEN 1 ELSE 0 END AS r FROM lagged),
seg AS (
  SELECT *, CAST(1 + sum(r) OVER (PARTITION BY session_id ORDER BY ts, snap_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM marked)
"""
_C = ("cost", "ms", "api", "added", "removed")
_NAMES = dict(zip(_C, ("total_cost_usd", "total_duration_ms", "total_api_duration_ms", "total_lines_added", "total_lines_removed"), strict=True))
_SESSIONS = f"""{_STATUS},
segmax AS (SELECT session_id, segment, {', '.join(f'greatest(max({c}), 0) AS {c}' for c in _C)} FROM seg GROUP BY ALL),
tot AS (SELECT session_id, count(*) AS segments, {', '.join(f'sum({c}) AS {c}' for c in _C)} FROM segmax GROUP BY ALL),
one AS (
  SELECT session_id, {', '.join(f'arg_min({c}, (ts, snap_id)) AS b_{c}' for c in _C)}, arg_min(project_dir, (ts, snap_id)) AS project,
    arg_max(display_name, (ts, snap_id)) AS model_name, arg_max(client_version, (ts, snap_id)) AS version, max(context_used_percentage) AS max_context_pct,
    min(ts) AS first_ts, max(ts) AS last_ts, min(five_hour_used_percentage) AS min_five_hour_pct, max(five_hour_used_percentage) AS max_five_hour_pct,
    min(seven_day_used_percentage) AS min_seven_day_pct, max(seven_day_used_percentage) AS max_seven_day_pct
  FROM st GROUP BY session_id),
sess AS (
  SELECT session_id, project, model_name, version, segments, greatest(tot.cost - b_cost, 0) AS total_cost_usd,
    {', '.join(f'CAST(greatest(tot.{c} - b_{c}, 0) AS BIGINT) AS {_NAMES[c]}' for c in _C[1:])},
    max_context_pct, first_ts, last_ts, min_five_hour_pct, max_five_hour_pct, min_seven_day_pct, max_seven_day_pct
  FROM one JOIN tot USING (session_id))
"""


def _rollup(label: str, name: str) -> str:
    n = ", ".join(f"CAST(sum({_NAMES[c]}) AS BIGINT) AS {_NAMES[c]}" for c in _C[1:])
    return f"""WITH {_SESSIONS} SELECT {label} AS {name}, count(*) AS sessions, round(sum(total_cost_usd) + {NUDGE}, {DIGITS}) AS total_cost_usd, {n},
min(min_five_hour_pct) AS min_five_hour_pct, max(max_five_hour_pct) AS max_five_hour_pct, min(min_seven_day_pct) AS min_seven_day_pct,
max(max_seven_day_pct) AS max_seven_day_pct FROM sess GROUP BY 1"""


def _cum() -> str:
    top = ", ".join(f"greatest(max({c}) OVER w, 0) AS top_{c}" for c in _C)
    return f"""{_STATUS},
tops AS (SELECT *, {top} FROM seg WINDOW w AS (PARTITION BY session_id, segment ORDER BY ts, snap_id ROWS UNBOUNDED PRECEDING)),
was AS (SELECT *, {', '.join(f'lag(top_{c}) OVER w AS was_{c}' for c in _C)} FROM tops WINDOW w AS (PARTITION BY session_id ORDER BY ts, snap_id)),
cum AS (SELECT *, {', '.join(f'top_{c} + sum(CASE WHEN r = 1 THEN was_{c} ELSE 0 END) OVER w AS cum_{c}' for c in _C)} FROM was
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, snap_id ROWS UNBOUNDED PRECEDING))"""


def _ratio(a: str, b: str) -> str:
    return "(" + " + ".join(f"greatest(0, least({b}, {y}) - greatest({a}, {x}))" for x, y in INTERVALS) + f") / ({b} - {a})"


def _window_sql(kind: str) -> str:
    resets = "seven_day_resets_at" if kind == "1w" else "five_hour_resets_at"
    length = 604_800 if kind == "1w" else 18_000
    rows = f"SELECT *, {resets} - {length} AS window_start, {resets} AS window_end, {resets} AS resets_at FROM st WHERE {resets} IS NOT NULL"
    if kind == "1h":
        rows = f"""SELECT * EXCLUDE (ws, h), ws + h * 3600 AS window_start, ws + h * 3600 + 3600 AS window_end, ws + 18000 AS resets_at FROM (
          SELECT *, {resets} - 18000 AS ws, CAST(floor((ts - ({resets} - 18000)) / 3600.0) AS BIGINT) AS h FROM st WHERE {resets} IS NOT NULL) WHERE h BETWEEN 0 AND 4"""
    lo, hi = ("min_seven_day_pct", "max_seven_day_pct") if kind == "1w" else ("min_five_hour_pct", "max_five_hour_pct")
    at = lambda edge: ", ".join(f"coalesce(max(CASE WHEN cum.ts < p.{edge} THEN cum_{c} END), any_value(b.b_{c})) AS {edge[7]}_{c}" for c in _C)
    n = ", ".join(f"CAST(sum(greatest(e_{c} - s_{c}, 0)) AS BIGINT) AS {_NAMES[c]}" for c in _C[1:])
    return f"""WITH {_cum()},
w AS ({rows}),
pct AS (
  SELECT window_start, window_end, resets_at, coalesce(min(five_hour_used_percentage), 0) AS min_five_hour_pct,
    coalesce(max(five_hour_used_percentage), 0) AS max_five_hour_pct, min(seven_day_used_percentage) AS min_seven_day_pct,
    max(seven_day_used_percentage) AS max_seven_day_pct FROM w GROUP BY ALL),
pairs AS (SELECT DISTINCT window_start, window_end, resets_at, session_id FROM w),
b AS (SELECT session_id, {', '.join(f'arg_min({c}, (ts, snap_id)) AS b_{c}' for c in _C)} FROM st GROUP BY session_id),
edges AS (
  SELECT p.window_start, p.window_end, p.resets_at, p.session_id, {at('window_end')}, {at('window_start')}
  FROM pairs p JOIN cum USING (session_id) JOIN b USING (session_id) GROUP BY ALL),
agg AS (
  SELECT window_start, window_end, resets_at, count(*) AS sessions, sum(greatest(e_cost - s_cost, 0)) AS total_cost_usd, {n} FROM edges GROUP BY ALL)
SELECT agg.* REPLACE (round(total_cost_usd + {NUDGE}, {DIGITS}) AS total_cost_usd), min_five_hour_pct, max_five_hour_pct, min_seven_day_pct, max_seven_day_pct,
  CASE WHEN coalesce({hi}, 0) > coalesce({lo}, 0) THEN
    round(total_cost_usd * 100 / ((coalesce({hi}, 0) - coalesce({lo}, 0)) * (1 + {_ratio('agg.window_start', 'agg.window_end')})) + {NUDGE}, {DIGITS}) END AS est_budget
FROM agg JOIN pct USING (window_start, window_end, resets_at)"""


_Q = "five_hour_used_percentage IS NOT NULL AND five_hour_resets_at IS NOT NULL AND seven_day_used_percentage IS NOT NULL AND seven_day_resets_at IS NOT NULL"
_ACTIONS = f"""WITH {_STATUS},
base AS (SELECT session_id, arg_min(cost, snap_id) AS b FROM st GROUP BY session_id),
q AS (SELECT snap_id, session_id, cost, five_hour_used_percentage AS f, seven_day_used_percentage AS s FROM st WHERE {_Q}),
ch AS (SELECT *, lag(f) OVER (ORDER BY snap_id) AS pf, lag(s) OVER (ORDER BY snap_id) AS ps FROM q),
hit AS (SELECT snap_id, session_id, cost, f, s FROM ch WHERE f IS DISTINCT FROM pf OR s IS DISTINCT FROM ps),
hp AS (SELECT *, lag(cost) OVER (PARTITION BY session_id ORDER BY snap_id) AS p FROM hit),
fin AS (
  SELECT q.session_id, arg_max(q.cost, q.snap_id) AS fc, arg_max(q.f, q.snap_id) AS lf, arg_max(q.s, q.snap_id) AS ls, max(q.snap_id) AS lid FROM q GROUP BY 1),
ends AS (SELECT session_id, max(snap_id) AS e, arg_max(cost, snap_id) AS shown FROM hit GROUP BY 1),
per AS (
  SELECT fin.*, b, e, CASE WHEN fc < coalesce(shown, b) THEN fc ELSE fc - coalesce(shown, b) END AS rest
  FROM fin JOIN base USING (session_id) LEFT JOIN ends USING (session_id))
SELECT h.snap_id, h.session_id, round(CASE WHEN h.cost < coalesce(p, b) THEN h.cost ELSE h.cost - coalesce(p, b) END
    + CASE WHEN h.snap_id = e AND rest > 1e-9 THEN rest ELSE 0 END + {NUDGE}, {DIGITS}) AS cost_delta,
  f AS five_hour_used_percentage, s AS seven_day_used_percentage, false AS flushed
FROM hp h JOIN per USING (session_id)
UNION ALL SELECT lid, session_id, round(rest + {NUDGE}, {DIGITS}), lf, ls, true FROM per WHERE e IS NULL AND rest > 1e-9"""


def _diff_sql(id_: str) -> str:
    return f"""WITH {_SESSIONS}, {_PRICED},
comp AS (SELECT {id_} AS k, sum(total_cost) AS computed_cost FROM priced WHERE session_id IS NOT NULL GROUP BY 1),
pairs AS (
  SELECT a.session_id AS a, c.k, CASE WHEN a.session_id = c.k THEN 1 ELSE 0 END AS exact, least(length(a.session_id), length(c.k)) AS n
  FROM sess a JOIN comp c ON a.session_id = c.k OR starts_with(a.session_id, c.k) OR starts_with(c.k, a.session_id)),
best AS (SELECT a, k FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY exact DESC, n DESC, k DESC) = 1),
d AS (
  SELECT s.session_id, s.total_cost_usd, best.k AS matched_id, comp.computed_cost, s.total_cost_usd - comp.computed_cost AS diff
  FROM sess s LEFT JOIN best ON best.a = s.session_id LEFT JOIN comp ON comp.k = best.k)"""


def _raw_sql() -> str:
    """Raw lines with one flag for status lines and one for transcript lines, each field's JSON type checked."""
    t = lambda p: f"coalesce(json_type(j, '$.{p}'), '-')"
    need = lambda p, *k: f"{t(p)} IN ({', '.join(map(repr, k))})"
    whole, number, text = ("UBIGINT",), ("UBIGINT", "BIGINT", "DOUBLE"), ("VARCHAR",)
    status = [
        need("ts", "UBIGINT", "BIGINT"), need("data.cost.total_cost_usd", *number), *[need(f"data.{p}", *text) for p in ("session_id", "workspace.project_dir", "model.id")],
        *[need(f"data.{p}", *whole) for p in ("cost.total_duration_ms", "cost.total_api_duration_ms", "context_window.context_window_size")],
        *[need(f"data.{p}", "-", *text) for p in ("model.display_name", "version")], *[need(f"data.cost.{p}", "-", *whole) for p in ("total_lines_added", "total_lines_removed")],
    ]
    usage = [
        *[need(p, "-", "NULL", *text) for p in ("type", "requestId", "message.id", "message.model", "timestamp")], *[need(p, "-", "NULL", "OBJECT") for p in ("message", "message.usage", "snapshot")],
        *[need(f"message.usage.{p}", "-", "NULL", *whole) for p in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")],
    ]
    return f"""
WITH l AS (SELECT raw_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM raw_lines WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
k AS (SELECT raw_id, j, coalesce(json_type(j) = 'OBJECT' AND {' AND '.join(status)}, false) AS ok, coalesce(json_type(j) = 'OBJECT' AND {' AND '.join(usage)}, false) AS used FROM l)"""


_DIFF_ROWS = f" SELECT session_id, matched_id, round(total_cost_usd + {NUDGE}, {DIGITS}) AS total_cost_usd, round(computed_cost + {NUDGE}, {DIGITS}) AS computed_cost, round(diff + {NUDGE}, {DIGITS}) AS diff, round(CASE WHEN abs(computed_cost) > 1e-9 THEN diff / computed_cost * 100 END + {NUDGE}, 3) AS diff_pct FROM d"


def _csv_sql() -> dict[str, str]:
    tok = lambda n: f"CASE WHEN {n} >= 1000000 THEN printf('%.2fM', {n} / 1e6) WHEN {n} >= 1000 THEN printf('%.1fK', {n} / 1e3) ELSE CAST({n} AS VARCHAR) END"
    a, b, c, o = "coalesce(input_tokens, 0)", "coalesce(cache_creation_tokens, 0)", "coalesce(cache_read_tokens, 0)", "coalesce(output_tokens, 0)"
    cells = " || ',' || ".join(tok(f"({x})") for x in (a, b, c, f"{a} + {b} + {c}", o, f"{a} + {b} + {c} + {o}"))
    took = lambda ms: f"""CASE WHEN {ms} // 3600000 > 0 THEN ({ms} // 3600000) || 'h ' || ({ms} // 60000 % 60) || 'm'
      WHEN {ms} // 60000 > 0 THEN ({ms} // 60000) || 'm ' || ({ms} // 1000 % 60) || 's' ELSE ({ms} // 1000) || 's' END"""  # noqa: E731
    pct = lambda w: f"CASE WHEN {w[0]} IS NULL THEN '—' WHEN {w[0]} = {w[1]} THEN {w[0]} || '%' ELSE {w[0]} || '–' || {w[1]} || '%' END"
    use = lambda f: (
        f"'—,' || {took(f.format('total_duration_ms'))} || ',' || {took(f.format('total_api_duration_ms'))} || ',+' || {f.format('total_lines_added')} || ' -' || {f.format('total_lines_removed')}"
        f" || ',' || {f.format('segments')} || ',' || "
    )
    week = ("min_seven_day_pct", "max_seven_day_pct")
    five = ("min_five_hour_pct", "max_five_hour_pct")
    outer = lambda w: (f"min({w[0]})", f"max({w[1]})")
    month, model = _key("month"), _key("model")
    return {
        "report_usage_csv": f"""WITH {_PRICED},
g AS (SELECT {month} AS p, {model} AS c, grouping({month}) AS gp, grouping({model}) AS gc, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
  sum(cache_creation_tokens) AS cache_creation_tokens, sum(cache_read_tokens) AS cache_read_tokens FROM priced GROUP BY CUBE ({month}, {model})),
l AS (
  SELECT CASE WHEN gp = 0 AND gc = 0 THEN '└─ ' || coalesce(c, '') WHEN gp = 0 THEN coalesce(p, '') WHEN gc = 0 THEN '└─ ' || coalesce(c, '') ELSE 'TOTAL' END || ',' || {cells} AS line,
    row_number() OVER (ORDER BY gp, p NULLS FIRST, CASE WHEN gp = 0 THEN 1 - gc ELSE 1 - gc END, c NULLS FIRST) AS n
  FROM g)
SELECT CAST(n AS INT) AS n, line FROM l UNION ALL SELECT 0, 'Month / Model,In,Cache Cr,Cache Rd,In Total,Out,Total'""",
        "report_status_csv": f"""WITH {_SESSIONS},
t AS (SELECT sum(total_duration_ms)::BIGINT AS total_duration_ms, sum(total_api_duration_ms)::BIGINT AS total_api_duration_ms, sum(total_lines_added)::BIGINT AS total_lines_added,
  sum(total_lines_removed)::BIGINT AS total_lines_removed, sum(segments)::BIGINT AS segments, {', '.join(f'{f} AS {n}' for w in (five, week) for f, n in zip(outer(w), w, strict=True))}, count(*) AS k FROM sess)
SELECT CAST(row_number() OVER (ORDER BY session_id) AS INT) AS n, session_id[1:8] || ',' || {use('{}')} {pct(five)} || ',' || {pct(week)} AS line FROM sess
UNION ALL SELECT CAST(k + 1 AS INT), 'TOTAL,' || {use('{}')} {pct(five)} || ',' || {pct(week)} FROM t
UNION ALL SELECT 0, 'Session,Cost,Duration,API Time,Lines,Segments,5h%,1w%'""",
        "report_json": f"""WITH {_PRICED}
SELECT CASE WHEN grouping({model}) = 1 THEN 'TOTAL' ELSE {model} END AS label, {month} AS child, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
FROM priced GROUP BY CUBE ({model}, {month})""",
        "line_numbers": r"""
WITH l AS (SELECT file_id // 50 AS part, file_id, line_no, raw_id, regexp_replace(regexp_replace(body, '[\r\n]+', ' ', 'g'), '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g') AS body FROM raw_lines WHERE file_id IS NOT NULL AND body IS NOT NULL)
SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY file_id, line_no NULLS FIRST, raw_id) AS INT) AS line, body FROM l WHERE body <> ''""",
        "range_shortcut": f"""SELECT record_id FROM token_records WHERE (model IS NULL OR model <> '<synthetic>')
AND strftime(record_timestamp AT TIME ZONE '{TZ}', '%Y-%m-%dT%H:%M:%S') BETWEEN '2025-10-05T07:00:00' AND '2025-10-05T12:00:00'""",
        "catalog_overlay": "SELECT model, "
        + ", ".join(f"round({p} * CASE WHEN length(model) % 2 = 0 THEN 2 ELSE 1 END * 1e6, 4) AS {p}" for p in pricing.PRICES)
        + " FROM price_catalog UNION ALL SELECT 'new', "
        + ", ".join(["1e6"] * len(pricing.PRICES)),
        "live_catalog": f"SELECT replace(model, '@', '-') AS model, {pricing.PRICES[0]}, 1.0::DOUBLE AS {pricing.PRICES[1]}, 0.0::DOUBLE AS {pricing.PRICES[2]}, 0.0::DOUBLE AS {pricing.PRICES[3]} FROM price_catalog",
    }


def oracle_sql() -> dict[str, str]:
    wall = "strftime(record_timestamp AT TIME ZONE '{}', '%Y-%m-%dT%H:%M:%S')".format(TZ)
    edge = lambda c: f"strftime(to_timestamp({c}) AT TIME ZONE '{TZ}', '%Y-%m-%dT%H:%M:%S')"
    path = r"regexp_extract(file_path, '(?:^|/)projects/([^/]+)', 1)"
    out = {
        "usable_records": f"WITH {_USABLE} SELECT row_id, model FROM usable",
        "dedup_keep_max": f"WITH {_USABLE} SELECT row_id, output_tokens FROM kept",
        "dedup_stats": f"WITH {_USABLE} SELECT (SELECT count(*) FROM usable) AS before, (SELECT count(*) FROM kept) AS after",
        "dedup_partial_key": f"WITH {_USABLE} SELECT row_id FROM kept WHERE message_id IS NULL OR request_id IS NULL",
        "ts_probe_coalesce": f"SELECT row_id, coalesce({_parsed('line_timestamp')}, {_parsed('created_at')}, {_parsed('updated_at')}) AS us FROM transcript_lines",
        "ts_repair": f"""
WITH p AS (SELECT row_id, file_path, line_no, {_parsed('line_timestamp')} AS us, epoch_us(delivered_at) AS f FROM transcript_lines),
s AS (SELECT *, max(CASE WHEN us IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_no NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS seen FROM p)
SELECT row_id, coalesce(us, f) AS us FROM s WHERE us IS NOT NULL OR (seen = 0 AND f IS NOT NULL)""",
        "filter_date_range": f"SELECT record_id FROM token_records WHERE {wall}[1:10] >= '2025-10-01' AND {wall} <= '2025-12-24T18:00:00'",
        "filter_substring": "SELECT record_id FROM token_records WHERE contains(lower(project), 'atlas') AND contains(lower(model), 'loom')",
        "records_meta": """SELECT min(epoch_us(record_timestamp)) AS earliest, max(epoch_us(record_timestamp)) AS latest, count(DISTINCT project) AS projects,
count(DISTINCT model) AS models, count(DISTINCT session_id) AS sessions FROM token_records""",
        "record_names": " UNION ALL ".join(
            f"SELECT DISTINCT '{k}' AS kind, {c} AS name FROM token_records WHERE {c} IS NOT NULL" for k, c in (("project", "project"), ("model", "model"), ("session", "session_id"))
        ),
        "path_parts": rf"""
WITH p AS (
  SELECT row_id, {path} AS pr, regexp_replace(split_part(file_path, '/', -1), '\.[^.]*$', '') AS stem, split_part(file_path, '/', -2) AS parent,
    split_part(file_path, '/', -3) AS grand FROM transcript_lines)
SELECT row_id, CASE WHEN pr = '' THEN 'unknown' WHEN starts_with(pr, '-') THEN replace(pr, '-', '/') ELSE pr END AS project,
  CASE WHEN parent = 'subagents' AND length(grand) = 36 AND length(grand) - length(replace(grand, '-', '')) = 4 THEN grand ELSE stem END AS session_id,
  CASE WHEN parent = 'subagents' THEN stem ELSE '' END AS agent_id FROM p""",
        "tool_combinations": """SELECT f AS combination, count(*) AS orders FROM (
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS f FROM lineitem GROUP BY 1) GROUP BY 1""",
        "price_lookup_tiers": f"WITH {_PRICED} SELECT n AS model, tier, model AS matched FROM matched",
        "unpriced_models": f"WITH {_PRICED} SELECT DISTINCT model FROM tok WHERE model IS NOT NULL AND model NOT IN (SELECT n FROM matched)",
        "cost_lines": f"WITH {_PRICED} SELECT record_id, {', '.join(f'round({c}, 10) AS {c}' for c in grouping.COSTS)} FROM priced",
        "group_empty_totals": "SELECT 3 AS level, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS child, "
        + ", ".join([*(f"CAST(0 AS BIGINT) AS {c}" for c in grouping.COUNTERS), *(f"CAST(0 AS DOUBLE) AS {c}" for c in grouping.COSTS)]),
        "group_line_sorted": f"""WITH {_PRICED} SELECT 3 AS level, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS child,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM priced UNION ALL SELECT 1, {_key('line')}, NULL, CAST(sum(output_tokens) AS BIGINT) FROM priced GROUP BY ALL""",
        "display_tokens": f"""WITH {_PRICED}, g AS (
  SELECT CASE WHEN grouping(project) = 1 THEN 3 ELSE 1 END AS level, project AS parent, sum(input_tokens) + sum(cache_creation_tokens) + sum(cache_read_tokens) AS i,
    sum(output_tokens) AS o FROM tok GROUP BY ROLLUP (project))
SELECT level, parent, CAST(i AS BIGINT) AS all_input, CAST(i + o AS BIGINT) AS all_tokens FROM g""",
        "chart_series_auto": f"""WITH {_PRICED}, g AS (SELECT count(*) AS n, epoch(max(record_timestamp)) - epoch(min(record_timestamp)) AS s FROM priced WHERE record_timestamp IS NOT NULL)
SELECT CASE WHEN n < 2 THEN {_key('day')} WHEN s <= 172800 THEN {_key('hour')} WHEN s <= 7776000 THEN {_key('day')} ELSE {_key('month')} END AS label,
CAST(sum(output_tokens) AS BIGINT) AS value FROM priced, g WHERE record_timestamp IS NOT NULL GROUP BY 1""",
        "chart_series_groups": f"WITH {_PRICED} SELECT {_key('day')} AS label, round(sum(total_cost) + {NUDGE}, {DIGITS}) AS value FROM priced GROUP BY 1",
        "status_counts": """SELECT count(*) FILTER (ok) AS loaded, count(*) FILTER (NOT ok) AS malformed FROM (
SELECT snap_id IS NOT NULL AND ts IS NOT NULL AND session_id IS NOT NULL AND total_cost_usd IS NOT NULL AND total_duration_ms IS NOT NULL AS ok FROM status_snapshots)""",
        "reset_segments": f"WITH {_STATUS} SELECT snap_id, segment FROM seg",
        "cumulative_totals": f"WITH {_cum()} SELECT snap_id, round(cum_cost + {NUDGE}, {DIGITS}) AS cum_cost, CAST(cum_ms AS BIGINT) AS cum_ms, CAST(cum_added AS BIGINT) AS cum_added FROM cum",
        "session_summary": f"WITH {_SESSIONS} SELECT * REPLACE (round(total_cost_usd + {NUDGE}, {DIGITS}) AS total_cost_usd) FROM sess",
        "by_project": _rollup("project", "project"),
        "by_day": _rollup(f"{edge('first_ts')}[1:10]", "day"),
        "session_totals": _rollup("'TOTAL'", "label"),
        "cumulative_cost": f"""WITH {_SESSIONS} SELECT session_id, first_ts, round(total_cost_usd + {NUDGE}, {DIGITS}) AS total_cost_usd,
round(sum(total_cost_usd) OVER (ORDER BY session_id ROWS UNBOUNDED PRECEDING) + {NUDGE}, {DIGITS}) AS cumulative FROM sess""",
        "action_changes": _ACTIONS,
        "windows_range_filter": f"""SELECT window_start, window_end, sessions FROM ({_window_sql('5h')})
WHERE {edge('window_end')} > '2025-10-01T12:00:00' AND {edge('window_start')} < '2025-12-01'""",
        "status_filters": f"""WITH {_STATUS} SELECT snap_id FROM st WHERE {edge('ts')}[1:10] >= '2025-10-01' AND contains(lower(project_dir), 'srv')
AND contains(lower(concat_ws(' ', coalesce(model_id, ''), display_name)), 'loom')""",
        "promo_overlap": f"""SELECT record_id, round({_ratio('s', '(s + 18000)')}, 9) AS ratio FROM (
SELECT record_id, CAST(floor(epoch(record_timestamp)) AS BIGINT) AS s FROM token_records WHERE record_timestamp IS NOT NULL)""",
        "cost_diff_exact": _diff_sql("session_id") + _DIFF_ROWS,
        "cost_diff_prefix": _diff_sql("CASE WHEN ascii(session_id[1]) % 2 = 0 THEN session_id[1:6] ELSE session_id || '-x' END") + _DIFF_ROWS,
        "cost_diff_totals": _diff_sql("session_id")
        + f""", t AS (SELECT coalesce(sum(CASE WHEN matched_id IS NOT NULL THEN total_cost_usd END), 0.0) AS reported,
coalesce(sum(CASE WHEN matched_id IS NOT NULL THEN computed_cost END), 0.0) AS computed, count(matched_id) AS matched, count(*) - count(matched_id) AS unmatched FROM d)
SELECT round(reported + {NUDGE}, {DIGITS}) AS reported, round(computed + {NUDGE}, {DIGITS}) AS computed, matched, unmatched, round(reported - computed + {NUDGE}, {DIGITS}) AS diff,
CASE WHEN computed > 0 THEN round((reported - computed) / computed * 100 + {NUDGE}, {DIGITS}) END AS diff_pct FROM t""",
    }
    n = lambda p: f"CAST(coalesce(j ->> '$.{p}', '0') AS BIGINT)"
    out |= {
        "raw_status_counts": _raw_sql() + " SELECT count_if(ok) AS loaded, count_if(NOT ok) AS malformed FROM k",
        "raw_status_rows": _raw_sql()
        + f""" SELECT raw_id AS snap_id, CAST(j ->> '$.ts' AS BIGINT) AS ts, j ->> '$.data.session_id' AS session_id, j ->> '$.data.workspace.project_dir' AS project_dir,
j ->> '$.data.model.id' AS model_id, CAST(j ->> '$.data.cost.total_cost_usd' AS DOUBLE) AS total_cost_usd, {n('data.cost.total_duration_ms')} AS total_duration_ms,
{n('data.cost.total_lines_added')} AS total_lines_added, {n('data.cost.total_lines_removed')} AS total_lines_removed, {n('data.context_window.context_window_size')} AS context_window_size FROM k WHERE ok""",
        "raw_usage_rows": _raw_sql()
        + f""" SELECT raw_id, j ->> '$.requestId' AS request_id, j ->> '$.message.id' AS message_id, j ->> '$.message.model' AS model,
epoch_us(try_cast(j ->> '$.timestamp' AS TIMESTAMPTZ)) AS us, {n('message.usage.input_tokens')} AS input_tokens, {n('message.usage.output_tokens')} AS output_tokens,
{n('message.usage.cache_creation_input_tokens')} AS cache_creation_tokens
FROM k WHERE used AND coalesce(j ->> '$.type', 'message') IN ('message', 'user', 'assistant') AND j ->> '$.message.model' <> '<synthetic>'
AND j ->> '$.message.usage.input_tokens' IS NOT NULL AND j ->> '$.message.usage.output_tokens' IS NOT NULL""",
    }
    out |= _csv_sql()
    out |= {k: _group_sql(v) for k, v in _GROUPS.items()} | {"group_tz": _group_sql(("hour",), TZ)}
    return out | {f"data_driven_windows_{k}": _window_sql(k) for k in ("1h", "5h", "1w")}
