"""The driver's queries of the core training-data operators (p1, p2, p3, p5)."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.operators import instants, packed, redelivery, rescue
from tallywise.plans.scale import materialise
from tallywise.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "token_records")
    return packed.explode_packed(t, "record_id", "tool_names", value="tool_name", keep_single=False)


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tool is named, and in how many records."""
    t = table(spark, sf_dir, "token_records")
    return packed.explode_packed(t, "record_id", "tool_names", value="tool_name").groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("named"), F.countDistinct("record_id").alias("records")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.dropped(table(spark, sf_dir, "transcript_lines"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and distinct messages by batch: the tables of even batches and of all others, null too, merged."""
    t = table(spark, sf_dir, "transcript_lines")
    even = F.coalesce(F.col("batch_id") % 2 == 0, F.lit(False))
    both = redelivery.merge(*(redelivery.insert(t.where(c)) for c in (even, ~even)))
    return both.groupBy(F.col("r1").alias("batch_id")).agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("delivered"))


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read once and written with what they rescued; then names for the targets are looked up among the rescued paths."""
    d = materialise(rescue.ingest(table(spark, sf_dir, "raw_lines").select("raw_id", "file_id", "body")))
    found = materialise(rescue.paths(d))
    known = rescue.approve(found)
    known = rescue.accept(rescue.candidates(d, table(spark, sf_dir, "log_files"), approved=known, found=found), known)
    return rescue.promote(d, approved=known)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = rescue.file_shapes(_promoted(spark, sf_dir))
    return rescue.drift_report(shapes, table(spark, sf_dir, "log_files")).select("file_id", "field_name", "change_kind")


def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stand in for a watched field, from where they stand alone: no name is approved beforehand."""
    d = materialise(rescue.ingest(table(spark, sf_dir, "raw_lines").select("raw_id", "file_id", "body")))
    return rescue.candidates(d, table(spark, sf_dir, "log_files"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent table: every readable line with the drifting fields under one name and type."""
    return _promoted(spark, sf_dir).where("_readable").select("raw_id", "file_id", *rescue.WATCHED)


def _normalised(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    clients = table(spark, sf_dir, "clients")
    if not ordered:
        clients = clients.withColumn("date_order", F.lit(None).cast("string"))
    return instants.normalise(table(spark, sf_dir, "transcript_lines"), "row_id", ["line_timestamp", "created_at", "updated_at"], "client_id", clients, "client_id", "zone_name", "date_order")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).where("status = 'instant'").select("row_id", "field_name", "instant_us")


def p5_order_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How values come out if no client's date order were known, by the status they have with it."""
    key = ["row_id", "field_name"]
    d = _normalised(spark, sf_dir).select(*key, F.col("status").alias("with_order"), F.col("instant_us").alias("_a"))
    e = _normalised(spark, sf_dir, ordered=False).select(*key, F.col("status").alias("without_order"), F.col("instant_us").alias("_b"), "format")
    same = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_a") == F.col("_b"))
    numeric = F.coalesce(F.substring("format", 1, 3).isin("mdy", "dmy"), F.lit(False))
    return d.join(e, key).groupBy("with_order", "without_order", numeric.alias("slashes"), same.alias("same_instant")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_batches, p3_found, p3_candidates, p3_table, p5_found, p5_order_withheld)}


_IDS = r"""
keyed AS (
  SELECT row_id, output_tokens, batch_id,
         lower(regexp_replace(message_id, '^\s+|\s+$', '', 'g')) AS m, lower(regexp_replace(request_id, '^\s+|\s+$', '', 'g')) AS r
  FROM transcript_lines),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY m, r ORDER BY output_tokens DESC NULLS LAST, batch_id DESC NULLS LAST, row_id DESC) AS k,
         count(*) OVER (PARTITION BY m, r) AS n
  FROM keyed WHERE m <> '' AND r <> '')
"""


#: Where the tables have the fields, for the SQL alone.
_PLACES = {
    "total_lines_added": "data.cost.total_lines_added data.cost.totalLinesAdded data.cost.lines_added data.cost.added_lines data.cost.loc_added data.diff.insertions data.lines.added",
    "total_lines_removed": "data.cost.total_lines_removed data.cost.totalLinesRemoved data.cost.lines_removed data.cost.deleted_lines data.cost.loc_removed data.diff.deletions data.lines.removed",
    "cache_creation_input_tokens": "message.usage.cache_creation_input_tokens message.usage.cacheCreationInputTokens message.usage.cache_creation_tokens message.usage.cache_write_tokens "
    "message.usage.cache.creation message.cacheCreation.inputTokens",
}


def _paths() -> str:
    return ", ".join(f"('{n}', {i}, '$.{p}')" for n, places in _PLACES.items() for i, p in enumerate(places.split()))


def _values() -> str:
    return f"""
paths(field_name, i, path) AS (VALUES {_paths()}),
lines AS (SELECT raw_id, file_id, body::JSON AS j FROM raw_lines WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'),
vals AS (
  SELECT raw_id, file_id, field_name, i, path, j -> path AS v, json_type(j, path) AS t
  FROM lines, paths WHERE json_type(j, path) IS NOT NULL AND json_type(j, path) <> 'NULL')
"""


def _split_sql() -> str:
    """(record_id, pos, tool_name, k): lexemes of more than a character become single placeholder characters."""
    quoted = r'"(?:[^"\\]|\\.|"")*"' + "|" + r"''(?:[^''\\]|\\.|'''')*''"
    delim = r"\s*(?:[,;|\t\r\n、，；]|(?:^|\s)[&+/·](?:\s+[&+/·])*(?:\s|$))\s*"
    inner = "x[2:length(x) - 1]"
    plain = lambda q: rf"regexp_replace(replace(replace({inner}, '{q}{q}', '{q}'), '\t', chr(9)), '\\(.)', '\1', 'g')"
    value = f"CASE x[1] WHEN '\"' THEN {plain(chr(34))} WHEN '''' THEN {plain(chr(39) * 2)} ELSE x[2:] END"
    return rf"""
lexed AS (SELECT record_id, regexp_extract_all(regexp_replace(tool_names, '^\s+|\s+$', '', 'g'), '(?s){quoted}|\\.|.') AS l FROM token_records WHERE tool_names IS NOT NULL),
held AS (
  SELECT record_id, list_transform(l, lambda x: CASE WHEN length(x) > 1 THEN {value} ELSE x END) AS v,
    regexp_replace(array_to_string(list_transform(l, lambda x, i: CASE WHEN length(x) > 1 THEN chr(CAST(57344 + i AS INT)) ELSE x END), ''), '(?s)^[\[{{(]\s*(.*?)\s*[\]}})]$', '\1') AS h
  FROM lexed),
parts AS (
  SELECT record_id, v, CASE WHEN regexp_matches(h, '{delim}') THEN string_split_regex(h, '{delim}') ELSE string_split_regex(h, '\s+') END AS p FROM held),
named AS (
  SELECT record_id, list_filter(list_transform(p, lambda w: regexp_replace(array_to_string(list_transform(string_split(w, ''),
    lambda c: CASE WHEN ord(c) BETWEEN 57345 AND 63743 THEN v[ord(c) - 57344] ELSE c END), ''), '^\s+|\s+$', '', 'g')), lambda w: w <> '') AS n FROM parts),
vals AS (SELECT record_id, len(n) AS k, unnest(generate_series(1, len(n))) AS pos, unnest(n) AS tool_name FROM named)"""


#: Month names as they stand in the tables, upper case, by month; for the SQL alone.
_MONTH_NAMES = (
    "JANUARY JAN JANUAR ENERO ENE JANVIER JANV; FEBRUARY FEB FEBRUAR FEBRERO FÉVRIER FÉVR FÉV; MARCH MAR MÄRZ MÄR MRZ MARZO MARS; APRIL APR ABRIL ABR AVRIL AVR; MAY MAI MAYO;"
    "JUNE JUN JUNI JUNIO JUIN; JULY JUL JULI JULIO JUILLET JUIL; AUGUST AUG AGOSTO AGO AOÛT AOÛ; SEPTEMBER SEP SEPT SEPTIEMBRE SEPTEMBRE; OCTOBER OCT OKTOBER OKT OCTUBRE OCTOBRE;"
    "NOVEMBER NOV NOVIEMBRE NOVEMBRE; DECEMBER DEC DEZEMBER DEZ DICIEMBRE DIC DÉCEMBRE DÉC"
)


def _abbreviations() -> set[tuple[str, str, int]]:
    """(zone, abbreviation, seconds east) at the noon of each day of 2025 and 2026; for the SQL alone."""
    noon, out = datetime(2025, 1, 1, 12, tzinfo=UTC), set()
    for zone in available_timezones():
        z = ZoneInfo(zone)
        for day in range(730):
            t = (noon + timedelta(days=day)).astimezone(z)
            if t.tzname().isalpha():
                out.add((zone, t.tzname().upper(), int(t.utcoffset().total_seconds())))
    return out


def _instants_sql() -> str:
    """p5_found: one canonical text per value, then wall time, zone and instant; RE2 has nine groups."""
    zone = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?(?:\[[A-Z0-9_+/-]+\])?"
    time = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AP]M))?"
    word, day = r"([\p{L}]{3,10})\.?", r"(?:[\p{L}]{2,10},? +)?"
    forms = (
        ("n", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[T ]{time} ?{zone}$", "123456789"),
        ("n", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(\d{{2}})()() ?{zone}$", "123456789"),
        ("s", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {time} ?{zone}$", "312456789"),
        ("n", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {time} ?{zone}$", "321456789"),
        ("w", rf"^{day}(\d{{1,2}})\.? {word} (\d{{4}}),? {time} ?{zone}$", "321456789"),
        ("w", rf"^{day}{word} (\d{{1,2}}),? (\d{{4}}),? {time} ?{zone}$", "312456789"),
        ("o", rf"^(\d{{4}})-(\d{{3}})()[T ]{time} ?{zone}$", "123456789"),
        ("w", rf"^{day}{word} +(\d{{1,2}}) {time} {zone} (\d{{4}})$", "912345678"),
    )
    canon = " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_replace(s, '{p}', '{k}" + "".join(f"|\\{g}" for g in groups) + "')" for k, p, groups in forms)
    known = ", ".join(f"('{z}', '{a}', {o})" for z, a, o in sorted(_abbreviations()))
    names = ", ".join(f"('{k}', {m})" for m, ks in enumerate(_MONTH_NAMES.split(";"), 1) for k in ks.split())
    spans = ((1, 6), (1000, 3), (10**6, 0), (10**9, -3))
    low, high = 1735689600, 1798761600
    unit = " ".join(
        f"WHEN CAST(a AS HUGEINT) >= {low}::HUGEINT * {k} AND CAST(a AS HUGEINT) < {high}::HUGEINT * {k} THEN "
        + (f"CAST(a || rpad(b, {up}, '0')[1:{up}] AS BIGINT)" if up > 0 else f"CAST(a[1:length(a) - {-up}] AS BIGINT)")
        for k, up in spans
    )
    union = " UNION ALL ".join(f"SELECT row_id, client_id, '{c}' AS field_name, {c} AS t FROM transcript_lines WHERE {c} IS NOT NULL" for c in ("line_timestamp", "created_at", "updated_at"))
    return rf"""
WITH known(zone, abbr, secs) AS (VALUES {known}), months(name, nr) AS (VALUES {names}),
v AS ({union}),
t AS (SELECT row_id, client_id, field_name, upper(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^"\s*(.*?)\s*"$', '\1')) AS s FROM v),
e AS (
  SELECT row_id, field_name, CASE {unit} END AS instant_us FROM (
    SELECT *, split_part(s, '.', 1) AS a, split_part(s, '.', 2) AS b FROM t WHERE regexp_matches(s, '^\d{{9,20}}(\.\d*)?$'))),
c AS (SELECT row_id, client_id, field_name, string_split(x, '|') AS p FROM (SELECT *, CASE {canon} END AS x FROM t) WHERE x IS NOT NULL),
d AS (
  SELECT c.*, cl.zone_name, cl.date_order, CAST(p[2] AS INT) AS y,
    CASE p[1] WHEN 'w' THEN m.nr WHEN 'o' THEN 1 WHEN 's' THEN CAST(CASE cl.date_order WHEN 'mdy' THEN p[3] ELSE p[4] END AS INT) ELSE CAST(p[3] AS INT) END AS mo,
    CASE p[1] WHEN 'o' THEN 1 WHEN 's' THEN CAST(CASE cl.date_order WHEN 'mdy' THEN p[4] ELSE p[3] END AS INT) ELSE CAST(p[4] AS INT) END AS dy,
    CASE WHEN p[1] = 'o' THEN CAST(p[3] AS INT) - 1 ELSE 0 END AS more, CAST(p[5] AS INT) AS h, CAST(p[6] AS INT) AS mi,
    coalesce(try_cast(p[7] AS INT), 0) AS sec, CAST(rpad(p[8], 6, '0')[1:6] AS BIGINT) AS micro, p[9] AS ap, p[10] AS z
  FROM c LEFT JOIN clients cl USING (client_id) LEFT JOIN months m ON m.name = p[3]),
w AS (
  SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND sec <= 59 AND (ap = '' OR h BETWEEN 1 AND 12) AND (p[1] <> 'o' OR (more >= 0 AND more < CASE WHEN isodow(make_date(y, 1, 1)) IS NOT NULL
      AND try_cast(y || '-02-29' AS DATE) IS NOT NULL THEN 366 ELSE 365 END))
    THEN epoch(try_cast(printf('%04d-%02d-%02d', y, mo, dy) AS DATE)) + more * 86400 + (CASE ap WHEN '' THEN h WHEN 'PM' THEN h % 12 + 12 ELSE h % 12 END) * 3600 + mi * 60 + sec END AS wall
  FROM d WHERE y > 0),
o AS (
  SELECT w.*, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0
      WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 3600 + coalesce(try_cast(replace(z[4:], ':', '') AS INT), 0) * 60)
      WHEN z <> '' THEN k.secs
      WHEN regexp_matches(zone_name, '^[+-]') THEN (CASE WHEN zone_name[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone_name[2:3] AS INT) * 3600 + CAST(zone_name[5:6] AS INT) * 60)
      WHEN zone_name IS NULL OR zone_name = 'UTC' THEN 0 END AS off,
    make_timestamp(CAST(wall AS BIGINT) * 1000000) AS local
  FROM w LEFT JOIN known k ON k.zone = zone_name AND k.abbr = z WHERE wall IS NOT NULL),
u AS (SELECT *, CASE WHEN off IS NULL AND z = '' THEN local AT TIME ZONE zone_name END AS utc FROM o)
SELECT row_id, field_name, instant_us FROM e WHERE instant_us IS NOT NULL
UNION ALL
SELECT row_id, field_name, CASE WHEN off IS NOT NULL THEN (CAST(wall AS BIGINT) - off) * 1000000 ELSE epoch_us(utc) END + micro
FROM u
WHERE off IS NOT NULL OR (utc IS NOT NULL AND utc AT TIME ZONE zone_name = local
  AND (utc + INTERVAL 1 HOUR) AT TIME ZONE zone_name <> local AND (utc - INTERVAL 1 HOUR) AT TIME ZONE zone_name <> local)"""


def oracle_sql() -> dict[str, str]:
    number = "CASE t WHEN 'OBJECT' THEN coalesce((v ->> '$.count')::DOUBLE, (v ->> '$.short_lived')::DOUBLE + (v ->> '$.long_lived')::DOUBLE) ELSE try_cast(v ->> '$' AS DOUBLE) END"
    one = lambda n: f"CAST(max(CASE WHEN field_name = '{n}' THEN x END) AS BIGINT) AS {n}"
    return {
        "p2_found": f"WITH {_IDS} SELECT row_id FROM ranked WHERE k > 1",
        "p1_found": f"WITH {_split_sql()} SELECT record_id, CAST(pos AS INT) AS pos, tool_name FROM vals WHERE k >= 2",
        "p1_values": f"WITH {_split_sql()} SELECT tool_name, count(*) AS named, count(DISTINCT record_id) AS records FROM vals GROUP BY tool_name",
        "p5_found": _instants_sql(),
        "p2_batches": f"WITH {_IDS} SELECT batch_id, count(*) AS kept, CAST(sum(n) AS BIGINT) AS delivered FROM ranked WHERE k = 1 GROUP BY batch_id",
        "p3_found": f"""
WITH {_values()},
shapes AS (
  SELECT file_id, field_name, string_agg(DISTINCT path, ' ' ORDER BY path) AS place,
         string_agg(DISTINCT CASE t WHEN 'UBIGINT' THEN 'BIGINT' ELSE t END, ' ' ORDER BY CASE t WHEN 'UBIGINT' THEN 'BIGINT' ELSE t END) AS kind
  FROM vals GROUP BY ALL),
names AS (SELECT DISTINCT field_name FROM paths),
grid AS (
  SELECT f.file_id, n.field_name, s.place, s.kind,
         row_number() OVER w AS k, lag(s.place) OVER w AS place0, lag(s.kind) OVER w AS kind0
  FROM log_files f CROSS JOIN names n LEFT JOIN shapes s ON s.file_id = f.file_id AND s.field_name = n.field_name
  WINDOW w AS (PARTITION BY f.stream_id, n.field_name ORDER BY f.opened_at)),
changes AS (
  SELECT file_id, field_name, unnest([
    CASE WHEN place0 IS NULL AND place IS NOT NULL THEN 'added' END, CASE WHEN place0 IS NOT NULL AND place IS NULL THEN 'removed' END,
    CASE WHEN place0 <> place THEN 'renamed' END, CASE WHEN kind0 <> kind THEN 'retyped' END]) AS change_kind
  FROM grid WHERE k > 1)
SELECT * FROM changes WHERE change_kind IS NOT NULL""",
        "p3_table": f"""
WITH {_values()},
typed AS (SELECT raw_id, field_name, {number} AS x FROM vals)
SELECT l.raw_id, l.file_id, {', '.join(one(n) for n in _PLACES)}
FROM lines l LEFT JOIN typed USING (raw_id) GROUP BY l.raw_id, l.file_id""",
    }
