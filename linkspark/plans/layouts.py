"""Queries of files whose layout is data: files of five layouts, written as text from the
call records and read in one plan, and the headers of many files; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import layouts as L
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = DUCK + ", " + sql


_DAY, _CLOCK = "date_format(event_at, 'dd/MM/yyyy')", "date_format(event_at, 'HH:mm:ss')"
_OTHER, _KIND = "concat('0', b_party)", "if(call_type = 'OUTGOING', 'out', 'in')"
#: Lines before the header, the header, and a line of each record, as SQL.
_FORMS = (
    (
        ("Report of a number", ""),
        "Target A Party Number,B Party Number,Call Date,Call Initiation Time CIT,Dur(s),Call Type,First CGI Lat/Long,First Cell ID",
        f"concat_ws(',', concat(\"'91\", msisdn, \"'\"), concat('=\"', {_OTHER}, '\"'), {_DAY}, {_CLOCK}, duration_sec, {_KIND}, '12.9/77.5', event_id)",
    ),
    ((), "Mobile No,Other Party No,Date of Call,CIT,Duration,Call_Type,LAT,LNG,CGI", f"concat_ws(',', msisdn, {_OTHER}, {_DAY}, {_CLOCK}, duration_sec, {_KIND}, '12.9', '77.5', event_id)"),
    (
        ("x", "Case no 7", ""),
        '"Calling Party Telephone Number","Called Party Telephone Number",DATE,TIME,"Call Duration","Call Type","Lat Long","First Cell Global Id"',
        f"concat_ws(',', concat(msisdn, '.0'), {_OTHER}, {_DAY}, {_CLOCK}, duration_sec, call_type, '\"12.9,77.5\"', event_id)",
    ),
    # weak words for date and time, columns in another order, blank lines, and lines that are too long
    ((), "Call Type,TIME,DATE,msisdn b,MSISDN A,Odd", f"concat(concat_ws(',', {_KIND}, {_CLOCK}, {_DAY}, {_OTHER}, msisdn), if(id % 7 = 0, ',y,z', ''), '\\n')"),
    # no line has two of the words: the first one is the header
    ((), "Msisdn-A,cgi,dur", "concat_ws(',', msisdn, event_id, duration_sec)"),
)


def _files(ev) -> DataFrame:
    """``path, value``: a file for each layout and 500 numbers of events."""
    cdr = ev.tel.where("event_type = 'CDR'").withColumn("id", F.substring_index("event_id", "_", -1).cast("long")).withColumn("n", (F.col("id") % len(_FORMS)).cast("int"))
    by = lambda values: F.element_at(F.array(*values), F.col("n") + 1)
    rows = cdr.select("n", F.floor(F.col("id") / 500).alias("part"), F.struct("id", by([F.expr(line) for _, _, line in _FORMS]).alias("line")).alias("r"))
    body = rows.groupBy("n", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("body"))
    head = by([F.lit("\n".join([*lead, head])) for lead, head, _ in _FORMS])
    return body.select(F.format_string("op%d/%d.csv", "n", "part").alias("path"), F.concat_ws("\n", head, "body").alias("value"))


query(
    "mixed_layouts",
    lambda ev: S.mixed_cdr(_files(ev)).select("path", "line_no", "A_PARTY", "B_PARTY", "CALL_DATE", "CALL_TIME", "DURATION", "CALL_TYPE", "FIRST_CELL_ID", "LATITUDE", "LONGITUDE"),
    """c AS (SELECT *, split_part(event_id, '_', 2)::BIGINT AS id FROM tel WHERE event_type = 'CDR'),
 f AS (SELECT *, id % 5 AS n, 'op' || (id % 5) || '/' || (id // 500) || '.csv' AS path FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS nth FROM f)
 SELECT path, (CASE n WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 0 END + CASE n WHEN 3 THEN 2 * nth - 1 ELSE nth END)::INT AS line_no, msisdn AS "A_PARTY",
  CASE WHEN n = 4 THEN NULL WHEN length(b_party) = 10 THEN b_party WHEN b_party = '-' THEN '0-' ELSE '0' || b_party END AS "B_PARTY",
  CASE WHEN n < 4 THEN strftime(event_at, '%d/%m/%Y') END AS "CALL_DATE", CASE WHEN n < 4 THEN strftime(event_at, '%H:%M:%S') END AS "CALL_TIME",
  CASE WHEN n <> 3 THEN duration_sec::VARCHAR END AS "DURATION", CASE WHEN n < 4 THEN call_type END AS "CALL_TYPE", CASE WHEN n <> 3 THEN event_id END AS "FIRST_CELL_ID",
  CASE WHEN n < 3 THEN '12.9' END AS "LATITUDE", CASE WHEN n < 3 THEN '77.5' END AS "LONGITUDE" FROM r WHERE n <> 3 OR id % 7 <> 0""",
)

#: Header cells of many kinds: equal to an alias, around one, within one, of its words in
#: another order, weak ones, near-ties and blanks.
_CELLS = (
    "Call Date", "DATE", "Dates", "Time", "call_time", "Start Time", "CIT", "Calling Party", "Called Party", "A Party", "A-Party No.", "B Party No", "MSISDN", "msisdn a", "Mobile No",
    "IMEI", "IMEI A", "imsi", "Duration", "Dur", "First CGI", "First CGI Lat/Long", "Lat Long", "Latitude", "Roaming", "service of type", "Call_Type", "party calling", "", "Remark", "call",
)
_WIDTH = 8


def _headers(ev) -> DataFrame:
    """The matched columns of a file of eight cells for each entity."""
    cells = F.array(*map(F.lit, _CELLS))
    at = lambda j: F.get(cells, ((F.col("u") * (2 * j + 1) + F.lit(j * j)) % len(_CELLS)).cast("int"))
    found = ev.ent.select("u", L.placed(F.array(*[at(j) for j in range(_WIDTH)]), S.CDR_ALIASES, S.CDR_WEAK).alias("places"))
    # the names are exploded, not the places, which would be worked out again for a filter that Spark infers
    named = found.select("u", "places", F.posexplode(F.array(*map(F.lit, S.CDR_ALIASES))).alias("at", "field"))
    return named.select("u", "field", F.get("places", F.col("at")).alias("place")).where("place >= 0")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


def _headers_sql() -> str:
    """Rounds over the ranked pairs of a file, one pair a round."""
    names = [*S.CDR_ALIASES]
    aliases = _values((k, a) for k, n in enumerate(names) for a in S.CDR_ALIASES[n])
    weak = [(names.index(n), words) for n, words in S.CDR_WEAK.items()]
    score = """CASE WHEN h = '' THEN 0 WHEN h = a THEN 100 WHEN contains(h, a) THEN 70 + (40 * length(a)) // length(h) WHEN contains(a, h) THEN 50
   WHEN len(list_intersect(string_split(h, ' '), string_split(a, ' '))) / len(list_distinct(string_split(a, ' '))) >= 0.75
   THEN floor(40 + 30 * len(list_intersect(string_split(h, ' '), string_split(a, ' '))) / len(list_distinct(string_split(a, ' ')))) ELSE 0 END"""
    steps, last = [], "done"
    for i, (field, words) in enumerate(weak):
        steps.append(
            f"""w{i} AS (SELECT d.u, CASE WHEN best.pos IS NULL THEN fs ELSE list_append(fs, {field}) END AS fs, CASE WHEN best.pos IS NULL THEN ps ELSE list_append(ps, best.pos) END AS ps FROM {last} AS d LEFT JOIN
   (SELECT u, arg_min(pos, -1000 * s + pos) AS pos FROM (SELECT h.u, h.pos, max({score}) AS s FROM heads AS h JOIN {last} AS b ON b.u = h.u, (VALUES {_values((w,) for w in words)}) AS t(a)
    WHERE NOT list_contains(b.fs, {field}) AND NOT list_contains(b.ps, h.pos) GROUP BY 1, 2) WHERE s >= 100 GROUP BY u) AS best ON best.u = d.u)"""
        )
        last = f"w{i}"
    return f"""heads AS (SELECT u, j AS pos, trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) AS h FROM (SELECT u, j, (u * (2 * j + 1) + j * j) % {len(_CELLS)} AS k FROM ent, range({_WIDTH}) AS t(j))
   JOIN (VALUES {_values(enumerate(_CELLS))}) AS t(k, c) USING (k)),
 pairs AS (SELECT u, pos, f, max({score}) AS s FROM heads, (VALUES {aliases}) AS t(f, a) GROUP BY 1, 2, 3),
 ranked AS MATERIALIZED (SELECT u, pos, f, row_number() OVER (PARTITION BY u ORDER BY s DESC, pos, f) AS r FROM pairs WHERE s >= 50),
 rounds(u, r, fs, ps) AS (SELECT u, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM ent UNION ALL
   SELECT p.u, p.r + 1, CASE WHEN list_contains(fs, f) OR list_contains(ps, pos) THEN fs ELSE list_append(fs, f) END, CASE WHEN list_contains(fs, f) OR list_contains(ps, pos) THEN ps ELSE list_append(ps, pos) END
   FROM rounds AS p JOIN ranked AS c ON c.u = p.u AND c.r = p.r + 1),
 done AS (SELECT u, arg_max(fs, r) AS fs, arg_max(ps, r) AS ps FROM rounds GROUP BY u), {", ".join(steps)}
 SELECT u, t.field, ps[i]::INT AS place FROM (SELECT u, unnest(fs) AS f, ps, generate_subscripts(fs, 1) AS i FROM {last}) JOIN (VALUES {_values(enumerate(names))}) AS t(f, field) USING (f)"""


QUERIES["header_assignment"] = lambda spark, sf_dir: _headers(evidence(spark, sf_dir))
ORACLE_SQL["header_assignment"] = DUCK.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _headers_sql()
