"""The same results in SQL, for DuckDB over the given tables."""

from __future__ import annotations

from delaylake.functions.messages import MESSAGE_FIELDS

_REC_COLUMNS = """
    case when l_orderkey % 97 = 0 then 'bad' when l_orderkey % 89 = 0 then null
         else cast(cast(l_shipdate as date) as varchar) end as "FL_DATE",
    case when l_suppkey % 13 = 0 then null
         else concat('CARRIER-', lpad(cast(l_suppkey as varchar), 4, '0')) end as "AIRLINE",
    case when l_linenumber = 7 then null
         else concat('O', lpad(cast(l_suppkey % 40 as varchar), 3, '0')) end as "ORIGIN",
    concat('D', cast(l_partkey % 30 as varchar)) as "DEST",
    case when l_linenumber = 6 then '' else cast(l_quantity * 40 as varchar) end as "DISTANCE",
    case when l_returnflag = 'R' then ''
         else cast(l_quantity - 20 as varchar) end as "DEP_DELAY",
    case when l_returnflag = 'R' then ''
         else cast(l_quantity - 22 as varchar) end as "ARR_DELAY",
    case when l_returnflag = 'R' then '1.0' when l_linenumber = 5 then ''
         else '0.0' end as "CANCELLED",
    case when l_returnflag = 'R' then l_linestatus else '' end as "CANCELLATION_REASON"
"""

_REC = f"rec as (select {_REC_COLUMNS} from lineitem)"

_REC_KEYED = f"""
keyed as (
  select l_orderkey % 3 = 0 as early,
    row(l_orderkey, l_partkey, l_suppkey, l_linenumber, {
    ", ".join(f'"{name}"' for name in MESSAGE_FIELDS)
}) as row_text
  from (select *, {_REC_COLUMNS} from lineitem))"""

_TYPED = """
typed as (
  select try_cast("FL_DATE" as date) as flight_date,
         "AIRLINE" as airline, "ORIGIN" as origin, "DEST" as dest,
         try_cast("DISTANCE" as double) as distance,
         try_cast("DEP_DELAY" as double) as dep_delay,
         try_cast("ARR_DELAY" as double) as arr_delay,
         try_cast("CANCELLED" as double) as cancelled,
         "CANCELLATION_REASON" as cancellation_reason
  from rec)"""

_SILVER = """
silver as (
  select flight_date,
         cast(year(flight_date) as integer) as year,
         cast(month(flight_date) as integer) as month,
         cast(dayofweek(flight_date) + 1 as integer) as day_of_week,
         airline, origin, dest, distance, dep_delay, arr_delay,
         case when cancelled = 1.0 then 1 else 0 end as cancelled_flag,
         cancellation_reason,
         case when distance < 300 then 'SHORT' when distance < 800 then 'MEDIUM'
              else 'LONG' end as distance_bucket,
         case when dep_delay is null then 'UNKNOWN' when dep_delay <= 15 then 'ONTIME'
              else 'DELAYED' end as delay_bucket
  from typed)"""

_FACT = """
fact as (
  select flight_date,
         coalesce(substring(origin, 1, 3), 'UNK') as origin,
         coalesce(substring(dest, 1, 3), 'UNK') as dest,
         coalesce(substring(airline, 1, 10), 'UNKNOWN') as airline,
         distance, dep_delay, arr_delay, cancelled_flag, distance_bucket, delay_bucket
  from silver where flight_date is not null)"""

_TO_TYPED = f"with {_REC}, {_TYPED}"
_TO_SILVER = f"{_TO_TYPED}, {_SILVER}"
_TO_FACT = f"{_TO_SILVER}, {_FACT}"

_FIELDS = ", ".join(f'"{name}"' for name in MESSAGE_FIELDS)
_REC_ROWS = f"with {_REC} select {_FIELDS} from rec"
_REC_TEXT = (
    f"with {_REC} select "
    + ", ".join(f"""coalesce("{name}", '') as "{name}" """ for name in MESSAGE_FIELDS)
    + " from rec"
)

_SLICES = """
with placed as (
  select event_id, row_number() over (order by event_id) - 1 as i,
         count(*) over () as total
  from events),
sliced as (
  select event_id,
         cast(least(10, i // greatest(total // 10, 1) + 1) as integer) as slice
  from placed)"""

_SLICE_RANGES = f"""{_SLICES}
select slice, count(*) as n, min(event_id) as first_id, max(event_id) as last_id
from sliced group by slice"""

_SUMMARY = """
    count(*) as flights,
    cast(sum(cancelled_flag) as bigint) as cancelled,
    count(*) filter (delay_bucket = 'DELAYED') as delayed,
    round(avg(dep_delay), 6) as avg_dep_delay,
    round(avg(arr_delay), 6) as avg_arr_delay
"""


def _hash_bits(*keys: str) -> str:
    text = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in keys)
    return f"cast('0x' || substring(md5(concat_ws('|', {text})), 1, 8) as bigint)"


_CONTENT = (
    "flight_date year month day_of_week airline origin dest distance dep_delay arr_delay "
    "cancelled_flag cancellation_reason distance_bucket delay_bucket"
).split()
_TO_SIDES = f"""{_TO_SILVER}, sides as (
  select *, {_hash_bits(*_CONTENT)} < 0.8 * 4294967296 as known from silver)"""
_KNOWN_COUNTS = " union all ".join(
    f"""select {i} as place, '{c}' as "column", {c} as value, count(*) as n
from known where {c} is not null group by {c}"""
    for i, c in enumerate(("origin", "dest", "airline"))
)

_BUCKETS = f"""{_TO_FACT}
select distance_bucket, delay_bucket, count(*) as flights,
       cast(sum(cancelled_flag) as bigint) as cancelled
from fact group by distance_bucket, delay_bucket"""


def _not_a_number(name: str) -> str:
    return f"""("{name}" <> '' and try_cast("{name}" as double) is null)"""


_CHECKS = {
    "messages": "true",
    "empty_message": "empty",
    "unparseable": "unparsed and not empty",
    "missing_date": """coalesce("FL_DATE", '') = '' """,
    "invalid_date": """("FL_DATE" <> '' and try_cast("FL_DATE" as date) is null)""",
    "non_numeric_distance": _not_a_number("DISTANCE"),
    "non_numeric_dep_delay": _not_a_number("DEP_DELAY"),
    "non_numeric_arr_delay": _not_a_number("ARR_DELAY"),
    "non_numeric_cancelled": _not_a_number("CANCELLED"),
    "missing_origin": '"ORIGIN" is null',
    "missing_dest": '"DEST" is null',
    "missing_airline": '"AIRLINE" is null',
    "dropped_by_gold": 'try_cast("FL_DATE" as date) is null',
}

_SENT_FIELDS = ", ".join(
    f"""case when unparsed then null
         {"when spoiled then 'late'" if name == "ARR_DELAY" else ""}
         else "{name}" end as "{name}" """
    for name in MESSAGE_FIELDS
)

_SENT = f"""
with lines as (
  select {_REC_COLUMNS}, l_orderkey % 101 = 0 as spoiled,
         l_partkey % 30 in (7, 9, 11) as unparsed, l_partkey % 30 in (9, 11) as empty,
         l_partkey % 30 = 11 as absent
  from lineitem),
sent as (select unparsed, empty, absent, {_SENT_FIELDS} from lines)"""

_QUALITY = _SENT + " union all ".join(
    f""" select '{name}' as "check", count(*) filter ({test}) as n from sent"""
    for name, test in _CHECKS.items()
)

_STAGES = f"""{_TO_SILVER}, sides as (
  select flight_date,
         {_hash_bits("flight_date", "origin", "dest", "airline")} < 0.8 * 4294967296 as in_training from silver)
select 'silver' as stage, count(*) as n from sides
union all select 'fact', count(flight_date) from sides
union all select 'train', count(*) filter (in_training) from sides
union all select 'test', count(*) filter (not in_training) from sides"""

_FAULTS = [name for name in _CHECKS if name not in ("messages", "dropped_by_gold")]
_QUARANTINE = f"""{_SENT}, faulty as (
  select *, list_filter([{", ".join(f"case when {_CHECKS[n]} then '{n}' end" for n in _FAULTS)}],
    lambda r: r is not null) as reasons from sent),
routed as (
  select *, list_has_any(
    reasons, ['empty_message', 'unparseable', 'missing_date', 'invalid_date']) as held from faulty)
select cast(held as varchar) as quarantined, array_to_string(reasons, ',') as reasons,
  count(*) as n, count(*) filter (held and not absent) as kept_messages,
  count(try_cast("FL_DATE" as date)) as dated,
  sum(case when try_cast("CANCELLED" as double) = 1.0 then 1 else 0 end)::bigint as cancelled
from routed group by held, reasons"""

_CATEGORY_INDEX = " union all ".join(
    f"""
select '{c}' as "column", {c} as value,
       cast(row_number() over (order by count(*) desc, {c}) - 1 as integer) as idx
from silver where {c} is not null group by {c}
union all
select distinct '{c}', cast(null as varchar),
       cast((select count(distinct {c}) from silver) as integer)
from silver where {c} is null"""
    for c in ("origin", "dest", "airline")
)

_NUMERIC = ("distance", "dep_delay", "arr_delay", "day_of_week", "month")
_FILLED = ", ".join(f"coalesce({c}, 0) as {c}" for c in _NUMERIC)
_ASSEMBLED = ", ".join(
    f"round(coalesce(cast({c} as double), 0), 6) as {c}" for c in _NUMERIC
)
_SCALED = ", ".join(
    f"round({c} / (select stddev_samp({c}) from filled), 6) as {c}" for c in _NUMERIC
)

_GUESSED = """
guessed as (
  select case when l_returnflag = 'R' then 1 else 0 end as label,
         l_quantity / 50 as score,
         case when l_quantity / 50 > 0.7 then 1 else 0 end as prediction
  from lineitem)"""



def _newton_steps(steps: int, regularization: float) -> str:
    """Newton's method for an intercept and two features; each step solves three equations."""
    parts = ["c0 as (select 0::double as x, 0::double as y, 0::double as z)"]
    for i in range(steps):
        parts.append(f"""
s{i} as (
  select x, y, z, sum(w) as t,
    sum(w * (label - p)) as g0, sum(w * (label - p) * a) as g1, sum(w * (label - p) * b) as g2,
    sum(w * p * (1 - p)) as h00, sum(w * p * (1 - p) * a) as h01, sum(w * p * (1 - p) * b) as h02,
    sum(w * p * (1 - p) * a * a) as h11, sum(w * p * (1 - p) * a * b) as h12,
    sum(w * p * (1 - p) * b * b) as h22
  from (select *, 1 / (1 + exp(-(x + y * a + z * b))) as p from grouped, c{i}) group by x, y, z),
e{i} as (
  select x, y, z, h00 / t as h00, h01 / t as h01, h02 / t as h02,
    h11 / t + {regularization}::double as h11, h12 / t as h12,
    h22 / t + {regularization}::double as h22, g0 / t as g0,
    g1 / t - {regularization}::double * y as g1, g2 / t - {regularization}::double * z as g2
  from s{i}),
d{i} as (
  select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
    + h02 * (h01 * h12 - h11 * h02) as det from e{i}),
c{i + 1} as (
  select
    x + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2)
      + h02 * (g1 * h12 - h11 * g2)) / det as x,
    y + (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02)
      + h02 * (h01 * g2 - g1 * h02)) / det as y,
    z + (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02)
      + g0 * (h01 * h12 - h11 * h02)) / det as z
  from d{i})""")
    return ",".join(parts)


_NEWTON = f"""
{_TO_SILVER},
numbers as (
  select cancelled_flag as label, coalesce(distance, 0)::double as distance,
    coalesce(day_of_week, 0) as day_of_week from silver),
spread as (
  select stddev_samp(distance) as da, stddev_samp(day_of_week) as db,
    count(*) filter (where label = 0) / count(*) filter (where label = 1) as ratio from numbers),
grouped as (
  select label, distance / da as a, day_of_week / db as b,
    sum(case when label = 1 then ratio else 1 end) as w
  from numbers, spread group by label, distance, day_of_week, da, db),
{_newton_steps(8, 0.01)}"""

_SCORES = f"""{_NEWTON}
select distance, day_of_week, count(*) as n, sum(label)::bigint as cancelled,
  round(1 / (1 + exp(-(any_value(x) + any_value(y) * distance / any_value(da)
    + any_value(z) * day_of_week / any_value(db)))), 6) as probability
from numbers, c8, spread group by distance, day_of_week"""

_KEPT = ", ".join(
    f"""coalesce("{name}", '') as "{name}\"""" for name in MESSAGE_FIELDS if name != "CANCELLATION_REASON"
)
_BROKEN = f"""
with rec as (select l_linenumber, {_REC_COLUMNS} from lineitem)
select {_KEPT},
  case l_linenumber
    when 1 then 'first' || chr(10) || 'second, "third"'
    when 2 then chr(10) || chr(10) || repeat('long, "' || chr(10), 20)
    when 3 then '""' else coalesce("CANCELLATION_REASON", '') end as "CANCELLATION_REASON"
from rec"""

ORACLE_SQL = {
    "csv_scan": _REC_TEXT,
    "csv_split_scan": _BROKEN,
    "source_row_count": "select count(*) as n from lineitem",
    "batch_slices": _SLICE_RANGES,
    "file_slices": _SLICE_RANGES,
    "batch_progress": f"""{_SLICES}
select slice, count(*) as n,
       cast(sum(count(*)) over (order by slice) as bigint) as running_total
from sliced group by slice""",
    "json_envelope": f"""select *,
  'AIRLINE,ARR_DELAY,CANCELLATION_REASON,CANCELLED,DEP_DELAY,DEST,DISTANCE,FL_DATE,ORIGIN' as keys
from ({_REC_ROWS})""",
    "bronze_stream": _REC_ROWS,
    "bronze_replay": _SLICE_RANGES,
    "bronze_exactly_once": _SLICE_RANGES,
    "json_parse": _REC_ROWS,
    "event_json_parse": "select event_id, cast(props->>'k' as integer) as k from events",
    "date_parts": f"{_TO_SILVER} select flight_date, year, month, day_of_week from silver",
    "canonical_columns": f"{_TO_TYPED} select airline, origin, dest, cancellation_reason from typed",
    "numeric_casts": f"{_TO_TYPED} select distance, dep_delay, arr_delay, cancelled from typed",
    "cancelled_flag": f"""with {_REC} select "CANCELLED",
    case when try_cast("CANCELLED" as double) = 1.0 then 1 else 0 end as cancelled_flag from rec""",
    "distance_bucket": f"{_TO_SILVER} select distance, distance_bucket from silver",
    "delay_bucket": f"{_TO_SILVER} select dep_delay, delay_bucket from silver",
    "fill_defaults": f"{_TO_SILVER} select cancelled_flag from silver",
    "silver_table": f"{_TO_SILVER} select * from silver",
    "silver_incremental": f"{_TO_SILVER} select * from silver",
    "silver_by_month": f"""{_TO_SILVER}
select year, month, count(*) as n, cast(sum(cancelled_flag) as bigint) as cancelled
from silver group by year, month""",
    "code_standardize": f"""{_TO_SILVER}
select coalesce(substring(origin, 1, 3), 'UNK') as origin,
       coalesce(substring(dest, 1, 3), 'UNK') as dest,
       coalesce(substring(airline, 1, 10), 'UNKNOWN') as airline
from silver""",
    "gold_fact": f"{_TO_FACT} select * from fact",
    "fact_preview": f"""{_TO_FACT} select * from fact
order by flight_date nulls last, origin nulls last, dest nulls last, airline nulls last,
         distance nulls last, dep_delay nulls last, arr_delay nulls last,
         cancelled_flag nulls last, distance_bucket nulls last, delay_bucket nulls last
limit 5""",
    "stage_counts": _STAGES,
    "observed_counts": _STAGES,
    "quality_report": _QUALITY,
    "quarantine": _QUARANTINE,
    "label_prep": f"{_TO_SILVER} select cancelled_flag, cancelled_flag as label from silver",
    "numeric_fill": f"{_TO_SILVER} select {_FILLED} from silver",
    "class_counts": f"""{_TO_SILVER}
select cancelled_flag as label, count(*) as n from silver group by cancelled_flag""",
    "class_weight": f"""{_TO_SILVER}, classes as (
  select cancelled_flag as label, count(*) as n from silver group by cancelled_flag)
select label, n,
       case when label = 1 then round((select n from classes where label = 0) / n, 9)
            else 1.0::double end as class_weight
from classes""",
    "hash_split": f"""
select case when {_hash_bits("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")} < 0.8 * 4294967296
            then 'train' else 'test' end as split, count(*) as n
from lineitem group by 1""",
    "string_index": f"{_TO_SILVER} {_CATEGORY_INDEX}",
    "one_hot": f"""{_TO_SILVER}, indexed as ({_CATEGORY_INDEX})
select "column", value, idx, case when value is null then -1 else idx end as hot from indexed""",
    "assemble_features": f"{_TO_SILVER} select {_ASSEMBLED} from silver",
    "scale_features": f"""{_TO_SILVER}, filled as (select {_FILLED} from silver)
select {_SCALED} from filled""",
    "logistic_newton": f"""{_NEWTON}
select 'intercept' as feature, round(x, 6) as coefficient, null::double as deviation from c8
union all select 'distance', round(y, 6), round(da, 6) from c8, spread
union all select 'day_of_week', round(z, 6), round(db, 6) from c8, spread""",
    "logistic_scores": _SCORES,
    "score_stream": _SCORES,
    "metric_auc": f"""with {_GUESSED}, per_score as (
  select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg
  from guessed group by score),
ranked as (
  select pos, neg, coalesce(sum(neg) over (order by score
         rows between unbounded preceding and 1 preceding), 0) as below from per_score)
select round(cast(sum(pos * (2 * below + neg)) as double)
             / (2.0::double * sum(pos) * sum(neg)), 9) as auc from ranked""",
    "metric_confusion": f"""with {_GUESSED}
select label, prediction, count(*) as n from guessed group by label, prediction""",
    "metric_weighted": f"""with {_GUESSED}, counts as (
  select l.label, (select count(*) from guessed g where g.label = l.label) as actual,
         (select count(*) from guessed g where g.prediction = l.label) as said,
         (select count(*) from guessed g
           where g.label = l.label and g.prediction = l.label) as hits
  from (select distinct label from guessed) l),
rates as (
  select actual, case when said = 0 then 0 else hits / said end as p, hits / actual as r
  from counts)
select round(sum(actual * case when p + r = 0 then 0 else 2 * p * r / (p + r) end)
             / sum(actual), 9) as f1,
       round(sum(actual * p) / sum(actual), 9) as weighted_precision,
       round(sum(actual * r) / sum(actual), 9) as weighted_recall
from rates""",
    "mart_airline": f"{_TO_FACT} select airline, {_SUMMARY} from fact group by airline",
    "mart_route": f"{_TO_FACT} select origin, dest, {_SUMMARY} from fact group by origin, dest",
    "mart_route_laid_out": (
        f"{_TO_FACT} select origin, dest, {_SUMMARY} from fact group by origin, dest"
    ),
    "mart_airline_merged": f"{_TO_FACT} select airline, {_SUMMARY} from fact group by airline",
    "mart_route_merged": (
        f"{_TO_FACT} select origin, dest, {_SUMMARY} from fact group by origin, dest"
    ),
    "mart_calendar": f"""{_TO_FACT}
select cast(year(flight_date) as integer) as year, cast(month(flight_date) as integer) as month,
       cast(dayofweek(flight_date) + 1 as integer) as day_of_week, {_SUMMARY}
from fact group by 1, 2, 3""",
    "bucket_summary": _BUCKETS,
    "end_to_end": _BUCKETS,
    "reingest": f"""with {_REC_KEYED},
runs as (select unnest([1, 2, 3]) as run)
select run, count(*) as n, count(distinct row_text) as n_distinct
from runs, keyed where run = 3 or early group by run""",
    "random_split": """select count(*) as total, 0::bigint as on_both, true as share_is_near
from lineitem""",
    "train_model": f"""{_TO_SIDES}, known as (select * from sides where known),
counts as ({_KNOWN_COUNTS}),
ranked as (
  select *, row_number() over (partition by place order by n desc, value) as idx from counts),
hot as (
  select place, "column" || '=' || value as feature, n,
    cast(row_number() over (order by place, idx) - 1 as integer) as position
  from ranked)
select feature, position, n from hot
union all
select name, cast((select count(*) from hot) + i as integer), (select count(*) from known)
from (select unnest(['distance', 'dep_delay', 'arr_delay', 'day_of_week', 'month']) as name,
             unnest([0, 1, 2, 3, 4]) as i)""",
    "score": f"""{_TO_SIDES}
select cancelled_flag as label, count(*) as n, 0::bigint as other_class, 0::bigint as other_margin
from sides where not known group by cancelled_flag""",
    "model_metrics": f"""{_TO_SIDES}
select count(*) filter (cancelled_flag = 0) as support_0,
       count(*) filter (cancelled_flag = 1) as support_1,
       true as recall_is_accuracy, true as all_in_range
from sides where not known""",
}
