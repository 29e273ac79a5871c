"""Registered queries for problems 1 and 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitloom.operators.sessions import sessionize
from hitloom.operators.spikes import implausible_readings
from hitloom.runtime import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every crystal that is listed in ``crystals``."""
    known = table(spark, sf, "crystals").select("crystal_no")
    hits = table(spark, sf, "interactions").select("crystal_no", "ts", "event_id").join(known, "crystal_no", "left_semi")
    return sessionize(hits).select("crystal_no", "start_ts", "end_ts", "n_events")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings of energy, position and crystal number."""
    return implausible_readings(table(spark, sf, "interactions"), table(spark, sf, "crystals")).select("event_id", "point_idx", "field").distinct()


def p1_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of problem 1 that explicit rules tell, with their reasons: limits, places and stuck runs."""
    cases = implausible_readings(table(spark, sf, "interactions"), table(spark, sf, "crystals"))
    return cases.where("reason <> 'spike'").select("event_id", "point_idx", "field", "reason").distinct()


QUERIES = {"p1_found": p1_found, "p1_rules": p1_rules, "p3_found": p3_found}

SQL = {
    "p1_rules": """
with h as (select distinct event_id, point_idx, case when not isnan(x) then x end as x, case when not isnan(y) then y end as y, case when not isnan(z) then z end as z, case when not isnan(e) then e end as e, ts, crystal_no
           from interactions where event_id is not null and point_idx is not null),
k as (select h.*, coalesce((x-cx)**2 + (y-cy)**2 + (z-cz)**2 > 4.2**2, false) as away from h join crystals using (crystal_no)),
p as (select *, away and exists (select 1 from crystals c where (k.x-c.cx)**2 + (k.y-c.cy)**2 + (k.z-c.cz)**2 <= 4.2**2) as other from k),
e1 as (select *, case when abs(e - lag(e) over w) <= 5e-6 then 0 else 1 end as b from p where ts is not null and e is not null window w as (partition by crystal_no order by ts, event_id, point_idx)),
e2 as (select *, sum(b) over (partition by crystal_no order by ts, event_id, point_idx) as r from e1),
e3 as (select *, count(*) over (partition by crystal_no, r) as n from e2),
x1 as (select *, case when abs(x - lag(x) over w) <= 5e-4 and abs(y - lag(y) over w) <= 5e-4 and abs(z - lag(z) over w) <= 5e-4 then 0 else 1 end as b from p
       where ts is not null and x is not null and y is not null and z is not null window w as (partition by crystal_no order by ts, event_id, point_idx)),
x2 as (select *, sum(b) over (partition by crystal_no order by ts, event_id, point_idx) as r from x1),
x3 as (select *, count(*) over (partition by crystal_no, r) as n from x2)
select distinct event_id, point_idx, field, reason from (
 select event_id, point_idx, 'crystal_no' as field, 'unknown crystal' as reason from h where crystal_no is not null and crystal_no not in (select crystal_no from crystals)
 union all select event_id, point_idx, 'crystal_no', 'inside another crystal' from p where other
 union all select event_id, point_idx, 'x', 'outside all crystals' from p where away and not other
 union all select event_id, point_idx, 'e', 'impossible energy' from p where not other and (e <= 0 or e >= 1000)
 union all select event_id, point_idx, 'e', 'stuck' from e3 where n >= 5 and not other
 union all select event_id, point_idx, 'x', 'stuck' from x3 where n >= 5 and not other)""",
    "p3_found": """
with h as (select distinct crystal_no, ts, event_id from interactions
           where ts is not null and crystal_no in (select crystal_no from crystals)),
g as (select *, case when ts - lag(ts) over w <= 200000 then 0 else 1 end as brk from h
      window w as (partition by crystal_no order by ts)),
s as (select *, sum(brk) over (partition by crystal_no order by ts) as sid from g)
select crystal_no, min(ts) as start_ts, max(ts) as end_ts, count(distinct event_id) as n_events
from s group by crystal_no, sid""",
}
