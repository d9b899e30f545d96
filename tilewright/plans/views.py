"""Views that give the driver tables the shape of building, element and camera sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLD = """
with b as (
 select cast(o_orderkey as bigint) k, o_orderdate ts,
        cast(floor(o_orderkey/4.0) as bigint) c, cast(o_orderkey%4 as bigint) j from orders),
p as (
 select k, ts, c, j,
   (c%1000)*100 + case when j=3 then 12 else 10+j*18+(c%3) end x,
   cast(floor(c/1000.0) as bigint)*100 + 10 + (c%4) y,
   case when j=3 then 8 else 16+2*(c%3) end w,
   case when j=3 then 6 else 14+(c%5) end h from b)
select 'osm' name, k id, cast(null as bigint) grp, ts, cast(x as bigint) xmin, cast(y as bigint) ymin,
  cast(x+w as bigint) xmax, cast(y+h as bigint) ymax,
  case when k%11=0 then null else cast(3+k%40 as double) end height_m,
  case when k%7=0 then null else cast(1+k%12 as double) end floors from p
union all
select 'msbf', k, cast(null as bigint), ts, cast(x+(k%3)-1 as bigint), cast(y+(k%2)+case when k%17=0 then 50 else 0 end as bigint),
  cast(x+w+(k%3)-1 as bigint), cast(y+h+(k%2)+case when k%17=0 then 50 else 0 end as bigint),
  cast(null as double), cast(null as double) from p where k%5<>0
union all
select 'ocm', k*2, k, ts, cast(x as bigint), cast(y as bigint), cast(x+cast(floor(w/2.0) as bigint) as bigint), cast(y+h as bigint),
  cast(3+(k*3)%41 as double), cast(null as double) from p where k%3<>0
union all
select 'ocm', k*2+1, k, ts, cast(x+cast(floor(w/2.0) as bigint) as bigint), cast(y as bigint), cast(x+w as bigint), cast(y+h as bigint),
  case when k%13=0 then null else cast(5+(k*3)%41 as double) end, cast(null as double) from p where k%3<>0
"""

ELEM = """
select cast(p_partkey as bigint) id, case when p_partkey%4=0 then 'r' else 'w' end ty,
 case p_size%6 when 0 then null when 1 then 'roof' when 2 then 'no' else 'yes' end building,
 case when p_size%5=0 then 'yes' end building_part,
 case when p_size%10=3 then 'yes' end bridge,
 case p_size%8 when 1 then 'underground' when 2 then 'rooftop' end location,
 case when p_size%9=0 then '3;4;5' when p_size%9=1 then '7;x' when p_size%9=2 then ''
      when p_size%9=3 then null else cast(p_size as {string}) end levels,
 case when p_size%9=0 then '10.5;12' when p_size%9=4 then 'tall' else cast(p_size*2 as {string}) end height,
 case when p_size%7=0 then null else cast(p_partkey as {string}) end housenumber,
 case when p_size%3=0 then null else p_brand end street,
 case p_size%4 when 0 then '0' when 1 then 'n/a' when 2 then '19800'
      else cast(1900+p_size as {string}) end year_built
from part
"""

CAM = """
select cast(event_id as bigint) poid, cast((user_id*7919)%100000 as bigint) x,
 cast((user_id*104729)%4000 as bigint) y, cast((event_id*37)%360 as double) heading from events
"""

POINTS = """
select cast(l_partkey%512 as bigint) x, cast(l_suppkey%512 as bigint) y, cast(l_quantity as double) hag from lineitem
"""

VIEWS = {"bld": (BLD, "orders"), "elem": (ELEM, "part"), "cam": (CAM, "events"), "points": (POINTS, "lineitem")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = VIEWS[name]
    frame = table(spark, sf_dir, source)
    return spark.sql(text.format(string="string").replace(f"from {source}", "from {source}"), source=frame)


def with_views(sql: str, *names: str, **more: str) -> str:
    """DuckDB SQL with the views (and further named queries) in front."""
    parts = [f"{n} as ({VIEWS[n][0].format(string='varchar')})" for n in names] + [f"{n} as ({q})" for n, q in more.items()]
    return f"with recursive {', '.join(parts)} {sql}" if parts else sql
