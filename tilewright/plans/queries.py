"""Registered queries of the conflation engine, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geo, olc, slippy, text
from tilewright.functions.boxes import Box
from tilewright.operators import aggregate, compare, components, footprint, raster, select, street, tiles

from tilewright.sources.scratch import stage

from .views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, **more: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views, **more)
        return f

    return register


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building rows with the identity that halves and copies share."""
    return view(spark, sf_dir, "bld").withColumn("ubid", F.coalesce("grp", "id"))


def compared(spark: SparkSession, sf_dir: str) -> compare.Compare:
    return compare.Compare(keyed(spark, sf_dir))


DATA = "select coalesce(grp, id) as ubid, * from bld"
AGG = """
select name, ubid, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax,
  case when count(coalesce(height_m, floors*cast(3.6 as double)))=count(*) then max(coalesce(height_m, floors*cast(3.6 as double))) end height_m,
  case when count(floors)=count(*) then max(floors) end floors, count(*) n
from data group by name, ubid"""
PAIRS = """
select a.ubid, a.xmin axmin, a.ymin aymin, a.xmax axmax, a.ymax aymax, a.height_m ah, b.xmin bxmin, b.ymin bymin, b.xmax bxmax, b.ymax bymax, b.height_m bh,
  cast(greatest(least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin),0)*greatest(least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin),0) as bigint) cut,
  cast((a.xmax-a.xmin)*(a.ymax-a.ymin) as bigint) aa, cast((b.xmax-b.xmin)*(b.ymax-b.ymin) as bigint) ba
from agg a join agg b on a.ubid=b.ubid where a.name='osm' and b.name='{}'"""


def agg_query(sql: str):
    return query(sql, "bld", data=DATA, agg=AGG)


def pair_query(sql: str, other: str):
    return query(sql, "bld", data=DATA, agg=AGG, pairs=PAIRS.format(other))


# scans, projections, parsing


@query("select cast(o_orderkey as bigint) id, cast(o_totalprice as double) value, cast(o_orderdate as date) placed, 'orders' as name from orders")
def scan_project_cast(spark, sf_dir):
    from tilewright.operators.registry import Declared, Source

    class Orders(Source):
        name = "orders"
        id = Declared(lambda: F.col("o_orderkey"), "bigint")
        value = Declared(lambda: F.col("o_totalprice"), "double", depends=("id",))
        placed = Declared(lambda: F.col("o_orderdate"), "date")

    return Orders.standardize(table(spark, sf_dir, "orders"))


@query("select name, id, grp, xmin, ymin, xmax, ymax, height_m, floors from bld", "bld")
def union_sources(spark, sf_dir):
    return view(spark, sf_dir, "bld").select("name", "id", "grp", "xmin", "ymin", "xmax", "ymax", "height_m", "floors")


@query("select name, id from bld where xmin<=20000 and xmax>=5000 and ymin<=40 and ymax>=0", "bld")
def bbox_filter(spark, sf_dir):
    return view(spark, sf_dir, "bld").filter(Box.of().intersects(Box.literal(5000, 0, 20000, 40))).select("name", "id")


@query("""select r.r_name region, n.n_name nation from region r join nation n on r.r_regionkey=n.n_regionkey
where n.n_nationkey*10<=115 and n.n_nationkey*10+8>=42 and r.r_regionkey*50<=115 and r.r_regionkey*50+49>=42""")
def manifest_prune(spark, sf_dir):
    """Extracts within extracts: only children whose box and whose parent's box meet the request."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region")).filter("r_regionkey*50<=115 and r_regionkey*50+49>=42")
    nations = table(spark, sf_dir, "nation").filter("n_nationkey*10<=115 and n_nationkey*10+8>=42")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("region", F.col("n_name").alias("nation"))


@query("select name, id, height_m from bld where height_m is not null and xmax>xmin", "bld")
def drop_missing_geometry(spark, sf_dir):
    return view(spark, sf_dir, "bld").filter("height_m is not null and xmax > xmin").select("name", "id", "height_m")


TAGGED = """ty='w' and ((building is not null and bridge is null) or building_part is not null) and coalesce(location,'')<>'underground'
 or ty='r' and (building is not null or building_part is not null) and coalesce(location,'')<>'underground'"""


@query(f"select id, ty from elem where {TAGGED}", "elem")
def tag_predicates(spark, sf_dir):
    way, relation, above = F.col("ty") == "w", F.col("ty") == "r", F.coalesce("location", F.lit("")) != "underground"
    building, part = F.col("building").isNotNull(), F.col("building_part").isNotNull()
    return view(spark, sf_dir, "elem").filter((way & (building & F.col("bridge").isNull() | part) | relation & (building | part)) & above).select("id", "ty")


@query("select id, coalesce(building,'no') not in ('roof','no','bridge') and (ty='w' or id%100>=40) as container from elem", "elem")
def container_mask(spark, sf_dir):
    big = (F.col("ty") == "w") | (F.col("id") % 100 >= 40)  # the id's last digits stand for square metres
    return view(spark, sf_dir, "elem").select("id", (~F.coalesce("building", F.lit("no")).isin("roof", "no", "bridge") & big).alias("container"))


@query("select id, case when coalesce(housenumber,'')<>'' and coalesce(street,'')<>'' then housenumber||' '||street end as address from elem", "elem")
def address_compose(spark, sf_dir):
    return view(spark, sf_dir, "elem").select("id", text.osm_address(F.col("housenumber"), F.col("street")).alias("address"))


@query("select id, nullif(try_cast(levels as double),0) as floors from elem", "elem")
def stories_parse(spark, sf_dir):
    return view(spark, sf_dir, "elem").select("id", text.storeys(F.col("levels")).alias("floors"))


@query("select id, case when try_cast(year_built as int) between 1 and 9999 then make_date(try_cast(year_built as int),1,1) end as built from elem", "elem")
def year_to_date(spark, sf_dir):
    return view(spark, sf_dir, "elem").select("id", text.year_date(F.col("year_built")).alias("built"))


DATES = "select id, case id%4 when 0 then '19'||lpad(cast(id%90+10 as {0}),2,'0')||'-0'||cast(id%9+1 as {0})||'-15' when 1 then cast(1900+id%100 as {0}) when 2 then 'unknown' end as s from {1}"


@query("select id, coalesce(cast(try_strptime(s,'%Y-%m-%d') as date), cast(try_strptime(s,'%Y') as date)) as start_date from d", "elem", d=DATES.format("varchar", "elem"))
def lenient_date(spark, sf_dir):
    rows = spark.sql(DATES.format("string", "{elem}"), elem=view(spark, sf_dir, "elem"))
    return rows.select("id", text.lenient_date(F.col("s")).cast("date").alias("start_date"))


def enumerated(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each value of the longest of the semicolon lists; a single value repeats, a shorter list
    ends in nulls.  A list with anything in it that is no number is null and gives no rows of its own."""
    lists = rows.select("id", *[text.listed(F.col(c)).alias(c) for c in columns])
    most = F.greatest(*[F.coalesce(F.size(c), F.lit(1)) for c in columns], F.lit(1))
    spread = lists.select("id", *columns, F.explode(F.sequence(F.lit(0), most - 1)).alias("pos"))
    value = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.get(c, F.col("pos")))
    return spread.select("id", F.col("pos").cast("long").alias("pos"), *[value(c).alias(c) for c in columns])


LISTS = "select id, list_transform(string_split(levels,';'), lambda x: try_cast(trim(x) as double)) l, list_transform(string_split(height,';'), lambda x: try_cast(trim(x) as double)) h from elem"
SIZED = "select id, case when len(l)=len(list_filter(l, lambda x: x is not null)) then l end l, case when len(h)=len(list_filter(h, lambda x: x is not null)) then h end h from lists"


@query(
    """select id, cast(pos as bigint) pos, case when len(l)=1 then l[1] else l[pos+1] end levels, case when len(h)=1 then h[1] else h[pos+1] end height
from (select *, unnest(range(greatest(coalesce(len(l),1),coalesce(len(h),1)))) pos from sized)""",
    "elem", lists=LISTS, sized=SIZED,
)
def enumerative_explode(spark, sf_dir):
    return enumerated(view(spark, sf_dir, "elem"), "levels", "height")


@query("select name, id, cast(row_number() over (order by name, id)-1 as bigint) iloc from bld", "bld")
def iloc_row_number(spark, sf_dir):
    rows = view(spark, sf_dir, "bld").select("name", "id")
    return compare.ordinals(rows, "name", "id").select("name", "id", F.col("ordinal").alias("iloc"))


# codes, tiles, projections

CENTRES = "select name, id, cast(-88 as double)+((xmin+xmax)/cast(2 as double))/cast(100000 as double) lon, cast(41 as double)+((ymin+ymax)/cast(2 as double))/cast(100000 as double) lat from bld"
UNITS = "select name, id, cast(floor((lon+180)*8192000) as bigint) lx, cast(floor((lat+90)*25000000) as bigint) ly from centres"


def centres(spark, sf_dir) -> DataFrame:
    b = Box.of()
    return view(spark, sf_dir, "bld").select("name", "id", tiles.lon_of(b.cx).alias("lon"), tiles.lat_of(b.cy).alias("lat"))


def code_sql(lx: str, ly: str, length: int) -> str:
    """The code of units as a DuckDB expression."""
    d = lambda e: f"substr('{olc.ALPHABET}', cast({e} as integer)+1, 1)"
    digits = [d(x) for k in range(4, -1, -1) for x in (f"(({ly})//{3125 * 20**k})%20", f"(({lx})//{1024 * 20**k})%20")]
    digits += [d(f"(({ly})//{5**k})%5*4+(({lx})//{4**k})%4") for k in range(4, -1, -1)]
    return "||".join([*digits[:8], "'+'", *digits[8:length]])


@query(f"select name, id, {code_sql('lx', 'ly', 11)} code from units", "bld", centres=CENTRES, units=UNITS)
def olc_encode(spark, sf_dir):
    return centres(spark, sf_dir).select("name", "id", olc.encode(F.col("lon"), F.col("lat"), 11).alias("code"))


@query(
    """select name, id, round((lx//256*256)/cast(8192000 as double)-180,9) west, round((ly//625*625)/cast(25000000 as double)-90,9) south,
  round((lx//256*256+256)/cast(8192000 as double)-180,9) east, round((ly//625*625+625)/cast(25000000 as double)-90,9) north from units""",
    "bld", centres=CENTRES, units=UNITS,
)
def olc_bounds(spark, sf_dir):
    rows = centres(spark, sf_dir).select("name", "id", olc.encode(F.col("lon"), F.col("lat"), 11).alias("code"))
    lx, ly = olc.decode(F.col("code"))
    return rows.select("name", "id", lx.alias("lx"), ly.alias("ly")).select("name", "id", *[F.round(v, 9).alias(k) for k, v in olc.bounds(F.col("lx"), F.col("ly"), 11).items()])


LENGTHS = " ".join(f"when {dx}/cast(8192000 as double)<=x and {dy}/cast(25000000 as double)<=y then {n}" for n, (dx, dy) in olc.STEPS.items())


@query(
    f"""select name, id, cast(case {LENGTHS} end as integer) length
from (select name, id, ((xmax-xmin)/cast(100000 as double))/cast(2.5 as double) x, ((ymax-ymin)/cast(100000 as double))/cast(2.5 as double) y from bld)""",
    "bld",
)
def olc_length(spark, sf_dir):
    rows = view(spark, sf_dir, "bld")
    return rows.select("name", "id", olc.length_for((F.col("xmax") - F.col("xmin")) / tiles.UNIT, (F.col("ymax") - F.col("ymin")) / tiles.UNIT).alias("length"))


BOXED = """select name, id, cast(floor((cast(-88 as double)+xmin/cast(100000 as double)+180)*8192000) as bigint) w, cast(floor((cast(41 as double)+ymin/cast(100000 as double)+90)*25000000) as bigint) s,
 cast(floor((cast(-88 as double)+xmax/cast(100000 as double)+180)*8192000) as bigint) e, cast(floor((cast(41 as double)+ymax/cast(100000 as double)+90)*25000000) as bigint) n from bld"""


def inner_sql(length: int, source: str = "boxed") -> str:
    dx, dy = olc.STEPS[length]
    return f"""select name, id, i, j from (select *, unnest(range(s//{dy}+1, n//{dy}+1)) j from (select *, unnest(range(w//{dx}+1, e//{dx}+1)) i from {source}))
 where i*{dx}>=w and (i+1)*{dx}<=e and j*{dy}>=s and (j+1)*{dy}<=n"""


CLAIM = "select name, id, w+a*1024 x, s+b*3125 y from (select *, unnest(range(1, n//3125-s//3125)) b from (select *, unnest(range(1, e//1024-w//1024)) a from boxed))"


@query(CLAIM, "bld", boxed=BOXED)
def olc_claim(spark, sf_dir):
    rows = tiles.units(view(spark, sf_dir, "bld"))
    return rows.select("name", "id", F.explode(olc.claim(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 10)).alias("t")).select("name", "id", "t.x", "t.y")


@query("select name, id, round((lx//1024*1024)/cast(8192000 as double)-180,9) lon, round((ly//3125*3125)/cast(25000000 as double)-90,9) lat from units", "bld", centres=CENTRES, units=UNITS)
def olc_corner(spark, sf_dir):
    """Lower left corner of the tile of ten digits around each centre."""
    at = centres(spark, sf_dir).select("name", "id", olc.lon_units(F.col("lon")).alias("lx"), olc.lat_units(F.col("lat")).alias("ly"))
    return at.select("name", "id", *[F.round(v, 9).alias(k) for k, v in olc.south_west(F.col("lx"), F.col("ly"), 10).items()])


@query(inner_sql(10), "bld", boxed=BOXED)
def tiles_of_box(spark, sf_dir):
    return tiles.tiles_of_box(view(spark, sf_dir, "bld"), 10)


T10 = inner_sql(10)
T11 = inner_sql(11)
TILES = f"""select name, id, {code_sql('i*1024', 'j*3125', 10)} tile from t10 union all
 select name, id, {code_sql('i*256', 'j*625', 11)} from t11 where not exists (select 1 from t10 where t10.name=t11.name and t10.id=t11.id)"""
TILED = dict(boxed=BOXED, t10=T10, t11=T11, tiles=TILES)


def tiled(spark, sf_dir) -> DataFrame:
    return tiles.tessellate(view(spark, sf_dir, "bld"))


@query("select name, id, tile from tiles", "bld", **TILED)
def tessellate(spark, sf_dir):
    return tiled(spark, sf_dir)


@query("select name, id, cast(n as bigint) n, cast(coalesce(sum(n) over (partition by name order by id rows between unbounded preceding and 1 preceding),0) as bigint) start from (select name, id, count(*) n from tiles group by name, id)", "bld", **TILED)
def tile_offsets(spark, sf_dir):
    return tiles.tile_offsets(tiled(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))


TILE = ("length", "i", "j")


def keys_of_tiles(spark, sf_dir) -> DataFrame:
    """The tessellation by numbers, made once for all sides of a match."""
    return stage(tiles.tile_keys(view(spark, sf_dir, "bld")), "tiles")


MATCHED = "select min(l.id) left_id, r.id right_id from tiles l join tiles r on l.tile=r.tile where l.name='osm' and r.name='{}' group by r.id having count(distinct l.id)=1"


@query("select left_id, right_id from m", "bld", **TILED, m=MATCHED.format("msbf"))
def tmatch(spark, sf_dir):
    t = keys_of_tiles(spark, sf_dir)
    return tiles.tmatch(t.filter("name='osm'"), t.filter("name='msbf'"), TILE)


@query("select distinct name, id, id left_id from tiles where name='osm' union all select 'msbf', right_id, left_id from m1 union all select 'ocm', right_id, left_id from m2", "bld", **TILED, m1=MATCHED.format("msbf"), m2=MATCHED.format("ocm"))
def tconcat(spark, sf_dir):
    t = keys_of_tiles(spark, sf_dir)
    return tiles.tconcat(t.filter("name='osm'"), t.filter("name='msbf'"), t.filter("name='ocm'"), on=TILE)


@query("select name, id, cast(floor((lon+180)/360*131072) as bigint) tw, cast(floor((1-asinh(tan(radians(lat)))/pi())/2*131072) as bigint) tn from centres", "bld", centres=CENTRES)
def slippy_forward(spark, sf_dir):
    return centres(spark, sf_dir).select("name", "id", slippy.tile_x(F.col("lon"), 17).alias("tw"), slippy.tile_y(F.col("lat"), 17).alias("tn"))


SLIPPY = "select name, id, cast(floor((lon+180)/360*131072) as bigint) tw, cast(floor((1-asinh(tan(radians(lat)))/pi())/2*131072) as bigint) tn from centres"


@query("select name, id, round(tw/cast(131072 as double)*360-180,9) west, round(degrees(atan(sinh(pi()*(1-2*tn/cast(131072 as double))))),9) north from sl", "bld", centres=CENTRES, sl=SLIPPY)
def slippy_inverse(spark, sf_dir):
    rows = slippy_forward(spark, sf_dir)
    return rows.select("name", "id", F.round(slippy.tile_west(F.col("tw"), 17), 9).alias("west"), F.round(slippy.tile_north(F.col("tn"), 17), 9).alias("north"))


@query("select name, id, cast(tn*4294967296+tw as bigint) k, tn, tw from sl", "bld", centres=CENTRES, sl=SLIPPY)
def tile_key(spark, sf_dir):
    rows = slippy_forward(spark, sf_dir).select("name", "id", slippy.pack(F.col("tn"), F.col("tw")).alias("k"))
    tn, tw = slippy.unpack(F.col("k"))
    return rows.select("name", "id", "k", tn.alias("tn"), tw.alias("tw"))


@query("select name, id, round(radians(lon)*6378137,6) x, round(ln(tan(pi()/4+radians(lat)/2))*6378137,6) y from centres", "bld", centres=CENTRES)
def mercator(spark, sf_dir):
    return centres(spark, sf_dir).select("name", "id", F.round(geo.mercator_x(F.col("lon")), 6).alias("x"), F.round(geo.mercator_y(F.col("lat")), 6).alias("y"))


@query("select name, id, printf('%.4f, %.4f', lat+cast(0.000012 as double), lon+cast(0.000012 as double)) as ref from centres", "bld", centres=CENTRES)
def ref_label(spark, sf_dir):
    off = F.lit(0.000012)  # no place on the lattice lies half way between two labels then
    return centres(spark, sf_dir).select("name", "id", geo.ref_label(F.col("lat") + off, F.col("lon") + off).alias("ref"))


@query("select name, id, cast(floor((lon+180)/6)+1 as integer) zone from centres", "bld", centres=CENTRES)
def utm_zone(spark, sf_dir):
    return centres(spark, sf_dir).select("name", "id", geo.utm_zone(F.col("lon")).alias("zone"))


# footprints and groups

OVERLAP = "greatest(least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin),0)*greatest(least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin),0)"
DISTANCE = "((a.xmin+a.xmax)-(b.xmin+b.xmax))*((a.xmin+a.xmax)-(b.xmin+b.xmax))+((a.ymin+a.ymax)-(b.ymin+b.ymax))*((a.ymin+a.ymax)-(b.ymin+b.ymax))"
GRID = "select *, (xmax-xmin)*(ymax-ymin) area, xmin//100 gx, ymin//100 gy, xmax//100 hx, ymax//100 hy from bld"
CELLED = "select *, unnest(range(gy, hy+1)) cy from (select *, unnest(range(gx, hx+1)) cx from grid)"
PARENT = f"""select name, id, parent_name, parent_id from (
 select a.name, a.id, b.name parent_name, b.id parent_id, row_number() over (partition by a.name, a.id order by {DISTANCE}, b.name, b.id) r
 from celled a join celled b on a.cx=b.cx and a.cy=b.cy and (b.area>a.area or (b.area=a.area and (b.name<a.name or (b.name=a.name and b.id<a.id))))
  and {OVERLAP}>0 and 10*{OVERLAP}>=a.area) where r=1"""
ROOT = """select bld.name, bld.id, bld.name root_name, bld.id root_id, 0 d from bld where not exists (select 1 from parent p where p.name=bld.name and p.id=bld.id)
 union all select p.name, p.id, r.root_name, r.root_id, r.d+1 from parent p join roots r on p.parent_name=r.name and p.parent_id=r.id"""


@query("select name, id, parent_name, parent_id from parent", "bld", grid=GRID, celled=CELLED, parent=PARENT)
def footprint_parent(spark, sf_dir):
    return footprint.parents(view(spark, sf_dir, "bld"))


@query("select name, id, root_name, root_id from roots", "bld", grid=GRID, celled=CELLED, parent=PARENT, roots=ROOT)
def footprint_clusters(spark, sf_dir):
    return footprint.clusters(view(spark, sf_dir, "bld"))


ASSIGNED = f"""select name, id, footprint from (
 select a.name, a.id, b.id footprint, row_number() over (partition by a.name, a.id order by {DISTANCE}, b.id) r
 from celled a join celled b on a.cx=b.cx and a.cy=b.cy and b.name='osm' and {OVERLAP}>0 and 2*{OVERLAP}>=a.area where a.name<>'osm') where r=1"""


@query("select b.name, b.id, f.footprint from bld b left join assigned f on b.name=f.name and b.id=f.id where b.name<>'osm'", "bld", grid=GRID, celled=CELLED, assigned=ASSIGNED)
def footprint_assign(spark, sf_dir):
    rows = view(spark, sf_dir, "bld")
    return footprint.assign(rows.filter("name <> 'osm'"), rows.filter("name = 'osm'"))


EDGES = "select distinct cast(l_orderkey as bigint) rel, cast(l_partkey as bigint) part from lineitem"


def named_together(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.col("l_orderkey").cast("long").alias("rel"), F.col("l_partkey").cast("long").alias("a"))
    edges = rows.join(rows.groupBy("rel").agg(F.min("a").alias("b")), "rel").select("a", "b")
    linked = components.components(edges)
    return rows.select(F.col("a").alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query()
def group_components(spark, sf_dir):
    """Parts that belong together because relations (orders) name them together; over all relations, for which
    recursive SQL is too slow: tests hold it against a plain search."""
    return named_together(table(spark, sf_dir, "lineitem"))


@query("select cast(rel as bigint) component, cast(count(*) as bigint) n from edges left join (select p_partkey, p_size from part where p_size<>7) p on p.p_partkey=part group by rel having bool_and(p_size is not null) or bool_or(coalesce(p_size=1,false))", edges=EDGES)
def relation_groups(spark, sf_dir):
    """Relations of which no member is missing, or that have a multipolygon (size 1) among them."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("component"), F.col("l_partkey").cast("long").alias("id")).distinct()
    elements = table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") == 1).alias("multipolygon"))
    return aggregate.complete_relations(members, elements)


@agg_query("select name, ubid, height_m from agg")
def height_aggregate(spark, sf_dir):
    return compared(spark, sf_dir).aggregate.select("name", "ubid", "height_m")


@agg_query("select name, ubid, floors from agg")
def floors_aggregate(spark, sf_dir):
    return compared(spark, sf_dir).aggregate.select("name", "ubid", "floors")


@query("""select name, ubid, id cardinal from (select *, row_number() over (partition by name, ubid order by case when height_m is null then 1 else 0 end, height_m desc, floors desc nulls last, id) r from data)
where r=1 and (height_m is not null or floors is not null) union all
select name, ubid, null from data group by name, ubid having count(height_m)=0 and count(floors)=0""", "bld", data=DATA)
def argmax_carry(spark, sf_dir):
    carry = aggregate.carried("id", F.col("height_m"), F.col("floors"), F.col("id"))
    return keyed(spark, sf_dir).groupBy("name", "ubid").agg(carry.alias("cardinal"))


@query("select name, ubid, round(avg(x),6) cx, round(avg(y),6) cy from (select distinct name, ubid, (xmin+xmax)/cast(2 as double) x, (ymin+ymax)/cast(2 as double) y from data) group by name, ubid", "bld", data=DATA)
def group_centroid(spark, sf_dir):
    """Centroid of the set of member centroids."""
    points = keyed(spark, sf_dir).select("name", "ubid", Box.of().cx.alias("x"), Box.of().cy.alias("y")).distinct()
    return points.groupBy("name", "ubid").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


# comparison


@agg_query("select name, ubid from agg a where name='osm' and exists (select 1 from agg b where b.ubid=a.ubid and b.name<>'osm')")
def matched(spark, sf_dir):
    return compared(spark, sf_dir).matched("osm").select("name", "ubid")


@agg_query("select name, ubid from agg a where name='osm' and not exists (select 1 from agg b where b.ubid=a.ubid and b.name<>'osm')")
def unmatched(spark, sf_dir):
    return compared(spark, sf_dir).unmatched("osm").select("name", "ubid")


@agg_query("select ubid from agg group by ubid having count(*)=1")
def singles(spark, sf_dir):
    return compared(spark, sf_dir).singles()


@agg_query("""select name, cast(count(*) as bigint) n, cast(sum(case when c>1 then 1 else 0 end) as bigint) matched, round(sum(case when c>1 then 1 else 0 end)/cast(count(*) as double),9) rate
from (select a.name, s.c from agg a join (select ubid, count(distinct name) c from agg group by ubid) s on a.ubid=s.ubid) group by name""")
def match_rate(spark, sf_dir):
    return compared(spark, sf_dir).match_rate().select("name", "n", "matched", F.round("rate", 9).alias("rate"))


@pair_query("select ubid, round(cut/cast(aa as double),9) containment from pairs where aa<>0", "msbf")
def containment(spark, sf_dir):
    return compared(spark, sf_dir).containment("osm", "msbf").select("ubid", F.round("containment", 9).alias("containment"))


@pair_query("select ubid, round(cut/cast(aa+ba-cut as double),9) quality from pairs", "msbf")
def iou_quality(spark, sf_dir):
    return compared(spark, sf_dir).quality("osm", "msbf").select("ubid", F.round("quality", 9).alias("quality"))


@pair_query("select ubid, cut area from pairs", "msbf")
def intersection_area(spark, sf_dir):
    return compared(spark, sf_dir).intersection("osm", "msbf")


@pair_query("select ubid, cast(aa+ba-cut as bigint) area from pairs", "msbf")
def union_area(spark, sf_dir):
    return compared(spark, sf_dir).union("osm", "msbf")


@pair_query("select ubid, round(abs(ah-bh)/nullif(greatest(ah,bh),0),9) difference from pairs where ah is not null and bh is not null", "ocm")
def difference_percent(spark, sf_dir):
    return compared(spark, sf_dir).difference_percent("osm", "ocm").select("ubid", F.round("difference", 9).alias("difference"))


@pair_query("select ubid, round(abs(ah-bh),9) difference from pairs where ah is not null and bh is not null", "ocm")
def difference_absolute(spark, sf_dir):
    return compared(spark, sf_dir).difference_absolute("osm", "ocm").select("ubid", F.round("difference", 9).alias("difference"))


@pair_query("select ubid, round(abs(ah-bh)/greatest(ah,bh)*(cut/cast(aa as double)),9) difference from pairs where ah is not null and bh is not null and greatest(ah,bh)<>0", "ocm")
def difference_scaled(spark, sf_dir):
    return compared(spark, sf_dir).difference_scaled("osm", "ocm").select("ubid", F.round("difference", 9).alias("difference"))


DIFF = "case when r.name<>'{0}' then coalesce(abs({0}.height_m-r.height_m)/nullif(greatest({0}.height_m,r.height_m),0), abs({0}.floors-r.floors)/nullif(greatest({0}.floors,r.floors),0)) end"


@agg_query(f"""select * from (select r.ubid, r.name, round({DIFF.format('ocm')},9) ocm, round({DIFF.format('osm')},9) osm from agg r left join (select * from agg where name='ocm') ocm on r.ubid=ocm.ubid
 left join (select * from agg where name='osm') osm on r.ubid=osm.ubid where r.name in ('osm','ocm')) where ocm is not null or osm is not null""")
def percent_matrix(spark, sf_dir):
    out = compared(spark, sf_dir).matrix(["osm", "ocm"], ["osm", "ocm"])
    return out.select("ubid", "name", F.round("ocm", 9).alias("ocm"), F.round("osm", 9).alias("osm"))


@pair_query("select ubid, round(abs(ah-bh)/greatest(ah,bh),9) difference, ah left_value, bh right_value from pairs where ah is not null and bh is not null and abs(ah-bh)/nullif(greatest(ah,bh),0)>0.2 order by difference desc, ubid", "ocm")
def discrepancies(spark, sf_dir):
    return compared(spark, sf_dir).discrepancies("osm", "ocm").withColumn("difference", F.round("difference", 9))


@query("select ubid, array_to_string(list_transform(list_sort(list(distinct id)), lambda x: cast(x as varchar)), ',') ids from data where name='ocm' group by ubid", "bld", data=DATA)
def identity_sets(spark, sf_dir):
    return compared(spark, sf_dir).identities("ocm")


@agg_query("select name, ubid from agg where ubid in (select ubid from agg where name='osm' and xmin<=20000 and xmax>=5000 and ymin<=40 and ymax>=0)")
def subcompare(spark, sf_dir):
    c = compared(spark, sf_dir)
    held = c.of("osm").filter(Box.of().intersects(Box.literal(5000, 0, 20000, 40))).select("ubid")
    return c[held].aggregate.select("name", "ubid")


@pair_query("select ubid, difference from (select ubid, round(abs(ah-bh)/nullif(greatest(ah,bh),0),9) difference, row_number() over (order by abs(ah-bh)/nullif(greatest(ah,bh),0), ubid) r, count(*) over () n from pairs where ah is not null and bh is not null) where r<=floor(n*0.05)", "ocm")
def bottom_5pct(spark, sf_dir):
    c = compared(spark, sf_dir)
    return c.bottom(c.difference_percent("osm", "ocm"), "difference").withColumn("difference", F.round("difference", 9))


@pair_query("select round(median(abs(ah-bh)/nullif(greatest(ah,bh),0)),9) median_error from pairs where ah is not null and bh is not null", "ocm")
def median_error(spark, sf_dir):
    return compared(spark, sf_dir).median_error("osm", "ocm").select(F.round("median_error", 9).alias("median_error"))


@query("select id, cast(case when c>1 then (dense_rank() over (partition by c>1 order by grp)-1)%7 end as bigint) hue from (select id, grp, count(*) over (partition by grp) c from bld where name='ocm')", "bld")
def cyclic_rank(spark, sf_dir):
    rows = view(spark, sf_dir, "bld").filter("name = 'ocm'").select("id", "grp")
    return compare.cyclic_rank(rows, "grp", 7).select("id", "hue")


@query("""select a.id, b.id near_id, cast(cast(cast(((a.xmin+a.xmax)-(b.xmin+b.xmax))*((a.xmin+a.xmax)-(b.xmin+b.xmax))+((a.ymin+a.ymax)-(b.ymin+b.ymax))*((a.ymin+a.ymax)-(b.ymin+b.ymax)) as bigint) as double)/4 as double) d2
from bld a join bld b on a.name='msbf' and b.name='osm' and a.id%17=0 and b.xmin//100 between a.xmin//100-1 and a.xmin//100+1 and b.xmin-50<=a.xmax and b.xmax+50>=a.xmin and b.ymin-50<=a.ymax and b.ymax+50>=a.ymin""", "bld")
def surroundings(spark, sf_dir):
    """Boxes within 50 units around a mismatch, found through the grid."""
    return around_mismatches(view(spark, sf_dir, "bld"))


def around_mismatches(rows: DataFrame) -> DataFrame:
    """id, near_id, d2 of the msbf rows that no osm box is assigned to and the osm boxes around them."""
    msbf, osm = rows.filter("name = 'msbf'"), rows.filter("name = 'osm'")
    lost = footprint.assign(msbf, osm).filter("footprint is null").select("id")
    wide = msbf.join(lost, "id", "left_semi").select(F.col("id"), *[F.col(c).alias(f"a_{c}") for c in footprint.CORNERS])
    around = Box(F.col("a_xmin") - 50, F.col("a_ymin") - 50, F.col("a_xmax") + 50, F.col("a_ymax") + 50)
    wide = wide.select("*", F.explode(around.cells(100)).alias("cell"))
    near = osm.select(F.col("id").alias("near_id"), *[F.col(c).alias(f"b_{c}") for c in footprint.CORNERS]).select("*", F.explode(Box.of("b_").cells(100)).alias("cell"))
    pairs = wide.join(near, "cell").filter(around.intersects(Box.of("b_")))
    return pairs.select("id", "near_id", Box.of("a_").distance2(Box.of("b_")).cast("double").alias("d2")).distinct()


# selection, nearest rows, exports


@query("select name, bool_or(xmin<=20000 and xmax>=15000 and ymin<=40 and ymax>=0) meets from bld group by name", "bld")
def box_in_source(spark, sf_dir):
    """Whether a source has anything in a box."""
    return select.meets_by(view(spark, sf_dir, "bld"), Box.literal(15000, 0, 20000, 40), "name")


@query("select name, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax, max(height_m) height_m from bld group by name", "bld")
def total_bounds(spark, sf_dir):
    return select.total_bounds(view(spark, sf_dir, "bld"), "name")


@query("select name, id from bld where xmin<=30000 and ymax>=50", "bld")
def coordinate_slice(spark, sf_dir):
    return select.slice_of(view(spark, sf_dir, "bld"), (None, 30000), (50, None)).select("name", "id")


@agg_query("select name, ubid from agg where ubid in (select ubid from (select ubid, row_number() over (order by ubid)-1 p from (select distinct ubid from agg)) where p>=100 and p<160)")
def positions(spark, sf_dir):
    """Aggregate rows of the identities at some positions."""
    return select.at_positions(compared(spark, sf_dir).aggregate, "ubid", 100, 160).select("name", "ubid")


NEAR_A = "select name, id, x, y, floor(x/60)+dx gx, gy from (select *, floor(y/60)+dy gy, unnest([-1,0,1]) dx from (select *, unnest([-1,0,1]) dy from (select name, id, (xmin+xmax)/cast(2 as double) x, (ymin+ymax)/cast(2 as double) y from bld where name='msbf')))"
NEAR_B = "select id near_id, u, v, floor(u/60) gx, floor(v/60) gy from (select id, (xmin+xmax)/cast(2 as double) u, (ymin+ymax)/cast(2 as double) v from bld where name='osm')"


@query(
    """select name, id, near_id, cast(r as bigint) as "rank" from (select name, id, near_id, row_number() over (partition by name, id order by d2, near_id) r
  from (select a.name, a.id, b.near_id, (x-u)*(x-u)+(y-v)*(y-v) d2 from na a join nb b on a.gx=b.gx and a.gy=b.gy) where d2<=3600) where r<=3""",
    "bld", na=NEAR_A, nb=NEAR_B,
)
def nearest_rows(spark, sf_dir):
    """The three nearest osm centres of each msbf row, within 60 units."""
    rows = view(spark, sf_dir, "bld")
    return select.nearest(rows.filter("name = 'msbf'"), rows.filter("name = 'osm'"), 3, 60)


@agg_query("select ubid, max(case when name='msbf' then n end) msbf, max(case when name='ocm' then n end) ocm, max(case when name='osm' then n end) osm from agg group by ubid")
def wide_export(spark, sf_dir):
    """Identity by source: how many rows each has."""
    return select.wide(compared(spark, sf_dir).aggregate, "ubid", ["msbf", "ocm", "osm"], F.col("n"))


CARRIED = """select name, ubid, id cardinal, ts from (select *, row_number() over (partition by name, ubid order by case when height_m is null then 1 else 0 end, height_m desc, floors desc nulls last, id) r from data)
where r=1 and (height_m is not null or floors is not null) union all
select name, ubid, null, null from data group by name, ubid having count(height_m)=0 and count(floors)=0"""


@query("select name, ubid, cardinal, cast(ts as date) ts from carry", "bld", data=DATA, carry=CARRIED)
def aggregate_carry(spark, sf_dir):
    """The aggregate stage with the id and time of the row that its height comes from."""
    rows = aggregate.merged(keyed(spark, sf_dir), carry=("id", "ts"))
    return rows.select("name", "ubid", "cardinal", F.col("ts").cast("date").alias("ts"))


# rasters and streets

STRIPS = "select *, unnest(range(ymin//4, (ymax-1)//4+1)) gy from bld where height_m is not null and name='osm'"
GRIDDED = "select *, unnest(range(xmin//4, (xmax-1)//4+1)) gx from strips"
WEIGHTS = """select gy//256 tn, gx//256 tw, gy%256 cn, gx%256 cw,
 (least(xmax,(gx+1)*4)-greatest(xmin,gx*4))*(least(ymax,(gy+1)*4)-greatest(ymin,gy*4))/cast(16 as double)*height_m/64*65535 weight from gridded"""
RASTER = "select tn, tw, cn, cw, cast(least(floor(sum(weight)),65535) as bigint) v from weights group by tn, tw, cn, cw"
RASTERED = dict(strips=STRIPS, gridded=GRIDDED, weights=WEIGHTS, raster=RASTER)


def rastered(spark, sf_dir) -> DataFrame:
    return raster.elevation(view(spark, sf_dir, "bld").filter("name = 'osm'"), 4, 64.0)


@query("select distinct tn, tw from (select *, unnest(range(xmin//1024,(xmax-1)//1024+1)) tw from (select *, unnest(range(ymin//1024,(ymax-1)//1024+1)) tn from bld))", "bld")
def raster_tiles(spark, sf_dir):
    return raster.tiles(view(spark, sf_dir, "bld"), 1024)


@query('select tn, tw, cn, cw, v as "value" from raster', "bld", **RASTERED)
def raster_cells_sum(spark, sf_dir):
    return rastered(spark, sf_dir)


@query('select tn*256+cn as "row", (tw-1)*256+cw as col, v as "value" from raster where tn between 0 and 1 and tw between 1 and 3', "bld", **RASTERED)
def mosaic_tiles(spark, sf_dir):
    return raster.mosaic(rastered(spark, sf_dir), 0, 1, 1, 3)


@query('select cast((tw*256+cw)*4 as bigint) xmin, cast((tn*256+cn)*4 as bigint) ymin, cast((tw*256+cw+1)*4 as bigint) xmax, cast((tn*256+cn+1)*4 as bigint) ymax, v as "value" from raster where v>0', "bld", **RASTERED)
def overlay_pixels(spark, sf_dir):
    return raster.overlay(rastered(spark, sf_dir), 4)


@query('select x, y, round(least(65535,case when hag<7 then 0 else hag/50*65535 end),6) as "value" from points', "points")
def hag_clamp(spark, sf_dir):
    return view(spark, sf_dir, "points").select("x", "y", F.round(raster.hag_value(F.col("hag"), 50.0), 6).alias("value"))


@query("select cast(floor(x/cast(2 as double)) as bigint) px, cast(floor(y/cast(2 as double)) as bigint) py, round(avg(hag),6) mean from points group by 1, 2", "points")
def point_raster_mean(spark, sf_dir):
    return raster.point_mean(view(spark, sf_dir, "points"), 2).withColumn("mean", F.round("mean", 6))


HEADED = "select poid, x, y, (heading+90)%360 heading, 0 k from cam union all select poid, x, y, case when heading-90<0 then heading+270 else heading-90 end, 1 from cam"


@query("select poid, x, y, heading from (select *, row_number() over (partition by poid, round(heading) order by k, heading) r from headed) where r=1", "cam", headed=HEADED)
def heading_expand(spark, sf_dir):
    return street.heading_expand(view(spark, sf_dir, "cam"))


CAMS = "select poid, cast(x//256%8 as bigint) tile, cast(y%256 as bigint) r0, cast(x%256 as bigint) c0, heading, radians((450-heading)%360) th from cam"
SET = """select *, abs(tan(th))>1 steep, case when abs(tan(th))>1 then 1/abs(tan(th)) else abs(tan(th)) end m, case when cos(th)>=0 then 1 else -1 end dx, case when sin(th)>=0 then -1 else 1 end dy from cams"""
WALK = """select poid, tile, r0, c0, heading, steep, m, dx, dy, 0 k, r0 r, c0 c, cast(0 as double) e from sett union all
 select poid, tile, r0, c0, heading, steep, m, dx, dy, k+1, case when (e>=1)<>steep then r+dy else r end, case when (e>=1)<>steep then c else c+dx end, case when e>=1 then e-1 else e+m end from walk
 where r between 0 and 255 and c between 0 and 255"""


def cameras(spark, sf_dir) -> DataFrame:
    cam = view(spark, sf_dir, "cam")
    return cam.select("poid", F.expr("(x div 256) % 8").alias("tile"), (F.col("y") % 256).alias("row"), (F.col("x") % 256).alias("col"), "heading")


def walls(spark, sf_dir) -> DataFrame:
    """Wall pixels of eight mask tiles."""
    b = view(spark, sf_dir, "bld").filter("name = 'osm'")
    return b.select((F.col("id") % 8).alias("tile"), F.pmod(F.col("ymin") * 7 + F.expr("id div 97"), F.lit(256)).alias("r"), F.pmod(F.col("xmin") * 3 + F.expr("id div 97") * 5, F.lit(256)).alias("c")).distinct()


def casted(spark, sf_dir) -> DataFrame:
    return street.raycast(cameras(spark, sf_dir), walls(spark, sf_dir))


WALLS = "select distinct id%8 tile, (ymin*7+id//97)%256 r, (xmin*3+id//97*5)%256 c from bld where name='osm'"
HIT = "select w.poid, w.heading, arg_min(w.c-w.c0, w.k) dcol, arg_min(w.r-w.r0, w.k) drow from walk w join walls on w.tile=walls.tile and w.r=walls.r and w.c=walls.c group by w.poid, w.heading"
SEEN = "select cams.poid, cams.heading, cast(dcol as bigint) dcol, cast(drow as bigint) drow from cams left join hit on hit.poid=cams.poid and hit.heading=cams.heading"
RAYS = dict(cams=CAMS, sett=SET, walk=WALK, walls=WALLS, hit=HIT, seen=SEEN)


@query("select poid, heading, dcol, drow from seen", "bld", "cam", **RAYS)
def raycast(spark, sf_dir):
    return casted(spark, sf_dir)


FAR = "select seen.poid, seen.heading, radians(41+y/cast(100000 as double)) p, radians(41+(y-drow/cast(255 as double)*100)/cast(100000 as double)) q, radians((dcol/cast(255 as double)*100)/cast(100000 as double)) dl from seen join cam on seen.poid=cam.poid"


@query("select poid, heading, round(2*6371008.8*asin(least(1,sqrt(pow(sin((q-p)/2),2)+cos(p)*cos(q)*pow(sin(dl/2),2)))),4) distance from far", "bld", "cam", **RAYS, far=FAR)
def wall_distance(spark, sf_dir):
    """Metres from each camera to the wall its ray hits first; a pixel is 1/255 of a tile of 100 units."""
    hit = casted(spark, sf_dir).join(view(spark, sf_dir, "cam").select("poid", "x", "y"), "poid")
    lon, lat = tiles.lon_of(F.col("x")), tiles.lat_of(F.col("y"))
    to_lon, to_lat = tiles.lon_of(F.col("x") + F.col("dcol") / 255 * 100), tiles.lat_of(F.col("y") - F.col("drow") / 255 * 100)
    return hit.select("poid", "heading", F.round(geo.haversine_m(lon, lat, to_lon, to_lat), 4).alias("distance"))


@query("select poid, round(2*6371008.8*asin(least(1,sqrt(pow(sin(radians(y/cast(100000 as double))/2),2)+cos(radians(cast(41 as double)))*cos(radians(cast(41 as double)+y/cast(100000 as double)))*pow(sin(radians(x/cast(100000 as double))/2),2)))),4) metres from cam", "cam")
def geodesic(spark, sf_dir):
    """Metres from the lattice's origin to each camera."""
    at = geo.haversine_m(F.lit(tiles.ORIGIN_LON), F.lit(tiles.ORIGIN_LAT), tiles.lon_of(F.col("x")), tiles.lat_of(F.col("y")))
    return view(spark, sf_dir, "cam").select("poid", F.round(at, 4).alias("metres"))


# text formats over columns of the tables


@query("select id, cast(4 as bigint) points, cast((xmax-xmin)*(ymax-ymin) as double) area, (xmin+xmax)/cast(2 as double) cx from bld where name='osm'", "bld")
def wkt_parse(spark, sf_dir):
    corner = lambda a, b: F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")), F.lit("))"))
    rows = view(spark, sf_dir, "bld").filter("name = 'osm'").select("id", text.wkt_points(wkt).alias("ring"))
    return rows.select("id", F.size("ring").cast("long").alias("points"), geo.ring_area(F.col("ring")).alias("area"), F.round(geo.ring_centroid(F.col("ring"), "x"), 6).alias("cx"))


@query("select n_nationkey as id, 'u!'||rtrim(replace(replace(to_base64(encode('https://x.example/'||n_name)),'/','_'),'+','-'),'=') link from nation")
def share_link(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.share_link(F.concat(F.lit("https://x.example/"), F.col("n_name"))).alias("link"))


@query("select poid, heading from (select cast(event_id as bigint) poid, case when event_id%13=0 then null else cast((event_id*37)%360 as double) end heading from events) where heading is not null")
def csv_error_skip(spark, sf_dir):
    """Lines of a camera log, those that begin with E skipped, parsed."""
    from tilewright.sources.files import parse_lines

    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 13 == 0, F.lit("Error: no camera")).otherwise(F.concat_ws(",", F.col("event_id").cast("string"), ((F.col("event_id") * 37) % 360).cast("string"))).alias("value"))
    return parse_lines(lines, "poid long, heading double").filter("heading is not null")


@query('select tn, tw, cn r, cw c, v as "value" from raster where v>0', "bld", **RASTERED)
def image_scan(spark, sf_dir):
    """The raster through 16-bit images and back."""
    from tilewright.sources import images

    return images.pixels(images.png_tiles(raster.dense(rastered(spark, sf_dir))), "tn", "tw")


@query("select n_nationkey as id, cast(1 as bigint) rings, cast(3 as bigint) points, cast(n_nationkey+2 as double) xmax from nation")
def poly_parse(spark, sf_dir):
    """Boundary files' text."""
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("place\n1\n   "), k, F.lit(".0   1.0\n   "), (F.col("n_nationkey") + 2).cast("string"), F.lit(".0   1.0\n   "), k, F.lit(".0   3.0E0\nEND\nEND\n"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.poly_points(body).alias("r"))
    return rows.select("id", F.size("r").cast("long").alias("rings"), F.size(F.flatten("r")).cast("long").alias("points"), F.array_max(F.transform(F.flatten("r"), lambda p: p["x"])).alias("xmax"))


@query()
def conflate(spark, sf_dir):
    """All of it: footprints of the united sources, identities, groups, aggregates, match rates."""
    from .lifecycle import conflate as conflated

    rows = view(spark, sf_dir, "bld")
    both = conflated(*[rows.filter(F.col("name") == n) for n in ("osm", "msbf", "ocm")])
    return both.match_rate().select("name", "n", "matched", F.round("rate", 9).alias("rate"))
