"""Domain views over the TPC-H-ish test tables.

Each view is one SQL text that Spark and DuckDB read alike, so the same text feeds the
Spark queries and, as a CTE, the oracle.  ``@name`` marks a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# City, country, currency by index 0..24 (a nation number, or a venue key mod 25).
PLACES = [
    ("Mumbai", "India", "INR"), ("Delhi", "India", "INR"), ("Bangalore", "India", "INR"),
    ("New York", "United States", "USD"), ("London", "United Kingdom", "GBP"),
    ("Sydney", "Australia", "AUD"), ("Toronto", "Canada", "CAD"),
    ("Dubai", "United Arab Emirates", "AED"), ("Singapore", "Singapore", "SGD"),
    ("Berlin", "Germany", "EUR"), ("Paris", "France", "EUR"), ("Chennai", "India", "INR"),
    ("Kolkata", "India", "INR"), ("Los Angeles", "United States", "USD"),
    ("Melbourne", "Australia", "AUD"), ("Auckland", "New Zealand", "NZD"),
    ("Hyderabad", "India", "INR"), ("Pune", "India", "INR"),
    ("Manchester", "United Kingdom", "GBP"), ("Chicago", "United States", "USD"),
    ("Vancouver", "Canada", "CAD"), ("Indore", "India", "INR"), ("Tokyo", "Japan", "JPY"),
    ("Cape Town", "South Africa", "ZAR"), ("Ahmedabad", "India", "INR"),
]
# Venue name heads by venue key mod 12.
KINDS = [
    "Royal Arena", "City Stadium", "Blue Club", "Metro Theatre", "Liberty Hall", "Sky Lounge Bar",
    "Festival Grounds", "Central Park", "Shoreline Amphitheatre", "Convention Centre",
    "Jazz Room", "Warehouse",
]


def pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {index} {arms} end"


def city_of(i: str) -> str:
    return pick(i, [p[0] for p in PLACES])


def country_of(i: str) -> str:
    return pick(i, [p[1] for p in PLACES])


def currency_of(i: str) -> str:
    return pick(i, [p[2] for p in PLACES])


def kind_of(i: str) -> str:
    return pick(i, KINDS)


_METRIC_TAIL = """
select artist_id, platform, metric_date as date, x as followers, 3 * x as streams,
       case when platform = 'youtube' then 3 * x else 0 end as views,
       step as likes, n as comments, 2 * n as shares,
       case when step % 3 = 0 then null else cast(step % 2000 - 900 as double) / 1e2 end as rog_daily,
       case when step % 4 = 0 then null else cast(step % 5000 - 2400 as double) / 1e2 end as rog_weekly,
       case when step % 5 <> 0 then null else cast(step % 9000 - 4000 as double) / 1e2 end as rog_monthly
from (
  select artist_id, platform, metric_date, n, step,
         cast(%s + sum(step) over (partition by artist_id, platform order by metric_date
              rows between unbounded preceding and current row) as bigint) as x
  from daily)
"""

VIEWS: dict[str, str] = {
    # one row per artist, platform and day of January 2024
    "dv_metrics": """
with daily as (
  select user_id as artist_id,
         case event_type when 'click' then 'spotify' when 'view' then 'youtube'
              when 'signup' then 'instagram' when 'purchase' then 'facebook' else 'twitter' end as platform,
         cast(ts as date) as metric_date, count(*) as n,
         cast(sum(cast(round(value * 100) as bigint)) as bigint) as step
  from @events group by 1, 2, 3)
""" + _METRIC_TAIL.replace("%s", "1000"),
    # seven years of days per artist and platform, going up and down
    "dv_metrics_long": """
with daily as (
  select l_suppkey as artist_id,
         case l_returnflag || l_linestatus when 'AF' then 'spotify' when 'AO' then 'youtube'
              when 'NF' then 'instagram' when 'NO' then 'facebook'
              when 'RF' then 'twitter' else 'apple_music' end as platform,
         cast(l_shipdate as date) as metric_date, count(*) as n,
         cast(sum(cast((l_quantity - 25) * 100 as bigint)) as bigint) as step
  from @lineitem group by 1, 2, 3)
""" + _METRIC_TAIL.replace("%s", "20000"),
    "dv_artists": f"""
select c_custkey as artist_id, c_name as artist_name, {country_of('n_nationkey')} as nationality,
       r_name as region, c_mktsegment as genre, c_acctbal > 0 as active,
       case when c_custkey % 11 = 0 then null
            else cast(abs(cast(round(c_acctbal * 100) as bigint)) % 10001 as double) / 1e2 end as popularity,
       case when c_acctbal > 0 then cast(round(c_acctbal * 100) as bigint) * 3 else null end as spotify_listeners,
       c_custkey * 7919 % 900001 as youtube_subscribers,
       c_custkey * 104729 % 2500009 as instagram_followers,
       case when c_custkey % 7 = 0 then null else c_custkey * 1299709 % 600011 end as facebook_followers,
       case when c_custkey % 5 = 0 then 0 else c_custkey * 15485863 % 300007 end as twitter_followers
from @customer join @nation on c_nationkey = n_nationkey join @region on n_regionkey = r_regionkey
""",
    "dv_venues": f"""
select s_suppkey as venue_id, {kind_of('s_suppkey % 12')} || ' ' || cast(s_suppkey as varchar(20)) as venue_name,
       {city_of('s_suppkey * 7 % 25')} as city, {country_of('s_suppkey * 7 % 25')} as country,
       case when s_suppkey % 4 = 0 then 0 else cast(floor(abs(s_acctbal)) as bigint) end as capacity_min,
       cast(floor(abs(s_acctbal) * 4) as bigint) as capacity_max,
       case when s_suppkey % 6 = 0 then null else cast(floor(abs(s_acctbal) * 3) as bigint) end as avg_capacity,
       case when s_acctbal > 0 then s_acctbal / 2e0 else null end as avg_ticket_price,
       s_suppkey % 3 = 0 as verified
from @supplier
""",
    "dv_concerts": f"""
with shows as (
  select l_orderkey, count(*) as n_lines, min(l_suppkey) as vid, cast(sum(l_quantity) as bigint) as qty,
         cast(round(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))), 2) as double) as rev
  from @lineitem group by l_orderkey)
select o_orderkey as concert_id, o_custkey as artist_id, cast(o_orderdate as date) as concert_date,
       vid as venue_id,
       {kind_of('vid % 12')} || ' ' || cast(vid as varchar(20)) as venue_name,
       coalesce({city_of('vid * 7 % 25')}, {city_of('o_custkey % 25')}) as city,
       coalesce({country_of('vid * 7 % 25')}, {country_of('o_custkey % 25')}) as country,
       case when o_orderkey % 5 = 0 then null else 'State ' || cast(vid % 7 as varchar(20)) end as state,
       case when vid is null then null when vid % 10 = 3 then 0
            when o_orderkey % 2 = 0 then 500 * n_lines else 5000 * n_lines end as capacity,
       case when vid is null then null when o_orderstatus = 'P' then 0
            when o_orderkey % 2 = 0 then 15 * qty else 150 * qty end as tickets_sold,
       case when o_orderpriority = '1-URGENT' then null when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 0e0
            else cast(round(o_totalprice * 100) as bigint) / 1e4 end as avg_ticket_price,
       case when o_orderkey % 3 = 0 then cast(round(o_totalprice * 50) as bigint) / 1e4 else null end as price_tier3,
       case when o_orderkey % 4 = 1 then cast(round(o_totalprice * 250) as bigint) / 1e4 else null end as price_vip,
       case when vid is null then null when o_orderstatus = 'P' then 0e0 else rev end as total_revenue,
       case when o_orderkey % 13 = 0 then null
            else coalesce({currency_of('vid * 7 % 25')}, {currency_of('o_custkey % 25')}) end as currency,
       case when o_orderkey % 4 = 0 then null else cast(o_orderkey * 37 % 9600 as double) / 1e2 end as demand_score,
       case o_orderpriority when '1-URGENT' then 'setlistfm' when '2-HIGH' then 'songkick'
            when '3-MEDIUM' then 'bookmyshow' when '4-NOT SPECIFIED' then 'district' else 'manual' end as source,
       case o_orderstatus when 'F' then 'VERIFIED' else 'PENDING' end as verification_status
from @orders left join shows on o_orderkey = l_orderkey
""",
    "dv_predictions": """
select l_orderkey as concert_id, l_partkey as prediction_id, cast(l_shipdate as date) as created_at,
       'v' || cast(l_linenumber % 3 as varchar(20)) as model_version,
       cast(l_quantity * 100 as bigint) as expected_attendance, 1000 * l_linenumber as predicted_capacity,
       cast(round(l_extendedprice * 100) as bigint) / 1e4 as predicted_price, l_extendedprice as expected_revenue,
       cast(round(l_discount * 100) as bigint) * 1e1 as demand_score,
       cast(round(l_tax * 100) as bigint) / 1e1 as confidence
from @lineitem
""",
    "dv_demographics": f"""
select o_orderkey as demo_id, o_custkey as artist_id,
       case when o_orderkey % 2 = 0 then o_orderkey else null end as concert_id,
       case o_orderkey % 4 when 0 then 'AGE_GROUP' when 1 then 'GENDER' when 2 then 'GEOGRAPHY' else 'GENRE' end as dimension,
       case o_orderkey % 4 when 0 then {pick('o_custkey % 4', ['18-24', '25-34', '35-44', '45+'])}
            when 1 then {pick('o_custkey % 4', ['female', 'male', 'other'])}
            when 2 then {city_of('o_orderkey * 3 % 25')} || ', ' || {country_of('o_orderkey * 3 % 25')}
            else {pick('o_custkey % 3', ['pop', 'rock', 'folk'])} end as dimension_value,
       case when o_orderkey % 9 = 0 then null
            else cast(cast(round(o_totalprice * 100) as bigint) % 10001 as double) / 1e2 end as percentage,
       case when o_orderkey % 10 = 0 then null else cast(floor(o_totalprice) as bigint) end as absolute_count,
       cast(o_orderdate as date) as metric_date
from @orders
""",
    "dv_artist_genres": """
select c_custkey as artist_id, c_mktsegment as genre from @customer
union all
select c_custkey as artist_id, 'FESTIVAL' as genre from @customer where c_custkey % 3 = 0
""",
}

VIEWS["dv_venue_texts"] = """
select p_partkey as venue_key, p_brand as venue_group,
       case p_partkey % 8
         when 0 then 'The ' || p_name || ' has a seating capacity of ' || cast(p_size * 100 as varchar(20)) || ' for concerts.'
         when 1 then 'Standing capacity ' || cast(p_size as varchar(20)) || 'k depending on the configuration; 12,500 seats in the round'
         when 2 then 'approx ' || cast(p_size * 37 as varchar(20)) || '  people at the ' || p_name
         when 3 then p_name || ' holds up to ' || cast(p_size as varchar(20)) || ',000 guests, capacity: 7,250'
         when 4 then 'arena for ' || cast(p_size * 211 as varchar(20)) || ' | ' || cast(p_size * 3 as varchar(20)) || '-seat hall'
         when 5 then 'No numbers about ' || p_name
         when 6 then 'Max capacity: 1.5m crowd? about ' || cast(p_size as varchar(20)) || '.5k seats'
         else 'a ' || cast(p_size as varchar(20)) || ' capacity bar, seats 4' end as text
from @part
"""

# scraped listings: each line item is one listing of its order's concert, spelled in its own way
VIEWS["dv_raw"] = f"""
select cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) || '-' || cast(l_partkey as varchar(20))
         || '-' || cast(l_suppkey as varchar(20)) as source_event_id,
       case o_orderpriority when '1-URGENT' then 'SETLIST_FM' when '2-HIGH' then 'SONGKICK' when '3-MEDIUM' then 'BOOKMYSHOW'
            when '4-NOT SPECIFIED' then 'DISTRICT' else 'BLOG' end as source_platform,
       case l_linenumber when 2 then '  the   customer ' || lpad(cast(o_custkey as varchar(20)), 9, '0') || ' | Band'
            when 5 then 'dj customer ' || lpad(cast(o_custkey as varchar(20)), 9, '0')
            else 'Customer#' || lpad(cast(o_custkey as varchar(20)), 9, '0') end as artist_name,
       case when l_linenumber = 3 then null else 'Customer ' || cast(o_custkey as varchar(20)) || ' |  Live' end as event_name,
       case l_linenumber
         when 1 then {kind_of('o_custkey % 12')} || ' ' || cast(o_custkey % 40 as varchar(20)) || ', ' || {city_of('o_custkey * 3 % 25')} || ', NSW, ' || {country_of('o_custkey * 3 % 25')}
         when 2 then {kind_of('o_custkey % 12')} || ' ' || cast(o_custkey % 40 as varchar(20)) || ' Pvt Ltd'
         when 4 then {kind_of('o_custkey % 12')} || ' ' || cast(o_custkey % 40 as varchar(20)) || ', ' || {city_of('o_custkey * 3 % 25')}
         when 6 then 'Café ' || {kind_of('o_custkey % 12')}
         else {kind_of('o_custkey % 12')} || '  ' || cast(o_custkey % 40 as varchar(20)) end as venue_name,
       case when l_linenumber in (1, 4) then null when l_linenumber = 3 and o_custkey * 3 % 25 = 0 then 'bombay'
            else {city_of('o_custkey * 3 % 25')} end as city,
       case when l_linenumber = 1 then (case when l_suppkey % 2 = 0 then null else 'us' end)
            when l_linenumber = 7 and l_suppkey % 3 = 0 then null
            when o_custkey * 3 % 25 in (0, 1, 2) and l_linenumber = 3 then 'in'
            else {country_of('o_custkey * 3 % 25')} end as country,
       case l_linenumber when 3 then cast(cast(o_orderdate as date) as varchar(10)) || 'T19:00:00+1000'
            when 5 then cast(cast(o_orderdate as date) as varchar(10)) || 'T01:30:00+05:30'
            when 7 then (case when l_suppkey % 11 = 0 then 'soon' else cast(cast(o_orderdate as date) as varchar(10)) || 'T12:00:00Z' end)
            else cast(cast(o_orderdate as date) as varchar(10)) end as event_date,
       case when l_partkey % 4 = 0 then null else cast(floor(l_extendedprice / 100) as bigint) * 1e0 end as price_min,
       case when l_partkey % 5 = 0 then null else cast(floor(l_extendedprice / 50) as bigint) * 1e0 end as price_max,
       case l_suppkey % 6 when 0 then null when 1 then 'https://in.bookmyshow.com/mumbai/e' || cast(l_partkey as varchar(20))
            when 2 then 'https://www.songkick.com/concerts/' || cast(l_partkey as varchar(20)) when 3 then 'not a url'
            when 4 then 'https://notsongkick.com/x' else 'https://blog.example.org/p' end as source_url,
       case when l_suppkey % 9 = 0 then 'https://tickets.example.org/t' else null end as official_ticket_url,
       l_returnflag = 'A' as verified_artist_account,
       case when l_tax = 0 then null else cast(round(l_tax * 100) as bigint) * 1.5e1 / 1e2 end as confidence_score,
       o_custkey as artist_id, cast(o_orderdate as date) as show_date
from @lineitem join @orders on l_orderkey = o_orderkey
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, views on views included."""
    needed = {name for name in VIEWS if name in body}
    while True:
        more = {n for n in VIEWS for v in needed if n in VIEWS[v]} | needed
        if more == needed:
            break
        needed = more
    ctes = [f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed]
    body = body.strip()
    if not ctes:
        return body
    head = "with recursive " + ",\n".join(ctes)
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return head + ",\n" + body[len(start):]
    return head + "\n" + body


def oracle_text(body: str) -> str:
    """The SQL for DuckDB, where base tables are plain names."""
    return _with_views(body).replace("@", "")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain view (or base table) as a DataFrame over the parquet files."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _with_views(f"select * from {name}")
    for table in _TABLES:
        text = text.replace(f"@{table}", f"parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(text)


class Views:
    """``Views(spark, dir).concerts`` is the view ``dv_concerts``; base tables by their name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = f"dv_{name}"
        return bound(self.spark, self.sf_dir, view if view in VIEWS else name)
