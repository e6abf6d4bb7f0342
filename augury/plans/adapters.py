"""The engine's logical tables over the given parquet tables, as Spark frames and, for the oracle, as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    label = F.when(F.col("event_type") == "view", "forward_looking").when(F.col("event_type") == "click", "latent").when(F.col("event_type") == "purchase", "confirmation")
    s = e.select("event_id", F.to_date("ts").alias("day"), label.alias("temporality"), F.col("event_type").isin("error").alias("failed"), (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("conf"), (F.col("user_id") % 25).cast("int").alias("geo_key"), (F.col("user_id") % 10 + 1).alias("sup_key"), (F.col("user_id") % 50 + 1).alias("part_key"), "user_id")
    n, p, c = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "supplier")
    s = s.join(n.select(F.col("n_nationkey").alias("geo_key"), F.array("n_name").alias("geographies")), "geo_key", "left")
    s = s.join(c.select(F.col("s_suppkey").alias("sup_key"), F.array("s_name").alias("companies")), "sup_key", "left")
    short = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), "")  # half the signals abbreviate goods
    s = s.join(p.select(F.col("p_partkey").alias("part_key"), "p_name", short.alias("short")), "part_key", "left")
    return s.withColumn("commodities", F.array(F.when(F.col("user_id") % 2 == 0, F.col("short")).otherwise(F.col("p_name")))).drop("p_name", "short")


def truth(spark: SparkSession, d: str) -> DataFrame:
    n, p, c = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "supplier")
    t = n.select(F.col("n_name").alias("truth_id"), F.col("n_nationkey").alias("ev_ord"), F.expr("date_add(date'2024-01-05', n_nationkey)").alias("onset"), F.expr("case n_nationkey % 3 when 0 then 'company' when 1 then 'geo_one' else 'geo_multi' end").alias("axis"), F.array("n_name").alias("t_geographies"), (F.col("n_nationkey") % 10 + 1).cast("long").alias("sup_key"), (F.col("n_nationkey") + 1).cast("long").alias("part_key"))
    t = t.join(c.select(F.col("s_suppkey").alias("sup_key"), F.array("s_name").alias("t_companies")), "sup_key", "left")
    return t.join(p.select(F.col("p_partkey").alias("part_key"), F.array("p_name").alias("t_commodities")), "part_key", "left").drop("sup_key", "part_key")


def leads(spark: SparkSession, d: str) -> DataFrame:
    """Scored signals at scale: one per lineitem, with its order's date as the onset."""
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = i.join(o, i.l_orderkey == o.o_orderkey)
    k = F.col("l_linenumber") % 3
    return j.select(
        (F.col("o_custkey") % 17).cast("int").alias("event"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sid"), F.to_date("l_shipdate").alias("day"), F.datediff("o_orderdate", "l_shipdate").alias("lead"),
        F.round(F.col("l_discount") * 10, 3).alias("conf"), (F.col("l_returnflag") == "R").alias("is_tp"), (k != 2).alias("forward"), ((F.col("l_quantity").cast("int") % 5) / 4).alias("g"), F.col("l_linestatus").alias("arm"),
        (F.col("l_linenumber") % 5 + 1).alias("sev"),
    )


#: The same tables for the oracle.
SIGNALS = """signals as (select event_id, cast(ts as date) as day, case event_type when 'view' then 'forward_looking' when 'click' then 'latent' when 'purchase' then 'confirmation' end as temporality,
 event_type = 'error' as failed, cast(json_extract_string(props, '$.k') as int) / 100.0 as conf, n_name as geo, s_name as co, case when user_id % 2 = 0 then array_to_string([x[1] for x in string_split(p_name, ' ')], '') else p_name end as good, user_id
 from events left join nation on n_nationkey = user_id % 25 left join supplier on s_suppkey = user_id % 10 + 1 left join part on p_partkey = user_id % 50 + 1)"""
TRUTH = """truth as (select n_name as truth_id, n_nationkey as ev_ord, date '2024-01-05' + n_nationkey as onset, case n_nationkey % 3 when 0 then 'company' when 1 then 'geo_one' else 'geo_multi' end as axis,
 n_name as t_geo, s_name as t_co, p_name as t_good from nation left join supplier on s_suppkey = n_nationkey % 10 + 1 left join part on p_partkey = n_nationkey + 1)"""
LEADS = """leads as (select cast(o_custkey % 17 as int) as event, l_orderkey * 10 + l_linenumber as sid, cast(l_shipdate as date) as day, date_diff('day', cast(l_shipdate as date), cast(o_orderdate as date)) as lead,
 round(l_discount * 10, 3) as conf, l_returnflag = 'R' as is_tp, l_linenumber % 3 <> 2 as forward, (cast(l_quantity as int) % 5) / 4.0 as g, l_linestatus as arm, l_linenumber % 5 + 1 as sev from lineitem join orders on l_orderkey = o_orderkey)"""
