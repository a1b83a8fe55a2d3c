"""Replay of vehicle routes under time, load and energy, as a fold over a route's ordered stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerance of the checks, battery, charging power (kWh, kW) and efficiency.
TOLERANCE, BATTERY, POWER, EFFICIENCY = 1e-5, 100.0, 100.0, 1.0


def charge_seconds(energy: Column) -> Column:
    return energy / (EFFICIENCY * POWER) * 3600


def replayed(routes: DataFrame, start: float, capacity: float) -> DataFrame:
    """`routes` (with stops: array of at, travel_s, energy, demand, tw0, tw1, service_s, station) with end_s,
    battery, load and how often windows, battery and load were violated.

    A vehicle waits for a window, and leaves a station full. A route is bounded by a vehicle's day,
    so its array is small; routes never meet in a task by more than chance.
    """
    zero = F.struct(
        F.lit(start).alias("t"), F.lit(BATTERY).alias("battery"), F.lit(capacity).alias("load"), F.lit(0).alias("late"), F.lit(0).alias("empty"), F.lit(0).alias("over"))

    def step(s: Column, x: Column) -> Column:
        arrival = F.greatest(s["t"] + x["travel_s"], x["tw0"])
        battery, load = s["battery"] - x["energy"], s["load"] - x["demand"]
        leave = arrival + x["service_s"] + F.when(x["station"], charge_seconds(BATTERY - battery)).otherwise(0.0)
        return F.struct(
            leave.alias("t"), F.when(x["station"], F.lit(BATTERY)).otherwise(battery).alias("battery"), load.alias("load"), (s["late"] + (arrival > x["tw1"] + TOLERANCE).cast("int")).alias("late"),
            (s["empty"] + (battery < -TOLERANCE).cast("int")).alias("empty"), (s["over"] + (load < -TOLERANCE).cast("int")).alias("over"))

    return routes.withColumn("_s", F.aggregate("stops", zero, step)).select(
        *(c for c in routes.columns if c != "stops"), F.size("stops").cast("bigint").alias("n"), F.col("_s.t").alias("end_s"), "_s.battery", "_s.load", "_s.late", "_s.empty", "_s.over")


def penalties(routes: DataFrame, start: float, capacity: float) -> DataFrame:
    """`routes` (with stops: array as of `replayed`, at charging stations without demand and service) with load_pen,
    time_pen, battery_pen and whether the route is `feasible`.

    Lateness counts at each stop and is carried on, and so is a battery that is overdrawn, until the next station
    gives back what was used since the last one. A route without customers is not feasible.
    """
    zero = F.struct(F.lit(start).alias("t"), F.lit(0.0).alias("used"), F.lit(0.0).alias("load"), F.lit(0.0).alias("late"), F.lit(0.0).alias("short"), F.lit(True).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        arrival, used = F.greatest(s["t"] + x["travel_s"], x["tw0"]), s["used"] + x["energy"]
        return F.struct(
            (arrival + F.when(x["station"], charge_seconds(used)).otherwise(x["service_s"])).alias("t"), F.when(x["station"], 0.0).otherwise(used).alias("used"), (s["load"] + x["demand"]).alias("load"),
            (s["late"] + F.greatest(F.lit(0.0), arrival - x["tw1"])).alias("late"), (s["short"] + F.greatest(F.lit(0.0), used - BATTERY)).alias("short"), (s["kept"] & (arrival <= x["tw1"] + TOLERANCE) & (used <= BATTERY + TOLERANCE)).alias("kept"))

    served = F.exists("stops", lambda x: ~x["station"])
    return routes.withColumn("_s", F.aggregate("stops", zero, step)).select(
        *routes.columns, F.greatest(F.lit(0.0), F.col("_s.load") - capacity).alias("load_pen"), F.col("_s.late").alias("time_pen"), F.col("_s.short").alias("battery_pen"),
        (F.col("_s.kept") & (F.col("_s.load") <= capacity + TOLERANCE) & served).alias("feasible"))


def steps(routes: DataFrame, start: float) -> DataFrame:
    """(route_id, step, t, battery) after each stop of `routes` (as of `replayed`), steps from 1, without checks."""
    state = "array<struct<t: double, battery: double>>"

    def step(states: Column, x: Column) -> Column:
        last = F.element_at(states, -1)
        battery = last["battery"] - x["energy"]
        leave = F.greatest(last["t"] + x["travel_s"], x["tw0"]) + x["service_s"] + F.when(x["station"], charge_seconds(BATTERY - battery)).otherwise(0.0)
        return F.concat(states, F.array(F.struct(leave.alias("t"), F.when(x["station"], F.lit(BATTERY)).otherwise(battery).alias("battery"))).cast(state))

    first = F.array(F.struct(F.lit(start).alias("t"), F.lit(BATTERY).alias("battery"))).cast(state)
    rows = routes.select("route_id", F.posexplode(F.slice(F.aggregate("stops", first, step), 2, F.size("stops"))).alias("step", "s"))
    return rows.select("route_id", (F.col("step") + 1).alias("step"), "s.t", "s.battery")
