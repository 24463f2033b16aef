"""Trigger rules over snapshots of a system's state: each criterion is true, false, or NULL where its signal is missing.

``criteria``: (trigger_id, ord, enabled, kind, op, number, number2, text, texts array, flag). ``snapshots``: (ts, idle_s, ssid, cpu, battery,
adapter, displays, builtin_displays, audio, ips array, apps array, frontmost, dns array, volumes array, vpns array, bluetooth array, usb array, ...);
a signal without a column is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparklode.functions.text import ip_key, ip_key_of


def compared(value: Column, op: Column, against: Column) -> Column:
    return F.when(op == "<", value < against).when(op == ">", value > against).when(op == "=", value == against)


def schedule(ts: Column, days: Column, start: Column, end: Column) -> Column:
    """Weekdays (1: Sunday) and minutes of the day; past midnight the day before counts, and equal ends are the whole day."""
    minute, day = F.hour(ts) * 60 + F.minute(ts), F.dayofweek(ts)
    before = F.pmod(day + 5, F.lit(7)) + 1
    on = lambda d: F.array_contains(days, d.cast("string"))
    return (
        F.when(start == end, on(day))
        .when(start < end, on(day) & (minute >= start) & (minute < end))
        .otherwise(on(day) & (minute >= start) | on(before) & (minute < end))
    )


#: Signals of a snapshot.
SIGNALS = dict.fromkeys(("idle_s", "cpu", "battery"), "double") | {"ssid": "string", "audio": "string", "adapter": "boolean", "displays": "int", "builtin_displays": "int"}
SIGNALS |= dict.fromkeys(("ips", "apps", "frontmost", "dns", "volumes", "vpns", "bluetooth", "usb"), "array<string>")


def tests(c: Mapping[str, Column] | Column, ends: tuple[Column, Column] | None = None) -> dict[str, Callable[[], Column]]:
    """By kind, whether a snapshot meets a criterion (a struct, or its settings by name); NULL where its signal is missing. ``ends``: keys of an address range, if known."""
    number, op, texts = c["number"], c["op"], c["texts"]
    among = lambda have: F.arrays_overlap(F.coalesce(have, F.array().cast("array<string>")), texts)
    one_of = lambda name: F.when(F.col(name).isNotNull(), F.array_contains(texts, F.col(name)))

    def battery() -> Column:
        level = F.when(F.col("battery").isNotNull(), compared(F.col("battery"), op, number))
        both = F.when(c["text"] == "and", level & F.col("adapter")).otherwise(level | F.col("adapter"))
        return F.when(c["text"].isNull(), level).otherwise(both)

    def between() -> Column:
        low, high = ends or (ip_key(F.get(texts, 0)), ip_key(F.get(texts, 1)))
        return F.exists(F.transform(F.coalesce("ips", F.array().cast("array<string>")), ip_key), lambda k: k.between(low, high))

    listed = {"app": "apps", "frontmost": "frontmost", "dns": "dns", "volume": "volumes", "vpn": "vpns", "bluetooth": "bluetooth", "usb": "usb"}
    return {
        "idle": lambda: compared(F.col("idle_s") / 60, op, number),
        "wifi": lambda: one_of("ssid"),
        "cpu": lambda: compared(F.col("cpu"), op, number),
        "displays": lambda: compared(F.col("displays") - F.when(c["flag"], F.col("builtin_displays")).otherwise(0), op, number),
        "battery": battery,
        "power": lambda: F.col("adapter") == c["flag"],
        "audio": lambda: one_of("audio"),
        **{k: lambda name=name: among(F.col(name)) for k, name in listed.items()},
        "ip": between,
        "schedule": lambda: schedule(F.col("ts"), texts, number, c["number2"]),
        "date": lambda: F.date_format("ts", "yyyy-MM-dd") == c["text"],
    }


def met(c: Column) -> Column:
    """Whether a snapshot meets a criterion whose kind is a value of its row."""
    out = F.lit(None).cast("boolean")
    for kind, test in tests(c).items():
        out = F.when(c["kind"] == kind, test()).otherwise(out)
    return out


#: Criteria that are compiled to columns; a longer list of settings is looked through by each row.
COMPILED = 200
SETTINGS = {"op": "string", "number": "double", "number2": "double", "text": "string", "flag": "boolean"}


def _compiled(rows: DataFrame, criteria: list[Row], key: str) -> DataFrame:
    """Each rule as columns: the one test that each criterion is, with its settings as literals."""
    rules: dict[tuple[int, str], dict[str, list[Column]]] = {}
    for c in criteria:
        settings = {k: F.lit(c[k]).cast(kind) for k, kind in SETTINGS.items()} | {"texts": F.array(*map(F.lit, c["texts"] or [])).cast("array<string>")}
        ends = tuple(F.lit(ip_key_of(t)).cast("string") for t in [*(c["texts"] or []), None, None][:2])
        test = tests(settings, ends).get(c["kind"], lambda: F.lit(None).cast("boolean"))
        rules.setdefault((c["ord"], c["trigger_id"]), {}).setdefault(c["kind"], []).append(test())
    out = []
    for (place, name), kinds in sorted(rules.items()):
        listed = lambda odd, kinds=kinds: F.concat_ws(",", *(F.when(reduce(Column.__or__, map(odd, kinds[k])), k) for k in sorted(kinds)))
        every = reduce(Column.__and__, (F.coalesce(m, F.lit(False)) for ms in kinds.values() for m in ms))
        out.append(F.struct(F.lit(name).alias("trigger_id"), F.lit(place).alias("ord"), every.alias("matched"), listed(lambda m: F.coalesce(~m, F.lit(False))).alias("failed"), listed(lambda m: m.isNull()).alias("unavailable")))
    if not out:
        return rows.select(key, F.lit("").alias("trigger_id"), F.lit(0).alias("ord"), F.lit(False).alias("matched"), F.lit("").alias("failed"), F.lit("").alias("unavailable")).limit(0)
    return rows.select(key, F.explode(F.array(*out)).alias("_r")).select(key, "_r.*")


def evaluated(snapshots: DataFrame, criteria: DataFrame, key: str = "ts", compiled: int = COMPILED) -> DataFrame:
    """(key, trigger_id, ord, matched, failed, unavailable): every snapshot against every enabled rule; ``key`` names the snapshot.

    The rules are a list of settings: a short one is compiled into the projection, a longer one is one row of arrays that goes to every
    task. Either way snapshots aren't exchanged, and the results are the same.
    """
    some = criteria.filter("enabled").limit(compiled + 1).collect()
    if len(some) <= compiled:
        known = snapshots.withColumns({c: F.lit(None).cast(kind) for c, kind in SIGNALS.items() if c not in snapshots.columns})
        return _compiled(known, some, key)
    one = criteria.filter("enabled").groupBy("trigger_id", "ord").agg(F.collect_list(F.struct("kind", "op", "number", "number2", "text", "texts", "flag")).alias("criteria"))
    rules = one.agg(F.array_sort(F.collect_list(F.struct("ord", "trigger_id", "criteria"))).alias("_rules"))
    rows = snapshots.withColumns({c: F.lit(None).cast(kind) for c, kind in SIGNALS.items() if c not in snapshots.columns}).crossJoin(F.broadcast(rules))
    each = lambda r: F.transform(r["criteria"], lambda c: F.struct(c["kind"].alias("kind"), met(c).alias("met")))
    rows = rows.select(F.col(key), F.explode(F.transform("_rules", lambda r: F.struct(r["ord"].alias("ord"), r["trigger_id"].alias("trigger_id"), each(r).alias("found")))).alias("_r"))
    found = F.col("_r.found")
    kinds = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(found, keep), lambda f: f["kind"]))), ",")
    return rows.select(
        key,
        "_r.trigger_id",
        "_r.ord",
        F.forall(found, lambda f: F.coalesce(f["met"], F.lit(False))).alias("matched"),
        kinds(lambda f: ~f["met"]).alias("failed"),
        kinds(lambda f: f["met"].isNull()).alias("unavailable"),
    )


def first_matching(results: DataFrame, key: str = "ts") -> DataFrame:
    """(key, trigger_id): the first rule in list order that matches each snapshot, NULL if none does."""
    return results.groupBy(key).agg(F.min_by(F.when(F.col("matched"), F.col("trigger_id")), F.when(F.col("matched"), F.col("ord"))).alias("trigger_id"))


LISTED = ("wifi", "audio", "app", "frontmost", "dns", "volume", "vpn", "bluetooth", "usb")


def valid_identifier(value: Column, most: Column | int = 1024) -> Column:
    """Something is left when blanks around it go, it has no control or format characters, and it isn't too long in UTF-8."""
    t = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.coalesce((t != "") & (F.octet_length(t) <= most) & ~F.rlike(t, F.lit(r"[\p{Cc}\p{Cf}]")), F.lit(False))


def valid_criterion() -> Column:
    """Whether a criterion (kind, op, number, number2, text, texts, flag) may be stored."""
    kind, n, texts = F.col("kind"), F.col("number"), F.coalesce("texts", F.array().cast("array<string>"))
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    listed = (F.size(texts) > 0) & F.forall(texts, lambda t: valid_identifier(t, F.when(kind == "wifi", 32).otherwise(1024)))
    days = (F.size(texts) > 0) & F.forall(texts, lambda t: t.isin(*"1234567"))
    ends = F.transform(F.slice(texts, 1, 2), ip_key)
    low, high = F.get(ends, 0), F.get(ends, 1)
    out = (
        F.when(kind == "idle", finite & (n > 0))
        .when(kind == "cpu", finite & n.between(0, 100))
        .when(kind == "displays", finite & (n >= 0))
        .when(kind == "battery", (n.isNotNull() | F.col("flag").isNotNull()) & (n.isNull() | finite & n.between(0, 100)))
        .when(kind == "power", F.col("flag").isNotNull())
        .when(kind == "schedule", days & n.between(0, 1439) & F.col("number2").between(0, 1439))
        .when(kind == "ip", (F.left(low, F.lit(1)) == F.left(high, F.lit(1))) & (low <= high))
        .when(kind == "date", F.try_to_date("text", "yyyy-MM-dd").isNotNull())
        .when(kind.isin(*LISTED), listed)
    )
    return F.coalesce(out, F.lit(False))


def invalid(criteria: DataFrame) -> DataFrame:
    """Rules that can't be stored: a kind twice, or a criterion that isn't valid."""
    twice = criteria.groupBy("trigger_id", "kind").count().filter("count > 1").select("trigger_id")
    return twice.union(criteria.filter(~valid_criterion()).select("trigger_id")).distinct()
