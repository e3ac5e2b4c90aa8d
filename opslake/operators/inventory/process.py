"""Processes: status facts, open files, TCP sockets, top CPU users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.text import bind, field, fields, once, tail, trim
from opslake.operators.inventory.timers import pick_keys

# Status keys, TCP state codes, processes shown.
STATUS_KEYS = ["Name", "State", "VmRSS", "Threads", "Uid"]
TCP_STATES = {
    "01": "ESTABLISHED", "02": "SYN_SENT", "03": "SYN_RECV", "04": "FIN_WAIT1", "05": "FIN_WAIT2",
    "06": "TIME_WAIT", "07": "CLOSE", "08": "CLOSE_WAIT", "09": "LAST_ACK", "0A": "LISTEN", "0B": "CLOSING",
}
TOP_PROCESSES = 15


def facts(df: DataFrame) -> DataFrame:
    """Name, state, memory, threads and real uid per (host, pid); '' when absent."""
    at = F.instr("line", ":")
    kv = df.filter(at > 0).withColumns({
        "key": F.substring(F.col("line"), F.lit(1), at - 1),
        "value": trim(F.substring(F.col("line"), at + 1, F.length("line")))})
    wide = pick_keys(kv, ["host", "pid"], STATUS_KEYS, "line_no")
    return wide.select("host", "pid", F.col("Name").alias("name"), F.col("State").alias("state"),
                       F.col("VmRSS").alias("rss"), F.col("Threads").alias("threads"),
                       field(fields(F.col("Uid")), 0).alias("uid"))


def fd_label(target: Column) -> Column:
    return (F.when(target.startswith("socket:["), "socket (anonymous)")
            .when(target.startswith("pipe:["), "pipe (anonymous)").otherwise(target))


def open_files(df: DataFrame) -> DataFrame:
    """Distinct open files per process with the first descriptor of each."""
    return df.groupBy("host", "pid", fd_label(F.col("target")).alias("label")).agg(F.min("fd").alias("first_fd"))


def _hex(c: Column) -> Column:
    return F.conv(c, 16, 10)


def decode_address(raw: Column) -> Column:
    """``0100007F:0050`` -> ``127.0.0.1:80``; text of another shape is left as it is."""
    def parts(a: Column) -> Column:
        p = F.regexp_extract(raw, r"^[^:]*:\s*([0-9A-Fa-f]+)", 1)
        port = F.when(p != "", (F.conv(p, 16, 10).cast("bigint") % 65536).cast("string"))
        byte = lambda i: _hex(F.substring(a, i, 2))
        v4 = F.concat_ws(".", byte(7), byte(5), byte(3), byte(1))
        # every 4-byte word is stored reversed
        swapped = F.regexp_replace(F.lower(a), "(..)(..)(..)(..)", "$4$3$2$1")
        v6 = F.concat(F.lit("["), F.rtrim(F.regexp_replace(swapped, "(....)", "$1:"), F.lit(":")), F.lit("]"))
        with_port = lambda ip: F.when(port.isNull(), ip).otherwise(F.concat(ip, F.lit(":"), port))
        return (F.when(a.rlike("^[0-9A-Fa-f]{8}$"), with_port(v4))
                .when(a.rlike("^[0-9A-Fa-f]{32}$"), with_port(v6)).otherwise(raw))
    return F.when(~F.contains(raw, F.lit(":")), raw).otherwise(bind(F.substring_index(raw, ":", 1), parts))


def tcp_sockets(df: DataFrame) -> DataFrame:
    """State and endpoints of every socket line; an unset remote is ''."""
    rows = once(df, "f", fields(F.col("line"))).filter(F.size("f") >= 4)
    code = field(F.col("f"), 3)
    known = F.create_map(*[x for k, v in TCP_STATES.items() for x in (F.lit(k), F.lit(v))])
    rows = rows.select(
        "host", "pid", "line_no",
        F.coalesce(F.try_element_at(known, F.upper(code)), F.concat(F.lit("state-"), code)).alias("state"),
        decode_address(field(F.col("f"), 1)).alias("local"), decode_address(field(F.col("f"), 2)).alias("remote"))
    rows = rows.withColumn("remote", F.when(F.col("remote").isin("0.0.0.0:0", "[::]:0"), "").otherwise(F.col("remote")))
    line = F.concat(F.lit("tcp  "), "state", F.lit("  local="), "local", F.when(
        F.col("remote") != "", F.concat(F.lit("  remote="), "remote")).otherwise(""))
    return rows.withColumn("summary", line)


def tcp_state_counts(sockets: DataFrame) -> DataFrame:
    return sockets.groupBy("host", "state").agg(F.count(F.lit(1)).alias("n"))


def top_processes(df: DataFrame, n: int = TOP_PROCESSES) -> DataFrame:
    """The ``n`` busiest processes per host; the rank filter limits groups before the shuffle."""
    f = fields(F.col("line"))
    rows = once(df, "f", f).filter(F.size("f") >= 11).select(
        "host", "pid", field(F.col("f"), 2).try_cast("decimal(10,1)").alias("cpu"), tail(F.col("f"), 10).alias("command"))
    w = Window.partitionBy("host").orderBy(F.desc("cpu"), "pid")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
