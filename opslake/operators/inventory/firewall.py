"""Firewall rules of four backends as one table, read status, cross-check, findings.

Input lines are (host, backend, line_no, line); firewalld lines carry their ``zone``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import bind, field, fields, once, tail, trim
from opslake.operators.inventory.ports import LOOPBACK, split_local
from opslake.plans.partitioning import carry_forward

# Line starts that are nft rules, and nft verdict names.
NFT_STARTS = ["tcp dport", "udp dport", "tcp sport", "ip protocol", "iif", "oif", "ct state"]
CRITICAL_PORTS = {22: "SSH", 443: "HTTPS", 53: "DNS"}
MANAGEMENT_PORTS = {3306: "MySQL", 5432: "PostgreSQL", 6379: "Redis", 27017: "MongoDB", 9090: "Cockpit"}
ANY_SOURCE = ["", "any", "Anywhere", "0.0.0.0/0", "::/0"]
SERVICE_PORTS = {"ssh": 22, "http": 80, "https": 443, "dns": 53, "cockpit": 9090,
                 "mysql": 3306, "postgresql": 5432, "redis": 6379, "mongodb": 27017}

RULE_COLUMNS = ["host", "backend", "line_no", "item", "chain", "action", "protocol", "port", "source", "comment", "match"]
NUMBERS = r"^[0-9]+([-:][0-9]+)?$"
#: Ports of a bin; whole bins stand for their ports where rules and listeners meet.
PORT_BIN = 256
LAST_PORT = 65535


def _rule(**given: Column | str) -> Column:
    values = {"item": F.lit(0)} | {c: F.lit("") for c in RULE_COLUMNS[4:]} | given
    return F.struct(*[values[c].alias(c) for c in RULE_COLUMNS[3:]])


def _firewalld(line: Column) -> Column:
    """Ports, services, sources and rich rules of a zone listing."""
    def of_kind(kind: Column) -> Column:
        rest = F.substring(line, F.length(kind) + 2, F.length(line))
        values = F.when(kind == "rich-rules", F.filter(F.array(trim(rest)), lambda x: x != "")).otherwise(fields(rest))

        def rule(v: Column, i: Column) -> Column:
            is_port = kind == "ports"
            return _rule(
                item=i, chain=F.col("zone"), action=F.when(kind == "rich-rules", "RULE").otherwise("ALLOW"),
                protocol=F.when(is_port & F.contains(v, F.lit("/")), F.regexp_extract(v, r"^[^/]*/(.*)$", 1))
                .when(is_port, "tcp").otherwise(""),
                port=F.when(is_port, F.substring_index(v, "/", 1)).otherwise(""),
                source=F.when(is_port, "any").when(kind == "sources", v).otherwise(""),
                comment=F.when(kind == "services", F.concat(F.lit("service: "), v)).when(kind == "sources", "trusted source")
                .when(kind == "rich-rules", F.concat(F.lit("rich rule: "), v)).otherwise(""))
        return F.when(kind != "", F.transform(values, rule))
    return bind(F.regexp_extract(line, r"^(ports|services|sources|rich-rules):", 1), of_kind)


def _ufw(line: Column, f: Column) -> Column:
    """Numbered ufw rules: the first ``port/proto`` field and what follows it."""
    places = F.sequence(F.lit(0), F.size(f) - 1)

    def of_place(at: Column) -> Column:
        way = F.get(f, at + 2)
        sources = F.filter(f, lambda x: (x == "Anywhere") | F.contains(x, F.lit(".")) | F.contains(x, F.lit(":")))
        note_at = F.get(F.filter(places, lambda i: (i > at) & F.get(f, i).startswith("(")), F.lit(0))
        note = bind(note_at, lambda i: F.when(i.isNotNull(), F.array_join(F.slice(f, i + 1, F.size(f) - i), " ")))
        return F.when(at + 1 < F.size(f), F.array(_rule(
            action=F.concat(F.get(f, at + 1), F.when(way.isin("IN", "OUT"), F.concat(F.lit(" "), way)).otherwise("")),
            port=F.substring_index(F.get(f, at), "/", 1), protocol=F.regexp_extract(F.get(f, at), r"^[^/]*/(.*)$", 1),
            source=F.coalesce(F.get(sources, F.size(sources) - 1), F.lit("")),
            comment=F.coalesce(F.btrim(note, F.lit("()")), F.lit("")))))
    first = F.get(F.filter(places, lambda i: F.contains(F.get(f, i), F.lit("/"))), F.lit(0))
    return F.when((F.size(f) >= 4) & ~line.startswith("Status:") & ~line.startswith("To"), bind(first, of_place))


def _nft(line: Column, f: Column) -> Column:
    """nft rules; port sets are joined by commas, ``match`` is what stands before the verdict."""
    wanted = reduce(lambda a, b: a | b, [line.startswith(s) for s in NFT_STARTS])
    at = F.element_at(F.filter(F.sequence(F.lit(0), F.size(f) - 1),
                               lambda i: (F.get(f, i) == "dport") & (i + 1 < F.size(f))), -1)

    def port(i: Column) -> Column:
        after = F.slice(f, i + 3, F.size(f))
        end = F.array_position(after, "}")
        inside = F.when(end > 0, F.slice(after, F.lit(1), (end - 1).cast("int"))).otherwise(after)
        in_set = F.array_join(F.transform(inside, lambda x: F.rtrim(x, F.lit(","))), ",")
        return F.when(i.isNull(), "").when(F.get(f, i + 1) == "{", in_set).otherwise(F.get(f, i + 1))
    return F.when(~line.startswith("chain ") & (wanted | line.isin("drop", "accept")), F.array(_rule(
        chain=F.coalesce("chain_name", F.lit("")), action=F.upper(F.element_at(f, -1)),
        protocol=F.when(F.contains(line, F.lit("tcp ")), "tcp").when(F.contains(line, F.lit("udp ")), "udp").otherwise("all"),
        port=bind(F.when(F.array_contains(f, "dport"), at), port), match=F.array_join(F.slice(f, F.lit(1), F.size(f) - 1), " "))))


def _iptables(line: Column, f: Column) -> Column:
    """iptables listing: one rule per default policy and per line, with its chain."""
    header = line.startswith("Chain ")
    policy = F.regexp_replace(F.regexp_extract(line, r"\(policy (.*?)(?=\(policy |$)", 1), r"\)$", "")
    plain = ~line.startswith("target") & ~line.startswith("pkts") & (F.size(f) >= 4) & F.col("chain_name").isNotNull()
    ports = F.filter(f, lambda x: x.startswith("dpt:"))
    proto = field(f, 1)
    return F.when(header, F.when(F.contains(line, F.lit("(policy ")), F.array(_rule(
        chain=F.col("chain_name"), action=F.upper(policy), comment=F.lit("default policy"))))).when(plain, F.array(_rule(
            chain=F.col("chain_name"), action=field(f, 0), protocol=F.when(proto == "0", "all").otherwise(proto),
            port=F.when(F.size(ports) == 0, "").otherwise(F.substring(F.element_at(ports, -1), F.lit(5), F.length(line))),
            source=field(f, 3), match=tail(f, 5))))


def all_rules(df: DataFrame, backends: Iterable[str] = ("firewalld", "ufw", "nftables", "iptables")) -> DataFrame:
    """Rules of the given backends in one pass: a line becomes an array of rules, in its chain."""
    rows = once(df.filter(F.col("backend").isin(*backends)).withColumn("line", trim(F.col("line"))), "f", fields(F.col("line")))
    line, f, backend = F.col("line"), F.col("f"), F.col("backend")
    if {"nftables", "iptables"} & set(backends):
        starts = F.when(backend == "nftables", line.startswith("chain ")).otherwise(
            (backend == "iptables") & line.startswith("Chain ") & (F.size("f") >= 2))
        rows = carry_forward(rows, ["host", "backend"], "line_no", F.when(starts, field(f, 1)), "chain_name")
    parsers = {"firewalld": lambda: _firewalld(line), "ufw": lambda: _ufw(line, f), "nftables": lambda: _nft(line, f),
               "iptables": lambda: _iptables(line, f)}
    rules = reduce(lambda c, b: c.when(backend == b, parsers[b]()), backends, F)
    return rows.filter("line <> ''").select("host", "backend", "line_no", F.inline(rules))


def firewalld_rules(df: DataFrame) -> DataFrame:
    return all_rules(df, ["firewalld"])


def ufw_rules(df: DataFrame) -> DataFrame:
    return all_rules(df, ["ufw"])


def nft_rules(df: DataFrame) -> DataFrame:
    return all_rules(df, ["nftables"])


def iptables_rules(df: DataFrame) -> DataFrame:
    return all_rules(df, ["iptables"])


def read_status(reads: DataFrame, rules: DataFrame) -> DataFrame:
    """none, failed, partial, empty or ok per host, from the warning and the rule count."""
    counts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("rules"))
    warned = F.col("warning") != ""
    n = F.coalesce("rules", F.lit(0))
    return reads.join(counts, "host", "left").select(
        "host", "backend", "warning", n.alias("rules"),
        F.when(F.col("backend") == "", "none").when(warned & (n == 0), "failed").when(warned, "partial")
        .when(n == 0, "empty").otherwise("ok").alias("read_status"))


def _numbered(port: Column) -> Column:
    """The parts of a port text, with known service names as numbers."""
    known = F.create_map(*[x for k, v in SERVICE_PORTS.items() for x in (F.lit(k), F.lit(str(v)))])
    return F.transform(F.split(port, ","), lambda p: F.coalesce(F.try_element_at(known, p), p))


def unresolved_ports(port: Column) -> Column:
    """Parts of a port text that name no known port."""
    return F.filter(_numbered(port), lambda p: (p != "") & ~p.rlike(NUMBERS))


def port_ranges(port: Column) -> Column:
    """array<struct<lo,hi>> of ``80,https,8000-8100`` or ``80:90``; names not known are left out."""
    parts = F.filter(_numbered(port), lambda p: p.rlike(NUMBERS))
    return F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("int").alias("lo"),
        F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("int").alias("hi")))


def is_allow(action: Column) -> Column:
    return action.startswith("ALLOW") | (action == "ACCEPT")


def is_closed(action: Column) -> Column:
    return action.rlike("^(DROP|REJECT|DENY)")


def _match(rules: DataFrame) -> Column:
    return F.col("match") if "match" in rules.columns else F.lit("")


def port_text(match: Column) -> Column:
    """The ports of a rule: those listed, else those its match text names (several, or a range)."""
    several = F.regexp_extract(match, r"(?:^| )multiport dports ([0-9A-Za-z,:-]+)(?: |$)", 1)
    span = F.regexp_extract(match, r"(?:^| )dpts:([0-9]+:[0-9]+)(?: |$)", 1)
    return F.when(F.col("port") != "", F.col("port")).when(several != "", several).otherwise(span)


def _unlimited(match: Column) -> Column:
    """Whether nothing but ports and protocol narrows a rule: no source, state, interface or rate."""
    iptables = r"(?:^| )(?:tcp|udp|dpts?:[0-9:]+|multiport dports [^ ]+|reject-with [^ ]+|/\*.*\*/)(?= |$)"
    rest = F.when(F.col("backend") == "nftables", F.regexp_replace(match, r"^(?:tcp|udp) dport (?:\{[^}]*\}|[^ {]+)$", "")).otherwise(
        F.btrim(F.regexp_replace(match, iptables, "")))
    return F.col("source").isin(ANY_SOURCE) & (rest == "")


def _cells(lo: Column, hi: Column) -> Column:
    """Cells of a port range: 0 for all ports, else whole bins and single ports; a range of no port keeps its bounds."""
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    def of(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        first, last = F.ceil(lo / PORT_BIN), F.floor((hi + 1) / PORT_BIN) - 1
        single = lambda a, b: F.transform(upto(a, b), _port_cell)
        return (
            F.when((lo > hi) | (lo > LAST_PORT), F.array(F.lit(3 << 40) + F.shiftleft(F.least(lo, F.lit((1 << 20) - 1)), 20)
                                                         + F.least(hi, F.lit((1 << 20) - 1))))
            .when((lo <= 0) & (hi >= LAST_PORT), F.array(F.lit(0).cast("bigint")))
            .when(first > last, single(lo, hi))
            .otherwise(F.concat(F.transform(upto(first, last), lambda b: b + F.lit(1 << 20)),
                                single(lo, first * PORT_BIN - 1), single((last + 1) * PORT_BIN, hi))))
    high = F.when(lo.cast("bigint") <= LAST_PORT, F.least(hi.cast("bigint"), F.lit(LAST_PORT))).otherwise(hi.cast("bigint"))
    return bind(F.struct(lo.cast("bigint").alias("lo"), F.when(lo <= hi, high).otherwise(hi.cast("bigint")).alias("hi")), of)


def _port_cell(port: Column) -> Column:
    return port.cast("bigint") + F.lit(2 << 20)


def first_matches(rules: DataFrame) -> DataFrame:
    """(host, protocol, chain, cell, first): the first rule of an inbound chain that decides a cell.

    ``first`` is (tier, line_no, item, allow): rules in their order, then the default policy, then
    the refusal that ends every firewall (in chain ''). A rule decides only what it matches for every
    caller: closing rules with a source, state, rate or interface are passed over, as are accepted
    states. Opening rules for some sources open their ports. An iptables rule that accepts a whole
    protocol opens nothing: the listing does not show whether it holds for one interface only, so it
    is a finding of its own. Rules of OUTPUT and FORWARD chains say nothing about listeners.
    """
    match, action = _match(rules), F.col("action")
    service = F.regexp_extract("comment", "^service: (.*)$", 1)
    known = F.create_map(*[x for k, v in SERVICE_PORTS.items() for x in (F.lit(k), F.lit(v))])
    by_service = F.try_element_at(known, service)
    pair = lambda lo, hi: F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    policy, allow = F.col("comment") == "default policy", is_allow(action)
    whole = (policy & (F.upper("chain") == "INPUT")) | (
        ~policy & (port_text(match) == "") & _unlimited(match) & (is_closed(action) | ((F.col("backend") == "nftables") & (match == ""))))
    decides = ~F.upper("chain").isin("OUTPUT", "FORWARD") & ~action.endswith(" OUT") & (
        allow | (is_closed(action) & (policy | _unlimited(match))))
    ranges = F.when(decides, F.when(whole, pair(F.lit(0), F.lit(LAST_PORT))).when(~policy & (port_text(match) != ""), port_ranges(port_text(match)))
                    .when(by_service.isNotNull(), pair(by_service, by_service)))
    protocols = (F.when(F.col("protocol").isin("tcp", "6"), F.array(F.lit("tcp"))).when(F.col("protocol").isin("udp", "17"), F.array(F.lit("udp")))
                 .when(F.col("protocol").isin("", "all"), F.array(F.lit("tcp"), F.lit("udp"))))
    cells = F.flatten(F.transform(F.filter(ranges, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull()), lambda r: _cells(r["lo"], r["hi"])))
    entry = lambda chain, cell, tier, line, item, ok: F.struct(
        chain.alias("chain"), cell.alias("cell"), F.struct(
            tier.alias("tier"), line.cast("bigint").alias("line_no"), item.cast("int").alias("item"), ok.alias("allow")).alias("first"))
    own = F.flatten(F.transform(protocols, lambda p: F.transform(cells, lambda c: F.struct(p.alias("protocol"), entry(
        F.col("chain"), c, policy.cast("int"), F.col("line_no"), F.col("item"), allow).alias("e")))))
    end = F.transform(F.array(F.lit("tcp"), F.lit("udp")), lambda p: F.struct(p.alias("protocol"), entry(
        F.lit(""), F.lit(0).cast("bigint"), F.lit(2), F.lit(0), F.lit(0), F.lit(False)).alias("e")))
    each = rules.select("host", F.explode(F.concat(F.coalesce(own, F.slice(end, 1, 0)), end)).alias("x")).select("host", "x.protocol", "x.e.*")
    return each.groupBy("host", "protocol", "chain", "cell").agg(F.min("first").alias("first"))


_PIECES = "host string, protocol string, chain string, tier int, line_no long, item int, lo int, hi int"


def _swept(group: pa.Table) -> pa.Table:
    """Disjoint port ranges of one chain, each with the rule that decides it; only those that are open."""
    cells = group["cell"].to_numpy()
    deciding = [tuple(f.values()) for f in group["first"].to_pylist()]
    rules = sorted(set(deciding))  # tier, line_no, item, allow
    place = {r: i for i, r in enumerate(rules)}
    rank = np.array([place[r] for r in deciding], np.int64)
    level, at = cells >> 20, cells & ((1 << 20) - 1)
    bins, ports = level == 1, level == 2
    edges = np.concatenate(([0], at[bins] * PORT_BIN, (at[bins] + 1) * PORT_BIN, at[ports], at[ports] + 1))
    starts = np.unique(edges[edges <= LAST_PORT])
    none = len(rules)
    of_bin = np.full((LAST_PORT + 1) // PORT_BIN, none)
    of_bin[at[bins]] = rank[bins]
    best = np.minimum(of_bin[starts // PORT_BIN], rank[cells == 0].min(initial=none))
    where = np.searchsorted(starts, at[ports])
    best[where] = np.minimum(best[where], rank[ports])
    new = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    lo, decided = starts[new], best[new]
    hi = np.append(lo[1:], LAST_PORT + 1) - 1
    pieces = [(rules[r], a, b) for r, a, b in zip(decided.tolist(), lo.tolist(), hi.tolist()) if r < none]
    pieces += [(deciding[i], int(cells[i] >> 20 & ((1 << 20) - 1)), int(at[i])) for i in np.flatnonzero(cells >> 40 == 3).tolist()]
    kept = [(*r[:3], a, b) for r, a, b in pieces if r[3]]
    keys = [pa.array([group[c][0].as_py()] * len(kept), pa.string()) for c in ("host", "protocol", "chain")]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.table(keys + [pa.array([x[i] for x in kept], k) for i, k in enumerate(kinds)],
                    names=["host", "protocol", "chain", "tier", "line_no", "item", "lo", "hi"])


def open_ranges(rules: DataFrame) -> DataFrame:
    """Disjoint open port ranges of every inbound chain, with the rule (tier 0) or policy (tier 1) that opens them.

    A range that holds no port is kept as it is listed. A chain has at most a cell for every
    port and bin, however many rules it has.
    """
    return first_matches(rules).groupBy("host", "protocol", "chain").applyInArrow(_swept, _PIECES)


def _bins(ranges: DataFrame) -> DataFrame:
    """One row per 256-port bin a range touches, so the range join is an equi-join on bins."""
    first, last = F.floor(F.col("lo") / PORT_BIN), F.floor(F.least("hi", F.lit(LAST_PORT)) / PORT_BIN)
    return ranges.filter("lo <= hi").withColumn("bin", F.explode(F.sequence(first, last)))


def _outside(ports: DataFrame) -> DataFrame:
    return split_local(ports).filter(~F.col("address").rlike(LOOPBACK) & F.col("port").isNotNull())


def listeners(ports: DataFrame) -> DataFrame:
    """Distinct (host, protocol, port) reachable from outside the host."""
    return _outside(ports).select("host", "protocol", "port").distinct()


def unprotected_listeners(ports: DataFrame, rules: DataFrame) -> DataFrame:
    """Listeners of hosts with a readable firewall that no chain opens, by the first rule that decides the port."""
    port = F.col("port").cast("bigint")
    heard = _outside(ports).select("host", "protocol", "port", F.explode(F.array(
        F.lit(0).cast("bigint"), F.floor(port / PORT_BIN) + F.lit(1 << 20), _port_cell(port))).alias("cell"))
    deciding = F.sort_array(F.collect_set(F.struct("chain", "first")))  # three entries a chain at most
    met = heard.join(first_matches(rules), ["host", "protocol", "cell"]).groupBy("host", "protocol", "port").agg(deciding.alias("d"))
    firsts = lambda d: F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1)["chain"] != x["chain"]))
    return met.filter(~F.exists(firsts(F.col("d")), lambda x: x["first"]["allow"])).select("host", "protocol", "port")


def stale_rules(ports: DataFrame, rules: DataFrame) -> DataFrame:
    """Port ranges that a rule opens without any listener."""
    ranges = open_ranges(rules).filter("tier = 0").select("host", "protocol", "lo", "hi").distinct()
    heard = listeners(ports).withColumn("bin", F.floor(F.col("port") / PORT_BIN))
    used = _bins(ranges).join(heard, ["host", "protocol", "bin"]).filter(
        (F.col("port") >= F.col("lo")) & (F.col("port") <= F.col("hi")))
    return ranges.join(used.select("host", "protocol", "lo", "hi").distinct(), ["host", "protocol", "lo", "hi"], "left_anti")


def findings(rules: DataFrame) -> DataFrame:
    """Rules that open or close too much, with a severity."""
    match, ports = _match(rules), port_text(_match(rules))
    ranges = port_ranges(ports)
    covers = lambda known: reduce(lambda a, b: a | b, [_covers(ranges, p) for p in known])
    any_source = F.col("source").isin(ANY_SOURCE)
    allow = is_allow(F.col("action"))
    inbound = ~F.col("chain").isin("OUTPUT")
    wide = _covers(ranges, 1) & _covers(ranges, 65535)
    bare = (F.col("backend") == "iptables") & (ports == "") & (match == "")
    closed = is_closed(F.col("action"))
    finding = (
        F.when((F.col("comment") == "default policy") & (F.col("action") == "ACCEPT")
               & F.col("chain").isin("INPUT", "FORWARD"), "default policy accepts")
        .when(F.col("comment") == "default policy", None)
        .when(F.col("action") == "RULE", "rich rule to review")
        .when(allow & inbound & any_source & wide, "all ports open to any source")
        .when(allow & inbound & any_source & bare & (F.col("protocol") == "all"), "everything accepted, perhaps on one interface")
        .when(allow & inbound & any_source & bare & F.col("protocol").isin("tcp", "6", "udp", "17"), "whole protocol accepted, perhaps on one interface")
        .when(allow & inbound & any_source & covers(MANAGEMENT_PORTS), "management port open to any source")
        .when(allow & inbound & any_source & covers(CRITICAL_PORTS), "critical service open to any source")
        .when(closed & (covers(MANAGEMENT_PORTS) | covers(CRITICAL_PORTS)), "service blocked")
        .when(F.size(unresolved_ports(ports)) > 0, "port name not known"))
    severity = (
        F.when(F.col("finding").isin("all ports open to any source", "management port open to any source"), "critical")
        .when(F.col("finding").isin("rich rule to review", "port name not known"), "info").otherwise("warning"))
    return rules.withColumn("finding", finding).filter("finding is not null").withColumn("severity", severity)


def _covers(ranges: Column, port: int) -> Column:
    return F.exists(ranges, lambda r: (r["lo"] <= port) & (r["hi"] >= port))


def digest_line() -> Column:
    """The labelled fields of one rule; empty fields are left out."""
    labels = [("chain", "chain:    "), ("action", "action:   "), ("protocol", "protocol: "),
              ("port", "port:     "), ("source", "source:   "), ("comment", "comment:  ")]
    rows = F.array(*[F.when(F.col(c) != "", F.concat(F.lit("    " + label), c)) for c, label in labels])
    return F.concat(F.lit("  rule_"), F.col("number").cast("string"), F.lit(":\n"), F.array_join(rows, "\n"))
