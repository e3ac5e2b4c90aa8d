"""Inventory parsers and their relational parts on small captures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opslake.operators import digests, logs
from opslake.operators.inventory import crons, firewall, hosts, mounts, ports, process, timers, updates
from opslake.sources import captures


def lines(spark, text, **cols):
    rows = [(i, line) for i, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(rows, "line_no long, line string").withColumn("host", F.lit("h"))
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_capture_lines(spark):
    df = spark.createDataFrame([("h", "\n a \r\n\t\nb\u00a0")], "host string, output string")
    assert [(r.line_no, r.line) for r in captures.capture_lines(df, ["host"]).collect()] == [(1, "a"), (3, "b")]


def test_read_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    got = captures.read_log_files(spark, str(tmp_path)).collect()
    assert [r.line for r in got] == ["one", "two"] and got[0].file.endswith("a.log")


def test_the_end_of_a_file_in_many_splits(spark, tmp_path):
    text = [f"line {i} of the file" for i in range(3000)] + ["last error", "quiet"]
    (tmp_path / "big.log").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = captures.read_log_files(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        assert [r.line for r in read.orderBy("line_at").collect()] == text
        assert [r.line for r in logs.tail_filtered(read, ["file"], "line_at", lines_=5).collect()] == ["last error"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ports(spark):
    text = ('LISTEN 0 128 0.0.0.0:22 0.0.0.0:* users:(("sshd",pid=7,fd=3))\nLISTEN 0 128 0.0.0.0:22 0.0.0.0:* users:(("other",pid=9,fd=3))\n'
            'LISTEN 0 128 *\nLISTEN 0 128 * x\nLISTEN 0 5 [::]:5432 [::]:*\nLISTEN 0 5 127.0.0.1:6379 x users:(("redis",pid=1,fd=2))\n'
            'LISTEN 0 5 0.0.0.0:80 x users:(("python",pid=3,fd=2))\nLISTEN 0 5 10.0.0.1:40000 x nonsense')
    inv = ports.inventory(lines(spark, text, proto="tcp"))
    assert {(r.local, r.process) for r in inv.collect()} == {
        ("0.0.0.0:22", "sshd (pid 7)"), ("[::]:5432", ""), ("127.0.0.1:6379", "redis (pid 1)"),
        ("0.0.0.0:80", "python (pid 3)"), ("10.0.0.1:40000", "")}
    assert {(r.port, r.severity) for r in ports.exposure(inv).collect()} == {(5432, "warning"), (80, "warning")}


def rules(spark, backend, text):
    df = lines(spark, text, backend=backend, zone="public")
    return [r.asDict() for r in firewall.all_rules(df).orderBy("line_no", "item").collect()]


def test_firewalld(spark):
    got = rules(spark, "firewalld", "ports: 22/tcp 80/tcp 443\nservices: ssh\nsources:\nrich-rules:\n  rich-rules: rule x y")
    assert [(r["action"], r["protocol"], r["port"], r["source"], r["comment"]) for r in got] == [
        ("ALLOW", "tcp", "22", "any", ""), ("ALLOW", "tcp", "80", "any", ""), ("ALLOW", "tcp", "443", "any", ""),
        ("ALLOW", "", "", "", "service: ssh"), ("RULE", "", "", "", "rich rule: rule x y")]
    assert {r["chain"] for r in got} == {"public"}


def test_ufw(spark):
    got = rules(spark, "ufw", "Status: active\nTo                         Action      From\n[ 1] 22/tcp      ALLOW IN    Anywhere\n"
                "[ 2] 80/tcp DENY 10.0.0.0   (web (x))\n[ 3] none here at all\n[ 4] a b 22/tcp")
    assert [(r["port"], r["protocol"], r["action"], r["source"], r["comment"]) for r in got] == [
        ("22", "tcp", "ALLOW IN", "Anywhere", ""), ("80", "tcp", "DENY", "10.0.0.0", "web (x")]


def test_nft(spark):
    got = rules(spark, "nftables", "tcp dport 1 drop\nchain INPUT {\n  tcp dport 22 accept\n  tcp dport { 80, 443 } accept\n  tcp dport { 80-90 } accept\n"
                "  tcp dport { } accept\n}\nchain OUT {\n  udp dport 53 reject\n  ct state established accept\n  accept\n  policy drop;\n  iif lo jump x")
    assert [(r["chain"], r["protocol"], r["port"], r["action"]) for r in got] == [
        ("", "tcp", "1", "DROP"), ("INPUT", "tcp", "22", "ACCEPT"), ("INPUT", "tcp", "80,443", "ACCEPT"), ("INPUT", "tcp", "80-90", "ACCEPT"),
        ("INPUT", "tcp", "", "ACCEPT"), ("OUT", "udp", "53", "REJECT"), ("OUT", "all", "", "ACCEPT"), ("OUT", "all", "", "ACCEPT"),
        ("OUT", "all", "", "X")]


def test_iptables(spark):
    got = rules(spark, "iptables", "ACCEPT tcp -- 1.1.1.1 x\nChain INPUT (policy DROP)\ntarget     prot opt source               destination\n"
                "ACCEPT     all  --  0.0.0.0/0            0.0.0.0/0           \nACCEPT     tcp  --  0.0.0.0/0   0.0.0.0/0  tcp dpt:22\nDROP 0 -- 9.9.9.9 x\nshort row")
    assert [(r["chain"], r["action"], r["protocol"], r["port"], r["source"], r["comment"]) for r in got] == [
        ("INPUT", "DROP", "", "", "", "default policy"), ("INPUT", "ACCEPT", "all", "", "0.0.0.0/0", ""),
        ("INPUT", "ACCEPT", "tcp", "22", "0.0.0.0/0", ""), ("INPUT", "DROP", "all", "", "9.9.9.9", "")]


@pytest.mark.parametrize("text", ["", "   \n\t\n  ", "???\nnot a rule\n!!!@@@\n", "tcp\nACCEPT\n22/\n/tcp\nChain\n",
                                  "Status:\nChain \npkts bytes target\n", "{\n}\n{ }\n"])
def test_broken_firewall_text_has_no_rules(spark, text):
    assert [r for b in ("firewalld", "ufw", "nftables", "iptables") for r in rules(spark, b, text)] == []


def test_cross_check_equals_brute_force(spark):
    allow = [("a", "tcp", "22,80,8000-8600"), ("a", "udp", "53"), ("b", "all", "1-65535"), ("c", "tcp", "5:3")]
    rule_rows = [(h, "nftables", i, 0, "INPUT", "ACCEPT", p, port, "", "") for i, (h, p, port) in enumerate(allow)]
    df = spark.createDataFrame(rule_rows, "host string, backend string, line_no long, item int, chain string, action string, protocol string, port string, source string, comment string")
    heard = [("a", "tcp", f"0.0.0.0:{p}", "") for p in (22, 255, 256, 7999, 8000, 8511, 8600, 8601)] + [
        ("a", "tcp", "127.0.0.1:9", ""), ("b", "udp", "[::]:65535", ""), ("c", "tcp", "1.2.3.4:4", ""), ("nofw", "tcp", "0.0.0.0:1", "")]
    inv = spark.createDataFrame(heard, "host string, protocol string, local string, process string")
    open_ = {(r.host, r.port) for r in firewall.unprotected_listeners(inv, df).collect()}
    assert open_ == {("a", 255), ("a", 256), ("a", 7999), ("a", 8601), ("c", 4)}
    stale = {(r.host, r.protocol, r.lo, r.hi) for r in firewall.stale_rules(inv, df).collect()}
    assert stale == {("a", "tcp", 80, 80), ("a", "udp", 53, 53), ("b", "tcp", 1, 65535), ("c", "tcp", 5, 3)}


def test_mounts(spark):
    text = ("/dev/sda1 / ext4 rw,errors=remount-ro 0 0\n# note a b c\nproc /proc proc rw 0 0\nshort line x\n/dev/sdb1 /my\\040data xfs ro 0 0\n"
            "/dev/sdc1 / xfs rw 0 0\nnas:/x /nas nfs4 rw 0 0\n/dev/sdd1 /\\303\\251 ext4 rw 0 0")
    table = mounts.mount_table(lines(spark, text))
    assert {(r.device, r.mountpoint) for r in table.collect()} == {
        ("/dev/sda1", "/"), ("proc", "/proc"), ("/dev/sdb1", "/my data"), ("nas:/x", "/nas"), ("/dev/sdd1", "/é")}
    df_text = "Filesystem 1K-blocks Used Available Use% Mounted on\n/dev/sda1 1310720 2048 512 96% /\nproc 1 1 1 1% /proc\nbad 1 2"
    used = {r.mountpoint: (r["size"], r.used, r.avail, r.use_percent) for r in mounts.with_usage(
        table, mounts.usage_table(lines(spark, df_text))).collect()}
    assert used["/"] == ("1.2G", "2.0M", "512K", "96%") and used["/proc"] == ("", "", "", "") and used["/my data"][0] == ""
    probes = spark.createDataFrame([("h", "nas:/x", True)], "host string, device string, stale boolean")
    full = mounts.with_probe(mounts.with_usage(table, mounts.usage_table(lines(spark, df_text))), probes)
    assert {(r.mountpoint, r.severity, r.finding) for r in mounts.findings(full).collect()} == {
        ("/", "critical", "disk almost full"), ("/", "warning", "remounts read-only on errors"),
        ("/my data", "warning", "mounted read-only"), ("/nas", "critical", "network mount is stale")}
    assert mounts.kind_counts(full).select("total", "real", "nfs", "stale_nfs").head() == (5, 4, 1, 1)


@pytest.mark.parametrize(("text", "want"), [
    ("\\040", " "), ("a\\011b", "a\tb"), ("\\134040", "\\040"), ("\\\\040", "\\ "), ("\\9", "\\9"), ("\\12", "\\12"), ("plain", "plain"), ("end\\", "end\\")])
def test_unescape(values, text, want):
    assert values(mounts.unescape, [text]) == [want]


@pytest.mark.parametrize(("text", "want"), [
    ("0", "0K"), ("1023", "1023K"), ("1024", "1.0M"), ("1280", "1.2M"), ("1382", "1.3M"), ("1310720", "1.2G"), ("1048575", "1024.0M"),
    ("-", "-"), ("-5", "-5")])
def test_human_blocks(values, text, want):
    assert values(mounts.human_blocks, [text]) == [want]


def test_timers(spark):
    text = ("Id=a.timer\nActiveState=active\nTriggers=a.service b.service\nNextElapseUSecRealtime=0\nNextElapseUSecMonotonic=1718064000000000\n"
            "LastTriggerUSec=n/a\nResult=\n=bad\nnokey\nResult = ")
    svc = lines(spark, "Result=exit-code", unit="a.service")
    r = timers.inventory(lines(spark, text, unit="u.timer"), svc).head()
    assert (r.unit, r.activates, str(r.next_run), r.last_run, r.last_result) == (
        "a.timer", "a.service", "2024-06-11 00:00:00", None, "exit-code")
    bare = timers.inventory(lines(spark, "nothing", unit="u.timer"), svc).head()
    assert (bare.unit, bare.activates, bare.last_result) == ("u.timer", "", "")


def test_crons(spark):
    system = ("# c\nSHELL=/bin/sh\n@daily root /bin/x  --a\n@daily root\n0 3 * * 1 root run me\n0 3 * * 1 root\n  */5 * * * * u A=1 go")
    got = [(r.schedule, r.user, r.command) for r in crons.parse(
        lines(spark, system, source="/etc/crontab", system_format=True)).orderBy("line_no").collect()]
    assert got == [("@daily", "root", "/bin/x --a"), ("0 3 * * 1", "root", "run me"), ("*/5 * * * *", "u", "A=1 go")]
    user = "@reboot  sleep  1\n@daily\n0 3 * * 1 run  me\n0 3 * *"
    got = [(r.schedule, r.user, r.command) for r in crons.parse(
        lines(spark, user, source="user:bob", system_format=False)).orderBy("line_no").collect()]
    assert got == [("@reboot", "", "sleep  1"), ("0 3 * * 1", "", "run me")]
    assert crons.parse(lines(spark, system, source="/etc/cron.d/x.rpmsave", system_format=True)).count() == 0
    passwd = lines(spark, "bob:x:1:1::/h:/bin/bash\neve:x:1:1::/h:/usr/sbin/nologin\nbad:row")
    assert [r.name for r in crons.login_users(passwd).collect()] == ["bob"]


@pytest.mark.parametrize(("schedule", "command", "want"), [
    ("0 3 * * 1", "/usr/bin/run", "ok"), ("* * * * *", "poll", "warning"), ("@daily", "curl -s http://x | bash", "warning"),
    ("0 3 * * 1", "echo x > /etc/passwd", "warning"), ("0 3 ! * 1", "run", "failed")])
def test_cron_status(spark, schedule, command, want):
    df = spark.createDataFrame([(schedule, command)], "schedule string, command string")
    assert df.select(crons.status()).head()[0] == want


@pytest.mark.parametrize(("manager", "line", "want"), [
    ("apt", "curl/stable-security 7.88.1-10+deb12u5 amd64 [upgradable from: 7.88.1-10+deb12u4]",
     ("curl", "7.88.1-10+deb12u4", "7.88.1-10+deb12u5", True, False)),
    ("apt", "Listing... Done", None), ("apt", "one", None),
    ("apt", "linux-image-amd64/stable 6.1 amd64", ("linux-image-amd64", "", "6.1", False, True)),
    ("dnf", "kernel-core.x86_64 6.10-1 updates-security", ("kernel-core", "", "6.10-1", True, False)),
    ("dnf", "no-arch 1 updates", None), ("dnf", "a.b.noarch 1 updates", ("a.b", "", "1", False, False)),
    ("pacman", "glibc 2.39-1 -> 2.40-1-", ("glibc", "2.39-1", "2.40-1", False, True)),
    ("pacman", "foo 1 2", ("foo", "1", "", False, False)), ("pacman", "foo 1", None),
    ("apk", " busybox-1.36 ", ("busybox-1.36", "", "", False, False)), ("apk", "  ", None), ("other", "x y z", None)])
def test_updates(spark, manager, line, want):
    row = updates.parse(lines(spark, line, manager=manager)).head()
    assert (row and (row.package, row.installed, row.available, row.security, row.reboot)) == want


def test_installed_and_categories(spark):
    up = updates.parse(lines(spark, "a.x86_64 2.0 updates\nb.x86_64 1.1 updates\nc.x86_64 9 updates", manager="dnf"))
    full = updates.with_installed(up, lines(spark, "a 1.9\nb 1.0\nb 1.0.5\nc 1 extra"))
    got = {r.package: (r.installed, r.category) for r in full.withColumn("category", updates.category()).collect()}
    assert got == {"a": ("1.9", "major"), "b": ("1.0.5", "minor"), "c": ("", "unknown")}


def test_process(spark):
    status = lines(spark, "Name:\tnginx\nState:\tS (sleeping)\nVmRSS:\t  12 kB\nUid:\t33\t0\t0\nnoise", pid=1)
    assert process.facts(status).head()[2:] == ("nginx", "S (sleeping)", "12 kB", "", "33")
    fds = spark.createDataFrame([("h", 1, 5, "socket:[1]"), ("h", 1, 3, "socket:[2]"), ("h", 1, 4, "/x")], "host string, pid int, fd int, target string")
    assert {(r.label, r.first_fd) for r in process.open_files(fds).collect()} == {("socket (anonymous)", 3), ("/x", 4)}
    tcp = lines(spark, "sl local\n0: 0100007F:0050 00000000:0000 0A x\n1: 0100007F:1F90 0200007F:C350 01\n"
                "2: 00000000000000000000000001000000:0016 00000000000000000000000000000000:0000 0A\n3: zz:1 nope 7f", pid=1)
    assert [r.summary for r in process.tcp_sockets(tcp).orderBy("line_no").collect()] == [
        "tcp  LISTEN  local=127.0.0.1:80", "tcp  ESTABLISHED  local=127.0.0.1:8080  remote=127.0.0.2:50000",
        "tcp  LISTEN  local=[0000:0000:0000:0000:0000:0000:0000:0001]:22  remote=[0000:0000:0000:0000:0000:0000:0000:0000]:0",
        "tcp  state-7f  local=zz:1  remote=nope"]


def test_hosts(spark):
    env = hosts.environment(lines(spark, "# c\nID=custom\nID_LIKE=\"foo rhel debian\"\nVERSION_ID='9'\nPRETTY_NAME=\"A \"B\"\"\n=x\nID"))
    assert env.head()[1:] == ("custom", "foo rhel debian", "9", 'A "B"')
    assert env.select(hosts.package_manager(F.col("distro_id"), F.col("distro_like"))).head()[0] == "dnf"
    mem = hosts.memory(lines(spark, "Mem: 16.0Gi 2.5Gi 1Gi 1Mi 2Gi 12Gi\nSwap: 8.0Gi 0B 8Gi")).head()
    assert (mem.memory, mem.swap) == ("2.5G / 16G  (12G free)", "inactive")
    disk = hosts.disks(lines(spark, "/dev/sda1 10.0Gi 5Gi 5Gi 50% /\n/dev/sda1 1 1 1 1% /x\ntmpfs 1 1 1 1% /t")).collect()
    assert [(d.device, d["size"], d.mountpoint) for d in disk] == [("/dev/sda1", "10G", "/")]


def test_swap_and_uptime(spark, values):
    swap = lambda text: hosts.memory(lines(spark, text)).head().swap
    assert (swap("Swap: 8Gi 0B"), swap("Swap: 8Gi 0"), swap("Swap: 8.0Gi 1.0Gi"), swap("x")) == ("inactive", "inactive", "1G / 8G", "")
    assert values(hosts.uptime, ["up 3 days, 4 hours, 1 minute", " "]) == ["3d 4h 1m", "(none)"]


def test_digest_pages_join_to_the_whole_text(spark):
    rows = spark.createDataFrame([("h", i, f"p{i:03}") for i in range(250)] + [("g", 1, "only")], "host string, n int, p string")
    every = spark.createDataFrame([("h",), ("g",), ("quiet",)], "host string")
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "p")
    got = digests.paged_digest(rows, every, ["n"], F.floor(F.col("n") / 10), line, "(none)", 100).orderBy("host", "page").collect()
    assert [(r.host, r.page) for r in got] == [("g", 0), ("h", 0), ("h", 1), ("h", 2), ("quiet", 0)]
    text = "\n".join(r.digest for r in got if r.host == "h")
    assert text == "\n".join(f"{i + 1}. p{i:03}" for i in range(250)) and got[-1].digest == "(none)"


def _unprotected(spark, backend, text, port):
    listening = spark.createDataFrame([("h", "tcp", f"0.0.0.0:{port}", "p")], "host string, protocol string, local string, process string")
    lines = spark.createDataFrame([("h", backend, i, x, "public") for i, x in enumerate(text.split("\n"))],
                                  "host string, backend string, line_no int, line string, zone string")
    return [r.port for r in firewall.unprotected_listeners(listening, firewall.all_rules(lines)).collect()]


@pytest.mark.parametrize(("backend", "text", "port", "open_"), [
    ("nftables", "chain INPUT {\ntcp dport { ssh, https } accept", 443, True), ("nftables", "chain INPUT {\ntcp dport { ssh, https } accept", 80, False),
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT all -- 0.0.0.0/0 0.0.0.0/0 ctstate RELATED,ESTABLISHED", 3306, False),
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT all -- 0.0.0.0/0 0.0.0.0/0", 3306, False),
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT tcp -- 0.0.0.0/0 0.0.0.0/0 tcp dpt:3306", 3306, True)])
def test_what_covers_a_listener(spark, backend, text, port, open_):
    assert _unprotected(spark, backend, text, port) == ([] if open_ else [port])


def test_long_texts_are_not_cut(values):
    assert len(values(mounts.unescape, ["a\\040" + "b" * 150_000])[0]) == 150_002


def _walk(listing, port):
    """Whether tcp ``port`` is open: every chain's lines one after the other, the policy last."""
    open_, chain, policy, verdicts = False, None, {}, {}
    for line in listing:
        f = line.split()
        if f[0] == "Chain":
            chain = f[1]
            if "policy" in line:
                policy[chain] = f[3].rstrip(")")
            verdicts.setdefault(chain, None)
            continue
        action, proto, source, rest = f[0], f[1], f[3], " ".join(f[5:])
        if verdicts[chain] or chain in ("OUTPUT", "FORWARD") or proto not in ("tcp", "6", "all", "0"):
            continue
        spans = [(p, p) for p in re.findall(r"dpt:(\d+)", rest)] + re.findall(r"dpts:(\d+):(\d+)", rest)
        for part in re.findall(r"multiport dports (\S+)", rest):
            spans += [tuple((p + ":" + p).split(":")[:2]) if ":" not in p else tuple(p.split(":")) for p in part.split(",")]
        limited = source != "0.0.0.0/0" or "state" in rest or "limit" in rest
        hit = any(int(a) <= port <= int(b) for a, b in spans) if spans else action != "ACCEPT"
        if hit and (action == "ACCEPT" or not limited):
            verdicts[chain] = action
    for chain, verdict in verdicts.items():
        open_ |= (verdict or (policy.get(chain) if chain == "INPUT" else None)) == "ACCEPT"
    return open_


def _listing(rng):
    ports_ = lambda: rng.choice([22, 80, 255, 256, 257, 511, 512, 3306, 8000, 65535, rng.randrange(65536)])
    out = []
    for chain in ("INPUT", "LOCAL", "OUTPUT"):
        out.append(f"Chain {chain} (policy {rng.choice(['DROP', 'DROP', 'ACCEPT'])})" if chain != "LOCAL" else "Chain LOCAL (1 references)")
        for _ in range(rng.randrange(9)):
            a, b = sorted((ports_(), ports_()))
            what = rng.choice([f"tcp dpt:{a}", f"tcp dpts:{a}:{b}", f"multiport dports {a},{b}", f"multiport dports {b},{a}:{min(a + 700, 65535)}",
                               f"ctstate NEW tcp dpt:{a}", "ctstate RELATED,ESTABLISHED", "" if rng.random() < 0.2 else f"tcp dpt:{b}"])
            out.append(f"{rng.choice(['ACCEPT', 'DROP', 'REJECT'])} {rng.choice(['tcp', '6', 'all', '0', 'icmp', 'udp'])} -- "
                       f"{rng.choice(['0.0.0.0/0', '0.0.0.0/0', '10.0.0.0/8'])} 0.0.0.0/0 {what}".strip())
    return out


def test_first_matching_rule_decides(spark):
    rng = random.Random(4)
    texts = {f"h{i}": _listing(rng) for i in range(40)}
    rows = [(h, "iptables", i, x, "") for h, text in texts.items() for i, x in enumerate(text)]
    every = firewall.all_rules(spark.createDataFrame(rows, "host string, backend string, line_no int, line string, zone string"))
    got = {}
    for r in firewall.open_ranges(every).filter("protocol = 'tcp'").collect():
        assert r.lo <= r.hi and not set(range(r.lo, r.hi + 1)) & got.setdefault((r.host, r.chain), set())
        got[r.host, r.chain].update(range(r.lo, r.hi + 1))
    for h, text in texts.items():
        mine = set().union(*(s for (host, _), s in got.items() if host == h))
        for port in {*range(0, 65536, 997), 65535, *(int(p) + d for p in re.findall(r"\d+", " ".join(x[-40:] for x in text)) if int(p) < 65535 for d in (-1, 0, 1))}:
            assert port < 0 or (port in mine) == _walk(text, port), (h, port, text)
    heard = [(h, "tcp", f"0.0.0.0:{p}") for h in texts for p in (22, 80, 81, 255, 256, 257, 511, 512, 700, 3306, 8000, 65535)]
    listening = spark.createDataFrame(heard * 2, "host string, protocol string, local string")
    open_ = {(r.host, r.port) for r in firewall.unprotected_listeners(listening, every).collect()}
    assert open_ == {(h, int(x[8:])) for h, _, x in heard if not _walk(texts[h], int(x[8:]))}
    assert 20 < len(open_) < len(heard) - 20


@pytest.mark.parametrize(("backend", "text", "port", "open_"), [
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT tcp -- 0.0.0.0/0 0.0.0.0/0 multiport dports 80,443", 443, True),
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT tcp -- 0.0.0.0/0 0.0.0.0/0 tcp dpts:6000:6010", 6005, True),
    ("iptables", "Chain INPUT (policy ACCEPT)\nDROP tcp -- 0.0.0.0/0 0.0.0.0/0 tcp dpt:80", 80, False),
    ("iptables", "Chain INPUT (policy ACCEPT)\nDROP tcp -- 1.2.3.4 0.0.0.0/0 tcp dpt:80", 80, True),
    ("iptables", "Chain INPUT (policy DROP)\nDROP tcp -- 0.0.0.0/0 0.0.0.0/0\nACCEPT tcp -- 0.0.0.0/0 0.0.0.0/0 tcp dpt:80", 80, False),
    ("iptables", "Chain INPUT (policy DROP)\nACCEPT tcp -- 0.0.0.0/0 0.0.0.0/0", 80, False),
    ("ufw", "[ 1] 80/tcp DENY IN Anywhere\n[ 2] 80/tcp ALLOW IN Anywhere", 80, False),
    ("ufw", "[ 1] 80/tcp ALLOW OUT Anywhere", 80, False), ("ufw", "[ 1] 80/tcp DENY IN 10.0.0.9\n[ 2] 80/tcp ALLOW IN Anywhere", 80, True),
    ("nftables", "chain input {\ntcp dport 80 drop\naccept", 80, False), ("nftables", "chain input {\ntcp dport 80 drop\naccept", 81, True),
    ("nftables", "chain input {\niif lo accept\nct state established accept", 81, False), ("nftables", "chain output {\naccept", 81, False),
    ("firewalld", "ports: 99999999999/tcp 81/tcp 82/sctp", 82, False)])
def test_order_and_forms_of_rules(spark, backend, text, port, open_):
    assert _unprotected(spark, backend, text, port) == ([] if open_ else [port])
