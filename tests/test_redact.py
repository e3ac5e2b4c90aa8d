"""Redaction rules, one by one and as a pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from opslake.functions import redact
from opslake.functions.redact import BY_NAME, classify_lines, collapse_repeats, sanitise, sanitise_line
from opslake.operators import redaction


@pytest.mark.parametrize(("rule", "text", "want"), [
    ("strip-timestamps", "2026-06-02T20:08:18+0000 [39054] x", " x"),
    ("strip-timestamps", "2026-06-02 20:08:18,123Z x", " x"),
    ("strip-timestamps", "Jun  2 20:08:18 host a", "host a"),
    ("strip-timestamps", "a\n-- Boot 4242 --\nb", "a\n\nb"),
    ("strip-timestamps", "a [42]\nb [7] c", "a b [7] c"),
    ("strip-hostnames", "web01 sshd[12]: hi\nweb02 cron: yo", "sshd[12]: hi\ncron: yo"),
    ("mask-urls", 'see HTTPS://a.b/c?d=1, "ftp://x" xhttp://no', 'see <URL>, "<URL>" xhttp://no'),
    ("mask-emails", "a@b.co,c.d+e@f.example.org x@y", "<EMAIL>,<EMAIL> x@y"),
    ("mask-emails", "a@b.com@c.org", "<EMAIL>@c.org"),
    ("mask-mac", "aa:bb:cc:dd:ee:ff and aa:bb:cc:dd:ee", "<MAC> and aa:bb:cc:dd:ee"),
    ("mask-ipv4", "10.0.0.1/24 999.1.1.1 1.2.3", "<IPV4> <IPV4> 1.2.3"),
    ("mask-ipv4", "é10.0.0.1é", "é<IPV4>é"),
    ("mask-ipv6", "2001:db8:abcd:0012:0000:0000:0000:0001", "<IPV6>"),
    ("mask-ipv6", "::1 and std::vector::iterator", "<IPV6> and std::vector::iterator"),
    ("mask-ipv6", "2001:db8::1", "<IPV6>1"),
    ("mask-ipv6", "12:30:45 at ::ffff:1:2", "12:30:45 at ::ffff:1:2"),
    ("mask-ipv6", "0:0:0:0:0:ffff:1:2 1:2:3:4:5:6:7:8:9", "0:0:0:0:0:ffff:1:2 <IPV6>:9"),
    ("normalise-repo", "/var/cache/libdnf5/updates-3cc07c89a20302f2/solv", "<REPO_CACHE>/solv"),
    ("mask-home", "at /home/alice/.bashrc, /root/x /Users/bob", "at <HOME_PATH>, <HOME_PATH> <HOME_PATH>"),
    ("mask-paths", "read /etc/passwd", "read <CONFIG_PATH>"),
    ("mask-paths", "see /var/log/syslog", "see <LOG_PATH>"),
    ("mask-paths", "in /var/cache/libdnf5/foo", "in <CACHE_PATH>"),
    ("mask-paths", "from /usr/lib/systemd/system/x.service", "from <LIB_PATH>"),
    ("mask-paths", "file /opt/myapp/bin/x (/srv/y)", "file <PATH> (<PATH>)"),
    ("mask-paths", "changed to /etc directory", "changed to <CONFIG_PATH> directory"),
    ("mask-uuid", "session abc12345-def0-1234-5678-9abcdef01234 started", "session <UUID> started"),
    ("mask-hex", "0xdeadbeef abc1234 " + "a" * 32, "<HEX> abc1234 <HEX>"),
    ("normalise-package-nvr", "installing kernel-6.10.7-200.fc40.x86_64", "installing kernel-<VERSION>"),
    ("normalise-package-nvr", "foo-bar-1.2.noarch baz-1.2", "foo-bar-<VERSION> baz-1.2"),
])
def test_rule(values, rule, text, want):
    assert values(BY_NAME[rule].apply, [text]) == [want]


@pytest.mark.parametrize(("line", "want"), [
    ("could not load module: fatal error", "<ERROR> could not load module: fatal error"),
    ("Warning: deprecated option", "<WARN> Warning: deprecated option"),
    ("Installed: foo-bar-1.0", "<TRANSACTION> Installed: foo-bar-1.0"),
    ("running %post step", "<SCRIPTLET> running %post step"),
    ("trace on", "<DEBUG> trace on"),
    ("starting service", "<INFO> starting service"),
    ("installed: foo failed to register", "<ERROR> installed: foo failed to register"),
    ("first\n\nsecond", "<INFO> first\n\n<INFO> second"),
    ("<URL> error", "<URL> error"),
    ("<IPV4> error", "<ERROR> <IPV4> error"),
    ("éerror", "<ERROR> éerror"),
    ("terror", "<INFO> terror"),
    ("  \x85 spaced ", "<INFO> spaced"),
])
def test_classify(values, line, want):
    assert values(classify_lines, [line]) == [want]


def test_collapse(values):
    texts = ["<INFO> a\n<INFO> a\n<INFO> a\n<INFO> b", "only one", "", "x\nx", "a\nb\na", "\n\n\na"]
    assert values(collapse_repeats, texts) == [
        "<INFO> a [x3]\n<INFO> b", "only one", "", "x [x2]", "a\nb\na", " [x3]\na"]


def test_pipeline_hides_secrets(values):
    secrets = ["203.0.113.45", "2001:db8:abcd:0012:0000:0000:0000:0001", "de:ad:be:ef:ca:fe", "webhost01",
               "/home/alice/.ssh/id_ed25519", "admin@example.com"]
    blob = ("Jun  2 20:08:18 webhost01 sshd[1234]: Accepted publickey for admin\n"
            f"connection from {secrets[0]} to {secrets[1]}\ninterface fw0 link/ether {secrets[2]}\n"
            f"loaded credentials from {secrets[4]}\nnotified operator {secrets[5]} of the event")
    got = values(sanitise, [blob])[0]
    assert not [s for s in secrets if s in got]


def test_pipeline_on_package_log(values):
    log = (
        "2026-06-02T20:08:18+0000 [39054] DEBUG [librepo]   rsync://mirror.example.info/updates/44/repomd.xml\n"
        "2026-06-02T20:08:18+0000 [39054] DEBUG [librepo] check: checksum of /var/cache/libdnf5/"
        "free-updates-880b8bb66393fb1c/repodata/5a17d225ddb72809e540a2677a5a6edf-comps.xml.xz (expected: "
        "5a17d225ddb72809e540a2677a5a6edf6c3881324b6089547d11939210fa59ca [sha256])\n"
        "2026-06-02T20:08:20+0000 [39054] INFO DNF5 finished")
    got = values(sanitise, [log])[0]
    assert all(t in got for t in ("<URL>", "<HEX>", "<DEBUG>", "<INFO>", "DNF5 finished"))
    assert not any(t in got for t in ("2026-06-02", "rsync://", "39054", "5a17d225", "880b8bb6"))


def test_line_pipeline_keeps_repeats(values):
    assert values(sanitise_line, ["a\na"]) == ["<INFO> a\n<INFO> a"]
    assert [r.name for r in redact.default_rules()][:-1] == [r.name for r in redact.line_rules()]


def test_any_text_is_handled_and_stable(values):
    rng = random.Random(7)
    alphabet = "ab:/.@-[]<>0123456789f \n\t\r\x0bé€x%"
    texts = ["", "a", "::::::", "std::vector::iterator", "a:" * 1000, "x" * 20000, "a@" * 500]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    planted = [t + " mail bob@example.com from 10.1.2.3" for t in texts]
    got = values(sanitise, texts + planted)
    assert None not in got and got[0] == ""
    assert not [g for g in got[len(texts):] if "bob@example.com" in g or "10.1.2.3" in g]
    assert values(sanitise, texts) == got[:len(texts)]


def test_control_characters_stay(values):
    texts = ["plain \x02\x03 ::1", "a\x02b 2001:db8::1", "std::vector::x \x03", None]
    assert values(BY_NAME["mask-ipv6"].apply, texts) == ["plain \x02\x03 <IPV6>", "a\x02b <IPV6>1", "std::vector::x \x03", None]


def test_letters_that_fold_are_no_word_characters(values):
    assert values(BY_NAME["mask-urls"].apply, ["ſhttp://a.b/c", "Khttps://a.b/c", "xhttp://a.b/c"]) == [
        "ſ<URL>", "K<URL>", "xhttp://a.b/c"]
    assert values(redact.classify_line, ["ſinstalled x"]) == ["<TRANSACTION> ſinstalled x"]


def test_removed_values_that_survive(spark):
    texts = {
        1: "web1 sshd: web1 is at 10.0.0.1 and v10.0.0.1x, see a@b.cc", 2: "uuid 0123abcd-0123-abcd-0123-0123456789ab only", 3: None, 4: "",
        5: "a peer is 2001:db8::1 or x2001:db8::1", 6: "see (/opt/x and q/opt/x", 7: "10.1.1.1 " * 20000 + "z10.1.1.1", 8: "plain words", 9: "10.0.0.1 10.0.0.1"}
    df = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "id int, t string, rule_ string")
    got = {(r.id, r.rule, r.value, r.survived) for r in redaction.survivors(df, "t").collect()}
    assert {g for g in got if g[0] != 5} == {
        (1, "strip-hostnames", "web1", True), (1, "mask-ipv4", "10.0.0.1", True), (1, "mask-emails", "a@b.cc", False),
        (2, "mask-uuid", "0123abcd-0123-abcd-0123-0123456789ab", False),
        (6, "mask-paths", "/opt/x", True), (7, "mask-ipv4", "10.1.1.1", True), (9, "mask-ipv4", "10.0.0.1", False)}
    assert {g[1] for g in got if g[0] == 5} == {"mask-ipv6"}
    report = {(r.rule): (r.removed, r.survived) for r in redaction.survivor_report(df, "t", "rule_").collect()}
    assert set(report) == set(redact.MASKING) and len(report) == 13 and report["mask-ipv4"] == (3, 2) and report["mask-mac"] == (0, 0)
    assert redaction.survivor_report(df.limit(0), "t", "rule_").count() == 0


def test_many_values_in_one_pass():
    values = [f"v{i}" for i in range(3000)] + ["v1", "x"]
    assert redaction.found_in(values, "v12 and v7") == [v in ("v1", "v12", "v7") for v in values] and redaction.found_in([], "a") == []


def test_what_is_left_is_what_the_rules_leave(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    rules = [redact.BY_NAME[n] for n in redact.MASKING]
    both = redaction.removed_values(docs, "text", "r").select(F.col("r.text").alias("a"), redact.sanitise(F.col("text"), rules).alias("b"))
    assert both.filter(redact.trim(F.col("a")) != F.col("b")).count() == 0
