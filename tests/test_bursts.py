"""Windows of log lines with each status, told by hand."""

from galena.operators import bursts


def test_statuses_baselines_and_the_strongest(spark):
    rows, n = [], 0

    def say(service, tick, *lines, ids=None):
        nonlocal n
        for k, line in enumerate(lines):
            n += 1
            rows.append((service, tick * 10_000_000 + k, ids or f"i{n}", line))

    say("s", 0, *["user 1 in"] * 6)  # warming: learned
    say("s", 1, "user 2 in", "user 3 in")  # warming: too few to learn from
    say("s", 2, *["user 4 in"] * 4, *["disk full on a"] * 2)  # warming: learned
    say("s", 3, *["user 5 in"] * 7)  # 0.7 a second against 0.5: clear
    say("s", 4, *["disk full on a"] * 9, *["user 6 in"] * 25, *["odd thing"] * 4)  # 0.9 against 0.1: 8 times; 2.5 against 0.5: 4 times; too few of the last
    say("s", 5, *["user 7 in"] * 50, "")  # a blank line
    say("s", 6, *["user 8 in"] * 3)  # too few
    say("s", 8, "disk full on a", *["net down"] * 5, ids=None)  # after an empty window; net down was never seen
    say("s", 9, "a b", "a b", "a b", "a b", "a b", ids="same")  # one id for all
    say("s", 10, *["x" * 30] * 6)  # too long
    rows += [(None, 5, "q", "a"), ("s", None, "q", "a")]
    got = bursts.log_bursts(spark.createDataFrame(rows, "service string, us long, id string, line string"), 10_000_000, warmup=2, most_chars=29)
    told = {r.tick: (r.status, r.records, r.leader, r.n, None if r.deformation is None else round(r.deformation, 6), None if r.score is None else round(r.score, 6)) for r in got.collect()}
    none = (None, None, None, None)
    assert told == {
        0: ("WARMING", 6, *none), 1: ("WARMING", 2, *none), 2: ("WARMING", 6, *none), 3: ("CLEAR", 7, *none), 4: ("BREACH", 38, "disk full on a", 9, 8.0, 0.8), 5: ("INSUFFICIENT", 50, *none),
        6: ("INSUFFICIENT", 3, *none), 7: ("INSUFFICIENT", 0, *none), 8: ("BREACH", 6, "net down", 5, 50.0, 1.0), 9: ("INSUFFICIENT", 1, *none), 10: ("INSUFFICIENT", 0, *none),
    }


def test_no_lines(spark):
    assert bursts.log_bursts(spark.createDataFrame([], "service string, us long, id string, line string"), 10).count() == 0
