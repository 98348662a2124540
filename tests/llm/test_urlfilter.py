import datetime
import random
import re

from symloom.llm import queries, urlfilter

EVENTS = "list string, kind string, key string, action string, day int"
CAPTURES = "page_id long, url string, day int"


def keys_of(url):
    host = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not host:
        return []
    host = host[1].lower()
    segment = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", url)
    labels = host.split(".")
    out = [(2, "host", host), (3, "prefix", f"{host}/{segment[1] if segment else ''}")]
    return out + [(1, "domain", ".".join(labels[i:])) for i in range(len(labels) - 1)] if len(labels) > 1 else out


def brute(captures, events):
    out = {}
    for page, url, day in captures:
        if (page, url, day) in out:
            out[page, url, day][0] += 1
            continue
        active = []
        for rank, kind, key in keys_of(url):
            for name in {e[0] for e in events}:
                own = sorted({(d, a == "remove") for n, k, x, a, d in events if (n, k, x) == (name, kind, key) and d is not None and x is not None and day is not None and d <= day})
                if own and not own[-1][1]:
                    active.append((rank, name == "allow", kind, name))
        best = max(active, default=None)
        out[page, url, day] = [1, len(active), best and best[2], best and best[3], best is None or best[1]]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, captures, events, **options):
    got = urlfilter.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(events, EVENTS), **options)
    assert {(r["page_id"], r["url"], r["day"]): (r["n_rows"], r["n_active"], r["kind"], r["list"], r["kept"]) for r in got.collect()} == brute(captures, events)


def test_against_brute_force(spark):
    pick = random.Random(6)
    hosts = ["a.example.org", "b.example.org", "example.org", "x.co", "HOT.net", "localhost"]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "/one/two", "/one?x=1", ":8080/two", "/two#f")] + [None, "", "no address", "ftp://u@b.example.org/one"]
    events = []
    for _ in range(300):
        h = pick.choice(hosts).lower()
        kind, key = pick.choice([("host", h), ("domain", ".".join(h.split(".")[pick.randrange(len(h.split("."))) :])), ("prefix", f"{h}/{pick.choice(['one', 'two', ''])}")])
        events.append((pick.choice(["block", "allow", "other"]), kind, key, pick.choice(["add", "remove"]), pick.randrange(0, 400)))
    events += [("block", "host", None, "add", 5), ("block", "host", "x.co", "add", None), ("block", "host", "hot.net", "add", 10), ("block", "host", "hot.net", "remove", 10)] + [events[0]] * 3
    captures = [(n, pick.choice(urls), pick.choice([None, *range(0, 450, 3)])) for n in range(400)]
    captures += captures[:20] + [(1000 + n, "https://hot.net/one", n) for n in range(200)] + [(None, "https://x.co/one", 50)] * 2
    check(spark, captures, events)
    check(spark, captures, events, last_day=1000)


def test_validity_is_as_of_the_day_of_capture(spark):
    events = [("block", "host", "a.org", "add", 10), ("block", "host", "a.org", "remove", 20), ("block", "host", "a.org", "add", 90), ("allow", "prefix", "a.org/ok", "add", 15)]
    rows = spark.createDataFrame([(d, f"http://a.org/{p}", d) for d in (9, 10, 19, 20, 89, 90, 5000) for p in ("x", "ok")], CAPTURES)
    got = {(r["day"], r["url"][-1] == "k"): r["kept"] for r in urlfilter.evaluate(rows, spark.createDataFrame(events, EVENTS)).collect()}
    assert [got[d, False] for d in (9, 10, 19, 20, 89, 90, 5000)] == [True, False, False, True, True, False, False]
    assert [got[d, True] for d in (9, 10, 19, 20, 89, 90, 5000)] == [True, False, True, True, True, True, True]


def test_intervals(spark):
    rows = [("l", "host", "k", a, d) for a, d in (("add", 5), ("add", 7), ("remove", 9), ("remove", 11), ("add", 20))]
    assert sorted((r["since"], r["until"]) for r in urlfilter.intervals(spark.createDataFrame(rows, EVENTS)).collect()) == [(5, 7), (7, 9), (20, urlfilter.FOREVER)]


def test_empty_tables_and_other_columns(spark):
    captures, events = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], EVENTS)
    assert urlfilter.evaluate(captures, events).count() == 0
    rows = spark.createDataFrame([(1, "http://a.org/", 3, "x", 1, "y")], CAPTURES + ", kind string, list int, host string")
    got = urlfilter.evaluate(rows, events).first()
    assert (got["n_rows"], got["n_active"], got["kind"], got["list"], got["host"], got["kept"]) == (1, 0, None, None, "a.org", True)
    assert urlfilter.evaluate(captures, spark.createDataFrame([("b", "host", "a.org", "add", 1, "z")], EVENTS + ", page_id string")).count() == 0


def test_query_reads_every_page(spark, sf_tiny):
    pages = spark.read.parquet(f"{sf_tiny}/pages.parquet")
    got = queries.op4_url_filters(spark, sf_tiny).collect()
    assert sum(r["n_rows"] for r in got) == pages.count() and any(not r["kept"] for r in got)
    assert datetime.date(1970, 1, 1) + datetime.timedelta(days=queries.FIRST_DAY) == datetime.date(2024, 1, 1)
