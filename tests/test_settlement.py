import random

from pyspark.sql import functions as F

from fedrank.operators import merge, settlement, stateful
from fedrank.plans import rules


def simulate(profile, arrivals, poll=100):
    """Tick by tick: arrivals are (ms, ok, useful, sure)."""
    least, useful_least, _, soft, hard, needs = profile
    t = 0
    while True:
        seen = [a for a in arrivals if a[0] <= t]
        sure = any(a[3] for a in seen)
        if len(seen) >= len(arrivals) or t >= hard:
            return t
        if len(seen) >= least and sum(a[2] for a in seen) >= useful_least and (sure or not needs) and (t >= soft or sure):
            return t
        t += poll


def test_fast_path_is_the_simulation(spark):
    r = random.Random(4)
    texts = {"docs": "nodejs docs", "code": "github thing", "discussion": "forum thing", "factual": "what is thing", "general": "thing"}
    asked, settled, serp, want = [], [], [], {}
    for q in range(120):
        intent = r.choice(list(texts))
        asked.append((q, texts[intent], 10))
        arrivals = []
        for e in r.sample(rules.ENGINES, r.randint(0, 7)):
            ms, ok, n, sure = r.randint(0, 6000), r.random() < 0.8, r.randint(0, 2), r.random() < 0.3
            settled.append((q, e, ms, ok, None if ok else "x"))
            # a host that is confident for every intent but discussion and general, or none; scores do the rest
            score = 30 if sure else 0
            url = "https://docs.python.org/api" if sure and intent == "docs" else "https://shop.example.com/x"
            for p in range(n if ok else 0):
                serp.append((q, e, ms, p, "t", url, "s", score))
            arrivals.append((ms, ok, ok and n > 0 and e in rules.PROFILES[intent][2], ok and n > 0 and sure))
        want[q] = simulate(rules.PROFILES[intent], arrivals)
    q = spark.createDataFrame(asked, "query_id long, query string, limit int")
    s = spark.createDataFrame(settled, "query_id long, engine string, arrival_ms int, ok boolean, error string")
    h = spark.createDataFrame(serp, "query_id long, engine string, arrival_ms int, pos int, title string, url string, snippet string, score int")
    got = {x.query_id: x.resolve_ms for x in settlement.fast_path(s, h, q).collect()}
    assert got == want


def test_stats(spark):
    q = spark.createDataFrame([(1, "thing", 10, None), (2, "thing", 10, ["bing", "brave", "no"]), (3, "thing", 10, [])], "query_id long, query string, limit int, engines array<string>")
    s = spark.createDataFrame([(1, "ddg", 5, True, None), (1, "google", 9, False, "HTTP 500"), (2, "bing", 3, True, None)], "query_id long, engine string, arrival_ms int, ok boolean, error string")
    h = spark.createDataFrame([(1, "ddg", 5, 0, "t", "https://a.b", "s")], "query_id long, engine string, arrival_ms int, pos int, title string, url string, snippet string")
    r = {x.query_id: x for x in settlement.engine_stats(s, h, q).collect()}
    assert r[1].completed == ["ddg"] and r[1].failed == ["google"] and "brave" not in r[1].attempted and r[1].partial
    assert r[1].counts == {"ddg": 1, "google": 0} and r[1].errors == {"google": "HTTP 500"}
    assert r[2].attempted == ["bing"] and not r[2].partial and r[3].attempted == []
    a = {x.query_id: x for x in settlement.answers(h, s, q).where("phase = 'fast'").collect()}
    assert a[1].total == 1 and a[2].total == 0 and a[3].elapsed_ms == 0
    late = settlement.apply_timeouts(s.withColumn("arrival_ms", F.lit(9000)), 10_000, 8_000)
    assert late.where("ok").count() == 2


def test_state_machines():
    limiter = stateful.RateLimiter(2, 10)
    assert [limiter(t)[0] for t in (0, 1, 2, 10, 11, 12, 30)] == [True, True, False, False, True, True, True]
    cool = stateful.CoolDown(10)
    assert [cool(t, c)[0] for t, c in ((0, False), (1, True), (5, True), (11, False))] == ["ok", "challenged", "blocked", "ok"]
    flight = stateful.SingleFlight()
    assert [flight(*x) for x in ((7, 0, 5), (8, 4, 5), (9, 5, 5))] == [(True, 7), (False, 7), (True, 9)]
    cache = stateful.Cache(ttl=100, most=1)
    assert [cache(t, k, 5)[0] for t, k in ((0, "a"), (1, "a"), (6, "a"), (10, "b"), (20, "a"), (200, "a"))] == ["miss", "inflight", "hit", "miss", "miss", "miss"]
    slots = stateful.Slots(1)
    assert [slots(t, 4) for t in (0, 1, 10)] == [(0, 0), (4, 3), (10, 0)]


def test_batches_keep_keys_apart(spark):
    log = spark.createDataFrame([(k, t, t * 10 + k) for k in range(5) for t in range(40)], "k int, at_ms long, id long")
    got = stateful.rate_limit(log, "k", "at_ms", ["id"], 3, 9).collect()
    for k in range(5):
        machine = stateful.RateLimiter(3, 9)
        assert [r.accepted for r in sorted((r for r in got if r.k == k), key=lambda r: r.at_ms)] == [machine(t)[0] for t in range(40)]


def test_engine_order(spark):
    df = spark.createDataFrame([("code", "github"), ("code", "nowhere"), ("other", "ddg")], "i string, e string")
    assert [r[0] for r in df.select(merge.engine_rank(F.col("i"), F.col("e"))).collect()] == [0, 99, 99]
