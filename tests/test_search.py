"""Provider search, linkage and compatibility against plain Python."""

from collections import Counter

from rankweave.operators import linkage, ranking
from rankweave.sources.model import Model

DATA = "/root/testdata/sf0.001"


def test_compatibility_of_a_member(spark):
    rows = Model(spark, DATA).approved().collect()
    by_member = Counter(r.member_id for r in rows if r.member_id is not None)
    member = min(m for m, n in by_member.items() if n >= 3)
    providers = sorted({r.provider_id for r in rows})[:25] + [10**9]
    mine = [r for r in rows if r.member_id == member]
    mean = lambda some, p: sum(r[p] for r in some) / len(some)
    want = {}
    for p in providers:
        theirs = [r for r in rows if r.provider_id == p]
        if not theirs:
            want[p] = -1
            continue
        share = {}
        for c in ("type_id", "body_id", "level_id"):
            counts = Counter(r[c] for r in theirs)
            top = min(counts, key=lambda v: (-counts[v], v))
            share[c] = int(100 * sum(r[c] == top for r in mine) / len(mine) + 0.5)
        far = sum((mean(theirs, c) - mean(mine, c)) ** 2 for c in ("p1", "p2", "p3", "p4")) ** 0.5
        near = max(0, int(100 - far / 8 * 100 + 0.5))
        want[p] = int(round(0.35 * share["type_id"] + 0.30 * near + 0.20 * share["body_id"] + 0.15 * share["level_id"], 9) + 0.5)
    got = {r.provider_id: (r.score, r.label) for r in ranking.compatibility(Model(spark, DATA).approved(), member, providers).collect()}
    assert {p: s for p, (s, _) in got.items()} == want
    assert all(label == (None if s < 0 else "great" if s >= 70 else "good" if s >= 45 else "fair" if s >= 25 else "low") for s, label in got.values())


def test_search_pages_and_literal_keywords(spark):
    providers = spark.createDataFrame([(1, "a_b", 7, "active"), (2, "aXb", 7, "active"), (3, "A_B", 8, "active"), (4, "a_b", 7, "retired")], "provider_id long, name string, venue_id long, status string")
    reviews = spark.createDataFrame([(1, 80, 1, 1, 1), (2, 40, 2, 1, 1), (2, None, 1, 2, 1)], "provider_id long, score int, type_id int, body_id int, level_id int")
    ids = lambda **more: [r.provider_id for r in ranking.search_providers(providers, reviews, **more).collect()]
    assert ids() == [3, 2, 1] and ids(keyword="a_b") == [3, 1] and ids(keyword="%") == [] and ids(offset=1, limit=1) == [2] and ids(ids=[1, 4]) == [1]
    assert ids(with_stats=True) == [2, 1] and ids(sort="rating") == [1, 2, 3] and ids(sort="reviews") == [2, 1, 3] and ids(sort="name") == [3, 2, 1]
    assert ids(facets={"type_id": [1], "body_id": [2]}) == [2] and ids(min_score=50) == [1]
    assert ids(venues=spark.createDataFrame([(8,), (8,)], "venue_id long")) == [3]


def test_three_passes_of_linkage(spark):
    columns = "{} long, url string, domain string, venue string, name string"
    left = spark.createDataFrame([(1, "u1", "d1", "Big Shop", "ann"), (2, "u9", "d1", "x", "ann"), (3, None, None, "Big Shop Annex", "bea"), (4, None, None, "Big Shop", "bea"), (5, None, None, None, "bea"), (6, None, None, "Shop", None)], columns.format("a"))
    right = spark.createDataFrame([(10, "u1", "d1", "Big Shop", "zoe"), (11, "u2", "d1", "Other", "ann"), (12, None, None, "Big Shop", "bea"), (13, None, None, "Big Shop", "bea"), (14, None, None, "Shop", "bea")], columns.format("b"))
    got = {r.a: (r.b, r.method) for r in linkage.three_pass_links(left, right, "a", "b").collect()}
    assert got == {1: (10, "url"), 2: (11, "domain_name"), 3: (12, "venue_name"), 4: (12, "venue_name")}
