"""Host similarity against a comparison of all pairs."""

import difflib
import itertools
import random

from rankweave.operators import classify


def test_similar_hosts_lose_no_pair(spark):
    rng = random.Random(4)
    parts = ["blog", "m", "shop", "theron", "therly", "a", "aa", "news", "news1", "inglor"]
    hosts = {".".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + "." + rng.choice(["net", "com", "example.net"]) for _ in range(150)}
    hosts |= {"blog.therly.example.net", "m.theron.example.net", "net"}
    want = {}
    for a, b in itertools.combinations(sorted(hosts), 2):
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        if a.split(".")[-1] == b.split(".")[-1] and ratio >= 0.7:
            want[a, b] = ratio
    rows = [(h,) for h in hosts] * 2 + [(None,), ("",)]
    got = classify.similar_hosts(spark.createDataFrame(rows, "h string"), "h").collect()
    assert len(got) == len(want) and {(r.host, r.other): r.ratio for r in got} == want
    assert ("blog.therly.example.net", "m.theron.example.net") in want
