"""Top-k search and URL filters against brute force."""

import numpy as np
import pytest

from faultsift.llm import topk, url_filter

VECTORS = "vec_id long, embedding array<float>, rank int"


def brute(rows, asked, k):
    kept = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(asked & kept.keys()):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=False)), i) for i, v in kept.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("at_once", [8192, 3])
def test_search_is_exact_with_ties_and_odd_vectors(spark, at_once):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=6).round(1)], 0) for i in range(200)]
    rows += [(i, rows[0][1], 0) for i in range(200, 260)]  # a very common vector
    rows += [(300, None, 0), (301, [None] * 6, 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0),
             (304, [], 0), (305, [1.0, 2.0], 0), (None, rows[1][1], 0)]
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    asked = {i for i in range(0, 306, 20)} | {301, 305}
    got = topk.search(table, table.where(table.vec_id.isin(list(asked))), block_rows=16, queries_at_once=at_once)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 10)


def test_bounds_prune_where_vectors_lie_in_clusters():
    random = np.random.default_rng(4)
    centres = random.normal(size=(60, 32)) * 500
    rows = (centres[random.integers(60, size=20_000)] + random.normal(size=(20_000, 32)) * 40).astype(np.int64)
    ids, asked = np.arange(len(rows)), np.arange(0, len(rows), 100)
    searcher = topk._Searcher(asked, rows[asked], 10)
    searcher.rows(ids, rows)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -(1 << 62)
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :10]
    number, score, vector = searcher.top()
    assert (number.reshape(-1, 10) == np.arange(len(asked))[:, None]).all()
    assert (vector.reshape(-1, 10) == want).all()
    assert (score.reshape(-1, 10) == np.take_along_axis(scores, want, axis=1)).all()
    assert searcher.scored < 0.5 * searcher.pairs


def test_blocks_cover_all_rows_once():
    rows = np.random.default_rng(5).normal(size=(1000, 3))
    rows[:500] = rows[0]
    blocks = topk.coherent_order(rows, 64)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(1000)) and max(map(len, blocks)) <= 64


def test_search_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.search(few, few.where("vec_id = 1")).collect()] == [(1, 1, 2, 1024 * 2048)]
    none = spark.createDataFrame([], VECTORS)
    assert topk.search(none, none).count() == 0 and topk.search(few, none).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("example.net", "/", "block"), ("a.example.net", "/en/x", "block"), ("", "/", "block")]
URLS = ["http://a.example.net/en/x/1", "http://EXAMPLE.net/en/", "https://b.example.net?x=1", "http://example.com/de/",
        "http://notexample.com/de/", "http://example.com.evil.org/fr/", "no scheme", "", None, "http://", "x://net/",
        "http://net-x/", "http://a.net#frag", "http://w.org/fr/?q", "http://a..net/", "http://example.net:80/en/",
        "http://x.example.net/en/a\nb", "http://a.example.net/en/x/1"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    tail = rest[len(host):]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in RULES
            if ("." + host).endswith("." + h) and (h or not host) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("salts", [1, 5])
def test_urls_get_the_longest_fitting_rule(spark, salts):
    pages = spark.createDataFrame([(i if i != 4 else None, u, "x", "y") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block"), ("x", None, "allow")],
                                  "host string, path string, action string")
    got = url_filter.judge_urls(pages, rules, salts=salts)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = [(i if i != 4 else None, *judged(u)) for i, u in enumerate(URLS)]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.judge_urls(pages.where("false"), none).count() == 0
