"""Secrets, toxicity, vectors, urls, tool calls and the pipeline against brute force and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm.line_dedup import empty_state, insert, kept_lines
from sievework.llm.mixing import mixed_documents
from sievework.llm.ngram_join import drop_near_copies
from sievework.llm.quality_rules import keep_good, quality_rules
from sievework.llm.queries import queries
from sievework.llm.secret_scan import KINDS, Automaton, ScanSettings, outside, secret_scan, symbols
from sievework.llm.tool_calls import link_calls
from sievework.llm.toxicity import BlockIndex, ToxicSettings, toxicity
from sievework.llm.url_filter import RULES, Rule, url_filter
from sievework.llm.vector_search import SearchSettings, sample_size, search

SF = "/root/testdata/sf0.001"


def brute_spans(text):
    text, found = text or "", []
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"""(?:{name}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), m.end(), "assign") for m in re.finditer(assign, text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def test_secrets(spark, documents, odd, empty):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base62 = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    rows = [(10**6 + i, f"é text ToKen = '{base62(24)}' more {key(40)} AKIA{key(16).upper()} api_key:short") for i in range(60)]
    rows += [(10**5, f"ünder the {base62(23)}7 line"), (10**5 + 1, "plain-words_only.and/such=things"), (10**5 + 2, "secreT: ſecret=abcdefghi1 password=" + "x" * 9000)]
    made = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    texts = sorted(((r["doc_id"], r["text"]) for r in made.collect()), key=repr)
    got = sorted(secret_scan(made).collect(), key=lambda r: repr(r["doc_id"]))
    assert len(got) == len(texts) and secret_scan(empty).count() == 0
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in brute_spans(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[10**5]["n_grammar"] == 1 and by_id[10**5 + 1]["n_grammar"] == 0
    assert all(set(brute_spans(t)) <= {(int(a), int(b), k) for k, a, b in (x.split(":") for x in by_id[i]["spans"].split(",") if x)} for i, t in texts if i and i >= 10**5)


def test_secrets_short_or_joined_to_names(spark):
    rng = random.Random(9)
    key = lambda n, of="ABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(of) for _ in range(n))
    texts = [f"token={key(10)}" for _ in range(80)]
    asked = {100: ("client_key=", key(10), ""), 101: ("it was ", key(10), "."), 102: ("", key(10), " here"), 103: ("x ", "QWZXKPTVRS", " y"), 104: ("a=", key(10), "=b.")}
    rows = list(enumerate(texts)) + [(i, "".join(t)) for i, t in asked.items()]
    found = {r["doc_id"]: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (before, value, _) in asked.items():
        assert found[i]["spans"] == f"grammar:{len(before)}:{len(before) + len(value)}" and found[i]["n_grammar"] == 1


def test_runs_outside_known_spans():
    rng = random.Random(8)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 2 * rng.randint(0, 6)))
        runs = list(zip(cuts[::2], cuts[1::2]))
        known = sorted((a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6))))
        assert outside(runs, known) == [(a, b) for a, b in runs if not any(a < y and x < b for x, y in known)]


def test_automaton_learns_a_format():
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    made = Automaton([symbols(k) for k in keys], ScanSettings().alpha)
    least = sorted(made.likelihood(symbols(k)) for k in keys)[4]
    assert made.likelihood(symbols("deadbeef0123" * 3)) >= least - 0.2
    assert made.likelihood(symbols("readme-for-this.package")) == -np.inf


def test_block_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    ids = rng.permutation(500)
    index = BlockIndex(vectors, np.zeros(500), ids, 40, 16)
    for t, w in vectors[:60]:
        rows, cosines = index.nearest(t, w, 15)
        q = np.zeros(40)
        q[t] = w
        exact = np.round(dense @ q, 12)
        want = np.lexsort((ids, -exact))[:15]
        want = want[exact[want] > 0]
        assert index.ids[rows].tolist() == ids[want].tolist() and np.allclose(cosines, exact[want])


def test_block_bounds_skip_blocks():
    """Four groups of words: the blocks of other groups cannot hold a neighbour and are not read; ties go to smaller ids."""
    rng = np.random.default_rng(8)
    vectors, of = [], rng.integers(0, 4, 400)
    for g in of:
        t = np.sort(rng.choice(50, 12, replace=False)) + 50 * g
        w = rng.random(12) + 0.2
        t, w = np.append(t, 200), np.append(w, 0.1)  # one word that all share
        vectors.append((t, w / np.linalg.norm(w)))
    vectors[7] = vectors[3]
    ids = rng.permutation(400)
    index = BlockIndex(vectors, of.astype(float), ids, 201, 20)
    dense = np.zeros((400, 201))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(100):
        rows, cosines = index.nearest(*vectors[i], 5, without=int(ids[i]))
        exact = np.round(dense @ dense[i], 12)
        exact[i] = 0
        want = np.lexsort((ids, -exact))[:5]
        assert index.ids[rows].tolist() == ids[want].tolist() and np.allclose(cosines, exact[want])
    assert index.read < 100 * index.blocks / 2


def test_toxicity_by_held_out_rows(spark, odd, empty):
    scored = queries()["op9_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = scored[scored["held_out"]].merge(labels, on="doc_id")
    assert scored["score"].between(0, 1).all() and len(scored) == 1000
    assert held[held["toxic"] == 0]["predicted"].mean() <= 0.01 and held[held["toxic"] == 1]["predicted"].mean() >= 0.6
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(odd, none).collect()} == {0.0} and toxicity(empty, none).count() == 0
    some = spark.createDataFrame([(1, 1), (None, 1), (5, 0), (2, 7)], "doc_id long, toxic int")
    rows = toxicity(odd, some, settings=ToxicSettings(telling=1.0)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_uses_all_terms(spark):
    rng = random.Random(6)
    topics = [[f"{c}{chr(97 + i)}{chr(97 + k)}" for i in range(12) for k in range(10)] for c in ("river", "stone", "cloud")]
    rows = [(i, " ".join(rng.choices(topics[i % 3], k=40)) + (" blast" if i % 10 == 0 else "")) for i in range(240)] + [(900, "nothing known 12"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(180)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    # Texts without any insult have neighbours too: examples of their own topic.
    for i in range(180, 240):
        near = found[i]["evidence"]
        assert len(near) == 15
        if i % 10:
            assert all(n % 3 == i % 3 for n in near)
    assert min(found[i]["score"] for i in range(180, 240, 10)) > max(found[i]["score"] for i in range(180, 240) if i % 10)
    assert found[900]["evidence"] == [] and found[901]["score"] == pytest.approx(0.1)
    assert all(i not in found[i]["evidence"] for i in range(180))  # an example is no neighbour of its own


def exact_nearest(vectors, ids, q, k=10):
    apart = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
    apart[q] = np.inf
    best = np.lexsort((ids, apart))[:k]
    return [(int(ids[b]), apart[b]) for b in best if b != q]


@pytest.mark.parametrize("settings", [SearchSettings(), SearchSettings(unit=64, query_unit=2), SearchSettings(fit_bytes=1 << 16)])
def test_vector_search_recall(spark, settings):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = table.toPandas()
    vectors, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    got = search(table, F.col("vec_id") % 20 == 0, settings=settings).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact_nearest(vectors, ids, q)
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own["score"].is_monotonic_increasing
        hits, total = hits + len({i for i, _ in want} & set(own["vec_id"])), total + len(want)
        exact = dict(zip(ids.tolist(), np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))))
        assert np.allclose([exact[i] for i in own["vec_id"]], own["score"], atol=1e-12)
    assert hits / total >= 0.9


def test_vector_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.0, 2.0]), (8, [1.0]), (None, [1.0, 1.0]), (7, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as unit")
    found = [tuple(r) for r in search(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(found) == [(0, 1, 1, 0.0), (0, 2, None, 1.0), (0, 3, 7, pytest.approx(5**0.5)), (0, 4, 7, pytest.approx(5**0.5))]
    assert search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert search(table.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_vector_search_keeps_repeated_ids_and_looks_everywhere(spark):
    """Rows that repeat a query's id are queries and candidates; small far groups hold fewer than k."""
    rng = np.random.default_rng(4)
    near = [(i, (rng.standard_normal(8) + 100 * (i % 40)).tolist()) for i in range(1, 201)]
    rows = [(0, [1.0] * 8), (0, [2.0] * 8), *near, (300, [-500.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(table, F.col("vec_id") % 100 == 0, settings=SearchSettings(coverage=0.2)).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 20, 100: 10, 200: 10, 300: 10}
    first = got[got["query_id"] == 0].nsmallest(2, "score")
    assert sorted(got[(got["query_id"] == 0) & (got["vec_id"] == 0)]["score"]) == [pytest.approx(8**0.5)] * 2 and len(first) == 2
    vectors, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = [i for i, _ in exact_nearest(vectors, ids, len(rows) - 1)]
    assert got[got["query_id"] == 300].sort_values("rank")["vec_id"].tolist() == want


def test_lists_follow_the_root_of_the_rows():
    s = SearchSettings()
    assert [sample_size(n, 128, s)[0] for n in (1, 100, 10_000, 10**8)] == [1, 10, 100, 10_000]
    assert sample_size(10**8, 128, s)[1] == 160_000 and sample_size(10**12, 128, s)[1] * 8 * 128 <= s.fit_bytes


def test_urls(spark):
    rows = [
        (1, "http://a.com/fr/x", '<a href="https://b.net/y">'), (2, "http://B.net/z?q#f", "<a HREF='//bad.net/'>"), (3, "x://bad.org/", None), (4, "http://org", None),
        (5, None, "<a href=http://c.net>"), (6, "no scheme", None), (7, "http://EXAMPLE.ORG/es/1", None), (8, "http://w.example.org/en/12", None),
        (9, "http://evil.com/de/1", None), (10, "http://friend.net/p", '<a href="http://evil.com/de/2">'), (11, "http://evil.com/en/", None), (11, "http://evil.com/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as trust")
    found = {r["page_id"]: r for r in url_filter(pages, RULES).collect()}
    assert url_filter(pages, RULES).count() == 12 and url_filter(pages.limit(0), RULES).count() == 0
    assert (found[2]["host"], found[2]["path"], found[2]["rule"]) == ("b.net", "/z", None)
    assert (found[5]["host"], found[6]["path"], found[4]["rule"]) == ("", "", None)
    assert found[7]["rule"] == "example.org/es/" and found[8]["rule"] == "example.org/en/1" and found[3]["verdict"] == "allow"
    assert found[9]["verdict"] == "block" and found[11]["verdict"] == "block" and found[10]["verdict"] == "block"
    assert found[2]["verdict"] == "allow" and found[2]["trust"] > 0 and found[10]["distrust"] > 0


def test_spread_equals_power_iteration(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.net" for i in range(12)]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['ok', 'no', 'other'])}", f'<a href="http://{rng.choice(hosts)}/">') for i in range(200)]
    rules = [Rule(h, "/ok", "allow") for h in hosts[:3]] + [Rule(h, "/no", "block") for h in hosts[3:6]]
    found = {r["host"]: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    link, seed = np.zeros((12, 12)), np.zeros((12, 2))
    for _, url, html in rows:
        a, path = url[7:].split("/")
        b = html[16:-3]
        x, y = hosts.index(a), hosts.index(b)
        if x != y:
            link[x, y] += 1
        seed[x, 0] += path == "ok" and x < 3
        seed[x, 1] += path == "no" and 3 <= x < 6
    seed /= np.maximum(seed.sum(axis=1), 1)[:, None]
    along = link / np.maximum(link.sum(axis=1), 1)[:, None]
    against = link / np.maximum(link.sum(axis=0), 1)[None, :]
    trust, distrust = 0.15 * seed[:, 0], 0.15 * seed[:, 1]
    for _ in range(200):
        trust, distrust = 0.15 * seed[:, 0] + 0.85 * along.T @ trust, 0.15 * seed[:, 1] + 0.85 * against @ distrust
    for h, r in found.items():
        i = hosts.index(h)
        assert r["trust"] == pytest.approx(trust[i], abs=1e-3) and r["distrust"] == pytest.approx(distrust[i], abs=1e-3)


def test_tool_calls(spark):
    schemas = {"f": {"a": ("integer", True), "b": ("string", False)}}
    calls = spark.createDataFrame(
        [(1, 1, "x", "f", '{"b":"q","a":1}', ["y"]), (1, 1, "y", "f", '{"a":"1"}', None), (1, 0, "z", "g", None, ["x"]),
         (1, 2, "p", "f", "nope", ["q"]), (1, 2, "q", "f", '{"c":[1,{"z":1,"y":2.50}]}', ["p"]), (1, 3, "x", "f", '{"a":2}', None),
         (1, 1, None, "f", '{"a":3}', ["x"]), (None, 1, "x", "f", '{"a":3}', [None])],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 2, "x", 'a "b"\n'), (1, 2, "x", "z"), (1, 5, "w", None)], "conv_id long, turn long, call_id string, content string")
    rows = {(r["conv_id"], r["call_id"], r["kind"]): r for r in link_calls(calls, results, schemas).collect()}
    assert len(rows) == 10
    x = rows[1, "x", "call"]
    assert (x["order_turn"], x["order_level"], x["result_turn"]) == (1, 1, 2) and x["errors"] == []
    assert x["json"] == '{"arguments":{"a":1,"b":"q"},"id":"x","name":"f","result":"a \\"b\\"\\n"}'
    assert (rows[1, "z", "call"]["order_turn"], rows[1, "z", "call"]["order_level"]) == (1, 2)
    assert rows[1, "z", "call"]["errors"] == ["unknown tool"] and rows[1, "y", "call"]["errors"] == ["wrong type of a"]
    assert rows[1, "p", "call"]["order_level"] is None and rows[1, "p", "call"]["errors"] == ["arguments are no object"]
    assert rows[1, "q", "call"]["json"].startswith('{"arguments":{"c":[1,{"y":2.5,"z":1}]}')
    assert rows[1, "w", "orphan_result"]["json"] == '{"content":null,"id":"w"}' and (1, "x", "repeated_result") in rows
    assert link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_pipeline(spark, odd, empty, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{folder}/{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/{i}")
        if name != "packing":
            assert docs.columns == before.columns and docs.count() > 0
        if name == "quality":
            assert docs.count() < before.count()
    packed = docs.toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    for rows in (odd, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, SF).count()
    assert isinstance(packed, pd.DataFrame)


_INSIDE = (
    "_doc _size _turn _own _copy _of _held _words _same _all _d _s _z _cls _keep _set _lost lines _other _quality _host _host_host "
    "_host_rate _host_host_kept _rate _good _text doc cls first copies n_words kept base_failed host_rate host rate"
).split()


def test_stages_leave_clashing_columns_alone(spark, odd):
    """Every name used inside stands in the table, with values of its own, and comes out as it went in."""
    plain = odd.select("doc_id", "text", "source")
    marked = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for c in _INSIDE})
    wide = marked.withColumns({"_own": F.lit(77), "_copy": F.lit(78)})
    stages = [keep_good, lambda d: kept_lines(d, insert(empty_state(spark, 1), d)).drop("_lines"), drop_near_copies, mixed_documents]
    for stage in stages:
        got, alone = stage(wide), stage(plain)
        assert set(wide.columns) <= set(got.columns)
        rows = got.collect()
        key = lambda r: repr((r["doc_id"], r["text"], r["source"]))
        assert sorted(map(key, rows)) == sorted(map(key, alone.collect()))
        assert all(r["_own"] == 77 and r["_copy"] == 78 for r in rows)
        assert all(r[c] == f"{c}{r['doc_id'] or 0}" for r in rows for c in _INSIDE if c not in ("_own", "_copy"))
    judged = quality_rules(wide)
    assert judged.count() == odd.count() and {"_host", "_quality", "_good", "kept"} <= set(judged.columns)
