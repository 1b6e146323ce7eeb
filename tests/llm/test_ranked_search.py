import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import ranked_search as rs
from shopmetrics.llm.common import table
from shopmetrics.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cut(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(rows, queries, k=10):
    """Scores of all documents, one by one."""
    docs = [(d, Counter(cut(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, df = sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        scores = []
        for doc_id, tf, n in docs:
            m = 25 + 75 * n * len(docs) // total
            score = 0
            for t in cut(text):
                if t in tf:
                    w = math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, j + 1, s[3], -s[0]) for j, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def result(spark, docs, queries, layout=None, k=10):
    index = rs.read_index(spark, rs.write_index(docs, layout=layout))
    return sorted(map(tuple, rs.search(index, queries, k, layout=layout).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (1 + k) for k in range(300)]
    rows = [(k, " ".join(pick.choices(words, weights, k=pick.choice([3, 30, 200])))) for k in range(900)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 900, 3)]  # ties
    queries = [(k, " ".join(pick.choices(words, weights, k=20) + pick.choices(words, k=8))) for k in range(25)]
    return rows, queries


def test_numbers_keep_their_value():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1], np.int64)
    data, starts = rs.packed(values)
    assert (rs.unpacked(data.tobytes()) == values).all() and starts[3] == 3


@pytest.mark.parametrize("shard, window", [(1, 2048), (20_000, 2048), (20_000, 64), (1 << 25, 1), (1 << 25, 64), (1 << 25, 2048)])
def test_equals_all_scores(spark, make_docs, corpus, monkeypatch, shard, window):
    rows, queries = corpus
    docs = make_docs(rows).withColumn("term", F.lit(1)).withColumn("a.b", F.lit(1))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("query", F.lit(5))
    if shard == 1:
        docs, rows = docs.where("doc_id < 40"), [r for r in rows if r[0] < 40]
    index = rs.read_index(spark, rs.write_index(docs, layout=rs.Layout(shard=shard)))
    monkeypatch.setattr(rs, "WINDOW", window)
    # The tasks read the module's own numbers: the shards are searched here.
    heads = index.where("lengths IS NOT NULL").agg(F.sum("filled"), F.sum("total")).first()
    if window == 2048:
        found = sorted(map(tuple, rs.search(index, asked, layout=rs.Layout(part=100)).collect()), key=str)
    else:
        found = searched_here(index, queries, *heads)
    assert found == brute(rows, queries)


def searched_here(index, queries, documents, words):
    rows = index.toArrow()
    many = Counter()
    for r in rows.select(["term", "many"]).to_pylist():
        many[r["term"]] += r["many"] or 0
    best = {item: [] for item, _ in queries}
    for shard in set(rows.column("shard").to_pylist()):
        group = rows.filter(rs.pc.equal(rows.column("shard"), shard))
        group = group.append_column("asked", rs.pa.nulls(len(group)))
        lists = rs._Lists(group, documents, words)
        for item, text in queries:
            terms = Counter(rs.terms(text.encode()))
            wanted = [(t, n * math.floor(1000 * math.log((2 * documents + 2) / (2 * many[t] + 1)))) for t, n in terms.items()]
            best[item] += [(-score, lists.ids[place]) for score, place in lists.search(wanted, 10)]
    return sorted(((i, j + 1, d, -s) for i, found in best.items() for j, (s, d) in enumerate(sorted(found)[:10])), key=str)


def test_blocks_are_rejected_unread(spark, make_docs, monkeypatch):
    """Once the heap is full, few blocks of the lists that are not essential are decompressed."""
    rows = [(k, "often " * (1 + k % 3) + "word " * 20) for k in range(9000)]
    rows = [(d, t + "rare " * 9 if d < 20 or d in (5000, 7777) else t) for d, t in rows]
    rows[5000] = (5000, "rare " * 30 + "often")
    index = rs.read_index(spark, rs.write_index(make_docs(rows).coalesce(1))).toArrow()
    lists = rs._Lists(index.append_column("asked", rs.pa.nulls(len(index))), 9000, 200_000)
    monkeypatch.setattr(rs, "WINDOW", 64)
    found = lists.search([(b"rare", 5000), (b"often", 3)], 10)
    assert len(found) == 10 and 5000 in {place for _, place in found}
    first, end = lists.range[b"often"]
    assert end - first > 100 and len(lists.single) <= 2
    assert [low for term, low in lists.windows if term == b"often"] == [0]


def test_edge_rows(spark, make_docs):
    long = " ".join(f"x{k % 5000}" for k in range(100_000))
    rows = [
        (1, None), (2, ""), (3, " .,;\n"), (None, "alpha beta"), (None, "alpha beta"), (5, "Alpha-BETA é É"), (5, "Alpha-BETA é É"),
        (7, "gamma"), (8, long), (-4, "alpha"), (9, "a_b\x7fc d"),
    ]
    queries = [
        (1, "alpha alpha beta"), (1, "gamma"), (None, "x17 nowhere"), (2, None), (3, ""), (4, "..."), (5, "É"), (6, "b"), (7, "unknown"),
    ]
    docs, asked = make_docs(rows), spark.createDataFrame(queries, "item_id long, text string")
    for layout in (rs.Layout(shard=1, part=2), rs.Layout()):
        assert result(spark, docs, asked, layout) == brute(rows, queries)
    assert result(spark, docs.limit(0), asked) == []
    assert result(spark, docs, asked.limit(0)) == []
    assert result(spark, docs, asked, k=1) == brute(rows, queries, 1)


def test_query_equals_sql_and_all_scores(spark):
    import duckdb

    docs, queries = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    found = sorted(map(tuple, QUERIES["op12_ranked_search"](spark, SF_DIR).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in queries.collect()])
    other = duckdb.connect()
    for name in ("documents", "benchmark"):
        other.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'").fetchall()
    assert found == sorted(other.execute(ORACLE["op12_ranked_search"]).fetchall(), key=str)
