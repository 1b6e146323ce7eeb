import collections
import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shopmetrics.llm import components as cc
from shopmetrics.llm import mixing as mx
from shopmetrics.llm import multi_index as mi
from shopmetrics.llm import queries
from shopmetrics.llm import token_shards as ts
from shopmetrics.llm import warc
from shopmetrics.llm.common import small_batches

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# components


def test_components_match_union_find(spark):
    pick = random.Random(1)
    pairs = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {k: find(k) for p in pairs if p[0] != p[1] for k in p}
    found = dict(map(tuple, cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == expected
    assert cc.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


# mixing


def fractions(sizes, weights, most):
    """Targets by the rule, in plain Python."""
    total, open_sources, target = sum(sizes.values()), set(sizes), {}
    while total:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_sources)
        over = {s for s in open_sources if level * weights[s] >= most * sizes[s]}
        if not over:
            return {**target, **{s: level * weights[s] for s in open_sources}}
        target |= {s: most * sizes[s] for s in over}
        open_sources -= over
    return dict.fromkeys(sizes, 0.0)


def highest_quotients(weights, seats):
    won = collections.Counter()
    for _ in range(seats):
        best = max((w / (2 * won[k] + 1), -k) for k, w in enumerate(weights))
        won[-best[1]] += 1
    return [won[k] for k in range(len(weights))]


@pytest.mark.parametrize("seats", [0, 1, 3, 50, 1000])
def test_apportionment_is_by_highest_quotients(spark, seats):
    weights = [5.0, 5.0, 0.0, 1.0, 12.5, 0.3, 7.0, 1e3]
    parties = spark.createDataFrame(list(enumerate(weights)), "party long, w double")
    found = {r["party"]: r["seats"] for r in mx.apportioned(parties, seats, "w", ["party"]).collect()}
    assert [found[k] for k in range(len(weights))] == highest_quotients(weights, seats)


def mix_rows():
    pick = random.Random(2)
    rows = [(k, " ".join(["w"] * pick.randint(0, 90)), pick.choice(["hot", "hot", "b", "Z", "é", "zz", None])) for k in range(400)]
    return rows + [(900, None, "hot"), (901, "", "hot"), (None, "a b c", "hot"), (902, "a b", "hot"), (902, "a b", "hot"), (903, "w " * 20_000, "b"), (904, "one two", "tiny"), (905, None, "void")]


def test_mix_meets_its_targets(make_docs):
    rows, mix = mix_rows(), mx.Mix(stream=3000, stretch=64)
    found = mx.mixed(make_docs(rows), mix=mix).collect()
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    expected = fractions(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    assert sorted((r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None) == sorted((r[0], size(r[1])) for r in rows if r[0] is not None)
    source, taken = {r[0]: r[2] for r in rows}, collections.Counter()
    for r in found:
        own = source[r["doc_id"]]
        taken[own] += r["taken"]
        assert r["source_size"] == sizes[own] and math.isclose(r["target"], expected[own], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 2 + 0.01 * t, s


def test_mix_reruns_agree(make_docs):
    docs, mix = make_docs(mix_rows()), mx.Mix(stream=3000, stretch=64)
    one, two = (sorted(map(str, mx.mixed(d, mix=mix).collect())) for d in (docs, docs.repartition(5)))
    assert one == two


def test_mix_of_nothing(make_docs):
    assert mx.mixed(make_docs([(1, "a")]).limit(0)).collect() == []
    assert [tuple(r) for r in mx.mixed(make_docs([(1, None), (2, " ")])).collect()] in ([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)], [(2, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)])


def test_resampled_rows_are_whole(make_docs):
    docs = make_docs(mix_rows())
    again = mx.resampled(docs, mix=mx.Mix(stream=3000, stretch=64))
    assert again.columns == docs.columns
    counts = collections.Counter(r["doc_id"] for r in again.collect())
    assert max(n for k, n in counts.items() if k not in (902, None)) <= 3


# multi-index


def brute_neighbours(rows, every, keep):
    usable = [(k, np.array(v, float)) for k, v in rows if k is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (k, q) in enumerate(usable):
        if k % every == 0:
            near = sorted((-float((q * v).sum()), i) for m, (i, v) in enumerate(usable) if m != n)[:keep]
            out.setdefault(k, []).append([(i, -s) for s, i in near])
    return out


def vectors(n, seed=3):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, 8))
    return [(k, [float(x) for x in centres[k % 12] + 0.4 * pick.normal(size=8)]) for k in range(n)]


def nearest(spark, rows, index):
    found = mi.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int"), index=index).collect()
    out = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] <= index.neighbours
    return out


def test_index_is_exact_where_it_passes_all(spark):
    same = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0]
    odd = [(None, same), (5000, None), (5001, []), (5002, [0.0] * 8), (5003, [math.nan] + same[1:]), (5004, [math.inf] + same[1:]), (5005, [None] + same[1:]), (5006, [1.0, 2.0])]
    rows = vectors(150) + [(1000 + k, same) for k in range(60)] + odd
    full = mi.Index(recall=1.0, block=16, queries=4)
    expected = brute_neighbours(rows, 20, 20)
    found = nearest(spark, [(*r, 1) for r in rows], full)
    assert set(found) == set(expected)
    for k, answers in expected.items():
        assert [i for i, _ in found[k]] == [i for i, _ in answers[0]], k
        assert np.allclose([s for _, s in found[k]], [s for _, s in answers[0]], rtol=0, atol=1e-12)


def test_index_recall(spark):
    rows = vectors(3000)
    expected, index = brute_neighbours(rows, 20, 20), mi.Index(measured=60)
    found = nearest(spark, [(*r, 1) for r in rows], index)
    assert np.mean([len({i for i, _ in found[k]} & {i for i, _ in a[0]}) / 20 for k, a in expected.items()]) >= 0.9


def test_index_of_few_rows(spark):
    index = mi.Index()
    assert nearest(spark, [(20, [1.0, 2.0], 0), (21, [1.0, 0.0], 0)], index) == {20: [(21, 1.0)]}
    assert nearest(spark, [(1, [1.0], 0), (3, [2.0], 0)], index) == {}
    assert nearest(spark, [(20, None, 0)], index) == {}
    assert nearest(spark, [(20, [1.0], 0)], index) == {}


def test_pairs_come_in_order():
    pick = np.random.default_rng(4)
    halves, q = (pick.normal(size=(6, 2)), pick.normal(size=(9, 3))), pick.normal(size=5)
    order = list(mi.visited(q, halves))
    sums = ((halves[0] @ q[:2])[:, None] + (halves[1] @ q[2:])[None]).ravel()
    assert sorted(order) == list(range(54)) and (np.diff(sums[order]) <= 1e-12).all()


# WARC

PAGES = "page_id long, url string, html string, holder string"


def page_rows():
    big = ["é" * 700, "b" * 1000, "c" * 999, "d" * 5000]
    rows = [(k, f"http://h{k % 7}.org/{k}", big[k % 4] if k % 3 else f"<p>{k}</p>" * (k % 400), "x") for k in range(120)]
    return rows + [(500, None, None, None), (501, "", "", None), (None, "http://n/", "b" * 1000, None), (None, None, "b" * 1000, None), (None, "u", "<p>0</p>", None), (None, "v", "n" * 2000, None), (None, "w", "n" * 2000, None), (502, "a\r\nX: y", "d" * 5000, None), (503, "http://x/", "z" * 300_000, None), (40, "again", "b" * 1000, None), (119, "again", "d" * 5000, None), (119, "again", "d" * 5000, None)]


def expected_records(rows):
    with_id = [r for r in rows if r[0] is not None]
    top = {}
    for r in with_id:
        top[r[2]] = max(r[0], top.get(r[2], r[0]))
    out, seen = [], set()
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        shared = len(data) >= 1000 and html in top  # rows without an id revisit the page that has their payload
        again = shared and ((page_id, html) in seen or top[html] != page_id)
        if shared and top[html] == page_id:
            seen.add((page_id, html))
        out.append((page_id, len(data), "revisit" if again else "response", top[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [warc.Archive(), warc.Archive(shard=20_000, roll=2_000)])
def test_archives_round_trip(spark, tmp_path, limits):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    manifest, folder = warc.write_archives(pages, limits, str(tmp_path / "a"))
    back = warc.read_archives(manifest, folder).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back), key=str) == expected_records(rows)
    texts = {(r[0], r[2] or "") for r in rows}
    assert all((r["page_id"], r["html"]) in texts for r in back if r["record_type"] == "response")
    # The same pages laid out differently make the same files.
    other, second = warc.write_archives(pages.repartition(7), limits, str(tmp_path / "b"))
    files = sorted(map(tuple, manifest.collect()))
    assert files == sorted(map(tuple, other.collect()))
    assert all((tmp_path / "a" / f[0]).read_bytes() == (tmp_path / "b" / f[0]).read_bytes() for f in files)
    assert not [p for p in os.listdir(folder) if p.startswith("_temporary")]
    per_shard = collections.Counter(f[1] for f in files)
    assert limits.roll > 2_000 or len(files) > 5 and max(per_shard.values()) > 1  # files are rolled within a shard
    names = [h["WARC-Record-ID"] for f in files for h, _ in warc.records_of(folder, f[0])]
    assert len(names) == len(set(names))


def test_damaged_archives_are_noticed(spark, tmp_path):
    manifest, folder = warc.write_archives(spark.createDataFrame(page_rows()[:20], PAGES), folder=str(tmp_path / "a"))
    path = tmp_path / "a" / manifest.first()["file"]
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends within a record|invalid|Error"):
        warc.read_archives(manifest, folder).collect()


def test_archives_without_ids_fill_several_shards(spark, tmp_path):
    """Copies of one payload without ids are dealt by their urls, and are responses, as no page has it."""
    rows = [(None, f"http://h/{k}", "n" * 2000, None) for k in range(200)]
    manifest, folder = warc.write_archives(spark.createDataFrame(rows, PAGES), warc.Archive(shard=20_000), str(tmp_path / "a"))
    assert manifest.count() > 10 and manifest.agg({"records": "max"}).first()[0] < 60
    back = warc.read_archives(manifest, folder).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert [tuple(r) for r in back] == [(None, "response", None, 200)]


def test_shards_follow_the_input(spark):
    """A shard holds a 64th of the input, between its bounds."""
    facts = spark.range(10_000).selectExpr("id AS page_id", "488L AS bytes")
    count = lambda **limits: len(warc._cuts(facts, warc.Archive(**limits))[0])
    assert count() == 1
    assert 60 <= count(shard=1_000) <= 130
    assert count(shard=1_000, largest_shard=20_000) > 400


def test_archives_of_nothing(spark, tmp_path):
    manifest, folder = warc.write_archives(spark.createDataFrame([], PAGES), folder=str(tmp_path / "a"))
    assert warc.read_archives(manifest, folder).collect() == []


# token shards


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one(size):
    places = ts.permuted(np.arange(size), size, 5)
    assert sorted(places.tolist()) == list(range(size))
    assert size < 100 or (places != ts.permuted(np.arange(size), size, 6)).any()


def test_shards_round_trip(spark, tmp_path, make_docs):
    pick = random.Random(8)
    rows = [(k, " ".join(pick.choice(["alpha", "Größe", "x", "\n", "42", "naïve"]) for _ in range(pick.randint(0, 300)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (102, "word " * 9000), (7, "again"), (7, "again")]
    layout = ts.Layout(queries.TOKENIZER, length=64, shard=8_000)
    slots, folder = ts.materialise(make_docs(rows), layout, folder=str(tmp_path / "t"))
    found = slots.orderBy("slot").collect()
    assert [r["slot"] for r in found] == list(range(len(found)))
    records = list(ts.read_records(spark, folder, 0, len(found)))
    assert len(records) == len(found) and all(len(r) == 64 for r in records)
    some = list(ts.read_records(spark, folder, 5, 9))
    assert all((a == b).all() for a, b in zip(some, records[5:14])) and len(some) == 9
    encoder, tokens = ts._encoder(layout.tokenizer), collections.Counter()
    for r in found:
        assert sum(r["doc_tokens"]) == r["n_tokens"] <= 64
        for d, n in zip(r["doc_ids"], r["doc_tokens"]):
            tokens[d] += n
    expected = collections.Counter()
    for d, text in rows:
        expected[d] += len(encoder.encode_ordinary(text or "")) + 1
    assert tokens == expected
    # Undo the permutation's effect by the documents: each one's tokens are there, in some order of its sequences.
    pieces = collections.Counter()
    for r, record in zip(found, records):
        at = 0
        for d, n in zip(r["doc_ids"], r["doc_tokens"]):
            if tokens[d] == n:
                pieces[(d, encoder.decode_bytes([t for t in record[at : at + n].tolist() if t != layout.end_token]).decode())] += 1
            at += n
    texts = dict(rows)
    assert pieces and all(text == (texts[d] or "") for d, text in pieces)
    assert sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.startswith("shard-")) == len(found) * layout.stride


def test_shards_of_nothing(spark, tmp_path, make_docs):
    slots, folder = ts.materialise(make_docs([(1, "a")]).limit(0), ts.Layout(queries.TOKENIZER), folder=str(tmp_path / "t"))
    assert slots.collect() == []


def test_shards_are_written_from_small_batches(spark, tmp_path, make_docs, monkeypatch):
    """Large rows of a shard come to Python a few at a time, and the session's own bound is back afterwards."""
    key, during = "spark.sql.execution.arrow.maxBytesPerBatch", []
    stored, before = ts.written, spark.conf.get(key)

    def written(df, name):
        during.append(spark.conf.get(key))
        return stored(df, name)

    monkeypatch.setattr(ts, "written", written)
    slots, _ = ts.materialise(make_docs([(1, "word " * 900)]), ts.Layout(queries.TOKENIZER, length=64), folder=str(tmp_path / "t"))
    assert slots.count() == 15 and during == [str(8 << 20)] and spark.conf.get(key) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    blobs = spark.range(24, numPartitions=1).selectExpr("repeat('x', 1000000) AS blob")
    with small_batches(spark):
        assert blobs.mapInArrow(sizes, "bytes long").agg({"bytes": "max"}).first()[0] < 10_000_000


# queries and pipeline


def test_warc_query_matches_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = connection.execute(queries.ORACLE["op8_warc"])
    names = [c[0] for c in expected.description]
    found = queries.QUERIES["op8_warc"](spark, SF)
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("name", ["op3_toxicity", "op7_source_mix", "op9_decontamination", "op10_quality", "op2_license_scan", "op4_fuzzy_lines", "op5_near_duplicates"])
def test_document_queries_answer_each_row(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES[name](spark, SF)
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
            ids.append(collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3])
    assert all(n == 1 for some in ids[:3] for n in some.values()) and max(ids[3].values()) <= 3
    held = {d for r in docs.select("doc_ids").collect() for d in r["doc_ids"]}
    assert held == set(ids[3])
