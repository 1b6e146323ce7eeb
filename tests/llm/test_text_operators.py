import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from shopmetrics.llm import decontamination as dc
from shopmetrics.llm import fuzzy_lines as fl
from shopmetrics.llm import licenses as li
from shopmetrics.llm import quality as qu
from shopmetrics.llm import toxicity as tx
from shopmetrics.llm.common import held_out

SYLLABLES = ["ra", "to", "min", "el", "sho", "ver", "ti", "gan", "lu", "pe"]


def prose(pick, n):
    return " ".join("".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4))) for _ in range(n))


# toxicity


@pytest.fixture(scope="module")
def toxic_corpus(spark, make_docs):
    pick = random.Random(1)
    rows, labels = [], []
    for k in range(700):
        words = prose(pick, pick.randint(5, 200)).split()
        toxic = k % 5 == 0
        if toxic:  # stems with endings that vary
            words[pick.randrange(len(words))] = pick.choice(["zgrok", "fwemb"]) + pick.choice(SYLLABLES)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(make_docs, toxic_corpus):
    rows, labels = toxic_corpus
    extra = [(9001, None), (9002, ""), (9003, "!!! ..."), (None, "zgroklu"), (9004, prose(random.Random(2), 40_000) + " fwembra")]
    found = tx.toxicity(make_docs(rows + extra), labels).join(labels, "doc_id", "left").collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    unseen = [r for r in found if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in unseen) >= 0.97 * len(unseen)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[9001]["score"] == by_id[9002]["score"] == by_id[9003]["score"] < 0.3
    assert by_id[None]["held_out"] and by_id[None]["predicted"] == 1 and by_id[9004]["predicted"] == 1


def test_toxicity_learns_nothing_from_held_out_labels(spark, make_docs, toxic_corpus):
    rows, labels = toxic_corpus
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, tx.toxicity(make_docs(rows), x).collect())) for x in (labels, flipped))
    assert one == two


def test_samples_have_one_row_per_id(make_docs, toxic_corpus):
    rows, labels = toxic_corpus
    many = rows[:200] + [r for r in rows[:4] for _ in range(60)]
    one, two = (tx.fit(make_docs(r), labels) for r in (rows[:200], many))
    assert (one.per_bucket == two.per_bucket).all() and (one.slope, one.level) == (two.slope, two.level)
    known = labels.withColumn("quality", F.col("toxic"))
    one, two = (qu.fit(make_docs(r), known, qu.Quality()) for r in (rows[:200], many))
    assert one[0] is not None and np.allclose(one[0], two[0])


def test_toxicity_without_labels_or_rows(spark, make_docs, toxic_corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in tx.toxicity(make_docs([(1, "a"), (2, None)]), none).collect()} == {0}
    assert tx.toxicity(make_docs([(1, "a")]).limit(0), toxic_corpus[1]).collect() == []
    odd = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, toxic int")
    assert tx.toxicity(make_docs([(1, "a")]), odd).count() == 1


def test_filtering_stages_take_any_columns(spark, make_docs, toxic_corpus):
    """Names with dots, names that the operators use, nulls in every column and repeated rows."""
    rows, labels = toxic_corpus
    passage = "ver ti gan lu pe ra to min el sho ver ti gan lu pe to ra el min sho"
    odd = [(None, None), (None, "min el sho"), (9001, ""), (9002, f"so {passage} on"), (9002, f"so {passage} on"), (9003, "ra to"), (9003, "ra to")]
    docs = make_docs(rows + odd).withColumn("a.b", F.lit("x")).withColumn("c0", F.lit(1)).withColumn("Score.", F.lit(None).cast("int"))
    benchmark = spark.createDataFrame([(1, passage), (2, None), (None, passage)], "item_id long, text string")
    count = lambda df, doc_id: df.where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).count()
    kept = tx.clean(docs, labels)
    assert kept.schema == docs.schema
    assert [count(kept, x) for x in (None, 9001, 9002, 9003)] == [2, 1, 2, 2]
    free = dc.uncontaminated(docs, benchmark)
    assert free.columns == docs.columns and [count(free, x) for x in (None, 9001, 9002, 9003)] == [2, 1, 0, 2]
    assert dc.uncontaminated(docs, benchmark.limit(0)).count() == docs.count()
    for stage in (tx.clean(docs.limit(0), labels), dc.uncontaminated(docs.limit(0), benchmark)):
        assert stage.collect() == [] and stage.columns == docs.columns


def test_clean_keeps_columns(make_docs, toxic_corpus):
    rows, labels = toxic_corpus
    docs = make_docs(rows)
    kept = tx.clean(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) <= 0.05 * len(toxic) and len(ids - toxic) >= 0.97 * (len(rows) - len(toxic))


def test_worst_passage_of_long_texts_is_that_of_their_pieces():
    s = tx.Settings()
    scores = np.random.default_rng(1).normal(size=1 << s.bits).astype(np.float32)
    text = prose(random.Random(3), 40_000).encode()
    assert len(text) > 1 << 17
    half = len(text) // 2
    assert tx.worst_passage(text, scores, s) >= max(tx.worst_passage(text[:half], scores, s), 0) - 0.5
    assert tx.worst_passage(b" . ", scores, s) is None


# decontamination


def plain_distance(piece, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(piece, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def changed(data, pick, times):
    data = bytearray(data)
    for _ in range(times if data else 0):
        k = pick.randrange(max(1, len(data) - 1))
        pick.choice([lambda: data.__setitem__(slice(k, k + 1), b"x"), lambda: data.__delitem__(slice(k, k + 1)), lambda: data.insert(k, 121)])()
    return bytes(data)


def test_leaks_match_plain_alignment(spark, make_docs):
    pick = random.Random(4)
    items = [(k, prose(pick, pick.randint(12, 40))) for k in range(8)] + [(50, "short"), (51, None), (None, "x" * 60), (52, "")]
    rows = []
    for k in range(40):
        inner = changed(items[k % 8][1].encode(), pick, pick.randint(0, 40)).decode() if k % 2 else ""
        rows.append((k, f"{prose(pick, pick.randint(0, 60))}\n{inner.upper()}, {prose(pick, 20)}"))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1]), (103, prose(pick, 9000) + " " + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    budget = dc.Budget()
    pieces = [(k, p, budget.of(len(p))) for k, t in items[:8] for p in budget.pieces(dc.normalised(t))]
    expected = []
    for doc_id, text in rows:
        data = dc.normalised(text)
        if len(data) > 5000:
            hits = {k for k, p, _ in pieces if p in data}
        else:
            hits = {k for k, p, e in pieces if data and plain_distance(p, data) <= e}
        expected.append((doc_id, bool(hits), len(hits), sorted(hits)))
    for limits in (budget, dc.Budget(block=300)):  # one block, and several
        found = dc.contaminated(make_docs(rows), benchmark, budget=limits).drop("least_edits").collect()
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    docs = make_docs(rows)
    kept = dc.uncontaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r["leaks"] for r in kept.collect()} == {7}
    assert kept.count() == sum(not e[1] for e in expected)


def test_short_passages_are_found_word_for_word(spark, make_docs):
    items = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "Paris"), (2, "what is"), (3, "..."), (4, "Paris")], "item_id long, text string")
    rows = [(1, "So: WHAT IS 2+2, then"), (2, "what is 2 23"), (3, "in paris."), (4, "comparison"), (5, None), (6, "")]
    for limits in (dc.Budget(), dc.Budget(block=8)):
        found = {r["doc_id"]: (r["item_ids"], r["least_edits"]) for r in dc.contaminated(make_docs(rows), items, budget=limits).collect()}
        assert found == {1: ([1, 2], 0), 2: ([2], 0), 3: ([2, 4], 0), 4: ([], None), 5: ([], None), 6: ([], None)}


def test_leaks_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in dc.contaminated(make_docs([(1, "a")]), none).collect()] == [False]
    assert dc.contaminated(make_docs([(1, "a")]).limit(0), none).collect() == []


def test_long_passages_are_cut_in_pieces():
    budget = dc.Budget(piece=100)
    assert [len(p) for p in budget.pieces(b"x" * 250)] == [84, 84, 82]
    assert budget.pieces(b"x" * 39) == []


# fuzzy lines


def test_edit_distance_matches_plain():
    pick = random.Random(5)
    for _ in range(300):
        a = bytes(pick.choice(b"abc") for _ in range(pick.randint(0, 25)))
        b = changed(a + b"a", pick, pick.randint(0, 8)) if pick.random() < 0.8 else b""
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j - 1] + (x != y), row[j] + 1, now[j - 1] + 1))
            row = now
        most = pick.randint(0, 12)
        assert fl.edit_distance(a, b, most) == min(row[-1], most + 1)


def brute_lines(rows, lines):
    spots = sorted(((r[0] is None, r[0] or 0, k, n, line) for n, r in enumerate(rows) for k, line in fl._cut(r[1])), key=lambda s: s[:4])
    texts = sorted({s[4] for s in spots})
    sims, root = fl.simhashes(texts), list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if np.bitwise_count(sims[i] ^ sims[j]) <= lines.distance and fl.similar(texts[i], texts[j], lines.percent):
                root[find(i)] = find(j)
    seen, out = set(), {n: ([], []) for n in range(len(rows))}
    for _, _, k, n, line in spots:
        group = find(texts.index(line))
        out[n][group in seen].append(k)
        seen.add(group)
    return sorted(((r[0], sum(map(len, out[n])), len(out[n][0]), sorted(out[n][1])) for n, r in enumerate(rows)), key=str)


def test_fuzzy_lines_match_all_pairs(make_docs):
    pick = random.Random(6)
    base = [prose(pick, pick.randint(1, 60)) for _ in range(25)] + ["", "...", "Über é", "x"]
    rows = []
    for k in range(60):
        some = [pick.choice(base) for _ in range(pick.randint(0, 8))]
        some = [changed(s.encode(), pick, 1).decode("utf-8", "replace").upper() if s and pick.random() < 0.3 else s for s in some]
        rows.append((k, "\n".join(some)))
    rows += [(200, None), (201, ""), (None, base[0]), (202, prose(pick, 9000) + "\n" + base[1])]
    for lines in (fl.Lines(), fl.Lines(distance=2, small=4)):
        assert sorted(map(tuple, fl.fuzzy_lines(make_docs(rows), lines=lines).collect()), key=str) == brute_lines(rows, lines)


def test_fuzzy_lines_link_by_edits_alone(make_docs):
    """Near copies with a changed character or word are found whatever their SimHashes."""
    pick = random.Random(7)
    rows = []
    for k in range(60):
        base = prose(pick, pick.randint(5, 40))
        words = base.split()
        words[pick.randrange(len(words))] = "zq"
        rows += [(10 * k, base), (10 * k + 1, changed(base.encode(), pick, 1).decode()), (10 * k + 2, " ".join(words))]
    rows += [(1000, "abcdefgh"), (1001, "abcdefgx"), (1002, "to the gate"), (1003, "to a gate"), (1004, "abc"), (1005, "abd")]
    expected = brute_lines(rows, fl.Lines(distance=64))
    assert sum(kept for _, _, kept, _ in expected) < 75
    assert sorted(map(tuple, fl.fuzzy_lines(make_docs(rows)).collect()), key=str) == expected


def test_short_lines_meet_all_similar_ones():
    pick = random.Random(8)
    for _ in range(2000):
        a = bytes(pick.choice(b"abc ") for _ in range(pick.randint(1, 24)))
        b = changed(a, pick, pick.randint(1, 4))[:24]
        one, two = (set((n >> 16).tolist()) for n in fl.nodes([a, b], 12))
        assert a == b or not fl.similar(a, b, 80) or one & two


def test_grams_exclude_only_unlike_lines(monkeypatch):
    pick = random.Random(9)
    one = [prose(pick, pick.randint(1, 60)).encode() for _ in range(300)] + [b"", b"a", b"ab"]
    two = [changed(a, pick, pick.randint(0, len(a) // 4)) if a and k % 3 else prose(pick, 30).encode() for k, a in enumerate(one)]
    assert fl.similar_pairs(one, two, 80) == [fl.similar(a, b, 80) for a, b in zip(one, two)]
    asked = []
    monkeypatch.setattr(fl, "similar", lambda *pair: asked.append(pair))
    fl.similar_pairs([bytes([97 + k] * 100) for k in range(9)], [bytes([107 + k] * 100) for k in range(9)], 80)
    assert not asked


def test_windows_have_the_least_hashes_of_each_line():
    pick = random.Random(10)
    lines = [bytes(pick.choice(b"abcdefgh ") for _ in range(pick.randint(60, 900))) for _ in range(200)] + [b"ab" * 200, b"q" * 500]
    found = [set() for _ in lines]
    for line, node, _ in fl._windows(lines, 16, 12):
        for k, n in zip(line.tolist(), node.tolist()):
            found[k].add(n)
    for line, own in zip(lines, found):
        at = fl.np.arange(len(line) - 15)
        assert own == set(sorted(set(fl._hashed(line + bytes(8), at, 16).tolist()))[:12])


def test_edits_of_many_pairs_match_one_by_one():
    pick = random.Random(11)
    one = [prose(pick, pick.choice([1, 3, 10, 30, 90])).encode() for _ in range(900)]
    two = [changed(a, pick, pick.randint(1, 1 + len(a) // 3)) for a in one]
    pairs = [p for p in (sorted(fl._trimmed(a, b), key=len) for a, b in zip(one, two)) if p[0]]
    most = fl.np.array([pick.randint(0, len(a) // 3 + 2) for a, _ in pairs])
    expected = [fl.edit_distance(a, b, int(k)) <= k for (a, b), k in zip(pairs, most)]
    assert fl._within([a for a, _ in pairs], [b for _, b in pairs], most).tolist() == expected
    assert 100 < sum(expected) < len(pairs) - 100
    assert fl.similar_pairs(one, two, 80) == [fl.similar(a, b, 80) for a, b in zip(one, two)]


def test_unlike_long_lines_are_told_apart_side_by_side(monkeypatch):
    """Lines of the same words in another order pass any count of letters or 3-grams. Pairs of over 1024 bytes were compared
    one by one to their ends, and batch by batch."""
    pick = random.Random(14)
    one = [" ".join(pick.choices(["thing", "the", "with", "ning", "ered", "on"], k=pick.randint(260, 320))).encode() for _ in range(60)]
    two = [changed(a, pick, 99) if k % 4 == 0 else b" ".join(pick.sample(words := a.split(), len(words))) for k, a in enumerate(one)]
    expected = [fl.edit_distance(a, b, 1 << 30) <= max(len(a), len(b)) // 5 for a, b in zip(one, two)]
    assert sum(expected) == 15
    assert [fl.similar(a, b, 80) for a, b in zip(one, two)] == expected
    alone = []
    for name in ("similar", "edit_distance"):
        monkeypatch.setattr(fl, name, lambda *pair: alone.append(pair))
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(one), pa.array(two)], names=["a", "b", "text_a", "text_b"])
    found = [n for part in fl.linked((rows.slice(k, 3) for k in range(0, 60, 3)), 80) for n in part.column(0).to_pylist()]
    assert sorted(found) == [k for k, same in enumerate(expected) if same] and not alone


def test_edits_up_to_the_limit_are_found_side_by_side():
    """Lines that are as much longer as may be, and lines one edit beyond."""
    pick = random.Random(16)
    for size in (52, 80, 82, 128, 156, 400, 1100):
        one = [bytes(pick.choice(b"abcdefgh ") for _ in range(size)) for _ in range(40)]
        two = []
        for k, a in enumerate(one):
            b = bytearray(a)
            for _ in range(size // 4 + k % 2):
                at = pick.choice([pick.randrange(len(b) + 1), len(b), 0, len(b) // 2])
                b[at:at] = bytes([pick.choice(b"xyz")])
            two.append(bytes(b))
        most = np.array([(len(b) - len(a)) - (k % 3 == 0) for k, (a, b) in enumerate(zip(one, two))])
        assert fl._within(one, two, most).tolist() == [k % 3 > 0 for k in range(40)]
        assert fl.similar_pairs(one, two, 80) == [fl.similar(a, b, 80) for a, b in zip(one, two)]


def test_least_edits_are_a_lower_bound():
    """For each word of a column: the edits of the best way through its places."""
    pick = random.Random(15)
    for _ in range(40):
        a = bytes(pick.choice(b"abc") for _ in range(128))
        b = changed(a, pick, pick.randint(0, 60))
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                rows[i].append(min(rows[i - 1][j - 1] + (x != y), rows[i][j - 1] + 1, rows[i - 1][j] + 1))
        for j in range(8, len(b), 25):
            apart = [rows[i][j] - rows[i - 1][j] for i in range(1, 129)]
            up, down = (np.packbits([d == k for d in apart], bitorder="little").view(np.uint64)[:, None] for k in (1, -1))
            score = np.array([[rows[64][j]], [rows[128][j]]])
            least = fl._least(up, down, score, len(a) - len(b) + j - np.array([[0], [64]]))
            real = min(rows[i][j] + abs(len(a) - i - len(b) + j) for i in range(129))
            assert real - 12 <= least.item() <= real


def test_members_of_large_nodes_all_meet(make_docs):
    """A chain of lines around common windows, more than meet at once, and lines of many more that only share windows."""
    pick = random.Random(12)
    lines = [(prose(pick, 3) + " the quick brown fox of the northern woods jumps " + prose(pick, 2))[:74] for _ in range(2 * fl.FEW)]
    chain = [prose(pick, 9)]
    while len(chain) < 2 * fl.FEW:
        chain.append(changed(chain[-1].encode(), pick, 2).decode())
    rows = [(k, line) for k, line in enumerate(lines + chain)] + [(None, chain[3]), (None, lines[3]), (None, chain[3]), (5, chain[9])]
    expected = brute_lines(rows, fl.Lines())
    assert sorted(map(tuple, fl.fuzzy_lines(make_docs(rows)).collect()), key=str) == expected


def test_fuzzy_lines_store_neither_windows_nor_other_texts(make_docs, monkeypatch):
    pick = random.Random(13)
    some = [prose(pick, 60) for _ in range(300)]
    tables, held = {}, fl.written
    monkeypatch.setattr(fl, "written", lambda df, name: [tables.setdefault(name, (df.columns, out[0].count())) and out for out in [held(df, name)]][0])
    assert fl.fuzzy_lines(make_docs([(k, line) for k, line in enumerate([*some, some[7] + " end"])])).count() == 301
    assert all({"nodes", "text"}.isdisjoint(tables[name][0]) for name in ("lines", "line-classes", "line-spots"))
    assert 2 <= tables["line-texts"][1] < 100


def counted(monkeypatch):
    """Rows of each table that is stored, by name."""
    tables, held = {}, fl.written

    def written(df, name):
        out = held(df, name)
        tables.setdefault(name, []).append(out[0].count())
        return out

    monkeypatch.setattr(fl, "written", written)
    return tables


def test_unlike_lines_of_a_large_node_store_no_pairs(make_docs, monkeypatch):
    """Lines of the same words in another order around one window: about 20,000 pairs were stored for them, and sent to
    their texts."""
    pick, tables = random.Random(17), counted(monkeypatch)
    words = ["thing", "the", "with", "ning", "ered", "on", "tion", "wh", "er", "ingly"] * 3
    lines = [" ".join([*pick.sample(words, 30), "quick brown fox of northern woods", *pick.sample(words, 30)]) for _ in range(200)]
    lines += [changed(lines[k].encode(), pick, 3).decode() for k in (3, 50, 120)]
    rows = list(enumerate(lines))
    assert sorted(map(tuple, fl.fuzzy_lines(make_docs(rows)).collect()), key=str) == brute_lines(rows, fl.Lines())
    assert sum(tables["line-pairs"]) < 4000 and tables["line-meetings"][0] < 20 * len(lines)
    assert sum(tables["line-links"]) < 100


@pytest.mark.parametrize("most, some", [(None, fl.Lines(small=12)), (30_000, fl.Lines(small=12, distance=20))])
def test_chunks_of_large_nodes_meet_each_other(make_docs, monkeypatch, most, some):
    """Nodes of more members than meet in a cell, with links from chunk to chunk; and texts that travel in slices."""
    pick, tables, slices, held = random.Random(18), counted(monkeypatch), [], fl._slices
    monkeypatch.setattr(fl, "_slices", lambda rows, by, all_: slices.append(held(rows, by, most or all_)) or slices[-1])
    lines = [prose(pick, 3) + " the quick brown fox of the northern woods jumps " + prose(pick, 3) for _ in range(45)]
    chain = [prose(pick, 12)]
    while len(chain) < 30:
        chain.append(changed(chain[-1].encode(), pick, 2).decode())
    rows = list(enumerate(lines + chain)) + [(None, lines[3]), (200, changed(lines[7].encode(), pick, 2).decode())]
    assert sorted(map(tuple, fl.fuzzy_lines(make_docs(rows), lines=some).collect()), key=str) == brute_lines(rows, some)
    assert min(tables["line-unsettled"]) > 0
    assert max(map(len, slices)) > 1 or not most


def test_pairs_of_several_nodes_are_compared_once(make_docs, monkeypatch):
    """Of pairs that meet in many nodes, and of lines that are known to be connected, the edits are counted once."""
    pick, asked, held = random.Random(19), [], fl.similar_pairs
    monkeypatch.setattr(fl, "similar_pairs", lambda a, b, percent: asked.extend(zip(a, b)) or held(a, b, percent))
    base = prose(pick, 30).encode()
    texts = sorted({changed(base, pick, 1) for _ in range(120)} - {base})
    line, node = fl.met_by(texts, 12)
    common = [n for n, k in zip(*np.unique(node >> np.uint64(16), return_counts=True)) if k > fl.FEW]
    assert len(common) > 5
    spots = [(int(n), k, int(p) & fl.NOWHERE) for n in common for k, p in zip(line[node >> np.uint64(16) == n].tolist(), node[node >> np.uint64(16) == n])]
    column = lambda values, kind: pa.array(values, kind)
    cls = [k for _, k, _ in spots]
    rows = pa.table({
        "node": column([n for n, _, _ in spots], pa.int64()), "part": column([0] * len(spots), pa.int32()), "askers": column([0] * len(spots), pa.int32()),
        "asks": column([True] * len(spots), pa.bool_()), "cls": column(cls, pa.int64()), "label": column(cls, pa.int64()),
        "place": column([p for _, _, p in spots], pa.int32()), "text": column([texts[k] for k in cls], pa.binary()),
    })
    links = [tuple(x) for b in fl._cell_links(rows, fl.Lines(), False) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(set(asked)) == len(asked) < 4 * len(texts)
    assert len(links) < len(texts) and len({k for x in links for k in x}) == len(set(cls))


def test_fuzzy_lines_empty(make_docs):
    assert fl.fuzzy_lines(make_docs([(1, "a")]).limit(0)).collect() == []
    assert fl.without_lines("a\nb\nc", [1]) == "a\nc" and fl.without_lines(None, []) is None


# licenses


def test_licenses_are_found_and_told_apart(make_docs):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-SA 4.0."),
        (4, "Licensed under the Apache License, Version 2.0."), (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "The driver showed his license to the officer at the gate of the town."), (7, None), (8, ""), (8, ""), (None, "All rights reserved."),
        (9, prose(random.Random(7), 20_000) + " Released under the MIT License. " + prose(random.Random(8), 300)),
    ]
    found = sorted(((r["doc_id"], r["licenses"]) for r in li.license_names(make_docs(rows)).collect()), key=str)
    expected = [
        (1, ["MIT"]), (2, ["CC-BY-NC-4.0"]), (3, ["CC-BY-SA-4.0"]), (4, ["Apache-2.0"]), (5, ["GPL-3.0"]), (6, []), (7, []), (8, []), (8, []),
        (None, ["reserved"]), (9, ["MIT"]),
    ]
    assert found == sorted(expected, key=str)
    assert li.license_names(make_docs(rows).limit(0)).collect() == []


def test_each_template_finds_itself(make_docs):
    """Each name with each of its lead-ins, and each notice, is of its license and of no other."""
    rows = [(n, p) for n, t in li.TEMPLATES.items() for p in [*t.sentences, *(lead.format(x) for x in t.names for lead in li.LEADS[1:6])]]
    found = {r["doc_id"]: r["licenses"] for r in li.license_names(make_docs([(k, p + ".") for k, (_, p) in enumerate(rows)])).collect()}
    wrong = [(rows[k], names) for k, names in found.items() if set(names) - {rows[k][0]}]
    assert not wrong and len(found) == len(rows)
    # A lone short word names nothing: "Licensed under ISC", "under MIT".
    assert {rows[k] for k, names in found.items() if not names and rows[k][1].split()[-1] not in ("MIT", "ISC")} == set()


def test_licenses_inside_long_sentences(make_docs):
    long = lambda seed, n: prose(random.Random(seed), n)
    rows = [
        (1, "This library is released under the MIT License by its authors and may be copied."),
        (2, "Copyright 2021 Example Corporation and its contributors, all rights reserved worldwide."),
        (3, f"{long(1, 40)} Licensed under the Apache License, Version 2.0 {long(2, 60)}"),
        (4, f"{long(3, 4000)} {li.TEMPLATES['GPL-3.0'].sentences[0]} {long(4, 4000)} released under the MIT License {long(5, 50)}"),
        (5, "He was licensed under the new law, and got a copy of the license free of charge."),
    ]
    found = {r["doc_id"]: r["licenses"] for r in li.license_names(make_docs(rows)).collect()}
    assert found == {1: ["MIT"], 2: ["reserved"], 3: ["Apache-2.0"], 4: ["GPL-3.0", "MIT"], 5: []}


LOOK_ALIKES = [
    ("Distributed under the BSD license.", ["BSD"]), ("GNU Lesser General Public License version 2.1", ["LGPL-2.1"]),
    ("GNU Lesser General Public License version 2.0", []), ("GNU Affero General Public License v3.0", ["AGPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("Licensed under GPLv3.", ["GPL-3.0"]),
    ("GNU General Public License, version 4", []), ("Apache License 2.0", ["Apache-2.0"]), ("Licensed under Apache 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1", []), ("MIT License", ["MIT"]), ("This code is MIT licensed.", ["MIT"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]), ("2-Clause BSD License", ["BSD-2-Clause"]),
    ("No parts of this work can be reproduced without written permission", ["reserved"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC-ND 4.0.", []), ("Licensed under CC BY 3.0.", []), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Permission is hereby granted, without any charge, to any person obtaining a copy of this software and its documentation files (the "
     "\"Software\"), to deal in the Software without restriction", ["MIT"]),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ["ISC"]),
    ("Er fuhr mit der Lizenz des Amtes nach Hause.", []), ("She got a license from two MIT professors.", []),
    ("He copyrighted the general plan of the public park.", []),
]


def test_look_alike_licenses(make_docs):
    found = {r["doc_id"]: r["licenses"] for r in li.license_names(make_docs([(k, t) for k, (t, _) in enumerate(LOOK_ALIKES)])).collect()}
    assert [(LOOK_ALIKES[k][0], found[k]) for k in sorted(found)] == LOOK_ALIKES


def test_winners_match_all_templates_on_all_windows():
    """The winner saves most bytes of the block among all templates that some window of it, of any place and length, quotes."""
    scanner, pick = li._Scanner(li.Scan()), random.Random(12)

    def saved(text, name=None):
        data, kind = text.lower().encode(), None
        if name:
            kind = zstandard.ZstdCompressionDict(". ".join(scanner.phrases[name]).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kind.precompute_compress(level=6)
        return len(zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=kind).compress(data))

    def quoted(own, i, j, name):
        for words in scanner.words[name]:
            same = sum(r.size for r in difflib.SequenceMatcher(None, own[i:j], words, autojunk=False).get_matching_blocks())
            if j - i - same <= 0.2 * (j - i) and scanner.confirmed(own, i, j, name):
                return True
        return False

    for notice, _ in LOOK_ALIKES:
        block = " ".join([*prose(pick, 3).split(), *notice.rstrip(".").split(), *prose(pick, 3).split()])
        own = [li.word(w) for w in li.WORDS.findall(block)]
        able = [n for n in scanner.names if any(m <= li.terms(block) for m in scanner.marks[n])]
        able = [n for n in able if any(quoted(own, i, j, n) for i in range(len(own)) for j in range(i + 1, min(len(own), i + 30) + 1))]
        best = min(able, key=lambda n: (saved(block, n), n), default=None)
        assert best is None or saved(block, best) < saved(block)
        found = [n[0] for n in scanner.judge(block)]
        assert found[:1] == ([best] if best else []), block


def test_sentences_with_two_licenses(make_docs):
    text = "Licensed under the Apache License, Version 2.0, or released under the MIT License."
    found = li.licenses(make_docs([(1, text)])).first()["licenses"]
    assert [(n["license"], n["quoted"]) for n in found] == [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "released under the MIT License"),
    ]


# quality


def test_quality_keeps_good_rows(spark, make_docs):
    pick = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = prose(pick, pick.randint(5, 80))
        rows.append((k, " ".join(w.upper() + "!!" for w in text.split()) if bad else text.capitalize() + ".", "hot" if k % 3 else f"s{k % 40}"))
        labels.append((k, int(not bad)))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    extra = [(9001, None, None), (9002, "", "hot"), (None, "some text", "hot"), (9003, prose(pick, 30_000), None)]
    docs = make_docs(rows + extra + extra[:1])
    found = qu.quality(docs, known, F.col("source"), F.col("lang")).join(known, "doc_id", "left").collect()
    assert len(found) == len(rows) + 5
    judged = [r for r in found if r["quality"] is not None and r["held_out"]]
    assert all(r["kept"] for r in judged if r["quality"] == 1)
    assert sum(r["kept"] for r in judged if r["quality"] == 0) <= 0.1 * len(judged)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qu.quality(docs, none, F.col("source"), F.col("lang")).count() == len(found)
    assert qu.quality(docs.limit(0), known, F.col("source"), F.col("lang")).collect() == []


def test_sparse_sites_shrink_toward_the_level_above(spark, make_docs, monkeypatch):
    """A site with one document says little, one with many says much."""
    chances = spark.createDataFrame(
        [(k, "good", "a", 0.9 if k % 4 else 0.6) for k in range(200)] + [(500 + k, "bad", "a", 0.1 if k % 4 else 0.4) for k in range(200)]
        + [(900, "new", "a", 0.95), (901, "good", "b", 0.2)],
        "doc_id long, host string, path string, chance double",
    )
    monkeypatch.setattr(qu, "_evidence", lambda *a: chances)
    monkeypatch.setattr(qu, "fit", lambda *a: (None, 0.5))
    docs = make_docs([(1, "x")])
    found = {r["doc_id"]: r for r in qu.quality(docs, docs, F.col("source"), F.col("lang")).collect()}
    assert found[1]["host_mean"] > 0.8 and found[501]["host_mean"] < 0.2
    assert abs(found[900]["host_mean"] - 0.5) < abs(0.95 - 0.5)
    assert found[901]["path_mean"] > 0.7 and found[901]["score"] > 0.2
