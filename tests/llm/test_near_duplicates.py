import random

import numpy as np
from pyspark.sql import functions as F

from shopmetrics.llm import near_duplicates as nd

WORDS = [f"w{k}" for k in range(400)]


def brute(rows, words=2, percent=80):
    """Components by comparing all pairs of sets."""

    def cut(text):
        found = text.encode().lower().split() if text else []
        if not found:
            return frozenset()
        width = min(words, len(found))
        return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))

    sets, root = [cut(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    out = []
    for k, r in enumerate(rows):
        own = least.get(find(k)) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), own, r[0] == own))
    return sorted(out, key=str)


def edited(text, pick, times):
    words = text.split()
    for _ in range(times):
        words[pick.randrange(len(words))] = pick.choice(WORDS)
    return " ".join(words)


def corpus(seed, families, copies, most):
    pick = random.Random(seed)
    rows = []
    for _ in range(families):
        base = " ".join(pick.choice(WORDS) for _ in range(pick.randint(8, 120)))
        for _ in range(copies):
            rows.append(edited(base, pick, pick.randint(0, most)))
    pick.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def result(docs, join=None):
    return sorted(map(tuple, nd.near_duplicates(docs, join=join).collect()), key=str)


def test_matches_all_pairs(make_docs):
    rows = corpus(1, 12, 8, 6)
    assert result(make_docs(rows)) == brute(rows)


def test_edge_rows(make_docs):
    long = " ".join(random.Random(5).choice(WORDS) for _ in range(30_000))
    rows = [
        (9, None), (8, ""), (7, " \t\n"), (6, "One"), (5, "oNe"), (4, "one two"), (3, long), (2, long + " tail"), (None, "one two"),
        (1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text here"), (None, None), (None, "left alone"), (10, "quite another text here"),
        (11, "É é"), (12, "é É"),
    ]
    assert result(make_docs(rows)) == brute(rows)


def test_empty(make_docs):
    assert result(make_docs([(1, "a")]).limit(0)) == []


def test_hot_family_branches_and_chunks(make_docs):
    """A family larger than a node may be: nodes branch, and what stays large is compared in chunks."""
    rows = corpus(2, 1, 150, 14) + [(1000 + k, t) for k, t in corpus(3, 3, 10, 3)]
    for join in (nd.Join(small=8), nd.Join(small=8, depth=3)):
        assert result(make_docs(rows), join) == brute(rows)


def test_five_words_and_one_of_each_group_stays(make_docs):
    rows = corpus(4, 10, 6, 2) + [(900, None), (901, ""), (950, "a b c d e f"), (950, "a b c d e f")]
    docs = make_docs(rows)
    kept = nd.deduplicated(docs, join=nd.Join(words=5))
    assert kept.columns == docs.columns
    groups = {}
    for doc_id, _, component, _ in result(docs, nd.Join(words=5)):
        groups.setdefault(component, set()).add(doc_id)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) >= {900, 901}
    assert all(len(members & set(ids)) == 1 for members in groups.values())


def test_sets_hold_whole_texts():
    known = nd._Hashes()
    assert len(nd.shingles(b"a b a b a", 2, known)) == 2
    assert len(nd.shingles(b"A", 2, known)) == 1 and (nd.shingles(b"A", 2, known) == nd.shingles(b"a", 2, known)).all()
    assert len(nd.shingles(None, 2, known)) == 0


def test_samples_compare_exactly_or_closely():
    pick = np.random.default_rng(1)
    full = np.unique(pick.integers(0, 2**64, 5000, dtype=np.uint64))
    limit, part = nd.sample(full)
    assert limit < 1 << 32 and 200 < len(part) <= 700
    assert nd.sample(full[:100])[0] == 1 << 32


def test_texts_are_shuffled_once_and_one_stays_per_class(spark, make_docs):
    """Rows that share an id hold other texts, a row comes three times, and one has no id."""
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "i j"), (3, "i j"), (3, "i j"), (None, "k l m"), (4, "not asked for")]
    asked, firsts = {"a b c d": 1, "e f g h": 1, "i j": 3, "k l m": None}, []
    docs = make_docs(rows)
    marks = {r.text: r.mark for r in docs.select("text", F.xxhash64("text").alias("mark")).collect()}
    for cls, (text, first) in enumerate(asked.items()):
        digest = nd.xxhash.xxh3_128_digest(nd.shingles(text.encode(), 2, nd._Hashes()).tobytes())
        firsts.append((cls, digest, first, marks[text]))
    wanted = spark.createDataFrame(firsts, "cls long, digest binary, first_id long, first_mark long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = nd._texts(docs, wanted, "text", nd.Join())
        plan = texts._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["cls"], bytes(r["text"]).decode(), r["limit"], len(r["sample"]) // 4) for r in texts.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == [(0, "a b c d", 1 << 32, 3), (1, "e f g h", 1 << 32, 3), (2, "i j", 1 << 32, 1), (3, "k l m", 1 << 32, 2)]
    assert plan.count("Exchange hashpartitioning") == 2, plan
