import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shopmetrics.llm.common import table
from shopmetrics.llm.queries import QUERIES
from shopmetrics.llm.spelling import Composition, Spelling, acceptor, variants

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def pairs_by_deletion(words):
    """Pairs that a deleted letter makes equal, checked one by one: another way for large vocabularies."""
    met = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            met[w[:k] + w[k + 1 :]].add(w)
    return {tuple(sorted(p)) for group in met.values() for p in combinations(group, 2) if near(*p)}


def brute(rows, spelling):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spelling.drops and h % spelling.drops == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= spelling.shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= spelling.often}
    close = defaultdict(list)
    for a, b in pairs_by_deletion(counts):
        close[a].append(b)
        close[b].append(a)
    forms = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= spelling.times * counts[w]:
            forms[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(close[w]), counts.get(forms.get(w))))
    return sorted(out)


def result(docs, spelling):
    return sorted(map(tuple, variants(docs, spelling=spelling).collect()))


def made(seed, letters, shortest, longest, many):
    pick = random.Random(seed)
    return sorted({"".join(pick.choice(letters) for _ in range(pick.randint(shortest, longest))) for _ in range(many)})


def accepted(arcs, final, state=0, read=""):
    return ([read] if final[state] else []) + [w for c, s in arcs[state].items() for w in accepted(arcs, final, s, read + c)]


def test_acceptor_is_minimal():
    for seed in range(50):
        words = made(seed, "ab", 0, 5, 20)
        arcs, final = acceptor(words)
        assert sorted(accepted(arcs, final)) == words
        used = {0} | {s for a in arcs for s in a.values()}
        rests = [tuple(sorted(accepted(arcs, final, s))) for s in used]
        assert len(set(rests)) == len(rests)


def test_composition_accepts_all_pairs_once():
    for seed in range(200):
        words = made(seed, "abé", seed % 2, 6, 60)
        found = [tuple(sorted(p)) for p in Composition(words).pairs()]
        assert sorted(found) == sorted(p for p in combinations(words, 2) if near(*p))
    long = "ab" * 20_000
    assert set(Composition(sorted([long, long + "a", "b" + long, "c" + long[:-1] + "c"])).pairs()) == {(long + "a", long), ("b" + long, long)}


@pytest.mark.parametrize("group", [1, 3, 20, 100_000])
def test_any_cut_of_the_vocabulary(spark, make_docs, group):
    """Partitions of any size, with a start that most of the words share."""
    pick = random.Random(group)
    words = made(1, "abcñ", 6, 9, 150) + ["commons" + w for w in made(2, "ab", 0, 7, 120)] + ["x" * k for k in range(6, 30)]
    rows = [(k, " ".join(pick.choices(words, weights=[1 / (1 + j % 50) for j in range(len(words))], k=400))) for k in range(12)]
    spelling = Spelling(often=2, times=2, drops=7, group=group)
    assert result(make_docs(rows), spelling) == brute(rows, spelling)


def test_chains_and_ties(make_docs):
    many = {"aaaaaa": 1250, "aaaaab": 250, "aaaabb": 50, "aaabbb": 10, "zzzzzz": 50, "zzzzzy": 50, "zzzzyz": 50, "zzzzz": 9999, "zzzzzx": 5, "zzzzxx": 4}
    rows = [(None, " ".join([w] * n)) for w, n in many.items()]
    found = {r[0]: r[1:] for r in result(make_docs(rows), Spelling())}
    assert found["aaabbb"] == ("aaaabb", "aaaaaa", 10, 1, 50)
    assert found["zzzzzx"] == ("zzzzzy", "zzzzzy", 5, 2, 50)
    assert found["zzzzzz"] == (None, "zzzzzz", 50, 3, None)
    assert "zzzzz" not in found and "zzzzxx" not in found


def test_edge_rows(make_docs):
    # With partitions of one word every start of the long words is cut.
    for group, long in ((1, "q" * 700), (5000, "q" * 70_000)):
        edge_rows(make_docs, group, long)
    with pytest.raises(ValueError):
        Spelling(times=1)


def edge_rows(make_docs, group, long):
    rows = [
        (None, None), (1, None), (2, ""), (3, "÷×ÀÉÿàa " * 5), (4, "ABCDEF abcdef. Abcdef1abcdef_abcdeF"), (4, "ABCDEF abcdef. Abcdef1abcdef_abcdeF"),
        (5, f"{long} " * 5), (6, f"{long}q " * 30), (7, "Éabcdef éabcdef " * 6), (None, "abcdeg " * 5),
    ]
    docs = make_docs(rows).withColumn("word", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("n", F.lit(1))
    for drops in (0, 2):
        # Brute force takes all deletions of a word: those of the long ones are left to the other tests.
        spelling = Spelling(drops=drops, group=group)
        found = result(docs, spelling)
        short = [r for r in found if len(r[0]) < 10_000]
        assert short == [r for r in brute([(d, (t or "").replace(long, "-") if len(long) > 10_000 else t) for d, t in rows], spelling)]
        if not drops:
            assert {(r[0], r[1]) for r in found} >= {(long, f"{long}q"), (f"{long}q", None)}
    assert variants(docs.limit(0)).collect() == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect()]
    found = sorted(map(tuple, QUERIES["op11_spelling_variants"](spark, SF_DIR).collect()))
    assert found == brute(rows, Spelling(drops=199))
