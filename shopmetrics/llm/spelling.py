"""Spelling variants by finite-state composition (operator 11).

The vocabulary's minimised acceptor, a transducer that makes one edit, and the acceptor again are composed: what the
composition accepts are the pairs of words that lie one edit apart. Up to the edit both words walk the same states, and
after it they read the same letters, so a pair is a common start, one edit at the state it leads to, and a common rest.

The composition is cut by its initial states. A state that so few words pass through that one task can hold them begins
a partition: a task builds the minimised acceptor of these words and enumerates the pairs whose edit lies behind that
state. The states before it hold many words, and their own edits are a join: words that are equal without the letter at
the state meet there, at most one for each letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import discard, looked_up, splitting, written

#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Lengths of starts at which the vocabulary may be cut: the powers of two and the middles between them.
LENGTHS = [1, *sorted({k << p for k in (2, 3) for p in range(24)})]


@dataclass(frozen=True)
class Spelling:
    """Words are lower-cased (A-Z) maximal runs of letters A-Z and U+00C0 to U+00FF, of at least ``shortest`` code points
    and ``often`` occurrences. A near word is a form where it is ``times`` as frequent."""

    shortest: int = 6
    often: int = 5
    times: int = 5
    #: Each occurrence whose hash with its document's id this number divides loses one letter; 0 for none.
    drops: int = 0
    #: Words of a state at which a partition begins.
    group: int = 5000

    def __post_init__(self):
        if self.times < 2 or self.shortest < 1:
            raise ValueError("forms are at least twice as frequent, words have at least one letter")


def _occurrences(text: bytes, doc_id: object, runs: re.Pattern, spelling: Spelling) -> Iterator[tuple[str, int]]:
    """The words of a text and how often they stand there; words may come up twice."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
        if spelling.drops:
            h = zlib.crc32(run.encode(), start)
            if h % spelling.drops == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < spelling.shortest:
                    continue
        yield run, n


def counted(docs: DataFrame, text: str, spelling: Spelling) -> DataFrame:
    """``word, n`` of the words that are frequent enough in the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(f"[a-zÀ-ÿ]{{{spelling.shortest},}}"), Counter()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                if not value.is_valid:
                    continue
                for word, n in _occurrences(value.as_py(), doc_id.as_py(), runs, spelling):
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        yield handed()

    each = docs.select(F.col("doc_id"), F.col(text).cast("binary")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= spelling.often)


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """The minimised acceptor of sorted distinct words: per state its arcs, and whether a word ends there. A state whose
    words are all read is replaced by an equal one that is there already."""
    arcs: list[dict[str, int]] = [{}]
    final, known, path, last = [False], {}, [0], ""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            equal = known.setdefault((final[state], tuple(arcs[state].items())), state)
            if equal != state:
                arcs[path[-1]][last[len(path) - 1]] = equal
                arcs[state] = {}

    for word in words:
        shared = len(commonprefix((word, last)))
        settle(shared)
        for letter in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][letter] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]], last = True, word
    settle(0)
    return arcs, final


class Composition:
    """Acceptor, one-edit transducer and acceptor composed, for one initial state."""

    def __init__(self, words: list[str]):
        self.arcs, self.final = acceptor(words)
        #: Of each pair of states behind an edit: whether both end a word, and the letters that lead to pairs from which
        #: both can end one. None where no rest is common.
        self.behind: dict[tuple[int, int], tuple[bool, list] | None] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def _useful(self, pair: tuple[int, int]) -> bool:
        behind, open_pairs = self.behind, [pair]
        while open_pairs:
            now = open_pairs[-1]
            if now in behind:
                open_pairs.pop()
                continue
            left, right = self.arcs[now[0]], self.arcs[now[1]]
            following = [(c, (left[c], right[c])) for c in left if c in right]
            unknown = [x for _, x in following if x not in behind]
            if unknown:
                open_pairs.extend(unknown)
                continue
            arcs = [f for f in following if behind[f[1]] is not None]
            ends = self.final[now[0]] and self.final[now[1]]
            behind[now] = (ends, arcs) if ends or arcs else None
        return behind[pair] is not None

    def _rests(self, pair: tuple[int, int], first: str = "") -> Iterator[str]:
        """Common rests behind an edit, as far as they do not begin with ``first``."""
        if not self._useful(pair):
            return
        walk = [(pair, "")]
        while walk:
            now, read = walk.pop()
            # A stretch without a choice is read in one go: long words cost no copy for each letter.
            letters = []
            while True:
                ends, arcs = self.behind[now]
                if first and not read and not letters:
                    arcs = [a for a in arcs if a[0] != first]
                if ends or len(arcs) != 1:
                    break
                letters.append(arcs[0][0])
                now = arcs[0][1]
            read += "".join(letters)
            if ends:
                yield read
            walk.extend((following, read + letter) for letter, following in arcs)

    def _edits(self, state: int) -> list[tuple[str, str]]:
        """What the two words read from a state where the edit is made."""
        if state not in self.edits:
            arcs = self.arcs[state].items()
            found = [(a + r, b + r) for (a, p), (b, q) in combinations(arcs, 2) for r in self._rests((p, q))]
            # One letter more: a rest that begins with that letter would be an edit further on.
            found += [(a + r, r) for a, p in arcs for r in self._rests((p, state), a)]
            self.edits[state] = found
        return self.edits[state]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Each pair of words one edit apart, once."""
        walk = [(0, "")]
        while walk:
            state, start = walk.pop()
            while True:
                for a, b in self._edits(state):
                    yield start + a, start + b
                arcs = self.arcs[state]
                if len(arcs) != 1:
                    break
                ((letter, state),) = arcs.items()
                start += letter
            walk.extend((following, start + letter) for letter, following in arcs.items())


def _cut(words: DataFrame, group: int) -> DataFrame:
    """``word, n, depth``: the length of the start at which each word's partition begins. Only starts of fewer than
    ``group`` words begin one; they are as short as the lengths to choose from allow. A word costs about twice its depth in copies of itself, and is
    deep only where ``group`` others share its start."""
    if words.limit(group + 1).count() <= group:
        return words.withColumn("depth", F.lit(0))
    known = F.array(*map(F.lit, LENGTHS))
    lengths = F.filter(known, lambda k: k <= F.length("word"))
    starts = words.select("word", F.explode(lengths).alias("at")).select("word", "at", F.expr("left(word, at)").alias("start"))
    many, path = written(starts.groupBy("at", "start").agg(F.count("*").alias("m")).where(F.col("m") > group).drop("m"), "starts")
    longest = looked_up(starts, many, ["at", "start"]).groupBy("word").agg(F.max("at").alias("at"))
    # The next length may be more than the word has: then all its edits are found by the join.
    following = F.try_element_at(known, (F.array_position(known, F.col("at")) + 1).cast("int"))
    deep = looked_up(words, longest, ["word"], "left")
    cut, _ = written(deep.select("word", "n", F.coalesce(following, F.lit(LENGTHS[0])).alias("depth")), "depths")
    discard(words.sparkSession, path)
    return cut


def _before(cut: DataFrame) -> DataFrame:
    """``word, n_near, best`` of the pairs whose edit lies before their partitions begin. A word meets the others at each
    such place without its letter there, and as it is where the others have one letter more."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word"))))
    places = cut.where("depth > 0").select("word", "n", at.alias("at"))
    without = F.when(F.col("at") < F.length("word"), F.expr("concat(left(word, at), substr(word, at + 2))"))
    both = places.select("at", "n", F.posexplode(F.array("word", without)).alias("cut", "rest"), F.expr("substr(word, at + 1, 1)").alias("letter"))
    # An edit before the same letter is one further on.
    next_letter = F.expr("substr(rest, at + 1, 1)")
    both = both.where("rest IS NOT NULL").withColumn("letter", F.when(F.col("cut") == 1, F.col("letter")).otherwise(""))
    met = both.groupBy("at", "rest").agg(F.collect_list(F.struct("letter", "n")).alias("all")).where(F.size("all") > 1)
    each = met.withColumn("own", F.explode("all")).withColumn("other", F.explode("all")).where("own.letter <> other.letter")
    same = F.when(F.col("own.letter") == "", F.col("other.letter")).when(F.col("other.letter") == "", F.col("own.letter"))
    each = each.where(same.isNull() | (same != next_letter))
    word = lambda side: F.concat(F.expr("left(rest, at)"), F.col(f"{side}.letter"), F.expr("substr(rest, at + 1)"))
    best = F.min(F.struct((-F.col("other.n")).alias("less"), word("other").alias("near"))).alias("best")
    return each.select(word("own").alias("word"), "*").groupBy("word").agg(F.count("*").alias("n_near"), best)


def _behind(cut: DataFrame) -> DataFrame:
    """``word, n_near, best`` of the pairs whose edit lies behind their partition's initial state."""

    def run(group: pa.Table) -> pa.Table:
        (depth,) = set(group.column("depth").to_pylist())
        many = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        start = next(iter(many))[:depth]
        near, best = Counter(), {}
        for pair in Composition(sorted(w[depth:] for w in many)).pairs():
            a, b = start + pair[0], start + pair[1]
            for own, other in ((a, b), (b, a)):
                near[own] += 1
                best[own] = min(best.get(own, (1, "")), (-many[other], other))
        words = list(near)
        better = [{"less": best[w][0], "near": best[w][1]} for w in words]
        kind = pa.struct([("less", pa.int64()), ("near", pa.string())])
        return pa.table({"word": pa.array(words, pa.string()), "n_near": pa.array(near.values(), pa.int64()), "best": pa.array(better, kind)})

    # A word shorter than its depth has all its edits before it.
    whole = cut.where(F.length("word") >= F.col("depth")).withColumn("start", F.expr("left(word, depth)"))
    schema = "word string, n_near long, best struct<less: long, near: string>"
    return whole.groupBy("depth", "start").applyInArrow(run, schema)


def near_words(words: DataFrame, spelling: Spelling) -> DataFrame:
    """``word, n_near, near, near_n`` for the words with a near one: how many, and the most frequent (of several the
    first in code-point order). ``words`` has one row ``word, n`` for each word."""
    cut = _cut(words, spelling.group)
    both = _before(cut).unionByName(_behind(cut)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the last of the forms that follow one another. Each step doubles its
    reach, and frequencies at least double along the way, so six steps reach the end of any chain."""
    roots, last = forms.select("word", F.col("form").alias("root")), None
    for _ in range(6):
        further = looked_up(roots, roots.toDF("root", "next"), ["root"], "left")
        moved, path = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if last:
            discard(forms.sparkSession, last)
        roots, last = moved.drop("moved"), path
        if moved.where("moved").isEmpty():
            break
    return roots


def variants(docs: DataFrame, text: str = "text", spelling: Spelling | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the whole texts that is long and frequent enough.

    Two words are near if exactly one inserted, deleted or replaced code point parts them. ``form`` is the near word of
    largest ``n``, of several the first in code-point order, where that is ``times`` the word's ``n``, else null;
    ``root`` is the last of the forms that follow one another, the word itself where it has none; ``n_near`` counts near
    words.

    Null and empty texts have no words. Rows that repeat an id, or a whole row, count again; a null id counts as an empty
    one where occurrences lose letters. Words of any length count, whatever a text's length. Other columns, of any name,
    are not read. An empty table gives an empty result.
    """
    spelling = spelling or Spelling()
    with splitting(docs.sparkSession):
        words, _ = written(counted(docs, text, spelling), "vocabulary")
        near, _ = written(near_words(words, spelling), "near-words")
        known = looked_up(words, near, ["word"], "left")
        formed = F.col("near_n") >= spelling.times * F.col("n")
        known = known.select(
            "word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("near_n")).alias("form_n"),
        )
        known, _ = written(known, "forms")
        roots = _roots(known.where("form IS NOT NULL"))
        out = looked_up(known, roots, ["word"], "left")
        return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
