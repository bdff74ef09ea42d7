"""Runs of periodic words: stretches that repeat their first words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least
``least`` words and ``times`` periods (two or more) long, that no neighbouring word extends. Each text is read in one task:

1. Stretches that can hold a run are cut out. Within a run of period q, the window of a few words at each place
   but the last ones shows again at most q words later. So the places from each window to its next showing (within a
   third of the text) are joined where they overlap; a run lies in one of these stretches as a whole, and what
   bounds it there bounds it in the text. Texts without such a repeat have no run. This is exact, and only spares
   trees over words that can't matter.
2. Ukkonen's algorithm builds the suffix tree of a stretch and that of its reversal. A tour of each tree yields
   the order of its leaves and the depth of the lowest common ancestor of neighbours; a table of minima over
   powers of two gives that of any two leaves in constant time: how far two places agree to the right, and, by
   the reversal, to the left.
3. The longest Lyndon word at a place reaches to the next suffix of lower rank. For one of the two orders of the
   words (natural and inverse, the end lowest in both) the Lyndon root of a run is such a longest word, so these
   2n candidates, extended in both directions, give all runs.

Work per task is bounded by one slice of texts or one longer text: trees take about 400 bytes a word of a stretch.

Defined cases: null, empty and blank texts have no words and no runs; equal texts have equal runs; words are
compared as they are; an empty table gives no rows; other columns pass through, those of the names asked for are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwire.llm.common import SPACE_CLASS, WORD_CLASS, ascii_words, give_back, small_batches
from groundwire.functions.text import compute_once

LEAST, TIMES = 24, 3
SLICE_CHARS = 1_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_tree(letters: list[int], size: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``letters`` (whole numbers below ``size``; the last occurs once): where the edge into each
    node starts and ends (the end of the text for leaves), and the node below (node * size + first letter)."""
    n = len(letters)
    starts, ends, links, below = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for at, letter in enumerate(letters):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = at
            key = node * size + letters[edge]
            child = below.get(key)
            if child is None:
                below[key] = len(starts)
                starts.append(at)
                ends.append(n)
                links.append(0)
                if last:
                    links[last] = node
                last = node
            else:
                begin = starts[child]
                span = min(ends[child], at + 1) - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if letters[begin + length] == letter:
                    if last and node:
                        links[last] = node
                    length += 1
                    break
                split = len(starts)
                starts += [begin, at]
                ends += [begin + length, n]
                links += [0, 0]
                below[key] = split
                below[split * size + letter] = split + 1
                starts[child] = begin + length
                below[split * size + letters[begin + length]] = child
                if last:
                    links[last] = split
                last = split
            waiting -= 1
            if not node and length:
                length -= 1
                edge = at - waiting + 1
            elif node:
                node = links[node]
    return starts, ends, below


def leaf_tour(tree: tuple, size: int, n: int, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of a tour through the tree, and for each but the first the depth it shares with the
    one before: the depth of their lowest common ancestor. Children in order of their letters, or the inverse
    order; letter 0, the end, comes first in both."""
    starts, ends, below = tree
    keys = np.fromiter(below, "i8", len(below))
    to = np.fromiter(below.values(), "i8", len(below))
    parent, letter = keys // size, keys % size
    if inverse:
        letter = np.where(letter > 0, size - letter, 0)
    order = np.lexsort((-letter, parent))  # a stack gives them back the other way round
    first = np.searchsorted(parent[order], np.arange(len(starts) + 1)).tolist()
    nodes = to[order].tolist()
    suffixes, shared = [], []
    stack = [(0, 0, 0)]
    while stack:
        node, depth, gap = stack.pop()
        depth += ends[node] - starts[node]
        a, b = first[node], first[node + 1]
        if a == b:
            suffixes.append(n - depth)
            shared.append(gap)
        else:
            stack += [(child, depth, depth) for child in nodes[a : b - 1]]
            stack.append((nodes[b - 1], depth, gap))
    return np.array(suffixes), np.array(shared)


class Ancestors:
    """How long two suffixes agree, in constant time for each pair: minima over the tour between their leaves."""

    def __init__(self, suffixes: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(suffixes), "i8")
        self.rank[suffixes] = np.arange(len(suffixes))
        self.minima = [shared.astype("i4")]
        step = 1
        while 2 * step <= len(shared):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b that differ."""
        left, right = self.rank[a], self.rank[b]
        left, right = np.minimum(left, right) + 1, np.maximum(left, right) + 1
        level = np.frexp(right - left)[1] - 1
        out = np.empty(len(left), "i8")
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][left[at]], self.minima[k][right[at] - (1 << int(k))])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """For each place where the longest Lyndon word that starts there ends: the next suffix of lower rank. The
    last entry of ``rank`` is the empty suffix, the lowest."""
    ranks = rank.tolist()
    n = len(ranks) - 1
    ends = [n] * n
    for at in range(n - 1, -1, -1):
        own, to = ranks[at], at + 1
        while ranks[to] > own:
            to = ends[to]
        ends[at] = to
    return np.array(ends, "i8")


def runs_of(letters: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of whole numbers, by start and period."""
    n = len(letters)
    if n < max(least, times):
        return []
    _, plain = np.unique(letters, return_inverse=True)
    size = int(plain.max()) + 2
    forth, back = [*(plain + 1).tolist(), 0], [*(plain[::-1] + 1).tolist(), 0]
    tree = suffix_tree(forth, size)
    natural = Ancestors(*leaf_tour(tree, size, n + 1))
    inverse = np.empty(n + 1, "i8")
    inverse[leaf_tour(tree, size, n + 1, inverse=True)[0]] = np.arange(n + 1)
    tree = None
    reverse = Ancestors(*leaf_tour(suffix_tree(back, size), size, n + 1))
    at = np.arange(n)
    found = []
    for rank in (natural.rank, inverse):
        period = lyndon_ends(rank) - at
        i = np.flatnonzero(period * times <= n)
        q = period[i]
        # the empty suffix is place n, and in the reversal stands before the first place
        right = natural.agree(i, i + q)
        left = reverse.agree(n - i, n - i - q)
        length = left + q + right
        fits = length >= np.maximum(least, times * q)
        found.append(np.stack([i - left, q, length], axis=1)[fits])
    return [(start, length, q) for start, q, length in np.unique(np.concatenate(found), axis=0).tolist()]


def stretches(letters: np.ndarray, texts: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """The stretches (from, to) of the joined ``letters`` that can hold a run. ``texts`` numbers the text of each
    letter, ``sizes`` has the words of each text. Windows have least // times words, so that even the shortest
    run holds one that shows again a period later."""
    window = max(1, least // times)
    if len(letters) < window:
        return []
    mixed = (letters.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    held = len(letters) - window + 1
    hashed = texts[:held].astype("u8")
    for k in range(window):
        hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + held]
    whole = np.flatnonzero(texts[:held] == texts[window - 1 :])
    order = whole[np.argsort(hashed[whole], kind="stable")]
    again = hashed[order[:-1]] == hashed[order[1:]]
    a, b = order[:-1][again], order[1:][again]
    near = (b - a <= sizes[texts[a]] // times) & (texts[a] == texts[b])
    a, b = a[near], b[near]
    if not len(a):
        return []
    by_place = np.argsort(a)
    a, ends = a[by_place], np.maximum.accumulate(b[by_place] + window)
    opens = np.flatnonzero(np.concatenate([[True], a[1:] >= ends[:-1]]))
    closes = np.concatenate([opens[1:], [len(a)]]) - 1
    return [(int(x), int(y)) for x, y in zip(a[opens], ends[closes]) if y - x >= least]


WORD = re.compile(WORD_CLASS)


def _marked(texts: list[str], least: int, times: int) -> Iterator[tuple[int, list, str]]:
    """For each text its number of words, its runs and the text without the repeated words."""
    split = [WORD.findall(t) for t in texts]
    numbers: dict[str, int] = {}
    letters = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], "i8")
    sizes = np.array([len(words) for words in split], "i8")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs: dict[int, list] = {}
    for a, b in stretches(letters, owner, sizes, least, times):
        text = int(owner[a])
        base = a - int(offsets[text])
        runs.setdefault(text, []).extend((base + start, length, period) for start, length, period in runs_of(letters[a:b], least, times))
    for n, words in enumerate(split):
        own = sorted((start, period, length) for start, length, period in runs.get(n, []))
        if own:
            gone = np.zeros(len(words) + 1, "i8")
            for start, period, length in own:
                gone[start + period] += 1
                gone[start + length] -= 1
            words_kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        else:
            words_kept = words
        yield len(words), [(start, length, period) for start, period, length in own], " ".join(words_kept)


def with_runs(
    df: DataFrame, text: str, *, least: int = LEAST, times: int = TIMES, n_words: str = "n_words", runs: str = "runs",
    collapsed: str = "collapsed",
) -> DataFrame:
    """Add the number of words of ``text``, its runs (structs of start, length, period, by start and then period)
    and the text whose words are those that no run contains after its first period, joined by blanks."""
    small_batches(df.sparkSession)
    kind = pa.struct([("n", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("kept", pa.string())])

    @F.arrow_udf(f"struct<n:bigint,runs:{RUNS},kept:string>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, held, size = [], [], 0
            for each in batch:
                held.append(each.as_py())
                size += len(held[-1])
                if size >= SLICE_CHARS:
                    rows += _marked(held, least, times)
                    held, size = [], 0
            rows += _marked(held, least, times)
            found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for _, own, _ in rows], kind.field("runs").type)
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _, _ in rows], pa.int64()), found, pa.array([kept for _, _, kept in rows], pa.string())], fields=list(kind)
            )
        give_back()

    bound = df.withColumn("_marked_runs", marked(F.coalesce(F.col(text), F.lit(""))))
    return bound.withColumns({
        n_words: F.col("_marked_runs.n"), runs: F.col("_marked_runs.runs"), collapsed: F.col("_marked_runs.kept"),
    }).drop("_marked_runs")


def strongest(runs: str) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones; null without runs."""
    def better(held: Column, run: Column) -> Column:
        more = run["length"] * held["period"] > held["length"] * run["period"]
        return F.when(held.isNull() | more, run).otherwise(held)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_planted_runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``text`` with the repeats that a checksum of the id plants in a tenth of the documents."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    planted = docs.withColumns({"_h": h, "_g": F.floor(h / 10)})
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False)) & F.coalesce(F.col(text).rlike(WORD_CLASS), F.lit(False))
    bound = compute_once(planted, {"_own": F.when(chosen, ascii_words(F.col(text)))})
    n = F.size("_own")
    bound = compute_once(bound, {"_n": n, "_a": F.col("_g") % n})
    period = F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1
    bound = compute_once(bound, {"_p": F.when(F.col("_own").isNotNull(), period)})
    word = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1),
        lambda i: F.get("_own", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")),
    )
    repeated = F.when(F.col("_own").isNull(), F.col(text)).otherwise(F.array_join(word, " "))
    return bound.withColumn(text, repeated).drop("_h", "_g", "_own", "_n", "_a", "_p")
