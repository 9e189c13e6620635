"""Problem 8: passages of held-out evaluation items inside a corpus.

The items are normalised to words and put into one generalised suffix automaton.  Each corpus text is streamed through
it once, tracking the longest match that ends at each word; a match of ``min_words`` or more names the items that hold
the last ``min_words`` words.  Spans beyond the limits can be removed from the text.

The items are the stated query set.  They are put into blocks of bounded size (``block_words``) by a hash, an
automaton for each block is built by the executors and written to the shared folder, and the corpus is read once for each
group of blocks (``SCAN_WORDS``), so what is sent to the executors at a time has a proven bound; all corpus rows are
streamed against every block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable, returned, sent, sent_type, ship, spread

#: Characters of no width, removed before words are cut.
NO_WIDTH = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])
WORD = regex.compile(r"[\p{L}\p{N}]+")
_NO_WIDTH = regex.compile("[" + "".join(map(chr, NO_WIDTH)) + "]")

MIN_WORDS = 10
#: Words of the items in one automaton, and in all automata of one pass over the corpus.
BLOCK_WORDS = 200_000
SCAN_WORDS = 800_000


def words_of(text: str) -> list[str]:
    if _NO_WIDTH.search(text):
        text = text.translate(NO_WIDTH)
    return WORD.findall(text.casefold())


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words with their places in the text as it is."""
    kept = [i for i, c in enumerate(text) if ord(c) not in NO_WIDTH]
    clean = "".join(text[i] for i in kept)
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(clean)]
    return [w.casefold() for w, _, _ in found], [(kept[a], kept[b - 1] + 1) for _, a, b in found]


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items."""

    def __init__(self, items: Iterable[tuple[int, Sequence[str]]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        self.word_id: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.word_id.setdefault(w, len(self.word_id)))
                while len(owners) < len(self.next):
                    owners.append(set())
                owners[last].add(item)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # an item at a state is at all its suffixes
            owners[self.link[s]] |= owners[s]
        #: for each state that can end a long match, the items that hold its last min_words words
        self.hits: list[tuple[int, ...] | None] = [None] * len(self.next)
        for s in reversed(order):
            if self.length[s] >= min_words:
                up = self.link[s]
                self.hits[s] = self.hits[up] if self.length[up] >= min_words else tuple(sorted(owners[s]))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:  # the automaton already holds this word here: another item began alike
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def stream(self, words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(place of the last word, longest match that ends there, state), where that match is long enough."""
        nxt, link, length, ids = self.next, self.link, self.length, self.word_id
        state = n = 0
        for i, w in enumerate(words):
            c = ids.get(w)
            if c is None:
                state = n = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
                if n >= self.min_words:
                    yield i, n, state

    def items_in(self, words: Sequence[str]) -> dict[int, int]:
        """Item -> how many windows of min_words words of the text are in it; only items with one at least."""
        windows: dict[int, int] = {}
        for _, _, state in self.stream(words):
            for item in self.hits[state]:
                windows[item] = windows.get(item, 0) + 1
        return windows

    def covered(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """Runs of words [first, last] covered by matches, merged."""
        out: list[tuple[int, int]] = []
        for i, n, _ in self.stream(words):
            a = i - n + 1
            if out and a <= out[-1][1] + 1:
                out[-1] = (min(out[-1][0], a), i)
            else:
                out.append((a, i))
        return out


def block_automata(items: DataFrame, id_col: str, text_col: str, min_words: int, block_words: int) -> DataFrame:
    """(block, words, automaton): pickled automata over the items, each of at most ``block_words`` words (an item that is
    longer may be alone above it), from executors; a table in the shared folder."""
    ship(items.sparkSession)
    kind = sent_type(items, id_col)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(n=[len(words_of(t)) for t in b["t"]])

    sized = items.select(sent(items, id_col, "i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    sized = durable(spread(sized).mapInPandas(counted, f"i {kind}, t string, n long").where(F.col("n") >= min_words))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // block_words))
    while True:  # a hash spreads items evenly enough after a doubling or two
        block = F.pmod(F.xxhash64("i", "t"), F.lit(count)).cast("int")
        most = sized.groupBy(block.alias("block")).agg(F.sum("n").alias("words"), F.count("*").alias("items")).where((F.col("words") > block_words) & (F.col("items") > 1))
        if count == 1 and total <= block_words or most.isEmpty():
            break
        count *= 2

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["i", "t"])
        automaton = ItemAutomaton([(i, words_of(t)) for i, t in zip(own["i"], own["t"])], min_words)
        return pd.DataFrame({"block": [int(own["block"].iloc[0])], "words": [int(own["n"].sum())], "automaton": [pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL)]})

    return durable(sized.withColumn("block", block).groupBy("block").applyInPandas(build, "block int, words long, automaton binary"))


class SharedAutomata:
    """The automata of one pass, sent once to each executor and opened once in each worker."""

    def __init__(self, spark: SparkSession, pickled: list[bytes]) -> None:
        self.sent = spark.sparkContext.broadcast(pickled)
        self.opened: list[ItemAutomaton] | None = None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "opened": None}

    def __iter__(self) -> Iterator[ItemAutomaton]:
        if self.opened is None:
            self.opened = [pickle.loads(p) for p in self.sent.value]
        return iter(self.opened)


def passes(items: DataFrame, id_col: str, text_col: str, min_words: int, block_words: int, scan_words: int) -> list[SharedAutomata]:
    """Groups of automata, each of at most ``scan_words`` words, or of one block.  The driver holds the words of a block one
    group at a time."""
    spark = items.sparkSession
    table = block_automata(items, id_col, text_col, min_words, block_words)
    groups: list[list[int]] = []
    room = 0
    for r in table.select("block", "words").orderBy("block").collect():  # one small row for each block
        if not groups or r["words"] > room:
            groups.append([])
            room = scan_words
        groups[-1].append(r["block"])
        room -= r["words"]
    return [SharedAutomata(spark, [bytes(r["automaton"]) for r in table.where(F.col("block").isin(g)).orderBy("block").collect()]) for g in groups]


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, scan_words: int = SCAN_WORDS) -> DataFrame:
    """(key, item_id, windows): one row for each pair of a text and an item of which it holds ``min_words`` words on end.

    Null and empty texts: no rows.  Items of fewer words, or without an id: never found.  Texts that are the same: rows each.  Duplicate
    rows of a key: one row.  No items or no texts: no rows.  Extra columns are not read.
    """
    spark = corpus.sparkSession
    ship(spark)
    schema = f"k {sent_type(corpus, key)}, item_id {sent_type(items, item_key)}, windows long"
    scan = spread(corpus.select(sent(corpus, key, "k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    found = None
    for shared in passes(items, item_key, item_text, min_words, block_words, scan_words):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for k, t in zip(b["k"], b["t"]):
                    words = words_of(t)
                    rows += [(k, i, n) for a in shared for i, n in a.items_in(words).items()]
                yield pd.DataFrame(rows, columns=["k", "item_id", "windows"])

        part = scan.mapInPandas(run, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy("k", "item_id").agg(F.max("windows").alias("windows")).select(returned(corpus, key, "k"), returned(items, item_key, "item_id").alias("item_id"), "windows")


def cut_runs(t: str, runs: Sequence[tuple[int, int]], max_coverage: float) -> tuple[str | None, int, bool]:
    """(text without the runs of words, how many words they hold, whether the text is dropped)."""
    words, spans = word_spans(t)
    out, at, removed, done = [], 0, 0, -1
    for first, last in sorted(runs):
        removed += max(0, last - max(first, done + 1) + 1)
        done = max(done, last)
        if spans[first][0] >= at:
            out.append(t[at : spans[first][0]])
        at = max(at, spans[last][1])
    return (None, removed, True) if removed > max_coverage * len(words) else ("".join(out) + t[at:], removed, False)


def remove_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, scan_words: int = SCAN_WORDS) -> DataFrame:
    """(key, text, removed_words, dropped): every run of ``min_words`` or more words of an item is cut out of the text; a text of
    which more than ``max_coverage`` is such runs is dropped whole (text null).  Null texts stay null.

    Where the items need several passes, each finds its runs (a small row for each different text with any), and the runs
    of all are cut out of the texts that have them."""
    spark = corpus.sparkSession
    ship(spark)
    groups = passes(items, item_key, item_text, min_words, block_words, scan_words)
    rows = corpus.select(sent(corpus, key, "k"), F.col(text).alias("t"))
    schema = f"k {sent_type(corpus, key)}, text string, removed_words int, dropped boolean"

    def result(b: pd.DataFrame, cut: list[tuple[str | None, int, bool]]) -> pd.DataFrame:
        return pd.DataFrame({"k": b["k"], "text": [r[0] for r in cut], "removed_words": [r[1] for r in cut], "dropped": [r[2] for r in cut]})

    def covered(t: str | None, shared: SharedAutomata) -> list[tuple[int, int]]:
        words = words_of(t) if t else []
        return sorted(r for a in shared for r in a.covered(words)) if words else []

    if len(groups) <= 1:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [covered(t, groups[0]) if groups else [] for t in b["t"]]
                yield result(b, [cut_runs(t, r, max_coverage) if r else (t, 0, False) for t, r in zip(b["t"], found)])

        out = spread(rows).mapInPandas(run, schema)
        return out.select(returned(corpus, key, "k"), "text", "removed_words", "dropped")

    keyed = rows.withColumn("d", F.sha2("t", 256))
    runs = None
    for shared in groups:

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(d, *r) for d, t in zip(b["d"], b["t"]) for r in covered(t, shared)], columns=["d", "first", "last"])

        part = spread(keyed.select("d", "t").where("t is not null")).mapInPandas(look, "d string, first int, last int")
        runs = part if runs is None else runs.unionAll(part)
    of_text = runs.distinct().groupBy("d").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # no more runs than a text has words

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield result(b, [(t, 0, False) if r is None else cut_runs(t, [(x["first"], x["last"]) for x in r], max_coverage) for t, r in zip(b["t"], b["runs"])])

    out = keyed.join(of_text, "d", "left").select("k", "t", "runs").mapInPandas(cut, schema)
    return out.select(returned(corpus, key, "k"), "text", "removed_words", "dropped")
