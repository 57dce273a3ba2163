"""Passages of held-out test items inside a training corpus.

Method: a generalised suffix automaton over the normalised words of the test items. Corpus words stream through it,
tracking the longest match that ends at each word; wherever that is at least RUN words long, the words it covers in
each item count, and a document leaks an item once enough of the item's words are covered. Spans of the corpus whose
run is longer than a limit, or that belong to an item covered beyond a limit, can be removed from the texts.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.llm.common import broadcast_if_small
from verbloom.session import cut, table

#: Least words of an unbroken run, share of an item's words that makes a leak (1/3), and words of test items in one
#: automaton (measured: 0.17 GB in a Python worker for so many random words; real ones share words and take less).
RUN, SHARE, SHARD_WORDS = 8, 3, 200_000
#: Aligned blocks of so many words are looked up first; every run of RUN words holds one.
BLOCK = 4
#: Runs of so many words are removed whatever share of their item they are.
LONG_RUN = 30

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_INLINE = re.compile(r"</?(?:a|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)\b[^<>]*>", re.I)
_START = re.compile(r"^[ \t>|#*+•–—-]*(?:\(?\d{1,4}[.):\]])?[ \t]+", re.M)
_BREAK = re.compile(r"(?<=\w)[-‐‑­][ \t]*\r?\n[ \t]*(?=\w)")
_LINK = re.compile(r"\]\([^()\s]*\)")
_JOINED = re.compile(r"['’‘`´ʼ\-‐‑]")
_WORD = re.compile(r"[^\W_]+")
#: Letters that have no decomposition.
_LETTERS = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: Stands in a text for what is left out within a word; it is left out of words itself.
_FILLER = "\u2060"


def _plain(text: str, same_length: bool = False) -> str:
    """Without markup, entities, numbers and marks at line starts, and line-end hyphens. With `same_length` every
    character stays at its place: blanks or fillers stand for what is left out."""
    nothing = (lambda m: _FILLER * len(m[0])) if same_length else ""
    blank = (lambda m: " " * len(m[0])) if same_length else " "
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]).ljust(len(m[0]), _FILLER), text) if same_length else html.unescape(text)
    if "<" in text:
        text = _TAG.sub(blank, _INLINE.sub(nothing, text))
    if "](" in text:
        text = _LINK.sub(blank, text)
    if "\n" in text:
        text = _BREAK.sub(nothing, text)
    return _START.sub(blank, text)


def _chunk_words(chunk: str) -> list[str]:
    """Words of a piece without blanks: without case, accents, ligatures, invisible characters and punctuation."""
    chunk = unicodedata.normalize("NFKD", chunk.casefold()).translate(_LETTERS)
    if not chunk.isascii():
        chunk = "".join(c for c in chunk if not unicodedata.combining(c) and unicodedata.category(c) not in ("Cf", "Cc", "Co"))
    return _WORD.findall(_JOINED.sub("", chunk))


def words(text: str | None) -> list[str]:
    """The normalised words of a text, as items and documents are compared."""
    return [w for c in _plain(text or "").split() for w in _chunk_words(c)]


class Automaton:
    """Generalised suffix automaton of word sequences, with the places of every run of RUN words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids: dict[str, int] = {}
        self.trans: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        self.blocks: set[tuple[int, ...]] = set()
        self.items = [(item, len(ws)) for item, ws in items]
        for k, (_, ws) in enumerate(items):
            ids = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            self.blocks.update(zip(*(ids[i:] for i in range(BLOCK))))
            last = 0
            for at, w in enumerate(ids):
                last = self._extend(last, w)
                ends.append((last, k, at))
        self._places(ends)

    def _extend(self, last: int, w: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        if w in trans[last]:
            q = trans[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in trans[p]:
            trans[p][w] = cur
            p = link[p]
        if p != -1:
            q = trans[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        clone = len(trans)
        trans.append(dict(trans[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and trans[p].get(w) == q:
            trans[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def _places(self, ends: list[tuple[int, int, int]]) -> None:
        """For each state of RUN words or more, the state of its last RUN words, and the places of that run."""
        order = sorted(range(1, len(self.trans)), key=self.length.__getitem__)
        self.run_state = [0] * len(self.trans)
        for s in order:
            if self.length[s] >= RUN:
                self.run_state[s] = s if self.length[self.link[s]] < RUN else self.run_state[self.link[s]]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for state, item, at in ends:
            if self.run_state[state]:
                self.places.setdefault(self.run_state[state], []).append((item, at - RUN + 1))

    def covered(self, ids: list[int], marks: list[tuple[int, int, int]] | None = None) -> dict[int, list[int]]:
        """item -> [bit mask of its covered words, longest run]; `marks` gets (begin, end, state) of matched corpus words,
        the runs that grow from one begin one after the other."""
        hits = [i for i, b in enumerate(zip(*(ids[k::BLOCK] for k in range(BLOCK)))) if b in self.blocks]
        trans, link, length, run_state, n = self.trans, self.link, self.length, self.run_state, len(ids)
        done, longest = 0, {}
        for hit in hits:
            block_end = BLOCK * (hit + 1)
            if block_end <= done:
                continue
            at, state, size = max(0, BLOCK * hit - BLOCK + 1), 0, 0
            while at < n:
                w = ids[at]
                while state and w not in trans[state]:
                    state = link[state]
                    size = length[state]
                if w in trans[state]:
                    state, size = trans[state][w], size + 1
                at += 1
                if size >= RUN:
                    s = run_state[state]
                    if size > longest.get(s, 0):
                        longest[s] = size
                    if marks is not None:
                        marks.append((at - size, at, s))
                elif at >= block_end and size < BLOCK:
                    break
            done = at - size
        out: dict[int, list[int]] = {}
        for s, size in longest.items():  # each run of RUN words once, however often a text repeats it
            for item, begin in self.places[s]:
                got = out.setdefault(item, [0, 0])
                got[0] |= (1 << RUN) - 1 << begin
                got[1] = max(got[1], size)
        return out

    def leaked(self, covered: dict[int, list[int]]) -> set[int]:
        """The items covered by 1/SHARE or more."""
        return {i for i, (mask, _) in covered.items() if mask.bit_count() * SHARE >= self.items[i][1]}

    def removed(self, text: str) -> list[tuple[int, int]]:
        """Places (begin, end) of `text` that runs of LONG_RUN words or of leaked items fill, in order."""
        plain = _plain(text, same_length=True)
        ids, where = [], []
        for m in re.finditer(r"\S+", plain):
            for w in _chunk_words(m[0]):
                ids.append(self.ids.get(w, -1))
                where.append(m.span())
        marks: list[tuple[int, int, int]] = []
        leaked = self.leaked(self.covered(ids, marks))
        runs: dict[int, tuple[int, set[int]]] = {}
        for begin, end, s in marks:
            had = runs.get(begin, (0, set()))
            runs[begin] = (max(end, had[0]), had[1] | {s})
        out: list[tuple[int, int]] = []
        for begin, (end, states) in sorted(runs.items()):
            if end - begin >= LONG_RUN or any(i in leaked for s in states for i, _ in self.places[s]):
                a, b = where[begin][0], where[end - 1][1]
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
        return out


def passage(text: str | None, instructions: bool = True) -> list[str]:
    """The words of an item's passage. An item of two paragraphs or more has an instruction line: the shorter one of its
    first and last paragraph, the first if both are as long. Without `instructions` the whole text is the passage."""
    ps = [w for p in re.split(r"\n[ \t\r]*\n", text or "") if (w := words(p))]
    if instructions and len(ps) > 1:
        ps = ps[1:] if len(ps[0]) <= len(ps[-1]) else ps[:-1]
    return [w for p in ps for w in p]


class _Reader:
    """Texts as word ids of an automaton; pieces are normalised once and remembered."""

    def __init__(self, automaton: Automaton):
        self.get, self.known = automaton.ids.get, {}

    def ids(self, text: str) -> list[int]:
        chunks = _plain(text).split()
        known, get = self.known, self.get
        for c in set(chunks).difference(known):
            known[c] = [get(w, -1) for w in _chunk_words(c)]
        out = [i for c in chunks for i in known[c]]
        if len(known) > 300_000:
            known.clear()
        return out


def _passages(items: DataFrame, item: str, text: str, instructions: bool) -> DataFrame:
    """(item, words) of distinct items."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [passage(t.as_py(), instructions) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], ["item", "words"])

    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, words array<string>")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pickled automaton of the passages of each shard; rows come sorted by shard."""
    shard, held = None, []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(Automaton(held), protocol=5)], pa.binary())], ["shard", "automaton"])

    for b in batches:
        for k, name, ws in zip(*(b.column(x).to_pylist() for x in range(3))):
            if k != shard:
                if held:
                    yield done()
                shard, held = k, []
            held.append((name, ws))
    if held:
        yield done()


@functools.lru_cache(maxsize=1)
def _loaded(shared: Broadcast) -> Automaton:
    return pickle.loads(shared.value)


def _automata(found: DataFrame) -> Iterator[Broadcast]:
    """The automata of passages (passage, words), built by tasks from shards of about SHARD_WORDS words; the driver
    hands them on one by one."""
    spark = found.sparkSession
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // SHARD_WORDS)
    if not n:
        return
    rows = found.select(F.pmod(F.xxhash64("passage"), F.lit(n)).alias("shard"), "passage", "words")
    built = cut(rows.repartition(int(n), "shard").sortWithinPartitions("shard", "passage").mapInArrow(_built, "shard bigint, automaton binary"))
    for r in sorted(r.shard for r in built.select("shard").collect()):  # one number a shard
        yield spark.sparkContext.broadcast(bytes(built.filter(F.col("shard") == r).select("automaton").first()[0]))


def _known(items: DataFrame, item: str, text: str, instructions: bool) -> tuple[DataFrame, DataFrame]:
    """Passages (passage, words) of RUN words or more, and their items (passage, item): equal passages of several items
    are looked for once, by the smallest item."""
    rows = cut(_passages(items, item, text, instructions).filter(F.size("words") >= RUN))
    found = cut(rows.groupBy("words").agg(F.min("item").alias("passage")))
    return found, cut(rows.join(found, "words").select("passage", "item"))


def leaking(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", instructions: bool = True) -> DataFrame:
    """(key, item, covered_words, item_words, longest_run) of each document and item of which it holds at least
    1/SHARE of the words in runs of RUN or more.

    Null and empty texts leak nothing; repeated documents are reported each; items with equal passages are all named,
    however many there are; items shorter than RUN words can't leak, see `looked_for`. Automata hold SHARD_WORDS words
    each and are built in tasks; the texts are read once for each of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    shape = f"key {kind}, passage {item_kind}, covered_words int, item_words int, longest_run int"
    found, of = _known(items, item, item_text, instructions)
    out = spark.createDataFrame([], shape)
    for automaton in _automata(found):

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            auto = _loaded(automaton)
            reader = _Reader(auto)
            for batch in batches:
                found = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    got = auto.covered(reader.ids(t.as_py()))
                    found += [(k, auto.items[i][0], got[i][0].bit_count(), auto.items[i][1], got[i][1]) for i in sorted(auto.leaked(got))]
                if found:
                    names = ["key", "passage", "covered_words", "item_words", "longest_run"]
                    kinds = [batch.schema.field(0).type, None, pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

        out = out.unionByName(rows.mapInArrow(run, shape))
    named = out.join(broadcast_if_small(of), "passage").select("key", "item", "covered_words", "item_words", "longest_run")
    return named.withColumnsRenamed({"key": key, "item": item})


def looked_for(items: DataFrame, item: str = "item_id", item_text: str = "text", instructions: bool = True) -> DataFrame:
    """(item, n_words, checked) of the distinct items: an item whose passage has fewer than RUN words, as null and empty
    texts have, is in no run and isn't looked for."""
    size = F.size("words")
    return _passages(items, item, item_text, instructions).select(F.col("item").alias(item), size.alias("n_words"), (size >= RUN).alias("checked"))


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", instructions: bool = True) -> DataFrame:
    """(key, spans, removed_chars, text) of each document with something to remove: its text without the spans that runs of
    LONG_RUN words or more fill, and without all runs of items that it leaks. Spans (begin, end) are places in the old
    text, in order, and don't overlap. Documents that stay as they are aren't listed; keys have to be unique."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    shape = f"key {rows.schema['key'].dataType.simpleString()}, begin int, end int"
    out = spark.createDataFrame([], shape)
    for automaton in _automata(_known(items, item, item_text, instructions)[0]):

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            auto = _loaded(automaton)
            reader = _Reader(auto)
            for batch in batches:
                found = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    value = t.as_py()
                    if auto.covered(reader.ids(value)):
                        found += [(k, a, b) for a, b in auto.removed(value)]
                if found:
                    kinds = [batch.schema.field(0).type, pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["key", "begin", "end"])

        out = out.unionByName(rows.mapInArrow(run, shape))
    # spans of several automata may overlap: a span begins where none before reaches
    so_far = Window.partitionBy("key").orderBy("begin", "end")
    apart = out.withColumn("before", F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = apart.withColumn("n", F.sum(F.when(F.col("begin") <= F.col("before"), 0).otherwise(1)).over(so_far))
    span = numbered.groupBy("key", "n").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = cut(span.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")))  # of one text
    kept = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring("text", _end(i - 1) + 1, F.coalesce(F.get("spans", i)["begin"], F.length("text")) - _end(i - 1))))
    size = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["begin"])
    return rows.join(broadcast_if_small(spans), "key").select(F.col("key").alias(key), "spans", size.alias("removed_chars"), kept.alias("text"))


def _end(i):
    """Where span i ends; 0 before the first."""
    return F.when(i < 0, F.lit(0)).otherwise(F.get("spans", i)["end"])


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passage"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with leaked or long matched spans, and their texts without them."""
    return cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passage"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items, the words of their passages, and whether they are long enough to be looked for."""
    return looked_for(table(spark, sf_dir, "eval_passage"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_cleaned": p9_cleaned, "p9_items": p9_items}
SQL: dict[str, str] = {}
