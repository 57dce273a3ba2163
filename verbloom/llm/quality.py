"""Per-document text statistics, and prose told from lists, tables and junk.

Method: every line (long lines by sentence) is reduced to a few binned statistics, a hidden Markov model with the
states prose, list, table and junk labels the lines of a document jointly (Viterbi), and the share of characters
under each label describes the document. The model is fitted by expectation maximisation on the lines of all documents,
from stated probabilities that tell the states apart: the lines are written once, as numbers of their bins, and every
round reads them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import product
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.session import cut, ship, table

STATES = ("prose", "list", "table", "junk")

#: Function words of the languages whose prose is expected.
COMMON_WORDS = {
    "en": "a about after again against all although an and another any are around as asked at be because been before behind between both but by can could did do does each every few for from had has have he her his how if in into is it its like many may might most no not of off on one only or other out over said shall she should since so some such than that the their them then these they this those three through to toward two under until up was we were what when where whether which while who whom why will with within without would you your",
    "fr": "au aux avec car ce ces cet cette chaque chez dans de des du elle en entre est et il ils je la le les leur lui mais nous on ou par pas plus pour puisque quand que qui sa sans se ses si son sont sous sur tout un une vers vous",
    "de": "aber als am an auf aus bei bis das dass dem den denn der des die dieser diese dieses doch durch ein eine einem einen einer er es für gegen hat hinter ich ihr im in ist jede jeder jedes mit nach nicht noch nur ob oder ohne sich sie sind um und unter von vor war weil wenn wie wir wird zu zum zur über",
    "es": "al aunque bajo cada como con contra de del desde el ella en entre es esa ese esta este está hacia hasta la las le lo los me mi muy más ni no o para pero por porque que se si sin sobre son su sus también tras un una uno y ya",
    "it": "agli al alla che con da dal dalla dei del della delle di dove e gli ha i il in la le lo ma nel nella non o per perché più quando questa questo se si sono su sua suo tra un una uno è",
    "pt": "ao aos as até com como da das de do dos e ela ele em entre essa esse esta este foi isso mais mas na nas no nos não o os ou para pela pelo por porque que se sem seu sua são também um uma à é",
}
_COMMON = frozenset(w for ws in COMMON_WORDS.values() for w in ws.split())
#: The same for Chinese, by character.
_COMMON_HAN = frozenset("的了在是和个这那每一从向对把被因为但并且与也就不有我你他她们之其所以而")

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿぀-ヿ가-힯]")
_SPLIT = re.compile(r"(?<=[.!?][\s\"”'’])\s*(?=\S)|(?<=[。！？])")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|^[>#*_\s]+(?=\S)")
_BULLET = re.compile(r"\s*(?:[-+*•·–—]\s|\(?[0-9]{1,4}[.):]\s|\(?[a-zA-Z][.)]\s|[^\W\d_][\w-]*:\s)")
_GAP = re.compile(r"\S {3,}\S")
_COMMAS = re.compile(r"[^\s,]+(?:,[^\s,]+){2,}")
_SETTINGS = re.compile(r"\w=\S.*\w=\S")
_CALL = re.compile(r"\w\(.*\)\s*[{;:]")
#: Blanks and the punctuation of prose; what else isn't a letter counts as a digit or symbol.
_PLAIN = dict.fromkeys(map(ord, " \t\n\r\xa0\u3000.,;:!?'\"’‘“”()-–—。，！？、；：«»¿¡"))
LONG_LINE = 160

#: P(bin | state) of each line statistic, states in the order of STATES. Read: prose lines have one common word in
#: two to five, list items are short or begin with a mark, table rows have columns and digits, junk has no common words.
_EMISSION = {
    "common": [(0.03, 0.36, 0.50, 0.32), (0.07, 0.20, 0.25, 0.20), (0.88, 0.25, 0.18, 0.07), (0.02, 0.15, 0.02, 0.01), (0.002, 0.04, 0.05, 0.40)],  # share < .06, < .15, < .56, more; < .06 of 12 words or more
    "words": [(0.04, 0.42, 0.30, 0.25), (0.16, 0.48, 0.40, 0.25), (0.80, 0.10, 0.30, 0.50)],  # up to 2, up to 6, more
    "columns": [(0.985, 0.80, 0.10, 0.85), (0.015, 0.20, 0.90, 0.15)],  # no, yes
    "bullet": [(0.93, 0.35, 0.85, 0.90), (0.07, 0.65, 0.15, 0.10)],  # no, yes
    "end": [(0.30, 0.68, 0.93, 0.70), (0.64, 0.10, 0.04, 0.25), (0.06, 0.22, 0.03, 0.05)],  # none, sentence mark, question mark
    "symbols": [(0.90, 0.70, 0.20, 0.40), (0.08, 0.22, 0.40, 0.20), (0.02, 0.08, 0.40, 0.40)],  # digits and symbols: < .08, < .25, more
    "length": [(0.05, 0.08, 0.15, 0.22), (0.92, 0.84, 0.75, 0.53), (0.03, 0.08, 0.10, 0.25)],  # mean word: under 2.5, up to 8, more
    "question": [(0.985, 0.70, 0.99, 0.98), (0.015, 0.30, 0.01, 0.02)],  # a whole line that is a short question: no, yes
}
_STAY, _SWITCH = log(0.82), log(0.06)


class Model:
    """Probabilities of the states at a text's first line, and of each line statistic's bins in each state (as in
    _EMISSION). From line to line a state stays or switches with stated chances."""

    def __init__(self, start: tuple[float, ...], emission: dict[str, list[tuple[float, ...]]]):
        self.start, self.emission = start, emission
        self.log_start = tuple(map(log, start))
        self._log = [[tuple(map(log, row)) for row in rows] for rows in emission.values()]
        self._known: dict[tuple[int, ...], tuple[float, ...]] = {}

    def __getstate__(self):
        return self.start, self.emission

    def __setstate__(self, state):
        self.__init__(*state)

    def emit(self, bins: tuple[int, ...]) -> tuple[float, ...]:
        """log P(bins | state) for each state; there are some thousand combinations of bins."""
        got = self._known.get(bins)
        if got is None:
            got = self._known[bins] = tuple(sum(table[value][k] for table, value in zip(self._log, bins)) for k in range(len(STATES)))
        return got


STATED = Model((0.7, 0.12, 0.09, 0.09), _EMISSION)

#: All combinations of bins; a line's number is the place of its own.
_BINS = list(product(*(range(len(rows)) for rows in _EMISSION.values())))
_NUMBER = {bins: k for k, bins in enumerate(_BINS)}
#: For each row of _EMISSION in turn, the numbers that have its bin.
_HAS = np.array([[bins[x] == v for bins in _BINS] for x, rows in enumerate(_EMISSION.values()) for v in range(len(rows))], dtype=np.int64)
#: Expected counts are whole multiples of 1 / UNIT line, so that their sums don't depend on how the texts are spread.
UNIT = 1 << 24
#: Lines of several texts that are counted at once, at most.
LINES = 200_000
#: The stated probabilities count like WEIGHT lines of each state in up to SAMPLE texts, and like as many more in more
#: texts: against a fixed number of lines they would count the less the larger the table, and the states drift.
WEIGHT, SAMPLE = 2_000.0, 2_000
#: Texts from which on a step over all of them at once is faster than one after another.
FEW = 12
#: How many sums `expected` gives.
_WIDTH = 3 + len(STATES) * (1 + len(_HAS))


def _alone(numbers: list[int], rows: list[list[float]], came: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same steps as in `expected` for the last lines of one text: forward probabilities and scale of each, backward
    ones of the line before them and of each. `came` are the chances of the states at the first of them."""
    switch, more = exp(_SWITCH), exp(_STAY) - exp(_SWITCH)
    forward, scale, backward = array("d"), array("d"), array("d", [1.0] * 4)
    p, q, r, s = came
    for number in numbers:
        a, b, c, d = rows[number]
        a, b, c, d = p * a, q * b, r * c, s * d
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
        scale.append(total)
        forward.extend((a, b, c, d))
        p, q, r, s = switch + more * a, switch + more * b, switch + more * c, switch + more * d
    p = q = r = s = 1.0
    for number, total in zip(reversed(numbers), reversed(scale)):
        a, b, c, d = rows[number]
        a, b, c, d = p * a, q * b, r * c, s * d
        x = switch * (a + b + c + d)
        p, q, r, s = (x + more * a) / total, (x + more * b) / total, (x + more * c) / total, (x + more * d) / total
        backward.extend((p, q, r, s))
    return np.array(forward).reshape(-1, 4).T, np.array(scale), np.array(backward).reshape(-1, 4)[::-1].T


def expected(numbers: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Sums over texts, given the numbers of the lines of all of them and how many each has: texts, lines, then in units of
    1 / UNIT their log likelihood, first lines in each state and, for each row of _EMISSION, lines in each state (forward
    and backward probabilities)."""
    starts = np.cumsum(lengths) - lengths
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    place = np.arange(len(numbers)) - np.repeat(starts, lengths)
    numbers = numbers[np.lexsort((np.repeat(rank, lengths), place))]  # first lines of all texts, then second ones ...; longer texts first
    n = np.bincount(place)
    begin = np.cumsum(n) - n
    logs = np.array([model.emit(bins) for bins in _BINS]).T
    shift = logs.max(axis=0)
    odds = np.exp(logs - shift)
    e = odds[:, numbers]
    switch, more = exp(_SWITCH), exp(_STAY) - exp(_SWITCH)
    forward, backward, scale = np.empty_like(e), np.ones_like(e), np.empty(len(numbers))
    few = int(np.count_nonzero(n > FEW))
    for i in range(few):
        here = slice(begin[i], begin[i] + n[i])
        came = np.array(model.start)[:, None] if i == 0 else switch + more * forward[:, begin[i - 1] : begin[i - 1] + n[i]]
        at = came * e[:, here]
        scale[here] = at[0] + at[1] + at[2] + at[3]
        forward[:, here] = at / scale[here]
    if few < len(n):
        rows = odds.T.tolist()
        for r in range(n[few]):
            own = begin[few : np.count_nonzero(n > r)] + r
            came = model.start if few == 0 else (switch + more * forward[:, begin[few - 1] + r]).tolist()
            forward[:, own], scale[own], back = _alone(numbers[own].tolist(), rows, came)
            backward[:, own] = back[:, 1:]
            if few:
                backward[:, begin[few - 1] + r] = back[:, 0]
    for i in range(few - 1, 0, -1):
        here = slice(begin[i], begin[i] + n[i])
        at = e[:, here] * backward[:, here]
        backward[:, begin[i - 1] : begin[i - 1] + n[i]] = (switch * (at[0] + at[1] + at[2] + at[3]) + more * at) / scale[here]
    forward *= backward
    lines = np.rint(forward * UNIT)
    by_number = np.array([np.bincount(numbers, x, len(_BINS)) for x in lines]).astype(np.int64)
    likelihood = np.rint((np.log(scale) + shift[numbers]) * UNIT).sum()
    return np.concatenate([[len(lengths), len(numbers), int(likelihood)], lines[:, : n[0]].sum(axis=1).astype(np.int64), (_HAS @ by_number.T).ravel()])


def _sums(numbers: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """`expected` of any number of texts, also of empty ones (which don't count), some LINES at a time."""
    total = np.zeros(_WIDTH, dtype=np.int64)
    lengths = lengths[lengths > 0]
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(int(np.searchsorted(ends, begin + LINES, side="right")), first + 1)
        total += expected(numbers[begin : ends[last - 1]], lengths[first:last], model)
        first = last
    return total


def _maximised(expect: Callable[[Model], Iterable[list[int]]], begin: Model, rounds: int, weight: Callable[[int], float]) -> tuple[Model, list[float]]:
    """Rounds of expectation maximisation and the mean log likelihood of a line before each. `expect` gives the sums of
    `expected` over all texts under a model, in parts, and `weight` the lines that `begin` counts like, given the number
    of texts. Without any line it stays `begin`."""
    model, likelihood = begin, []
    for _ in range(rounds):
        n_texts, n_lines, total, *counts = map(sum, zip([0] * _WIDTH, *expect(model)))
        if not n_lines:
            break
        likelihood.append(total / UNIT / n_lines)
        counts = np.array([x / UNIT for x in counts]).reshape(-1, len(STATES))
        start = np.array(begin.start) * weight(n_texts) + counts[0]
        emission, at = {}, 1
        for k, rows in begin.emission.items():
            v = np.array(rows) * weight(n_texts) + counts[at : at + len(rows)]
            emission[k] = [tuple(r) for r in (v / v.sum(axis=0)).tolist()]
            at += len(rows)
        model = Model(tuple((start / start.sum()).tolist()), emission)
    return model, likelihood


def fitted(texts: list[list[tuple[int, ...]]], begin: Model = STATED, rounds: int = 10, weight: float = WEIGHT) -> tuple[Model, list[float]]:
    """The model after `rounds` of expectation maximisation over texts, each the bins of its lines, and the mean log
    likelihood of a line before each round. The stated probabilities count like `weight` lines of each state."""
    numbers = np.array([_NUMBER[b] for lines in texts for b in lines], dtype=np.int64)
    lengths = np.array([len(lines) for lines in texts], dtype=np.int64)
    return _maximised(lambda model: [_sums(numbers, lengths, model).tolist()], begin, rounds, lambda n: weight)


def _columns(line: str, body: str) -> bool:
    """Tabs, bars, comma-separated values, settings, calls and code ends."""
    return (
        "\t" in body or line.count("|") > 1 or body[-1] in "{};" or "," in body and " " not in body and bool(_COMMAS.fullmatch(body))
        or body.count("=") > 1 and bool(_SETTINGS.search(body)) or "(" in body and bool(_CALL.search(body))
    )


def line_bins(line: str, whole: bool) -> tuple[tuple[int, ...], tuple[int, int, int, int, int]]:
    """The binned statistics of a line in the order of _EMISSION, and its counts: words, letters, common words, symbols,
    characters without blanks. `whole` is false for a sentence of a longer line."""
    body = line.strip()
    if "<" in body or body[0] in ">#*_":
        body = _MARKUP.sub(" ", body).strip() or body
    letters = _WORD.findall(body.lower())
    n_words = n = len(letters)
    n_letters = sum(map(len, letters))
    n_common = sum(map(_COMMON.__contains__, letters))
    n_symbols = len(body.translate(_PLAIN)) - n_letters
    size = len(body) - body.count(" ") or 1
    symbols = n_symbols / size
    han = len(_HAN.findall(body)) if not body.isascii() else 0
    if han * 3 > size:
        common = 0.3 if sum(c in _COMMON_HAN for c in body) * 12 > han else 0.0
        n, mean = han // 2 + 1, 4.0
    else:
        common, mean = (n_common / n, n_letters / n) if n else (0.0, 0.0)
    last = body.rstrip("\"'”’)* _")[-1:]
    end = 2 if last in ("?", "？") else 1 if last in (".", "!", "。", "！", "…") else 0
    bins = (
        (4 if n >= 12 else 0) if common < 0.06 else 1 if common < 0.15 else 2 if common < 0.56 else 3,
        0 if n <= 2 else 1 if n <= 6 else 2,
        int(_columns(line, body) or (symbols >= 0.08 or common < 0.15) and "   " in body and bool(_GAP.search(body))),
        int(bool(_BULLET.match(line))),
        end,
        0 if symbols < 0.08 else 1 if symbols < 0.25 else 2,
        0 if mean < 2.5 else 1 if mean <= 8 else 2,
        int(whole and end == 2 and n <= 8),
    )
    return bins, (n_words, n_letters, n_common, n_symbols, size)


def _lines(text: str) -> list[tuple[str, bool]]:
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        if len(line) <= LONG_LINE:
            out.append((line, True))
        else:
            out += [(s, False) for s in _SPLIT.split(line) if s and s.strip()]
    return out


def label_lines(lines: list[tuple[int, ...]], model: Model = STATED) -> list[int]:
    """The most probable states of the lines of one document, given their bins (Viterbi)."""
    score, back = None, []
    for bins in lines:
        emit = model.emit(bins)
        if score is None:
            score = [s + e for s, e in zip(model.log_start, emit)]
            continue
        best = score.index(max(score))
        jump = score[best] + _SWITCH
        came = [k if score[k] + _STAY >= jump else best for k in range(4)]
        score = [max(score[k] + _STAY, jump) + emit[k] for k in range(4)]
        back.append(came)
    if score is None:
        return []
    path = [score.index(max(score))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def text_lines(text: str | None) -> tuple[list[int], list[int], int, int, int, int]:
    """The numbers and sizes of a text's lines, and its words, letters, common words and symbols."""
    got = [line_bins(*x) for x in _lines(text)] if text else []
    return [_NUMBER[bins] for bins, _ in got], [c[4] for _, c in got], *(sum(c[k] for _, c in got) for k in range(4))


def _described(numbers: list[int], sizes: list[int], n_words: int, n_letters: int, n_common: int, n_symbols: int, model: Model) -> tuple | None:
    """STATISTICS of a text by its `text_lines`; None if it has none."""
    if not numbers:
        return None
    lines = [_BINS[x] for x in numbers]
    shares = [0, 0, 0, 0]
    for size, state in zip(sizes, label_lines(lines, model)):
        shares[state] += size
    size, n = sum(sizes), n_words or 1
    marks = sum(bins[4] > 0 for bins in lines)
    return (n_words, n_letters / n, n_symbols / size, marks / len(lines), n_common / n, len(lines), *(s / size for s in shares))


def text_statistics(text: str | None, model: Model = STATED) -> tuple | None:
    """Statistics of one text, None for null, empty and blank ones; see STATISTICS."""
    return _described(*text_lines(text), model)


STATISTICS = [
    ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("punctuated_lines", "double"), ("common_words", "double"),
    ("n_lines", "bigint"), ("prose_share", "double"), ("list_share", "double"), ("table_share", "double"), ("junk_share", "double"),
]


_LINES = [("numbers", pa.list_(pa.int16())), ("sizes", pa.list_(pa.int32())), *((n, pa.int64()) for n in ("n_words", "n_letters", "n_common", "n_symbols"))]


def lines_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The `text_lines` of every row of `df`, with its key as `key`."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_lines(t.as_py()) for t in batch.column(1)]
            columns = zip(*got) if got else [()] * len(_LINES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, _LINES))], ["key", *(n for n, _ in _LINES)])

    kinds = "numbers array<smallint>, sizes array<int>, n_words bigint, n_letters bigint, n_common bigint, n_symbols bigint"
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {kinds}")


def labelled(lines: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """One row per row of `lines_of`: its key and STATISTICS."""
    kinds = [pa.int64() if t == "bigint" else pa.float64() for _, t in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * len(STATISTICS)
        for batch in batches:
            got = [_described(*(v.as_py() for v in row), model) or none for row in zip(*batch.columns[1:])]
            columns = zip(*got) if got else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", *(n for n, _ in STATISTICS)])

    shape = f"key {lines.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in STATISTICS)
    return lines.mapInArrow(run, shape).withColumnRenamed("key", key)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model = STATED) -> DataFrame:
    """One row per row of `df`: its key and STATISTICS of the whole text; all null for null, empty and blank texts.

    The shares are of the text's characters without blanks and sum to 1. Repeated keys and texts stay repeated; other
    columns are left out. Runs in the scan, without a shuffle.
    """
    return labelled(lines_of(df, key, text), model, key)


def fitted_to(lines: DataFrame) -> Model:
    """`fitted` on all texts of `lines_of`, which has to be written: every round reads it, and a row of sums comes from
    each task to the driver. Without lines it is the stated model."""
    numbers = lines.select("numbers")

    def expect(model: Model) -> list[list[int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_WIDTH, dtype=np.int64)
            for batch in batches:
                texts = batch.column(0)
                total += _sums(texts.flatten().to_numpy(), texts.value_lengths().to_numpy().astype(np.int64), model)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])

        return [r.sums for r in numbers.mapInArrow(run, "sums array<bigint>").collect()]

    return _maximised(expect, STATED, 10, lambda n: WEIGHT * max(n / SAMPLE, 1.0))[0]


def fitted_on(df: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """`fitted` on all texts; see `fitted_to`."""
    return fitted_to(cut(lines_of(df, key, text)))


def p10_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents aren't prose by the stated and by the fitted model, and how many they judge differently."""
    lines = cut(lines_of(table(spark, sf_dir, "documents")))
    own = lambda m, name: labelled(lines, m).select("doc_id", F.coalesce(F.col("prose_share") < 0.5, F.lit(False)).alias(name))
    both = own(STATED, "stated").join(own(fitted_to(lines), "fitted"), "doc_id")
    n = lambda x: F.count(F.when(x, 1))
    return both.agg(F.count(F.lit(1)).alias("documents"), n(F.col("stated")).alias("stated"), n(F.col("fitted")).alias("fitted"), n(F.col("stated") != F.col("fitted")).alias("differ"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cut(lines_of(table(spark, sf_dir, "documents")))
    return labelled(lines, fitted_to(lines))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents more than half of which isn't prose."""
    return p10_statistics(spark, sf_dir).filter("prose_share < 0.5").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_fitted": p10_fitted}
SQL: dict[str, str] = {}
