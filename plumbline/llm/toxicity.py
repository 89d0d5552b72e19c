"""Toxicity of documents whose words may be disguised: restore by a noisy channel, then score.

* A character model (trigrams over a-z and word bounds) is counted over every
  whole text.
* A word that holds digits or signs, alone or among its letters, long runs of
  one letter, or comes letter by letter, becomes a lattice of what each
  character may stand for; a Viterbi search takes the reading that the
  character model and the costs of the disguise together find likeliest.
  Words of any length and any share of digits are read; only a sign that
  stands alone isn't.
* Words that tell the labels apart are found on a bounded sample of labelled
  rows, and a logistic regression on their presence gives the score.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chance, crc_mod
from .tokens import process_memory

#: Labelled rows that the classifier is fitted on, at most about.
SAMPLE = 20_000
#: Words that it knows at most, and how clearly (in standard deviations) a word must tell labels apart.
FEATURES, CLEAR = 512, 5.0
#: What signs and digits may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s", "¡": "i", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = "-_.,*#~'/\\:;\"^`"
#: Costs (negative log probabilities) of a disguise: a substitute, a separator or another sign left out, a long run or a
#: double letter read as one, a blank left out.  A sign that may stand for a letter is dearer to leave out than any letter is
#: to read (-log(0.005 / 27) = 8.6), or the shorter reading would win.
SUBSTITUTE, SEPARATOR, SIGN, RUN, DOUBLE, BLANK = 1.5, 0.5, 9.0, 0.5, 9.0, 0.2
#: Lengths of the beginnings of words that count as words.
BEGINS = (4, 5, 6, 7)
#: Signs around a word that are no part of it.
EDGE = "\"'#%&*.,;:?!()[]{}<>|/\\-_=+~^`$@…"
#: Those of them that are stripped where the others may stand for letters.
QUIET = "\"'#%&*.,;:?)[]{}<>/\\-_=~^`"
#: Tokens that a worker process remembers at most; the memory is cleared when full, results stay the same.
REMEMBERED = 300_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What a reading can come from, and three or more of one letter.
READABLE = {*LETTERS, *STANDS_FOR}
RUNS = re.compile(r"([^\W\d_])\1\1")
#: One letter at a time, three or more; then the same with signs that stand for letters among them.
BETWEEN, ONE = r"(?:[ ._*-]{1,2}|\s{1,3}|\s?[,;/]\s?)", rf"(?:[^\W_]|[{re.escape(''.join(STANDS_FOR))}])"
LETTERED = re.compile(rf"(?<![^\W_])[^\W_](?:{BETWEEN}[^\W_]){{2,}}(?![^\W_])")
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?:{BETWEEN}{ONE}){{2,}}(?![^\W_])")
NEXT = re.compile(f"{BETWEEN}({ONE})")
CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(LETTERS):
    CODE[ord(_c)] = CODE[ord(_c.upper())] = _i + 1


def character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """27 x 27 x 27 counts of characters in sequence over all whole texts; 0 is anything but a letter."""
    def run(batches):
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                data = CODE[np.frombuffer(b"  ".join((t or "").encode() for t in batch.column(0).slice(begin, 256).to_pylist()) + b"  ", np.uint8)].astype(np.int32)
                total += np.bincount(data[:-2] * 729 + data[1:-1] * 27 + data[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(27**3)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 27^3 rows
        out[r["at"]] = r["n"]
    return out.reshape(27, 27, 27)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a character behind two others, interpolated with shorter contexts."""
    tri = counts / np.maximum(counts.sum(2, keepdims=True), 1)
    two = counts.sum(0)
    bi = two / np.maximum(two.sum(1, keepdims=True), 1)
    one = two.sum(0) / max(two.sum(), 1)
    return -np.log(0.9 * tri + 0.08 * bi[None] + 0.015 * one[None, None] + 0.005 / 27).astype(np.float32)


@cache
def choices(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n (3 stands for more) of one character may stand for and the cost."""
    if c in LETTERS:
        return [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, DOUBLE)] if n == 2 else [(c * 2, RUN), (c, RUN)]
    if c == " ":
        return [("", BLANK), (" ", 1.0)]
    out = [("", SEPARATOR if c in SEPARATORS else SIGN)]
    for x in STANDS_FOR.get(c, ""):
        price = SUBSTITUTE + (c in SEPARATORS)
        out += [(x, price)] if n == 1 else [(x * 2, price), (x, price + (DOUBLE if n == 2 else RUN))]
    return out


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character: what it may stand for (letters, maybe none or two) and the cost."""
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        if c in READABLE or c == " ":  # others add the same cost to all readings
            yield choices(c, min(j - i, 3))
        i = j


class Costs(list):
    """The costs as one list, which is quicker to look up in, and how far two letters can set readings apart."""

    def __init__(self, costs: np.ndarray):
        super().__init__(costs.ravel().tolist())
        self.apart = 2 * float(costs.max() - costs.min()) + 1e-6


def restore(token: str, costs: np.ndarray | Costs) -> str:
    """The likeliest reading of a token: words of a-z, blanks between them where letters were spaced.

    A Viterbi search over the last two letters.  From the next two letters on
    all readings cost the same, so one that is dearer than the cheapest by more
    than two letters can cost is out whatever follows: this bound loses nothing.
    """
    def text(end):
        back = []
        while end is not None:
            end, letters = end
            back.append(letters)
        return "".join(reversed(back))

    costs = costs if isinstance(costs, Costs) else Costs(costs)
    apart, done, steps = costs.apart, [], 0
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two letters: cost, and the letters as a chain
    for some in lattice(token):
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, end) in best.items():
            for letters, price in some:
                x, total = state, cost + price
                for c in letters:
                    at = x * 27 + (0 if c == " " else ord(c) - 96)
                    total += costs[at]
                    x = at % 729
                if x not in after or total < after[x][0]:
                    after[x] = (total, (end, letters) if letters else end)
        if len(after) > 8:
            most = min(after.values(), key=itemgetter(0))[0] + apart
            after = {x: held for x, held in after.items() if held[0] <= most}
        best = after
        steps += 1
        if steps > 1000 and len(best) == 1:  # all readings share what came so far
            (state, (cost, end)), steps = *best.items(), 0
            done.append(text(end))
            best = {state: (cost, None)}
    return "".join(done) + min((cost + costs[state * 27], text(end)) for state, (cost, end) in best.items())[1]


class Fold(dict):
    """By code point: what is left of a character without accents, widths and invisible parts."""

    def __missing__(self, point: int) -> str:
        self[point] = out = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        return out


FOLD = Fold()


def folded(token: str) -> str:
    """Lower case without accents, widths and invisible characters."""
    return token.lower() if token.isascii() else token.lower().translate(FOLD)


def begins(word: str) -> set[str]:
    """The word and its beginnings, marked: words built on one stem share them."""
    return {word, *(word[:n] + "*" for n in BEGINS if len(word) >= n)}


def plain(token: str) -> tuple[str, ...]:
    """The word of a token that is no disguise (letters, no run of three, quiet signs around them), and without accents; else none."""
    core = token.strip(QUIET)
    if not core.isalpha():
        return ()
    word = core.lower()
    bare = word if token.isascii() else word.translate(FOLD)
    return () if not bare.isalpha() or RUNS.search(bare) else (word,) if bare == word else (word, bare)


def readings(token: str, costs: np.ndarray | Costs) -> tuple[str, ...]:
    """What a token says: its words and their beginnings as they stand and, if it looks disguised, words as restored."""
    if words := plain(token):
        return tuple(set().union(*map(begins, words)))
    stripped = token.lower().strip(EDGE)
    out = set().union(*map(begins, [stripped] if stripped.isalpha() else [w for w in re.split(r"[\W_]+", stripped) if w]))
    t = folded(token)
    core, edges = t.strip(EDGE), t.strip(QUIET)
    if edges != core or not core.isalpha() or RUNS.search(core):
        for form in {core, edges}:
            if len(form) > 1 and not READABLE.isdisjoint(form):
                out.update(*map(begins, restore(form, costs).split()))
    if not token.isascii():
        out.update(begins(core))
    return tuple(out)


def spaced_runs(text: str) -> Iterator[str]:
    """Words of the text that come letter by letter, as letters with blanks between them."""
    spaced = {m[0] for m in SPACED.finditer(text)}
    if any(c in STANDS_FOR and not c.isdigit() for x in spaced for c in x):  # letters alone are read too, signs beside them may be no part of the word
        spaced.update(m[0] for m in LETTERED.finditer(text))
    for x in spaced:
        yield folded(" ".join([x[0], *NEXT.findall(x, 1)]))


def words_of(text: str, costs: np.ndarray | Costs, known: dict) -> set[str]:
    """The distinct words of a text and their beginnings, disguised ones restored; known: what tokens say."""
    out: set[str] = set()
    if len(known) > REMEMBERED // 5:
        known.clear()
    tokens = set(text.split())
    for token in tokens.difference(known):
        known[token] = readings(token, costs)
    out.update(*map(known.__getitem__, tokens))
    for run in spaced_runs(text):
        out.update(*(begins(w) for w in restore(run, costs).split() if len(w) > 1))
    return out


class Telling:
    """Finds the wanted words in texts: as words_of would, without making the others."""

    def __init__(self, wanted: dict, costs: np.ndarray | Costs, memory: dict):
        self.wanted, self.costs, self.memory = wanted, costs, memory
        self.stems = [(n, {w[:n] for w in wanted if len(w) == n + 1 and w[-1] == "*"}) for n in BEGINS]
        self.stems = [(n, found) for n, found in self.stems if found]

    def of_word(self, word: str) -> list[str]:
        found = [word[:n] + "*" for n, stems in self.stems if word[:n] in stems]
        return [word, *found] if word in self.wanted else found

    def __call__(self, text: str) -> set[str]:
        seen, telling = self.memory.setdefault("seen", set()), self.memory.setdefault("telling", {})
        if len(seen) > REMEMBERED:
            seen.clear()
            telling.clear()
        tokens = set(text.split())
        new = tokens - seen
        for token in new:
            words = plain(token)
            got = [x for w in words for x in self.of_word(w)] if words else [w for w in readings(token, self.costs) if w in self.wanted]
            if got:
                telling[token] = got
        seen |= new
        out: set[str] = set()
        for token in tokens.intersection(telling):
            out.update(telling[token])
        for run in spaced_runs(text):
            out.update(*(self.of_word(w) for w in restore(run, self.costs).split() if len(w) > 1))
        return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the last one without penalty, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """About `most` labelled rows at most, chosen by a hash of the id; several labels of one id count as their majority."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    one = one.where(crc_mod("id", 4) != 2)
    n = one.count()
    return one.where(chance(most / max(n, 1), 7, "id"))


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, id_col: str, text_col: str, label_col: str) -> tuple[dict[str, float], float]:
    """Weights by word and the bias; without labels of both kinds, no words and a bias of their share."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    sample = F.broadcast(sampled_labels(labels, id_col, label_col, SAMPLE))  # at most about SAMPLE rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id")

    def words(batches):
        costs, known = Costs(shared.value), {}
        for batch in (b.slice(begin, 100) for b in batches for begin in range(0, b.num_rows, 100)):  # a text has thousands of words and beginnings
            got = [list(words_of(t or "", costs, known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.string()))], ["id", "y", "words"])

    def hits(batches):
        index = chosen.value
        told = Telling(index, Costs(shared.value), {})
        for batch in batches:
            got = [sorted({index[w] for w in told(t.as_py() or "")}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(got, pa.list_(pa.int32()))], ["y", "at"])

    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return {}, float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 or n0 else -2.0
    seen = rows.select("id", "text", "y").mapInArrow(words, f"id {kind}, y int, words array<string>").select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(seen_, of):  # seen * log(seen / expected), for the rows with the word and those without
        out = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
        return out(seen_, share * of) + out(of - seen_, (1 - share) * of)

    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("a"), F.lit(n1)) + part(F.col("b"), F.lit(n0)))))  # root of the likelihood ratio
    top = seen.where(F.col("a") + F.col("b") >= 5).withColumn("z", z).where(F.col("z") >= CLEAR).orderBy(F.desc("z"), "word").limit(FEATURES).collect()
    index = {r["word"]: k for k, r in enumerate(top)}
    chosen = docs.sparkSession.sparkContext.broadcast(index)
    table = rows.select("id", "text", "y").mapInArrow(hits, "y int, at array<int>").groupBy("y", "at").agg(F.count("*").alias("n")).collect()  # at most SAMPLE rows
    x = np.zeros((sum(r["n"] for r in table), len(index)), np.float32)
    y, at = np.zeros(len(x)), 0
    for r in sorted(table, key=lambda r: (r["y"], r["at"])):
        x[at : at + r["n"], r["at"]] = 1
        y[at : at + r["n"]] = r["y"]
        at += r["n"]
    w = logistic(x, y)
    return {word: float(w[k]) for word, k in index.items()}, float(w[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 if score >= threshold), and the columns named in keep.

    Rows whose crc32(id) mod 4 is 2 are held out: their labels are not read.
    Null and empty texts get the score of a text without known words, texts of
    any length are read whole; repeated rows stay and score alike; an empty
    table gives no rows; several labels of one id count as their majority, a tie
    as toxic; without labels the score is the same for all.  Columns of docs may
    have any names.  Driver and broadcast hold 27^3 counts and a model of at
    most FEATURES words.
    """
    spark = docs.sparkSession
    costs = character_costs(character_counts(docs, text_col))
    weights, bias = fit(docs, labels, costs, id_col, text_col, label_col)
    shared, run_id = spark.sparkContext.broadcast((costs, weights, bias)), uuid.uuid4().hex

    def run(batches):
        costs, weights, bias = shared.value
        told = Telling(weights, Costs(costs), process_memory(("toxic", run_id)))
        for batch in batches:
            total = [bias + sum(weights[w] for w in sorted(told(t or ""))) for begin in range(0, batch.num_rows, 500) for t in batch.column(0).slice(begin, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30))))], names)

    carried = {c: "text" if c == text_col else f"c{k}" for k, c in enumerate(keep or [], 2)}
    first = 0 if "text" in carried.values() else 1  # a text that is kept goes through as it came, once
    others = [F.col(id_col).alias("c0"), crc_mod(id_col, 4).eqNullSafe(2).alias("c1"), *(F.col(c).alias(x) for c, x in carried.items() if x != "text")]
    given = docs.select(F.col(text_col).cast("string").alias("text"), *others)
    fields = given.schema.fields[first:]
    names = [*(f.name for f in fields), "score"]
    out = given.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double")
    extra = [F.col(x).alias(c) for c, x in carried.items()]
    return out.select(F.col("c0").alias(id_col), F.col("c1").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *extra)
