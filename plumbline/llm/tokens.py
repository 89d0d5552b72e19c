"""Token counts and ids of whole documents under a public byte-level BPE vocabulary.

Two facts about the vocabulary's word pattern carry everything here.  A blank
(U+0020) that follows a character other than white space always begins a new
pre-token, because no alternative of the pattern holds a blank behind such a
character; and what follows a pre-token's begin depends on the text from there
on only.  So such a place is a *stable boundary*: the ids of the whole text
are those of its left and right parts joined.

* `TextCoder` cuts texts at stable boundaries where the script changes, and
  gives each run to the library that encodes it fastest.
* `spliced_count` encodes overlapping chunks of a huge document with offsets
  and joins neighbours at a stable boundary where both have a token boundary;
  where the overlap holds none, it is widened.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a chunk, and of a text from which on it is encoded in chunks.
CHUNK, HUGE = 4_000, 8_000
SPACE_BLANK = re.compile(r"\s ")
#: A character beyond the Latin blocks.
FAR = re.compile("[^\u0000-\u024f]")


def load(vocabulary: str):
    """The tokenizer of a public vocabulary; its path on this machine is looked up by name."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    t.no_truncation()
    t.no_padding()
    return t


def process_memory(name: object) -> dict:
    """What this worker process keeps from task to task for one purpose; another purpose's things go.

    The functions themselves arrive anew with each task, so this can't be a global of theirs.
    """
    import sys
    import types

    own = vars(sys.modules.setdefault("_corpus_memory", types.ModuleType("_corpus_memory")))
    if own.get("name") != name:
        own["name"], own["kept"] = name, {}
    return own["kept"]


def stable_parts(text: str) -> list[str]:
    """Cut at stable boundaries; the parts joined are the text."""
    if text and text[0] != " " and "\0" not in text and not SPACE_BLANK.search(text):
        return text.replace(" ", "\0 ").split("\0")  # each blank is a stable boundary
    parts: list[str] = []
    held = ""
    for i, piece in enumerate(text.split(" ")):
        if i == 0:
            held = piece
        elif held and not held[-1].isspace():
            parts.append(held)
            held = " " + piece
        else:
            held += " " + piece
    if held:
        parts.append(held)
    return parts


def latin_encoder(vocabulary: str):
    """A function from a text to its ids, several times faster than the tokenizer, or None where no rank file is there.

    The rank file holds the same vocabulary for another library.  It is asked
    for Latin text only, where both libraries' tables of letters and white
    space agree (the tests compare them over all of it).
    """
    import base64
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    path = Path(public_tokenizers.path(vocabulary)).with_suffix(".tiktoken")
    if not path.exists():
        return None
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
    own = tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    lengths = np.zeros(len(ranks) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    lengths[len(ranks)] = len("<|endoftext|>")
    return (lambda text: own.encode_to_numpy(text, allowed_special="all")), lengths


class TextCoder:
    """Ids of whole texts under a public vocabulary, as arrays of 32 bits."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.vocabulary, self.loaded = vocabulary, None
        self.latin, self.lengths = latin_encoder(vocabulary) or (None, None)

    @property
    def tokenizer(self):
        """The tokenizer, loaded when it is first needed."""
        if self.loaded is None:
            self.loaded = load(self.vocabulary)
        return self.loaded

    def runs(self, text: str) -> list[tuple[bool, str]]:
        """The text in runs of stable parts within the Latin blocks (True) and beyond."""
        if self.latin is None:
            return [(False, text)]
        found = ((FAR.search(part) is None, part) for part in stable_parts(text))
        return [(latin, "".join(p for _, p in run)) for latin, run in groupby(found, itemgetter(0))]

    def starts(self, text: str) -> np.ndarray:
        """Offsets of all tokens' first characters: by their lengths in bytes for the Latin blocks, else as the tokenizer says."""
        out, at = [np.zeros(0, np.int64)], 0
        for latin, run in [(True, text)] if self.latin is not None and text.isascii() else self.runs(text):
            if latin:
                lengths = self.lengths[self.latin(run)]
                here = lengths.cumsum() - lengths
                if not run.isascii():
                    here = ((np.frombuffer(run.encode(), np.uint8) & 0xC0) != 0x80).cumsum()[here] - 1
            else:
                here = np.array([o[0] for o in self.tokenizer.encode(run, add_special_tokens=False).offsets], np.int64)
            out.append(at + here)
            at += len(run)
        return np.concatenate(out)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        mixed = {}
        for i, t in enumerate(texts):
            if self.latin is not None and (t.isascii() or not FAR.search(t)):
                out[i] = self.latin(t)
            else:
                mixed[i] = self.runs(t)
        if mixed:
            far = iter(self.tokenizer.encode_batch_fast([t for runs in mixed.values() for latin, t in runs if not latin], add_special_tokens=False))
            for i, runs in mixed.items():
                out[i] = np.concatenate([np.zeros(0, np.uint32), *(self.latin(t) if latin else np.array(next(far).ids, np.uint32) for latin, t in runs)])
        return out


def text_blocks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size (one text at least): first row, texts; null counts as empty."""
    begin, held, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if held and size + len(t) > most:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield begin, held


def boundary_after(text: str, begin: int, end: int) -> int:
    """The first stable boundary in [begin, end) of text, or -1."""
    at = text.find(" ", max(begin, 1), end)
    while at >= 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, end)
    return at


def spliced_count(starts: Callable[[str], np.ndarray], text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text by overlapping chunks joined at common stable boundaries.

    `starts` encodes a chunk and gives its tokens' offsets.  [left, right) is
    encoded so, and so is the next chunk, from
    right - overlap.  A stable boundary inside the overlap at which both have
    a token boundary ends the left chunk's share and begins the right one's.
    With none in the overlap, the overlap and the left chunk double, at last
    up to the end of the text: a text without any stable boundary is encoded
    as a whole.
    """
    n, left, done, total = len(text), 0, 0, 0
    right = min(n, chunk)
    mine = left + starts(text[left:right])
    while right < n:
        size, at = overlap, -1
        while True:
            begin = max(left + 1, right - size)
            until = min(n, begin + max(chunk, 2 * size))
            theirs = begin + starts(text[begin:until])
            common = set(np.intersect1d(mine[mine >= begin], theirs[theirs < right]).tolist())
            at = boundary_after(text, max(begin + 1, done + 1), right)
            while at >= 0 and at not in common:
                at = boundary_after(text, at + 1, right)
            if at >= 0:
                break
            size *= 2
            right = min(n, right + size)
            mine = left + starts(text[left:right])
            if right == n:
                return total + int((mine >= done).sum())
        total += int(((mine >= done) & (mine < at)).sum())
        done, left, right, mine = at, begin, until, theirs
    return total + int((mine >= done).sum())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = 1024, huge: int = HUGE, chunk: int = CHUNK, overlap: int = 200) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 of both; repeated rows stay repeated; a null id
    stays null; an empty table gives no rows; texts of over `huge` characters
    are encoded in chunks, whose splices give the count of the whole text; one
    without a blank behind another character has no splice, and is encoded as a
    whole by one task.  Other columns are not read, so their names don't matter.
    """
    def run(batches):
        coder = TextCoder(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for _, texts in text_blocks(batch.column(1)):
                short = iter(coder.ids([t for t in texts if len(t) <= huge]))
                for t in texts:
                    sizes.append(len(t.encode()))
                    counts.append(spliced_count(coder.starts, t, chunk, overlap) if len(t) > huge else len(next(short)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
