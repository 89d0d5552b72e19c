"""License notices by bounded-error search: exact seeds find candidates, the regex library verifies them.

A notice of length n that may differ by k edits is cut into k + 1 pieces; k
edits touch at most k of them, so one piece stands unchanged wherever the
notice does (pigeonhole).  One Aho-Corasick pass over the words of a text finds
all pieces of all notices; around each, the text that the notice could cover is
matched with at most k errors, best match first.  A notice with no errors is
its own only piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are no part of a word become blanks, A-Z become lower case.
CANON = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    """Words of a notice, the label that it gives, and the character edits that it may have (insertions, deletions, substitutions)."""

    words: str
    label: str
    errors: int


# The phrases that the base labels are defined by.
BASE = (Notice("mit license", "mit", 0), Notice("apache license", "apache", 0), Notice("general public license", "gpl", 0))
#: Short forms of notices in use; some edits for each, none where every letter counts; the cost of a check grows steeply with them.
FUZZY = (
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    Notice("licensed under the apache license version 2 0", "apache", 4),
    Notice("licensed under the gnu general public license", "gpl", 4),
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 4),
    Notice("gnu affero general public license", "agpl", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 5),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 4),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 4),
    Notice("boost software license", "bsl", 2),
    Notice("licensed under cc by nc", "cc", 1),
    Notice("licensed under cc by", "cc", 0),
    Notice("creative commons attribution", "cc", 3),
    Notice("all rights reserved", "proprietary", 2),
    *(Notice(f"spdx license identifier {name}", label, 0) for name, label in (("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("mpl 2 0", "mpl"), ("bsd 3 clause", "bsd"))),
)


def canonical(text: str) -> str:
    """The words of a text, lower-cased, with one blank before and behind each."""
    words = text.encode("utf-8", "surrogatepass").translate(CANON).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else ""


def pieces(text: str, n: int) -> list[tuple[int, str]]:
    """text cut into n pieces of about one length, with where each begins."""
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Search:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices, seeds = notices, {}
        self.texts = [f" {' '.join(n.words.split())} " for n in notices]
        # the outer blanks may not be edited: a notice begins and ends with whole words of the text
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(t[1:-1])}){{e<={n.errors}}}(?= )") if n.errors else None for t, n in zip(self.texts, notices, strict=True)]
        for k, (t, n) in enumerate(zip(self.texts, notices, strict=True)):
            if len(t) - 2 <= 2 * n.errors:
                raise ValueError(f"too many errors for a notice of this length: {n}")
            # an inner text is cut, the outer blanks stay with the whole of an exact one
            for at, piece in pieces(t[1:-1], n.errors + 1) if n.errors else [(-1, t)]:
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def windows(self, data: str) -> dict[int, list[list[int]]]:
        """For each notice the ranges of data that hold a piece of it and all that the notice could cover around; those that touch are one."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(data):
            begin = last - size + 1
            for k, at in uses:
                e, n = self.notices[k].errors, len(self.texts[k]) - 2
                a, b = max(begin - at - e - 1, 0), min(begin - at + n + e + 1, len(data))  # a blank more on each side
                mine = out.setdefault(k, [])
                if e and mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        return out

    def find(self, data: str) -> list[tuple[int, int, int, int]]:
        """(begin, end, notice, edits) of what stands in data, between the outer blanks; matches of one notice don't overlap unless it has no errors."""
        found = []
        for k, ranges in self.windows(data).items():
            if not self.notices[k].errors:
                found += [(a + 1, b - 1, k, 0) for a, b in ranges]
                continue
            todo = joined(ranges)
            while todo:  # the best match of a range, then what is left of it on either side
                a, b = todo.pop()
                if m := self.patterns[k].search(data, a, b):
                    found.append((*m.span(), k, sum(m.fuzzy_counts)))
                    todo += [[a, m.start()], [m.end(), b]]
        return sorted(found)


def joined(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    base are phrases that stand exactly; n_base counts all their places,
    first_word and last_word are the least and greatest word that one begins at
    (null without any).  fuzzy are notices that may have errors; they add to
    labels only.  Labels are distinct, sorted and comma-joined.  score is the
    likeness of the best match, 1 - edits / length: 1 for an exact one, 0 for
    none.  notices lists all matches: label, begin and until (words), edits; of
    one notice's overlapping matches the one with fewest edits counts, the
    first of several.

    Null and empty texts have no words and no labels; repeated rows stay, ids
    may be null; an empty table gives no rows; other columns aren't read, so
    their names don't matter.  A task holds one text at a time, of any length,
    and looks only around seeds.  Map only.
    """
    notices = (*base, *fuzzy)
    kind = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("until", pa.int64()), ("edits", pa.int32())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    n_base = len(base)

    def judge(search: Search, text: str):
        data = canonical(text)
        words = data.count(" ") - 1 if data else 0
        found, marks, word, at = search.find(data) if data else [], [], 0, 0
        firsts, base_labels, labels, score = [], set(), set(), 0.0
        for begin, end, k, edits in found:  # sorted by begin, so blanks are counted once
            word += data.count(" ", at, begin)
            at = begin
            first, label = word - 1, notices[k].label
            if k < n_base:
                firsts.append(first)
                base_labels.add(label)
            labels.add(label)
            score = max(score, 1 - edits / (len(search.texts[k]) - 2))
            marks.append({"label": label, "begin": first, "until": first + data.count(" ", begin, end) + 1, "edits": edits})
        return words, len(firsts), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, marks

    def run(batches):
        search = Search(notices)
        for batch in batches:
            rows = [judge(search, t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *names])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,begin:bigint,until:bigint,edits:int>>")
    return out.withColumnRenamed("id", id_col)
