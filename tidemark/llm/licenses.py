"""License scans: fuzzy search for short notices.

Each notice, as normal words joined by single blanks, is split into one piece more than the edits it may have: by
pigeonhole, any stretch of text within that many edits holds some piece unchanged. An Aho-Corasick automaton over all
pieces finds these seeds in one pass; around each the `regex` library's bounded-error matching verifies the notice and
reports its span and edits. Words that tell one license from another (TELLING) have to stand in the match whole, or with
one edit at most if they are long; words of another meaning at that distance (OTHER_WORDS) don't count as them. The fixed
phrases of the base are found as runs of whole words.

Texts are lower-cased in A-Z; words are runs of 0-9, a-z and characters from U+0080. Null and empty texts have no
words. Texts are read whole. Repeated rows give repeated results; extra columns pass through, those of the result's
names are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

#: The base's phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, short notice, edits allowed, weight in the score.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", 4, 0.9),
    ("mit", "released under the mit license", 2, 0.9),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6, 0.9),
    ("gpl", "licensed under the gnu general public license", 4, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it", 6, 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6, 0.9),
    ("mpl-2.0", "subject to the terms of the mozilla public license", 4, 0.9),
    ("cc-by-nc", "licensed under cc by nc", 1, 0.8),
    ("cc-by-sa", "licensed under cc by sa", 1, 0.8),
    ("cc-by", "licensed under a creative commons attribution", 4, 0.8),
    ("cc0", "dedicated to the public domain under cc0", 3, 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6, 0.9),
    ("spdx", "spdx license identifier", 2, 0.7),
    ("reserved", "all rights reserved", 1, 0.5),
)
#: By label: the words that a match of each of its notices has to hold if the notice has them, and the edits each may have.
TELLING = {
    "apache-2.0": (("apache", 1), ("2", 0)), "mit": (("mit", 1),), "mpl-2.0": (("mozilla", 1),), "cc-by-nc": (("cc", 0), ("nc", 0)), "cc-by-sa": (("cc", 0), ("sa", 0)),
    "cc-by": (("commons", 1),), "cc0": (("cc0", 0),), "spdx": (("spdx", 0),), "reserved": (("reserved", 1),), "gpl": (("gnu", 0), ("general", 1), ("free", 1)),
}
OTHER_WORDS = frozenset("bit fit hit it kit mix sit preserved deserved observed reversed resolved".split())
BASE_WEIGHTS = {"cc-by": 0.6, "gpl": 0.6, "reserved": 0.5}
_LOWER = {i: i + 32 for i in range(65, 91)}
#: By byte: A-Z to a-z, what is in no word to a blank.
_WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32 for b in range(256))
#: Fixed value: the word pattern.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RESULT = (
    "struct<n_words:bigint,places:array<struct<label:string,word:bigint>>,"
    "notices:array<struct<label:string,start:bigint,end:bigint,edits:int>>,score:double>"
)
_RESULT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
        ("notices", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))),
        ("score", pa.float64()),
    ]
)


def within(word: str, other: str, edits: int) -> bool:
    """Whether `other` is `word` but for that many edits, 0 or 1, and isn't another word."""
    if word == other:
        return True
    if not edits or abs(len(word) - len(other)) > 1 or other in OTHER_WORDS:
        return False
    same = 0
    while same < min(len(word), len(other)) and word[same] == other[same]:
        same += 1
    return word[same + (len(word) >= len(other)) :] == other[same + (len(other) >= len(word)) :]


def telling(label: str, notice: str) -> tuple[tuple[str, int], ...]:
    return tuple((w, e) for w, e in TELLING.get(label, ()) if w in notice.split())


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(start, piece): the notice in edits + 1 pieces of about equal length."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice, edits, _) in enumerate(notices):
            for start, piece in pieces(notice, edits):
                held.setdefault(piece, []).append((i, start))
        for piece, uses in held.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.weights = {label: max(w for k, _, _, w in notices if k == label) for label, *_ in notices}
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}") for _, notice, edits, _ in notices]
        self.telling = [telling(label, notice) for label, notice, *_ in notices]
        self.phrases = [(label, f" {phrase} ") for phrase, label in phrases]

    def places(self, padded: str) -> list[tuple[str, int]]:
        """(label, word index) of each place of a base phrase, in order; `padded` has a blank on either side of every word."""
        found = []
        for label, phrase in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = padded.find(phrase, at + 1)
        out, at, words = [], 0, 0
        for start, label in sorted(found):
            words += padded.count(" ", at, start)
            at = start
            out.append((label, words))
        return out

    def near(self, joined: str, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the notices, with at most their edits; places count code points of the text."""
        tries: dict[int, set[int]] = {}
        for end, (n, uses) in self.seeds.iter(joined):
            for i, start in uses:
                tries.setdefault(i, set()).add(end + 1 - n - start)
        if not tries:
            return []
        starts = [m.start() for m in WORD.finditer(text.translate(_LOWER))]
        offsets, at = [], 0
        lengths = [len(p) for p in joined.split(" ")]
        for n in lengths:
            offsets.append(at)
            at += n + 1
        out = set()
        for i, begins in tries.items():
            label, notice, edits, _ = self.notices[i]
            # Stretches that hold every match of a seed there; close ones are searched together.
            zones: list[list[int]] = []
            for b in sorted(begins):
                lo, hi = max(0, b - edits), b + len(notice) + edits
                if zones and lo <= zones[-1][1]:
                    zones[-1][1] = hi
                else:
                    zones.append([lo, hi])
            # The best match of a zone comes first; what stands before and after it is searched in turn.
            while zones:
                lo, hi = zones.pop()
                m = self.fuzzy[i].search(joined, lo, min(hi, len(joined))) if hi - lo >= len(notice) - edits else None
                if m:
                    zones += [[lo, m.start()], [m.end(), hi]]
                    first, last = bisect_right(offsets, m.start()) - 1, bisect_right(offsets, max(m.start(), m.end() - 1)) - 1
                    held = joined[offsets[first] : offsets[last] + lengths[last]].split(" ")
                    if all(any(within(w, x, e) for x in held) for w, e in self.telling[i]):
                        out.add((label, starts[first], starts[last] + lengths[last], sum(m.fuzzy_counts)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode().translate(_WORDS_ONLY).split()
        joined = b" ".join(words).decode()
        places, notices = self.places(f" {joined} "), self.near(joined, text or "")
        weights = {label: BASE_WEIGHTS[label] for label, _ in places}
        for label, _, _, edits in notices:
            weights[label] = max(weights.get(label, 0.0), self.weights[label] * (1 - 0.05 * edits))
        return {
            "n_words": len(words), "places": [{"label": k, "word": w} for k, w in places],
            "notices": [{"label": k, "start": s, "end": e, "edits": n} for k, s, e, n in notices], "score": 1 - math.prod(1 - w for _, w in sorted(weights.items())),
        }


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, places (base), notices (fuzzy, with spans in code points and edits) and score."""

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for texts in batches:
            yield pa.array([scanner.scan(t) for t in texts.to_pylist()], _RESULT_TYPE)

    small_batches(docs.sparkSession)
    names = ["n_words", "places", "notices", "score"]
    found = docs.drop(*names).withColumn("_found", scan(F.col(text)))
    return found.select("*", *(f"_found.{n}" for n in names)).drop("_found")
