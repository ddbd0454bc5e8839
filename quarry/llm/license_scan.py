"""License scans by template-markup matching.

A template is license wording with marked regions: ``<<opt>> ... <</opt>>`` may be
absent, ``<<var:N>>`` stands for up to N words of any kind. A template is compiled
once into a token automaton: states are places in the wording, a mandatory word is
a labelled edge, an optional region adds an edge that skips it, and a replaceable
region adds up to N edges that take any word. A text is accepted where a run of its
words leads from the first state to the last, so all mandatory wording matches
exactly. The automaton is started only where the template's first mandatory words
stand, and its state set is at most the template's length.

The base labels come from fixed phrases and are kept whatever the templates say.

Per document work only: nothing is shuffled. Defined cases: a null text is empty;
equal rows give equal rows; long texts are scanned whole, in time linear in their
words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import prepare, text_buffer

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of common grants, in our markup.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files <<opt>> the software <</opt>> to deal in the software without restriction",
    "isc": "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or "
           "without fee is hereby granted",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
           "that the following conditions are met",
    "apache-2": "licensed under the apache license version 2 <<opt>> 0 <</opt>>",
    "gpl": "<<opt>> either <</opt>> under the terms of the gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general "
           "public license as published by the free software foundation",
    "mpl-2": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "creative commons attribution noncommercial",
    "cc-by": "licensed under a creative commons attribution <<var:2>> license",
    "mit-named": "<<opt>> released <</opt>> <<opt>> licensed <</opt>> under the mit license",
    "all-rights": "copyright <<opt>> c <</opt>> <<var:6>> all rights reserved",
}
LABEL_OF = {"mit-named": "mit"}

_KEEP = bytes(b if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                     ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                     ("labels", pa.string()), ("score", pa.float64())])


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all non-ASCII bytes."""
    return text.lower().translate(_KEEP).split()


class Automaton:
    """A template as states 0..n; state k has one edge: a word, a skip or any word."""

    def __init__(self, template: str):
        self.word: list[bytes | None] = []
        self.skip: dict[int, int] = {}
        opened: list[int] = []
        for token in re.findall(r"<<[^>]*>>|\S+", template):
            if token == "<<opt>>":
                opened.append(len(self.word))
            elif token == "<</opt>>":
                self.skip[opened.pop()] = len(self.word)
            elif var := re.fullmatch(r"<<var:(\d+)>>", token):
                end = len(self.word) + int(var[1])
                self.skip.update({k: end for k in range(len(self.word), end)})
                self.word += [None] * int(var[1])
            else:
                self.word.append(token.encode())
        self.end = len(self.word)
        mandatory = [w for k, w in enumerate(self.word)
                     if w is not None and not any(a <= k < b for a, b in self.skip.items())]
        self.needs = frozenset(mandatory)
        self.starts = frozenset(self.word[s] for s in self._closed({0}) if s < self.end)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            to = self.skip.get(todo.pop())
            if to is not None and to not in states:
                states.add(to)
                todo.append(to)
        return states

    def run(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run from ``at``, or -1."""
        states, best = self._closed({0}), -1
        while True:
            if self.end in states:
                best = at
            if at >= len(words):
                return best
            states = self._closed({s + 1 for s in states if s < self.end and self.word[s] in (None, words[at])})
            if not states:
                return best
            at += 1


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in ' w w w '."""
    out, at, seen, count = [], joined.find(phrase), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = joined.find(phrase, at + 1)
    return out


def _scan(phrases: dict[str, str], templates: dict[str, str], label_of: dict[str, str]):
    def run(batches):
        base = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]
        automata = [(label_of.get(k, k), Automaton(t)) for k, t in templates.items()]
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            raw, out = buf.tobytes(), []
            for k, id_ in enumerate(batch.column("doc_id").to_pylist()):
                words = words_of(raw[off[k]:off[k + 1]])
                joined = b" " + b" ".join(words) + b" "
                places, labels, more = [], set(), set()
                hit = set()
                for phrase, n, label in base:
                    if phrase in joined:
                        at = _places(joined, phrase)
                        places += at
                        labels.add(label)
                        hit.update(p + i for p in at for i in range(n))
                have = None
                for label, auto in automata:
                    if have is None:
                        have = set(words)
                    if not auto.needs <= have:
                        continue
                    done = 0
                    for p, w in enumerate(words):
                        if p >= done and (w in auto.starts or None in auto.starts):
                            end = auto.run(words, p)
                            if end > p:
                                more.add(label)
                                hit.update(range(p, end))
                                done = end
                out.append((id_, len(words), len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(labels)), ",".join(sorted(labels | more)),
                            len(hit) / len(words) if words else 0.0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _SCHEMA)],
                                                 schema=_SCHEMA)

    return run


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                 label_of: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (share
    of the words that matched wording covers)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        _scan(phrases or PHRASES, templates or TEMPLATES, label_of or LABEL_OF),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double")
