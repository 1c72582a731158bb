"""Licence notices: a positional index of licence words, entered at each text's rarest ones (operator 13)."""

from __future__ import annotations

import bisect
import collections
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read_table

#: Phrases of the contract, each with its label; every place of one counts.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Wording of public licences' own notices (label, text, the phrases that must stand in it word by word).
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy", "with or without fee")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License", ("gnu general public license",)),
    ("lgpl", "Licensed under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "Licensed under the terms of the GNU Affero General Public License", ("affero general public license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("reserved", "Copyright. All rights reserved", ("all rights reserved",)),
)
#: A text's rarest words of a template that are looked up; how far words may have moved against each other; the share of a
#: template's words, weighed by rarity, that must be in place.
LOOKED_UP, SLACK, SHARE = 4, 8, 0.6

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_in(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class LicenceIndex:
    """Postings (word -> template -> places in it) with each word's weight, 1 + log((documents + 1) / (documents with it + 1))."""

    def __init__(self, templates, phrases, counts: dict[bytes, int], documents: int):
        self.templates = [(label, words_in(text), [words_in(k) for k in keys]) for label, text, keys in templates]
        self.phrases = [(label, words_in(text)) for label, text in phrases]
        self.postings = collections.defaultdict(lambda: collections.defaultdict(list))
        for t, (_, text, _) in enumerate(self.templates):
            for place, word in enumerate(text):
                self.postings[word][t].append(place)
        self.known = frozenset(self.postings).union(*(p for _, p in self.phrases))
        self.weight = {w: 1 + math.log((documents + 1) / (counts.get(w, 0) + 1)) for w in self.known}
        self.needed = [frozenset(w for k in keys for w in k) for _, _, keys in self.templates]

    def starts(self, phrase: list[bytes], places: dict) -> list[int]:
        """Where the phrase's words stand consecutively: the places of its rarest word, intersected with the others' by relative position."""
        out = None
        for j in sorted(range(len(phrase)), key=lambda j: (-self.weight[phrase[j]], j)):
            at = {i - j for i in places.get(phrase[j], ())}
            out = at if out is None else out & at
            if not out:
                return []
        return sorted(out or ())

    def base(self, places: dict) -> list[tuple[str, int]]:
        return sorted((start, label) for label, phrase in self.phrases for start in self.starts(phrase, places))

    def notices(self, words: list[bytes], places: dict) -> list[tuple[int, int, str, float]]:
        """(start, end, label, share) of the templates' occurrences, the best of those of a label that overlap."""
        votes = [collections.Counter() for _ in self.templates]
        looked_up = collections.Counter()
        # the text's licence words, rarest first: each enters the postings of the templates that it stands in
        for word in sorted(places, key=lambda w: (-self.weight[w], w)):
            for t, at in self.postings.get(word, {}).items():
                if self.needed[t] <= places.keys() and looked_up[t] < LOOKED_UP:
                    looked_up[t] += 1
                    votes[t].update(i - place for place in at for i in places[word])
        found = []
        for t, (label, text, keys) in enumerate(self.templates):
            if not votes[t]:
                continue
            least = min(2, looked_up[t])
            offsets = sorted(o for o, n in votes[t].items() if n >= least)
            stand = [[s - self._place(text, k) for s in self.starts(k, places)] for k in keys]
            total = sum(self.weight[w] for w in text)
            for o in offsets:
                if not all(self._near(s, o) for s in stand):
                    continue
                near = offsets[bisect.bisect_left(offsets, o - SLACK):bisect.bisect_right(offsets, o + SLACK)]
                at = [next((x + j for x in sorted(near, key=lambda x: abs(x - o)) if 0 <= x + j < len(words) and words[x + j] == w), None) for j, w in enumerate(text)]
                share = sum(self.weight[w] for w, a in zip(text, at) if a is not None) / total
                if share >= SHARE:
                    there = [a for a in at if a is not None]
                    found.append((min(there), max(there) + 1, label, share))
        out, taken = [], collections.defaultdict(set)
        for x in sorted(found, key=lambda x: (-x[3], x)):
            if taken[x[2]].isdisjoint(range(x[0], x[1])):
                taken[x[2]].update(range(x[0], x[1]))
                out.append(x)
        return sorted(out)

    @staticmethod
    def _place(text: list[bytes], key: list[bytes]) -> int:
        return next(j for j in range(len(text)) if text[j:j + len(key)] == key)

    @staticmethod
    def _near(places: list[int], o: int) -> bool:
        i = bisect.bisect_left(places, o - SLACK)
        return i < len(places) and places[i] <= o + SLACK


def document_counts(docs: DataFrame, words: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each of the (few) words stands, and how many documents there are. Every whole text is read; a task hands on a row per word."""
    def count(batches):
        import pyarrow as pa

        n, met = 0, collections.Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                met.update(words.intersection(words_in(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*met, None], pa.binary()), pa.array([*met.values(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word) if r.word is not None else None: r.n for r in rows}
    return counts, counts.pop(None, 0)


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words long, base array<(start, label)>, notices array<(start, end, label, share)>), one row per row of ``docs``; places are words from 0.

    base: each place where the words of one of the ``phrases`` stand consecutively. notices: the ``templates`` found. A text's licence words are
    taken by rarity over all documents; the rarest few of each template vote for the template's offset in the text, offsets of
    at least two votes are kept if each mandatory phrase stands word by word within SLACK of its place, and share is the part of the
    template, weighed by rarity, that stands within SLACK of the offset (SHARE at least). Of one label's overlapping notices the best
    is kept, at equal shares the first. Texts are read twice, whole, and nothing is shuffled but the counts of the licences' own words.
    Null and empty texts have no words. Ids may be null or repeat: each row gets its result. Other columns are ignored.
    """
    plain = LicenceIndex(templates, phrases, {}, 0)
    index = LicenceIndex(templates, phrases, *document_counts(docs, plain.known))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_type, notice_type = "array<struct<start: bigint, label: string>>", "array<struct<start: bigint, end: bigint, label: string, share: double>>"

    def scan(batches):
        import pyarrow as pa

        base_of = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        notice_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            sizes, base, notices = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_in(text)
                met = index.known.intersection(words)
                places = {w: [] for w in met}
                if any(need <= met for need in index.needed) or any(met.issuperset(p) for _, p in index.phrases):
                    for i, w in enumerate(words):
                        if w in met:
                            places[w].append(i)
                    base.append([{"start": s, "label": label} for s, label in index.base(places)])
                    notices.append([{"start": a, "end": b, "label": label, "share": share} for a, b, label, share in index.notices(words, places)])
                else:
                    base.append([])
                    notices.append([])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(base, base_of), pa.array(notices, notice_of)], names=["doc_id", "n_words", "base", "notices"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, base {base_type}, notices {notice_type}")


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(read_table(spark, sf_dir, "documents"))
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in columns]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    share = F.array_max(F.transform("notices", lambda x: x["share"]))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels("base").alias("base_labels"), labels("base", "notices").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0))).alias("score"))
