"""License scans with a positional index of rare words.

Templates are word sequences of licence notices with a mandatory phrase. If a text has all words of the phrase, their places in the
text, shifted by their places in the template, are intersected, the rarest word first (by document frequency over the whole corpus).
What is left are the places where the template begins with its phrase standing word for word; their score is the share of the
template's words that stand where they should. No word is left out, so none is missed. The base phrases are templates that are
mandatory as a whole.

Only counts per licence word reach the driver: a list as long as the templates' vocabulary.

Cases: a null text is empty and has no words, places or labels and score 0; words of equal frequency are looked up in their own order,
which changes no result; repeated rows are scanned each; texts of any length are scanned whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import sub_batches

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BATCH_BYTES = 4 << 20
#: phrase -> label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening words of public licence notices with their mandatory phrase and label.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license", "agpl"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "free of charge to any person or organization obtaining a copy of the software", "bsl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "under the terms of the eclipse public license", "epl"),
    ("to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "all copyright and related and neighboring rights to this software to the public domain", "cc0"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "verbatim or modified copies of this license document", "wtfpl"),
)
#: Least share of a template's words in place.
LEAST = 0.6


class Index:
    """Postings of the mandatory phrases, each with its rarest words first."""

    def __init__(self, frequency: dict[bytes, int], documents: int):
        self.templates = [(p.encode().split(), 0, len(p.split()), label, True) for p, label in BASE.items()]
        for text, phrase, label in TEMPLATES:
            words, key = text.encode().split(), phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.templates.append((words, at, len(key), label, False))
        self.weight = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in vocabulary()}
        self.postings = []
        for words, at, size, _, _ in self.templates:
            self.postings.append(sorted(((words[k], k) for k in range(at, at + size)), key=lambda x: (-self.weight[x[0]], *x)))
        self.phrases = [{w for w, _ in posting} for posting in self.postings]
        self.looked_up = set().union(*self.phrases)

    def starts(self, number: int, found: dict[bytes, list[int]]) -> set[int]:
        """Where a template begins: the places of its phrase's words, intersected by relative position."""
        (word, place), *rest = self.postings[number]
        left = {i - place for i in found[word]}
        for word, place in rest:
            if not left:
                break
            left &= {i - place for i in found[word]}
        return left

    def scan(self, words: list[bytes]):
        """(places, first, last, base labels, labels, score) of one text's words."""
        places, base, labels, best = [], set(), set(), 0.0
        present = self.looked_up.intersection(words)
        live = [number for number, phrase in enumerate(self.phrases) if phrase <= present]
        wanted = set().union(*(self.phrases[number] for number in live))
        found: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words if live else ()):
            if w in wanted:
                found[w].append(i)
        for number in live:
            template, _, _, label, whole = self.templates[number]
            for start in self.starts(number, found):
                if whole:
                    places.append(start)
                    base.add(label)
                    best = 1.0
                    continue
                there = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template)) / len(template)
                if there >= LEAST:
                    labels.add(label)
                    best = max(best, there)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), best


def vocabulary() -> list[bytes]:
    return sorted({w for text in (*BASE, *(t for t, _, _ in TEMPLATES)) for w in text.encode().split()})


def words_of(value) -> list[bytes]:
    return WORDS.findall((value.as_py() or "").encode().lower())


def word_frequency(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many rows each licence word stands, and the number of rows."""

    def count(batches):
        vocab, found, rows = set(vocabulary()), defaultdict(int), 0
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                for text in batch.column("text"):
                    rows += 1
                    for w in vocab.intersection(words_of(text)):
                        found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in found), ""]), pa.array([*found.values(), rows], pa.int64())], names=["word", "n"])

    sums = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in sums}
    return {w.encode(): n for w, n in found.items() if w}, found.get("", 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequency, documents = word_frequency(docs)

    def run(batches):
        index = Index(frequency, documents)
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                rows = [(len(w := words_of(text)), *index.scan(w)) for text in batch.column("text")]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for op8_license_scan: every place where a phrase stands, and the share of its template around it."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    rows = [f"({listed(p)}, {listed(p)}, 0, '{label}', true)" for p, label in BASE.items()]
    for text, phrase, label in TEMPLATES:
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append(f"({listed(text)}, {listed(phrase)}, {at}, '{label}', false)")
    return f"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
templates(words, phrase, before, label, base) as (values {", ".join(rows)}),
places as (
  select doc_id, ws, i, t.* from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w) p join templates t on ws[i] = phrase[1] where ws[i:i + len(phrase) - 1] = phrase),
found as (
  select *, list_sum(list_transform(range(1, len(words) + 1), lambda k: (i - before + k - 1 between 1 and len(ws) and coalesce(ws[greatest(i - before + k - 1, 1)] = words[k], false))::int)) / len(words) there
  from places),
good as (select * from found where base or there >= {LEAST}),
summed as (
  select doc_id, count(*) filter (base) n_base, min(i - 1) filter (base) first_word, max(i - 1) filter (base) last_word, coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels,
    string_agg(distinct label, ',' order by label) labels, max(there) score
  from good group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels,
  coalesce(labels, '') labels, coalesce(score, 0)::double score
from w left join summed using (doc_id)"""
