"""License scans by an exact set-similarity join, on DataFrame functions alone.

A text's blocks are runs of twice as many words as the longest template has, one starting each so many words, across
lines, so that a notice lies whole in a block however it is wrapped. A block is labelled when it holds at least
THRESHOLD of the distinct words of a template. Words are ordered by how many
blocks hold them, rarest first. A template of m words that needs c of them must
share one of its first m - c + 1 words with the block (prefix filter); a block
needs at least c of the templates' words at all (length filter); and from the
first shared word on, both sides must have c words left (positional filter).
Pairs that pass are counted exactly, so none is missed. Besides, phrases are
found wherever their words stand consecutively, across lines too.

One pass over the texts, without a shuffle, leaves a narrow table of counts and of
blocks cut down to the templates' words; all else works on it. In that pass the prefix filter already runs with a fixed order, the
longest words first. Templates are a parameter, a few rows that are broadcast.

Edge cases: a null text has no words; a block or text without words matches nothing;
long texts are scanned whole; repeated rows are scanned each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

THRESHOLD = 0.8

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and notice: fixed values, the words by which licenses are announced.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("reserved", "copyright all rights reserved"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words(templates, threshold) -> list[tuple[int, str, list[str], int]]:
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))
        out.append((k, label, words, math.ceil(threshold * len(words))))
    return out


def _meets_itself(words: list[str]) -> bool:
    return any(words[:k] == words[-k:] for k in range(1, len(words)))


def _count(where: Column, what: str) -> Column:
    """How often a word sequence stands in a padded text (' w1 w2 '), with every space doubled so that neighbours don't share one."""
    k = what.split(" ")
    if _meets_itself(k):  # places may overlap
        words = F.split(F.trim(where), " ")
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.slice(words, i, len(k)) == F.array(*map(F.lit, k)))
        return F.size(at).cast("long")
    double, p = F.replace(where, F.lit(" "), F.lit("  ")), " " + what.replace(" ", "  ") + " "
    return ((F.length(double) - F.length(F.replace(double, F.lit(p), F.lit("")))) / len(p)).cast("long")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _longest(templates) -> int:
    return max(len("".join(c if c.isalnum() else " " for c in text).split()) for _, text in templates)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row; score is the largest
    contained share of a template that reaches the threshold, 1 where a phrase stands, else 0."""
    phrases = phrases or PHRASES
    known = _template_words(templates or TEMPLATES, threshold)
    vocabulary = sorted({w for _, _, words, _ in known for w in words})
    least = min(c for *_, c in known)
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("low"))
    rows = rows.withColumn("flat", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", GAP, " ")), F.lit(" ")))
    flat = F.col("flat")
    vocab = F.array(*map(F.lit, vocabulary))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in phrases.items():
        p = f" {phrase} "
        has = F.contains(flat, F.lit(p))
        back = F.locate(p[::-1], F.reverse(flat))
        counts.append(F.when(has, _count(flat, phrase)).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, _spaces(F.substring(flat, F.lit(1), F.locate(p, flat))) - 1))
        lasts.append(F.when(has, _spaces(F.substring(flat, F.lit(1), F.length(flat) - back - len(p) + 2)) - 1))
        labels.append(F.when(has, F.lit(label)))
    n_base = sum(counts[1:], counts[0])
    step = _longest(templates or TEMPLATES)
    anchors = sorted({w for _, _, words, c in known for w in sorted(words, key=lambda w: (-len(w), w))[: len(words) - c + 1]})
    words = F.split(F.trim(flat), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step))
    runs = F.filter(F.transform(starts, lambda i: F.slice(words, i, 2 * step)), lambda v: F.arrays_overlap(v, F.array(*map(F.lit, anchors))))
    blocks = F.filter(F.transform(runs, lambda v: F.array_intersect(v, vocab)), lambda v: F.size(v) >= least)
    blocks = F.when(F.rlike(flat, F.lit(f" ({'|'.join(anchors)}) ")), blocks)
    staged = rows.select(
        "rid", "doc_id", F.when(flat == "  ", F.lit(0).cast("long")).otherwise(_spaces(flat) - 1).alias("n_words"), n_base.alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), blocks.alias("blocks"),
    )
    staged = written(staged, "license_blocks")
    block = staged.where(F.size("blocks") > 0).select("rid", F.posexplode("blocks").alias("block", "words"))

    # the global order: how many blocks hold each word, rarest first
    spark = docs.sparkSession
    freq = {r.w: r.n for r in block.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # the templates' words only
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (freq.get(w, 0), w)))}
    prefixes = []
    for k, label, words, c in known:
        ranked = sorted(words, key=order.__getitem__)
        prefixes += [(w, k, label, words, len(words), c, i) for i, w in enumerate(ranked[: len(words) - c + 1])]
    prefix = spark.createDataFrame(prefixes, "w string, template int, label string, own array<string>, m int, need int, i int")
    rank = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    ranked = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("r"), w.alias("w")))), lambda x: x["w"])
    tokens = block.select("rid", "block", ranked.alias("words")).select("rid", "block", "words", F.posexplode("words").alias("j", "w"))
    pairs = tokens.join(F.broadcast(prefix), "w").where("size(words) - j >= need and m - i >= need")
    sure = pairs.withColumn("share", F.size(F.array_intersect("words", "own")) / F.col("m")).where("size(array_intersect(words, own)) >= need")
    by_doc = sure.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    out = staged.drop("blocks").join(by_doc, "rid", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(templates=None, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, by brute force over all blocks and templates."""
    known, step = _template_words(templates or TEMPLATES, threshold), _longest(templates or TEMPLATES)
    rows = ", ".join(f"('{label}', {words!r}, {len(words)}, {c})" for _, label, words, c in known)
    ph = ", ".join(f"({p.split()!r}, {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    words = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with phrases(p, k, label) as (values {ph}), templates(label, own, m, need) as (values {rows}),
docs as (select doc_id, {words.format("coalesce(text, '')")} as w from documents),
spots as (select doc_id, w, unnest(range(len(w))) as i from docs),
hits as (select doc_id, i, label from spots, phrases where w[i + 1] = p[1] and w[i + 1 : i + k] = p),
base as (select doc_id, count(*) as n, min(i) as a, max(i) as b, list(distinct label) as labels from hits group by doc_id),
starts as (select doc_id, w, unnest(range(0, len(w), {step})) as s from docs),
blocks as (select doc_id, list_distinct(w[s + 1 : s + {2 * step}]) as w from starts),
found as (select doc_id, list(distinct label) as labels, max(n / m) as share from (select doc_id, label, m, need, len(list_intersect(w, own)) as n from blocks, templates where len(w) >= need) where n >= need group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n, 0) as n_base, b.a as first_word, b.b as last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
       case when b.n > 0 then 1.0::double else coalesce(f.share, 0.0)::double end as score
from docs d left join base b using (doc_id) left join found f using (doc_id)
"""
