"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, a set of words; for a template that no line of the text contains, blocks that span lines
count too. These are the paragraphs of several lines, runs of lines between blank ones: what the join finds in a whole
paragraph is counted in windows of twice the template's words that start every template's length, so a notice wrapped
over lines stands in one of them and words that are far apart do not add up. A template is contained in a block if the block holds at least the share
``threshold`` of the template's words. Template words are ordered by their frequency over all blocks, rarest first.
A template with n words, of which k must be met, has a prefix of n - k + 1 words, one of which every matching block
holds; so blocks are joined to templates on prefix words only. Blocks with fewer than k template words fall to the
length filter, and a hit at place p of the template and q of the block to the positional filter, if even all later
words of both could not reach k. What is left is counted exactly.

All of it is DataFrame expressions. What is broadcast are template words, as many as the caller gives; frequencies are
aggregated to one row a template word. Blocks are reduced to the template words they hold before they are exploded.
"""

import re

from pyspark.sql import functions as F

from .shared import numbered, stored

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAPS = re.compile(f"{GAP}+")
#: Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices with labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def scan(docs, id="doc_id", text="text", templates=None, threshold=0.8):
    """One row for each row of ``docs``: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Words are runs of letters and digits, where everything beyond ASCII is a letter; ASCII letters match in any case.
    ``n_base`` counts the places of ``PHRASES``, ``first_word`` and ``last_word`` are the smallest and largest word at
    which one starts, null without any. ``labels`` adds those of the templates that a line, or else a paragraph's
    window, contains, ``score`` is the largest containment that meets the threshold, 1 with a phrase, else 0. A null or empty text has no words, empty
    labels and score 0. Repeated rows give repeated results.
    """
    keyed = numbered(docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "row")
    found = matches(keyed, templates or TEMPLATES, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = keyed.select("row", "id", *_phrases(F.col("text"))).join(found, "row", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return base.select(F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _phrases(text):
    # most texts hold no phrase: a pattern without boundaries tells so at a fraction of the cost
    likely = "(?i)(?:" + "|".join(f"{GAP}+".join(phrase.split()) for phrase in PHRASES) + ")"
    one = {label: f"(?<!{LETTER})" + f"{GAP}+".join(f"(?i:{w})" for w in phrase.split()) + f"(?!{LETTER})" for phrase, label in PHRASES.items()}
    either = "|".join(one.values())
    words = lambda t: F.size(F.array_remove(F.split(t, f"{GAP}+"), "")).cast("long")
    n = F.when(text.rlike(likely), F.regexp_count(text, F.lit(either))).otherwise(0).cast("long")
    before_first = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(either)) - 1)
    before_last = F.regexp_extract(text, f"(?s)^(.*)(?:{either})", 1)
    labels = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in one.items())))
    return [
        words(text).alias("n_words"),
        n.alias("n_base"),
        F.when(n > 0, words(before_first)).alias("first_word"),
        F.when(n > 0, words(before_last)).alias("last_word"),
        F.when(n > 0, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    ]


def matches(keyed, templates, threshold):
    """(``row``, ``label``, ``share``) of the templates that a line of ``text``, or else a window over lines, contains."""
    spark = keyed.sparkSession
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), f"{GAP}+"), lambda w: w != ""))
    given = spark.createDataFrame(list(templates.items()), "label string, notice string").select("label", words(F.col("notice")).alias("words"))
    vocabulary = sorted({w for r in given.collect() for w in r.words})
    needs = {r.label: -(-len(r.words) * round(threshold * 1000) // 1000) for r in given.collect()}
    wide = F.filter(F.split("text", r"\n[ \t\r\x0B\f]*\n"), lambda p: F.trim(p, F.lit("\n")).contains("\n"))
    blocks = keyed.select("row", F.posexplode(F.concat(F.split("text", "\n"), wide)).alias("block", "part"))
    held = blocks.select("row", "block", "part", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.lower("part"), f"{GAP}+")).alias("held"))
    held = held.filter(F.size("held") >= max(1, min(needs.values()))).withColumn("part", F.when(F.col("part").contains("\n"), F.col("part")))  # null: a line
    held = stored(held)  # read for the counts and for the probes

    counts = held.select(F.explode("held").alias("word")).groupBy("word").count()
    frequent = {r["word"]: r["count"] for r in counts.collect()}  # one row for each template word at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequent.get(w, 0), w)))}
    index = []
    for r in given.collect():
        ranks = sorted(order[w] for w in r.words)
        need = needs[r.label]
        index += [(rank, r.label, r.words, len(GAPS.sub(" ", templates[r.label]).split()), ranks, need, place) for place, rank in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(index, "rank int, label string, words array<string>, length int, ranks array<int>, need int, place int")

    ranked = F.array_sort(F.transform("held", lambda w: F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), w)))
    probes = held.select("row", "block", "part", ranked.alias("has")).select("row", "block", "part", "has", F.posexplode("has").alias("at", "rank"))
    met = probes.join(F.broadcast(prefixes), "rank")
    size, n = F.size("has"), F.size("ranks")
    possible = (size >= F.col("need")) & (F.least(n - F.col("place"), size - F.col("at")) + F.least("place", "at") >= F.col("need"))
    both = F.size(F.array_intersect("has", "ranks"))
    found = met.filter(possible).filter(both >= F.col("need")).withColumn("both", both)
    # a template is met by a paragraph at several prefix words, one is enough
    over = found.filter(F.col("part").isNotNull()).dropDuplicates(["row", "block", "label"])
    # words that are only read are not split again for each window
    over = stored(over.select("row", "label", "length", "words", "ranks", "need", F.array_remove(F.split(F.lower("part"), f"{GAP}+"), "").alias("all")))
    window = lambda i: F.size(F.array_intersect(F.slice("all", i, 2 * F.col("length")), F.col("words")))
    over = over.withColumn("both", F.array_max(F.transform(F.sequence(F.lit(1), F.size("all"), F.col("length")), window))).filter(F.col("both") >= F.col("need"))
    shares = [df.select("row", "label", (F.col("both") / n).alias("share"), F.lit(spans).alias("spans")) for df, spans in ((found.filter(F.col("part").isNull()), False), (over, True))]
    share = lambda spans: F.max(F.when(F.col("spans") == spans, F.col("share")))
    return shares[0].unionAll(shares[1]).groupBy("row", "label").agg(F.coalesce(share(False), share(True)).alias("share"))
