"""License scans as an exact set-similarity join (DataFrame functions only).

Templates are notices and whole texts of public licenses. A text block is a window of words that begins every half window;
a template's windows are ``BLOCK_WORDS`` words long, or as many times twice that as it takes for the template to lie whole
in some block. A block meets a template when it holds at least the share ``CONTAINMENT`` of the template's distinct words.
All such pairs are found:

* tokens are put in one global order, from the rarest to the most frequent, by how many documents hold them;
* prefix filter: a block that meets a template of n tokens, needing m of them, holds one of the template's n - m + 1
  rarest, so only these are looked up, in an inverted index over templates (bounded by the templates, broadcast);
* length filter: a block with fewer than m template words at all can't meet it;
* positional filter: at the first token both share, what is left on either side bounds the overlap.

Pairs that pass are verified by counting. Templates of different licenses may have most words in common; such rivals are
told apart by the words that only one of them has: a template also needs the share ``CONTAINMENT`` of its own words against each
rival, and where a block meets two rivals, the one with the greater share of its own words takes it (both do when these are equal).

Words that occur in no template take no part, and documents without any prefix token are passed by after one look-up of
their words; phrases are counted on the same normalised text.

Cases: null counts as empty; a text without words has no phrases, no labels and score 0; repeated rows give a row
each; labels are distinct and sorted; extra columns are ignored; texts and templates may be of any length; a template
without a word is refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, text_of, with_row_key

#: What parts words, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices and texts of public licenses, in normalised words, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
        "apache",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation",
        "lgpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but "
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more "
        "details",
        "lgpl",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation",
        "agpl",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but "
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more "
        "details",
        "agpl",
    ),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction",
        "mit",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but "
        "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be "
        "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
        "use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
        "isc",
    ),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software "
        "is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
        "any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "http mozilla org mpl 2 0",
        "mpl",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
        "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use "
        "this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)
CONTAINMENT = 0.8
BLOCK_WORDS = 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cased (A-Z) words, each with a space before and after it; without words the empty string."""
    words = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), GAP, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _phrase(words: str) -> str:
    return " " + "  ".join(words.split()) + " "


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(norm: Column, phrases=PHRASES) -> dict[str, Column]:
    """Word count, places of all phrases, first and last word of any, and the distinct sorted labels."""
    count, first, last, labels = [], [], [], []
    for words, label in phrases:
        phrase = _phrase(words)
        p = F.lit(phrase)
        n = ((F.octet_length(norm) - F.octet_length(F.replace(norm, p, F.lit("")))) / len(phrase)).cast("long")
        count.append(n)
        has = norm.contains(p)
        # Two spaces stand for each word before the place.
        first.append(F.when(has, (_spaces(F.substring_index(norm, phrase, 1)) / 2).cast("long")))
        total = (_spaces(norm) / 2).cast("long")
        last.append(F.when(has, total - (_spaces(F.substring_index(norm, phrase, -1)) / 2).cast("long") - len(words.split())))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_words": (_spaces(norm) / 2).cast("long"),
        "n_base": sum(count[1:], count[0]),
        "first_word": F.least(*first),
        "last_word": F.greatest(*last),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def token_order(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> list[str]:
    """The templates' words, from the rarest in the corpus to the most frequent (by documents that hold them; ties by word).

    One pass over all documents; what reaches the driver is one count a template word.
    """
    vocabulary = sorted({w for words, _ in templates for w in words.split()})
    words = F.split(normalised(text_of(text_col)), " +")
    held = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), words)).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def need_of(size: int, containment: float = CONTAINMENT) -> int:
    """How many of a template's tokens a block has to hold."""
    return max(1, math.ceil(containment * size - 1e-9))


def half_window(words: str, block_words: int = BLOCK_WORDS) -> int:
    """Half the length of a template's blocks: half of ``block_words``, doubled until the template fits in it."""
    if not words.split():
        raise ValueError("a template without a word")
    half = max(1, block_words // 2)
    while half < len(words.split()):
        half *= 2
    return half


def rivals_of(templates=TEMPLATES, containment: float = CONTAINMENT) -> dict[tuple[int, int], list[str]]:
    """For templates (t, r) of different labels, of which the smaller meets the other's words: the words that only t has."""
    sets = [set(words.split()) for words, _ in templates]
    found = {}
    for t, (_, label) in enumerate(templates):
        for r, (_, other) in enumerate(templates):
            if label != other and len(sets[t] & sets[r]) >= need_of(min(len(sets[t]), len(sets[r])), containment):
                found[t, r] = sorted(sets[t] - sets[r])
    return found


def _index(templates, rank: dict[str, int], containment: float, block_words: int) -> list[tuple]:
    """A row for each template and prefix token: token, half window, template, label, tokens, need, rivals (template, own tokens)."""
    rivals, halves = rivals_of(templates, containment), [half_window(words, block_words) for words, _ in templates]
    rows = []
    for t, (words, label) in enumerate(templates):
        tokens = sorted({rank[w] for w in words.split()})
        need = need_of(len(tokens), containment)
        against = [(r, sorted(rank[w] for w in own), need_of(len(own), containment) if own else 0) for (x, r), own in rivals.items() if x == t]
        rows += [(token, halves[t], t, label, tokens, need, against) for token in tokens[: len(tokens) - need + 1]]
    return rows


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the largest containment of a template that some block meets, 1 where a phrase stands, else 0.
    ``docs`` is read twice.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates, text_col)
    rank = {w: i for i, w in enumerate(order)}
    index = _index(templates, rank, containment, block_words)
    prefix = sorted({order[row[0]] for row in index})
    schema = "token int, half int, template int, label string, tokens array<int>, need int, rivals array<struct<template:int, own:array<int>, need:int>>"
    inverted = spark.createDataFrame(index, schema)  # bounded by the templates

    norm = F.col("__norm")
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text"))).select(ROW, "doc_id", normalised(F.col("__text")).alias("__norm"))
    base = rows.select(ROW, "doc_id", "__norm", *[c.alias(n) for n, c in phrase_columns(norm, phrases).items()])
    words = F.split(F.trim(norm), " +")
    # Template words of a document that holds a prefix token, as (position, rank).
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    held = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: p["word"].isin(order))
    places = F.transform(held, lambda p: F.struct(p["at"].alias("at"), F.try_element_at(ranks, p["word"]).alias("rank")))
    none = F.array().cast("array<struct<at:int,rank:int>>")
    flat = base.withColumn("__places", F.when(F.arrays_overlap(words, F.lit(prefix)), places).otherwise(none)).drop("__norm")
    info = F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    spread = flat.select(ROW, info.alias("info"), F.explode_outer("__places").alias("p"))
    # Each place lies, for each length of blocks in which its word counts, in the block begun at its own half window and in the one before.
    halves = [sorted({half_window(words, block_words) for words, _ in templates if w in words.split()}) for w in order]
    lengths = F.element_at(F.lit([",".join(map(str, h)) for h in halves]), F.col("p.rank") + 1)
    lengths = F.transform(F.split(lengths, ","), lambda h: h.cast("int"))
    blocks = F.flatten(F.transform(lengths, lambda h: F.filter(F.transform(F.array(F.lit(0), F.lit(1)), lambda d: F.struct(h.alias("half"), (F.floor(F.col("p.at") / h).cast("int") - d).alias("block"))), lambda b: b["block"] >= 0)))
    spread = spread.select(ROW, "info", F.col("p.rank").alias("rank"), F.explode_outer(F.when(F.col("p").isNotNull(), blocks)).alias("b"))
    # The blocks' token sets: bounded by the templates' vocabulary. Documents without a place go along as one row.
    sets = spread.groupBy(ROW, F.col("b.half").alias("half"), F.col("b.block").alias("block")).agg(F.array_sort(F.collect_set("rank")).alias("held"), F.first("info").alias("info"))
    probe = sets.select(ROW, "half", "block", "info", "held", F.explode_outer("held").alias("token"))
    joined = probe.join(F.broadcast(inverted), ["token", "half"], "left")
    shared = F.array_intersect("held", "tokens")
    is_first = F.try_element_at(shared, F.lit(1)) == F.col("token")
    left_in_template = F.size("tokens") - F.array_position("tokens", F.col("token"))
    left_in_block = F.size("held") - F.array_position("held", F.col("token"))
    passes = (F.size("held") >= F.col("need")) & is_first & (1 + F.least(left_in_template, left_in_block) >= F.col("need"))
    own = F.forall("rivals", lambda r: F.size(F.array_intersect("held", r["own"])) >= r["need"])
    met = F.coalesce(F.col("template").isNotNull() & passes & (F.size(shared) >= F.col("need")) & own, F.lit(False))
    # The share of its own words that a block holds of a template, against each rival.
    against = F.transform("rivals", lambda r: F.struct(r["template"].alias("template"), F.when(F.size(r["own"]) == 0, 0.0).otherwise(F.size(F.array_intersect("held", r["own"])) / F.size(r["own"])).alias("share")))
    verified = F.when(met, F.struct("template", "label", (F.size(shared) / F.size("tokens")).alias("share"), against.alias("against")))
    # Partitioned by these keys already; a block meets a bounded number of templates.
    blocks_met = joined.select(ROW, "half", "block", "info", verified.alias("met")).groupBy(ROW, "half", "block").agg(F.first("info").alias("info"), F.collect_list("met").alias("met"))
    share_against = lambda t, r: F.get(F.filter(t["against"], lambda x: x["template"] == r["template"]), F.lit(0))["share"]
    beaten = lambda t: F.exists("met", lambda r: F.coalesce(share_against(r, t) > share_against(t, r), F.lit(False)))
    kept = blocks_met.select(ROW, "info", F.filter("met", lambda t: ~beaten(t)).alias("met"))
    labels = F.array_distinct(F.flatten(F.collect_list(F.transform("met", lambda t: t["label"]))))
    out = kept.groupBy(ROW).agg(F.first("info").alias("info"), labels.alias("found"), F.max(F.array_max(F.transform("met", lambda t: t["share"]))).alias("share"))
    return out.select(
        "info.doc_id", "info.n_words", "info.n_base", "info.first_word", "info.last_word", F.array_join("info.base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("info.base_labels", "found")), ",").alias("labels"),
        F.when(F.col("info.n_base") > 0, 1.0).otherwise(F.coalesce(F.col("share"), F.lit(0.0))).cast("double").alias("score"),
    )
