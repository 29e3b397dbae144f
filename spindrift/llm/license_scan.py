"""License scan by diagonal voting.

Word k-grams of every text are joined to the places they have in license templates. A copied template gives
many hits on one diagonal (place in the text less place in the template), so hits are counted by diagonal,
neighbouring diagonals are merged (an inserted or dropped word moves the diagonal by one), and the merged
spans are verified by the share of the template they hold. The base phrases are templates of one gram each.

The templates are an argument, a table kept by hand whose grams are broadcast; while a text is read, grams that no
template has are dropped before they leave the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import map_arrow, staged

K = 3
#: Phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings and notices of common licenses, as published.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
            "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
            "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
            "connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
            "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
            "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
            "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
            "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
            "this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
            "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
            "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
            "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but "
            "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on "
            "any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the "
            "use of this software even if advised of the possibility of such damage"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
               "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
               "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
               "or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version 3 of the license or at your option any later version this program is "
            "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
            "fitness for a particular purpose see the gnu general public license for more details"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                  "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
                  "any means"),
]


def _table(templates: list[tuple[str, str]]) -> list[tuple[int, int, int, str, int, bool, int]]:
    """(gram, its words, template, label, place in the template, whether a base phrase, grams of the template)."""
    rows = []
    for t, (text, label, base) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((text, x, False) for x, text in templates)]):
        (hashes,) = W.of_texts([text], W.NON_ALNUM)
        k = len(hashes) if base else K
        n = len(hashes) - k + 1
        rows += [(W.gram_of(hashes[i : i + k]), k, t, label, i, base, n) for i in range(n)]
    return rows


def scanned(docs: DataFrame, grams: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, text_key, n_words, hits (gram, its words, place)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                found = W.words(part, offsets[i : j + 1], W.NON_ALNUM)
                hits = []
                for k, known in grams.items():
                    values, ok = found.grams(k)
                    near = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
                    at = np.flatnonzero(ok & near)
                    hits.append((values[at].view(np.int64), np.full(len(at), k, np.int32), at))
                values, ks, at = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                values, ks, at = values[order], ks[order], at[order]
                doc = np.searchsorted(found.bounds, at, "right") - 1
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32),
                    pa.StructArray.from_arrays(
                        [pa.array(values), pa.array(ks), pa.array((at - found.bounds[doc]).astype(np.int64))], names=["gram", "k", "at"]
                    ),
                )
                raw, o = part.tobytes(), offsets[i : j + 1] - offsets[i]
                keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(keys, pa.binary()), pa.array(np.diff(found.bounds).astype(np.int64)), lists],
                    names=["doc_id", "text_key", "n_words", "hits"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), of,
        f"doc_id {kind}, text_key binary, n_words bigint, hits array<struct<gram:bigint,k:int,at:bigint>>",
    )


def spans(hits: DataFrame, table: DataFrame, slack: int = 2) -> DataFrame:
    """text_key, template, label, base, first, last, share: merged diagonals with the share of the template's grams they hold.

    A text that holds a template twice has two spans, since the second copy stands on a distant diagonal.
    A window holds the diagonals of one template in one text, which the text's length bounds.
    """
    placed = hits.join(F.broadcast(table), ["gram", "k"]).withColumn("diagonal", F.col("at") - F.col("place"))
    votes = placed.groupBy("text_key", "template", "label", "base", "grams", "k", "diagonal").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places")
    )
    order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > slack), 1).otherwise(0)
    group = F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = votes.withColumn("group", group).groupBy("text_key", "template", "label", "base", "grams", "k", "group").agg(
        F.min("first").alias("first"), (F.max("last") + F.first("k") - 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
    )
    return merged.withColumn("share", F.col("held") / F.col("grams")).drop("group", "held", "k")


def scan(docs: DataFrame, least_share: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs.

    templates: (label, text of K words or more). Null and empty texts have no words and labels. score: 1 with a base
    phrase, else the largest verified share of a template, or 0. Texts count whole, however long. Equal texts are handled
    once, each of their rows has the result; rows may repeat and have any id or none. An empty table gives no rows.
    Other columns of docs are ignored, whatever their names.
    """
    rows = _table(templates)
    table = docs.sparkSession.createDataFrame(rows, "gram long, k int, template int, label string, place int, base boolean, grams int")
    grams = {k: np.unique(np.array([r[0] for r in rows if r[1] == k], np.int64).view(np.uint64)) for k in sorted({r[1] for r in rows})}
    found = staged(scanned(docs, grams), "license-hits")
    hits = found.filter("size(hits) > 0").select("text_key", F.explode("hits").alias("h")).select("text_key", "h.*").distinct()
    verified = spans(hits, table).filter(F.col("base") | (F.col("share") >= least_share))
    base = F.when(F.col("base"), F.col("label"))
    start = F.when(F.col("base"), F.col("first"))
    per_text = verified.groupBy(F.col("text_key").alias("its")).agg(
        F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    per_text = staged(per_text, "license-texts")  # the join below then shuffles both sides anew, and a hot text is split
    return found.join(per_text, F.col("text_key") == F.col("its"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
