"""License scan by diagonal voting, in DataFrame operations only.

Every word bigram of every text is joined by its hash to the bigrams of the templates. A hit votes for its diagonal (place
in the text minus place in the template); votes are counted per text, template and diagonal. A phrase stands where a
diagonal has all its bigrams. Of longer templates, diagonals with some votes are merged with their neighbours (words left out
or put in shift the diagonal), and the merged span is verified by the share of the template's places that it covers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatewise.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``base`` phrases count as places of the base; all others only add their label. Two words at least."""

    label: str
    text: str
    base: bool = False


# The base phrases with their labels, then well-known notices.
BASE_TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
MORE_TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution international license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all rights reserved"),
    # Whole texts and notices.
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    Template("bsd-2-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    Template("bsd-3-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
)
TEMPLATES = BASE_TEMPLATES + MORE_TEMPLATES

#: Longer templates may be found in part: votes a diagonal needs, how far neighbours lie apart, and the share to cover.
PHRASE_WORDS = 5
LEAST_VOTES = 3
SLACK = 4
COVER = 0.7


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """template, tpos, gram and what a hit needs to know of the template; as many rows as the templates have words."""
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        if not grams:
            raise ValueError("a template has two words at least")
        rows += [(number, template.label, template.base, len(words) <= PHRASE_WORDS, len(grams), i, g) for i, g in enumerate(grams)]
    schema = "template int, label string, base boolean, phrase boolean, grams int, tpos int, t_gram string"
    return spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("t_gram"))


def words_of(text: str) -> Column:
    """Words after A-Z became a-z; null text has none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def license_hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """A header row (pos null) per document and a row per bigram that stands in a template.

    Documents are numbered in the same pass, and the table is stored, so a number stands for one row of ``docs`` whatever
    its doc_id. The header is an empty bigram in front, so that one pass over the texts gives both.
    """
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = worded.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), pairs)).alias("at", "gram"))
    known = template_grams(docs.sparkSession, templates)
    hits = grams.join(F.broadcast(known), (F.xxhash64("gram") == known["t_hash"]) & (F.col("gram") == known["t_gram"]), "left")
    pos = F.when(F.col("at") > 0, F.col("at").cast("long") - 1).alias("pos")
    kept = hits.filter((F.col("at") == 0) | F.col("template").isNotNull())
    return stored(kept.select("row", "doc_id", "n_words", pos, "template", "label", "base", "phrase", "grams", "tpos"), "license-hits")


def license_spans(hits: DataFrame) -> DataFrame:
    """Verified spans: row, template, label, base, first_word, last_word (start of the last bigram's second word) and cover."""
    votes = (
        hits.filter("pos IS NOT NULL")
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "template", "label", "base", "phrase", "grams", "diagonal")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("tpos").alias("covered"))
    )
    whole = votes.filter("phrase AND votes = grams").select("row", "template", "label", "base", F.col("low").alias("first_word"), (F.col("high") + 1).alias("last_word"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    groups = votes.filter(f"NOT phrase AND votes >= {LEAST_VOTES}").withColumn("begins", begins.cast("int"))
    merged = (
        groups.withColumn("group", F.sum("begins").over(order))
        .groupBy("row", "template", "label", "base", "grams", "group")
        .agg(F.min("low").alias("first_word"), (F.max("high") + 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("places"))
        .withColumn("cover", F.col("places") / F.col("grams"))
        .filter((F.col("cover") >= COVER) & (F.col("last_word") - F.col("first_word") <= 2 * F.col("grams")))
    )
    return whole.unionByName(merged.select(*whole.columns))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, one row per row of ``docs``.

    Null and empty texts have no words, no labels (empty strings) and score 0. Other columns of ``docs`` are ignored.
    """
    hits = license_hits(docs, templates, text)
    spans = license_spans(hits).select("row", "label", "base", "first_word", "cover")
    heads = hits.filter("pos IS NULL").select("row", "doc_id", "n_words")
    both = heads.unionByName(spans, allowMissingColumns=True)
    labels = lambda chosen: F.array_join(F.sort_array(F.collect_set(chosen)), ",")
    based = F.col("base")
    return (
        both.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count(F.when(based, 1)).alias("n_base"),
            F.min(F.when(based, F.col("first_word"))).alias("first_word"),
            F.max(F.when(based, F.col("first_word"))).alias("last_word"),
            labels(F.when(based, F.col("label"))).alias("base_labels"),
            labels(F.col("label")).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
