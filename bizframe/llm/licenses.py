"""License scans by diagonal voting, native Spark only.

Every text becomes its rolling k-grams of words; they are joined to the positions of the same k-grams in the templates
(a constant table, so its broadcast is bounded). K-grams that no template holds could not join and are left out while the
words are at hand, by a lookup in that same constant table, so that a text's words are made once and its row holds hits
only. A hit's diagonal is text position minus template position: a template copied word for word puts all its k-grams on
one diagonal, and an insertion or deletion moves the rest to a neighbouring one. Hits are counted per (document, template,
diagonal); diagonals at most `slack` apart are merged into one span; a span is verified by the part of the template's
k-grams that it holds in the template's order: in the order of the text, a hit counts if it is further on in the template
than all hits before it.

The join compares the k-gram's words, not only their hash, so a diagonal that holds all k-grams of a phrase is an exact
place of that phrase.

Defined cases: null text is empty and has no words; a text shorter than k words has no hits; rows repeated under one
id are variants of one document, whose places are united, and each keeps a row; an empty table gives an empty table;
extra columns are ignored, whatever their names; a long text is one row, of which only hits are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in lower-cased text, as Java matches them fastest.
JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
K = 3
SLACK = 4
MIN_COVER = 0.6

#: Fixed phrases: exact places count as base.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Fixed key sentences, notices and whole texts of public licences: matched with insertions and deletions. A name is a
#: label, or a label and a part of its licence.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mit/whole": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do
        so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including
        but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd/whole": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the
        copyright holders and contributors as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or
        contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
        procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory
        of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
        this software even if advised of the possibility of such damage""",
    "isc/whole": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
        all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
        author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
        data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use
        or performance of this software""",
    "zlib/whole": """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this
        software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
        an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly
        marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any
        source distribution""",
    "gpl/notice": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or at your option any later version this program is
        distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
        fitness for a particular purpose see the gnu general public license for more details""",
    "lgpl/notice": """
        this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation either version 2 1 of the license or at your option any later version""",
    "apache-2/notice": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
        obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
        or implied see the license for the specific language governing permissions and limitations under the license""",
}


def gram_rows(phrases: dict[str, str], templates: dict[str, str], k: int) -> list[tuple[str, str, str, bool, int, int]]:
    """gram, template, label, base, position in the template, the template's number of grams."""
    rows = []
    for base, texts in ((True, phrases), (False, templates)):
        for name, text in texts.items():
            label = name.partition("/")[0]
            words = re.findall(LICENSE_WORD, text)
            grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            if not grams:
                raise ValueError(f"{text!r} has fewer than {k} words")
            rows += [(g, f"{'p' if base else 't'}:{name}", label, base, i, len(grams)) for i, g in enumerate(grams)]
    return rows


def template_grams(spark, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """The k-grams of all templates by position: some hundreds of rows, whatever the data."""
    return spark.createDataFrame(gram_rows(phrases, templates, k), "gram string, template string, label string, base boolean, t_pos int, t_grams int")


def text_hits(df: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """One row per row of df: __id, __n_words, and __hits (pos, gram), the rolling k-grams that some template holds."""
    # the Kelvin sign is the one sign beyond ASCII whose lower case is an ASCII letter: another letter stands for it
    lowered = F.lower(F.replace(whole_text(text_col), F.lit("\u212a"), F.lit("\u00ff")))
    words = df.select(F.col(id_col).alias("__id"), F.regexp_extract_all(lowered, F.lit(JAVA_WORD), F.lit(0)).alias("__w"))
    grams = sorted({row[0] for row in gram_rows(phrases, templates, k)})
    word = lambda i, j: F.get("__w", i + j)
    gram = lambda i: F.concat_ws(" ", *[word(i, j) for j in range(k)])

    def held(i: Column) -> Column:
        found = F.lit(True)
        for j in range(k):  # most k-grams end at their first word
            found = found & word(i, j).isin(sorted({g.split(" ")[j] for g in grams}))
        return found & gram(i).isin(grams)

    starts = F.when(F.size("__w") >= k, F.sequence(F.lit(0), F.size("__w") - k)).otherwise(F.array().cast("array<int>"))
    hits = F.transform(F.filter(starts, held), lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")))
    return words.select("__id", F.size("__w").cast("long").alias("__n_words"), hits.alias("__hits"))


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    k: int = K,
    slack: int = SLACK,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Verified spans: __id, label, base, start (word), diagonals, cover (0 to 1). A base span is exact."""
    return spans_of(text_hits(df, id_col, text_col, phrases, templates, k), phrases, templates, k, slack, min_cover)


def spans_of(found: DataFrame, phrases: dict[str, str], templates: dict[str, str], k: int, slack: int, min_cover: float) -> DataFrame:
    """scan() of rows of text_hits()."""
    known = F.broadcast(template_grams(found.sparkSession, phrases, templates, k))
    hits = found.select("__id", F.inline("__hits")).join(known, "gram")
    diagonals = hits.groupBy("__id", "template", "label", "base", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("__covered")
    )
    exact = diagonals.where(F.col("base") & (F.size("__covered") == F.col("t_grams")))
    along = Window.partitionBy("__id", "template").orderBy("diagonal")
    loose = diagonals.where(~F.col("base"))
    loose = loose.withColumn("__new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.lit(-(2**30))) > slack).cast("int"))
    loose = loose.withColumn("__run", F.sum("__new").over(along)).withColumn("t_pos", F.explode("__covered"))
    before = Window.partitionBy("__id", "template", "__run").orderBy(F.col("diagonal") + F.col("t_pos"), "t_pos").rowsBetween(Window.unboundedPreceding, -1)
    loose = loose.withColumn("__on", F.col("t_pos") > F.coalesce(F.max("t_pos").over(before), F.lit(-1)))
    spans = loose.groupBy("__id", "template", "label", "base", "t_grams", "__run").agg(
        F.count_if("__on").alias("__n"),
        F.min("diagonal").alias("start"),
        F.count_distinct("diagonal").alias("diagonals"),
    )
    cover = F.col("__n") / F.col("t_grams")
    spans = spans.where(cover >= min_cover).select("__id", "label", "base", "start", "diagonals", cover.alias("cover"))
    return exact.select(
        "__id", "label", "base", F.col("diagonal").alias("start"), F.lit(1).cast("long").alias("diagonals"), F.lit(1.0).alias("cover")
    ).unionByName(spans)


def label_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    k: int = K,
    slack: int = SLACK,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover)."""
    found = materialize(text_hits(df, id_col, text_col, phrases, templates, k), "hits")  # read by several branches, the texts once
    per_doc = (
        spans_of(found, phrases, templates, k, slack, min_cover)
        .groupBy("__id")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    rows = found.select(F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"))
    return rows.join(per_doc, rows[id_col].eqNullSafe(per_doc["__id"]), "left").select(
        id_col,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
