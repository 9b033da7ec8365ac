"""License notices found by MinHash bands over overlapping windows and verified by containment.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters; shingles are five words. A window is some consecutive shingles and starts at
every shingle, so windows overlap in all but one. A window has ``BANDS`` bands of ``ROWS``
MinHash values; templates are cut into windows alike, and a band that equals one of a
template's retrieves the template.

Band settings: of Jaccard similarity j, two windows share a band with probability
1 - (1 - j**ROWS)**BANDS: 1 if they are equal, 0.94 at 0.5, 0.9999 at 0.78. A template's
windows have as many shingles as the largest power of two, ``WINDOW`` at most, that
``percent`` of its shingles reach. A word that is put in, left out or changed takes four or
five shingles in a row, so a notice that keeps ``percent`` = 80 of 100 shingles keeps a run
of that many somewhere (at least 16 m / (m + 20) of m shingles, and for m under 20 only
its ends can be hurt): some window is equal, and the template is retrieved with certainty.
Shingles that are all kept but in another order, one by one, are met by the bands' probability.

Only positions whose own shingle is some template's are cut into windows: a window that has
no template's shingle shares no MinHash value with one, and of an equal window the first
shingle is a template's too. They are found by one lookup of the shingle's hash.

Retrieved (document, template) pairs are verified exactly, by words: the share of the
template's distinct shingles that the whole document contains must reach ``percent`` / 100.

All is DataFrame expressions. The templates' tables are broadcast if their measured bytes
are within the bound. Only retrieved documents are read again, and only shingles that a
template has are shuffled. Defined results: null and empty texts, and texts under five
words, match nothing; templates under five words are refused; repeated rows give one row
for each template, and rows of one id are judged by their texts; null ids are kept; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, settled, small_side
from frameloom.llm.decontaminate import words

SHINGLE, WINDOW, BANDS, ROWS, PERCENT = 5, 8, 10, 2, 80

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)

#: Texts and notices of public licenses, by name.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-text": f"{_TWO_CLAUSES} {_DISCLAIMER}",
    "bsd-3-text": (
        f"{_TWO_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        f"permission. {_DISCLAIMER}"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def template_words(text: str) -> list[str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if len(w) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    return w


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _shingle(wh: Column, n: Column, at: Column) -> Column:
    """Hash of the shingle that starts at word ``at`` (from 0); null if it isn't whole."""
    return F.when(at + SHINGLE <= n, F.xxhash64(F.slice(wh, at + 1, F.lit(SHINGLE))))


def _positions(rows: DataFrame, kept: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """``kept``, at, n, wh (the words' hashes) and s0, the hash of the shingle there, for every shingle of the words ``w``."""
    each = rows.select(*kept, "w", F.size("w").alias("n"), _word_hashes(F.col("w")).alias("wh")).select(*kept, "w", "n", "wh", F.posexplode("wh").alias("at", "_first"))
    whole = each.where(F.col("at") + SHINGLE <= F.col("n"))
    return whole.select(*kept, *extra, "at", "n", "wh", _shingle(F.col("wh"), F.col("n"), F.col("at")).alias("s0"))


def _banded(rows: DataFrame, kept: list[str], bands: int) -> DataFrame:
    """rows (kept, at, n, wh, window): kept and the values of the bands of the window that begins at ``at``, where it is whole."""
    whole = rows.where(F.col("at") + F.col("window") - 1 + SHINGLE <= F.col("n"))
    inside = F.transform(F.sequence(F.lit(0), F.col("window") - 1), lambda i: F.xxhash64(F.slice("wh", F.col("at") + i + 1, F.lit(SHINGLE))))
    held = settled(whole, [*kept, "window"], s=inside)

    def least(number: int) -> Column:
        return F.array_min(F.transform("s", lambda x: F.xxhash64(F.lit(number), x)))

    values = [F.xxhash64(F.col("window"), F.lit(i), *[least(i * ROWS + r) for r in range(ROWS)]) for i in range(bands)]
    return held.select(*kept, F.explode(F.array(*values)).alias("value"))


def template_tables(spark: SparkSession, templates: dict[str, str], bands: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[int]]:
    """(license, h, gram) of the templates' distinct shingles, (value, license) of the bands of their windows, and the windows' sizes."""
    rows = []
    for name, text in templates.items():
        w = template_words(text)
        kept = max(1, len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}) * percent // 100)
        rows.append((name, w, min(WINDOW, 1 << (kept.bit_length() - 1))))
    split = spark.createDataFrame(rows, "license string, w array<string>, window int")
    at = _positions(split, ["license", "window"], (F.array_join(F.slice("w", F.col("at") + 1, F.lit(SHINGLE)), " ").alias("gram"),))
    shingles = at.select("license", F.col("s0").alias("h"), "gram").distinct()
    return shingles, _banded(at, ["license"], bands).distinct(), sorted({r[2] for r in rows})


def retrieved(docs: DataFrame, shingles: DataFrame, banded: DataFrame, windows: list[int], bands: int = BANDS) -> DataFrame:
    """doc_id, row (a hash of the text), license of the templates that a window of the document meets in a band."""
    base = settled(docs, ["doc_id"], row=F.xxhash64("text"), w=words(F.col("text")))
    known = materialize(shingles.select("h").distinct(), "license-hashes")
    near = _positions(base, ["doc_id", "row"]).join(small_side(known), F.col("s0") == known["h"], "left_semi")
    cut = near.select("doc_id", "row", "at", "n", "wh", F.explode(F.array(*map(F.lit, windows))).alias("window"))
    hits = _banded(cut, ["doc_id", "row"], bands).alias("b")
    return hits.join(small_side(banded).alias("t"), F.col("b.value") == F.col("t.value")).select("doc_id", "row", "license").distinct()


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """doc_id, license, n_shared, n_template of every notice that a document contains."""
    docs = docs.select("doc_id", "text")
    shingles, banded, windows = template_tables(docs.sparkSession, templates, bands, percent)
    shingles, banded = materialize(shingles, "license-shingles"), materialize(banded, "license-bands")
    size = shingles.groupBy("license").agg(F.count("*").alias("n_template"))
    pairs = materialize(retrieved(docs, shingles, banded, windows, bands), "retrieved").alias("p")
    rows = materialize(pairs.select(F.col("doc_id").alias("id"), F.col("row").alias("digest")).distinct(), "retrieved-rows")
    again = docs.join(small_side(rows), docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["digest"]), "left_semi")
    base = settled(again, ["doc_id"], row=F.xxhash64("text"), w=words(F.col("text")))
    own = _positions(base, ["doc_id", "row"], (F.array_join(F.slice("w", F.col("at") + 1, F.lit(SHINGLE)), " ").alias("gram"),))
    held = own.join(small_side(shingles), (own["s0"] == shingles["h"]) & (own["gram"] == shingles["gram"])).select("doc_id", "row", "license", shingles["gram"]).distinct()
    shared = held.groupBy("doc_id", "row", "license").agg(F.count("*").alias("n_shared")).alias("h")
    same = F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("p.row") == F.col("h.row")) & (F.col("p.license") == F.col("h.license"))
    verified = shared.join(pairs, same, "left_semi").join(small_side(size), "license")
    return verified.where(F.col("n_shared") * 100 >= F.col("n_template") * percent).select("doc_id", "license", "n_shared", "n_template").distinct()
