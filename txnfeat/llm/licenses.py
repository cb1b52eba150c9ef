"""License scans, native: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A template of t shingles (five words each) belongs to the size class c, the power of two from 8 on with c >= t. Its
windows are 3c/2 shingles long and start every c/2, so any c shingles in a row lie in one of them. A set's sketch are its
BANDS least distinct shingle hashes (bottom-k MinHash); each is a band of one row. Of the BANDS least hashes of the union
of a window and a template, each lies in both sets with probability J and is then in both sketches, so they collide
with probability 1 - (1 - J)^BANDS: certainly while a window has up to BANDS shingles, with over 0.99 for a template
of which 0.8 stands in its window (J >= 0.25), and over 0.998 where all of it does (J >= 1/3).

Everything is DataFrame operations on the JVM. A band of a template can only be in a window's sketch where that hash stands
in the text, so one scan looks up each shingle among the bands of all templates; windows around those places alone are cut
and sketched, on a second reading of the few texts that have one. Equal texts share what is found in the first scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table, written

WORDS, BANDS, LEAST_CLASS = 5, 16, 8
#: A template is found where at least so many percent of its shingles stand in a window.
PERCENT = 80
#: Band keys and candidates up to so many rows (under 50 MB) are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Wordings of public licenses and of the notices that refer to them.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
)


def _words(text: Column) -> Column:
    """Words of ASCII letters (lower-cased), digits and characters beyond ASCII; a null text has none."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _with_shingles(df: DataFrame) -> DataFrame:
    """The column words replaced by shingles, the hash of each five words in a row."""
    n = F.size("words") - (WORDS - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WORDS))))
    return df.withColumn("shingles", F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))).drop("words")


def _cut(at: Column, n: Column | int) -> Column:
    """n shingles from `at`; slice() would copy the whole array each time, which is quadratic for long texts."""
    return F.transform(F.sequence(at - 1, F.least(at + n - 2, F.size("shingles") - 1)), lambda j: F.get("shingles", j))


def _sketch(shingles: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, BANDS)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "license string, text string")


def scan(docs: DataFrame, templates: DataFrame, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, license, containment, window (its first shingle, from 1) of each document and license found in it.

    docs: doc_id, text; templates: license, text (other columns are left out). Of several windows the one with the
    highest containment, then the first, is told. Null, empty and shorter texts than five words have no license, and
    such templates are never found; templates that repeat a license name count each for themselves, the best wins.
    Rows that repeat a doc_id, or have none, are told together."""
    spark = docs.sparkSession
    ship(spark)
    known = _with_shingles(templates.where("license is not null").select("license", _words(F.col("text")).alias("words")))
    known = written(known.withColumn("shingles", F.array_distinct("shingles")), "license-shingles").where(F.size("shingles") > 0).distinct()
    t = F.size("shingles")
    known = written(known.select("license", "shingles", F.greatest(F.lit(LEAST_CLASS), F.pow(F.lit(2.0), F.ceil(F.log2(t.cast("double")) - 1e-9))).cast("int").alias("class"), F.xxhash64("license", "shingles").alias("template")), "license-classes")
    # At most one class for each power of two.
    classes = sorted(r[0] for r in known.select("class").distinct().collect())
    if not classes:
        return docs.select("doc_id").where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(1).alias("window"))
    known = written(known.withColumn("bands", _sketch(F.col("shingles"))), "license-templates")
    keys = known.select("template", "class", F.explode("bands").alias("band"))
    small = keys.count() <= broadcast_rows

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    # No filter on shingles, nor an inner explode, which infers one: pushed below, it would compute the words anew for each of them.
    shingled = _with_shingles(texts.select("key", _words(F.col("text")).alias("words")))
    places = shingled.select("key", F.posexplode_outer("shingles").alias("p", "h"))
    found = places.join(F.broadcast(keys) if small else keys, F.col("h") == F.col("band")).groupBy("key", "p", "class", "template").agg(F.lit(1).alias("one"))
    # Of the windows at 1, 1 + c/2, 1 + c ..., 3c/2 long, those that hold the place p (from 0).
    half = F.col("class") / 2
    first, last = (F.greatest(F.lit(0), F.floor((F.col("p") - F.col("class")) / half).cast("int")), F.floor(F.col("p") / half).cast("int"))
    at = F.explode(F.transform(F.sequence(first, last), lambda m: (m * half + 1).cast("int")))
    candidates = written(found.select("key", "class", at.alias("at"), "template").distinct(), "license-candidates")

    small = candidates.count() <= broadcast_rows
    asked = candidates.groupBy("key").agg(F.collect_list(F.struct("class", "at", "template")).alias("asked"))
    again = texts.join(F.broadcast(asked) if small else asked, "key").select("doc_id", "asked", _words(F.col("text")).alias("words"))
    each = _with_shingles(again).select("doc_id", F.explode(F.transform("asked", lambda a: F.struct(a["template"].alias("template"), a["at"].alias("at"), _cut(a["at"], F.floor(a["class"] * 3 / 2).cast("int")).alias("window")))).alias("a"))
    same = known.select("template", "license", "shingles", "bands")
    judged = each.select("doc_id", "a.*").join(F.broadcast(same) if known.count() <= broadcast_rows // 100 else same, "template")
    judged = judged.where(F.arrays_overlap(_sketch(F.col("window")), "bands"))
    n = F.size(F.array_intersect("shingles", "window"))
    hits = judged.select("doc_id", "license", "at", n.alias("n"), F.size("shingles").alias("of")).where(F.col("n") * 100 >= F.col("of") * percent)
    best = hits.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("n") / F.col("of")).alias("c"), "at")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.c")).alias("containment"), F.col("b.at").alias("window"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), template_table(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = r"""
with texts as (
  select doc_id, text, false as is_license, '' as license from documents
  union all
  select null, t, true, l from (values VALUES_) v(l, t)
), words as (
  select doc_id, is_license, license, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), s as (
  select doc_id, is_license, license, p, array_to_string(w[p : p + 4], ' ') as sh
  from (select *, unnest(range(1, len(w) - 3)) as p from words where len(w) >= 5)
), t as (select distinct license, sh from s where is_license),
n as (select license, count(*) as n, greatest(8, cast(pow(2, ceil(log2(count(*)) - 1e-9)) as integer)) as c from t group by license),
hit as (select distinct s.doc_id, t.license, p, s.sh, n.n, n.c from s join t on s.sh = t.sh join n on n.license = t.license where not is_license),
windowed as (
  select doc_id, license, n, sh, unnest(range(greatest(0, ((p - 3 * c // 2) // (c // 2))), (p - 1) // (c // 2) + 1)) * (c // 2) + 1 as first_at, p, c from hit
), counted as (
  select doc_id, license, first_at, count(distinct sh) as k, any_value(n) as n from windowed where first_at <= p and p < first_at + 3 * c // 2 group by doc_id, license, first_at
)
select doc_id, license, max(k / n) as containment, cast(arg_min(first_at, row(-k / n, first_at)) as integer) as "window"
from counted where 100 * k >= 80 * n group by doc_id, license
""".replace("VALUES_", ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in TEMPLATES))
