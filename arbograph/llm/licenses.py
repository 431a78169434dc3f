"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought into a canonical form: lower case, without lines that name the
owner of a copyright, every run of other characters than letters and digits made
one space, equivalent spellings made one, however its lines are wrapped.  Its
digest is looked up among those of known licences, as a whole; the same is done
with each of its lines taken as a text, for notices that stand within a
document.  An owner's line that ends in a comma, "&" or "and" may go on in the next:
where there is such a line, the text is also looked up without what follows, after
it was with it, as some licences have the owner's address there.  Lines are brought into their form once for both.

Whole texts of long licences are known by their digests alone.

Defined results: null and empty texts have no licence; of known licences with
equal digests the first by name counts; a document's notices are distinct and
sorted, and each row has those of its own text, null and repeated doc_ids
included; an empty table gives no rows; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings taken as equal, from the first to the second.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("copyright holder", "copyright owner"), ("merchantibility", "merchantability"), ("https", "http"))
#: Lines that name the owner of a copyright, by a sign, a year or a place for one ...
OWNER_LINE = r"(?i)^[^\p{L}\p{N}]*(copyright\s*(\(c\)|©|[0-9\[<{]|by\s)|\(c\)\s*[0-9\[<{]|©|all rights reserved)"
#: ... or by a name, which isn't one of the words that follow "copyright" in the terms of licences.
NAMED_LINE = r"^[^\p{L}\p{N}]*[Cc]opyright\s+\p{Lu}"
TERMS_LINE = r"(?i)^[^\p{L}\p{N}]*copyright\s+(and|claim|disclaimer|holder|interest|law|licen[cs]e|license|notice|or|owner|permission|right|statement|status|treaty)"

#: An owner's lines that are wrapped after a comma, "&" or "and", with the last of them, in 100 lines at most.
WRAPPED = r"(?i)(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9\[<{]|by[ \t])|\(c\)[ \t]*[0-9\[<{]|©)([^\n]*(,|&|\band)[ \t\r]*\n){1,100}[^\n]*"

# Licences and the names by which notices call them.
NAMES = {
    "MIT": ("MIT", "MIT License", "the MIT License"),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0", "the Apache License, Version 2.0"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "the GNU General Public License, version 2"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "the GNU General Public License, version 3"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "the GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "the GNU Lesser General Public License, version 3"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "the GNU Affero General Public License, version 3"),
    "MPL-2.0": ("MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD-2-Clause", "the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "the BSD 3-Clause License", "the New BSD License"),
    "ISC": ("ISC", "the ISC License", "ISC License"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
}
# Notices, with the name's place.
NOTICES = ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This file is licensed under {}", "This project is licensed under {}")

# Whole licence texts.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
)


# Digests of the canonical forms of whole texts as published, and of their terms without the appendix.
DIGESTS = (
    ("Apache-2.0", "77e1a2c8e9671a8095fa8108104daeae"),
    ("Apache-2.0", "d44d7dd7bb33c43e91c9d5e48b1d489e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GPL-2.0", "422f821c6c0b1812cbde7c1c3be04922"),
    ("GPL-2.0", "26f606e3d78ac5cd21540a2d8adde537"),
    ("GPL-2.0", "f70d604d4a80209220de9c8357273822"),
    ("GPL-2.0", "bbaca3ed3cdb6c5370bd8be74388f25f"),
    ("GPL-3.0", "dd25740036eafeeb440b379ece56a8ae"),
    ("GPL-3.0", "2048533964f4a556d38eb2de2a0efac8"),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e"),
    ("LGPL-2.1", "678176bc76eced93c061414ea9afa263"),
    ("LGPL-2.1", "bc5b2209506412796e319e384736323b"),
    ("LGPL-2.1", "fc13126365c85d1c3d39e113df5144b5"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all whole texts and notices that are given as such."""
    notices = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    return [*TEXTS, *notices]


def _spelled(form: Column) -> Column:
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def line_forms(text: Column) -> Column:
    """The canonical form of each line but for spellings; empty for owners' lines."""

    def of(line: Column) -> Column:
        owner = line.rlike(OWNER_LINE) | (line.rlike(NAMED_LINE) & ~line.rlike(TERMS_LINE))
        return F.when(owner, "").otherwise(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")))

    return F.transform(F.split(text, "\n"), of)


def _digest(form: Column) -> Column:
    """Null if nothing is left of the text."""
    return F.when(form != "", F.md5(_spelled(form).cast("binary")))


def _whole(forms: Column) -> Column:
    return _digest(F.array_join(F.filter(forms, lambda x: x != ""), " "))


def digests(text: Column) -> Column:
    """Of the whole text, and then of each line; null for a null text."""
    both = F.transform(F.array(line_forms(text)), lambda forms: F.concat(F.array(_whole(forms)), F.transform(forms, _digest)))
    return F.get(both, F.lit(0))


def digest_without_wrapped(text: Column) -> Column:
    """Of the whole text without the lines in which owners' lines go on; null if there are none."""
    return F.when(text.rlike(WRAPPED), _whole(line_forms(F.regexp_replace(text, WRAPPED, "$1"))))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and license of known texts, as a rule those of this module."""
    rows = spark.createDataFrame(known if known is not None else known_texts(), "license string, known string")
    rows = rows.select(F.get(digests(F.col("known")), F.lit(0)).alias("digest"), "license")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(list(DIGESTS), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license")).filter("digest is not null")


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license (of the whole text, or null) and notices (licences that lines name) of every row."""
    table = F.broadcast(known_digests(docs.sparkSession, known))  # as many rows as the driver's list of known texts at most
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    parts = own.select("doc_id", "row", F.posexplode_outer(F.concat(F.array(digest_without_wrapped(F.col("text"))), digests(F.col("text")))).alias("k", "digest"))
    # one row a text, and one for each of the few lines that are found
    found = parts.join(table, "digest", "left").filter("license is not null or k = 1 or k is null")
    notices = F.array_sort(F.collect_set(F.when(F.col("k") > 1, F.col("license"))))
    whole = F.coalesce(*(F.max(F.when(F.col("k") == k, F.col("license"))) for k in (1, 0)))
    rows = found.groupBy("row", "doc_id").agg(whole.alias("license"), notices.alias("notices"))
    return rows.select("doc_id", "license", F.array_join("notices", ", ").alias("notices"))


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, {quoted(old)}, {quoted(new)})"
        return x

    def forms(text: str) -> str:
        owner = f"regexp_matches(x, {quoted(OWNER_LINE)}) or (regexp_matches(x, {quoted(NAMED_LINE)}) and not regexp_matches(x, {quoted(TERMS_LINE)}))"
        line = f"case when {owner} then '' else trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) end"
        return f"[{line} for x in string_split({text}, chr(10))]"

    joined = lambda forms: f"array_to_string([x for x in {forms} if x <> ''], ' ')"
    whole = joined("forms")
    wrapped = f"case when regexp_matches(text, {quoted(WRAPPED)}) then regexp_replace(text, {quoted(WRAPPED)}, '\\1', 'g') end"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known_texts())
    listed = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, d in DIGESTS)
    return f"""
with given as (
  select license, {forms('known')} as forms from (values {values}) v(license, known)
), known as (
  select digest, min(license) as license from (
    select license, md5({spelled(whole)}) as digest from given where {whole} <> ''
    union all select * from (values {listed}) v(license, digest)
  ) group by digest
), texts as materialized (
  select r, doc_id, {forms('text')} as forms, {forms('bare')} as bare
  from (select row_number() over () as r, doc_id, text, {wrapped} as bare from documents)
), lines as (
  select r, unnest(forms) as form from texts
), noticed as (
  select r, string_agg(distinct license, ', ' order by license) as notices
  from (select r, md5({spelled('form')}) as digest from lines where form <> '') l join known using (digest) group by r
), whole as (
  select r, doc_id, case when {whole} <> '' then md5({spelled(whole)}) end as digest,
    case when {joined('bare')} <> '' then md5({spelled(joined('bare'))}) end as bare_digest from texts
)
select w.doc_id, coalesce(k.license, b.license) as license, coalesce(notices, '') as notices
from whole w left join known k using (digest) left join known b on b.digest = w.bare_digest left join noticed n using (r)
"""
