"""License scans: canonical digests of entire texts, hash-joined to the digests of known licences.

Canonical form: lower case, copyright notices removed, equivalent spellings unified, everything but letters and digits one space.
The whole text and each of its lines have a digest, so a document that is a licence and one that quotes a one-line notice are
both found.  DataFrame functions only; the table of known texts can be replaced by the caller.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values: spellings that count as one, applied to lower-case words
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "copyright holders": "copyright owners", "copyright holder": "copyright owner", "favour": "favor", "fulfil": "fulfill", "organisation": "organization",
    "merchantibility": "merchantability", "noninfringement": "non infringement", "per cent": "percent", "http": "https", "and or": "andor", "acknowledgement": "acknowledgment", "judgement": "judgment", "behaviour": "behavior", "initialise": "initialize",
}

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# fixed values: known texts under their SPDX ids; a notice is a line that names a licence
KNOWN = {
    "MIT": f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY} {_MIT_LIABILITY}",
    "MIT-0": f"MIT No Attribution\n{_MIT_GRANT}.\n{_WARRANTY} {_MIT_LIABILITY}",
    "ISC": f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_TAIL}",
    "Zlib": "zlib License\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
}

# other titles of the texts above
TITLES = {
    "MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "ISC": ["The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero-Clause License", "Zero-Clause BSD License (0BSD)"],
    "BSD-2-Clause": ["The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "FreeBSD License"],
    "BSD-3-Clause": ["The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Zlib": ["The zlib License", "The zlib/libpng License", "zlib License (Zlib)"],
}
_TERMS_END = "END OF TERMS AND CONDITIONS"


def entire_texts() -> list[tuple[str, str]]:
    """``license_id, text`` of each known text: under each title and without one, and those of ``known_licenses`` also without
    what follows their terms."""
    rows = [(k, f"{title}\n{text}") for k, (first, text) in ((k, t.split("\n", 1)) for k, t in KNOWN.items()) for title in (first, "", *TITLES[k])]
    for file in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = file.read_text("utf-8")
        rows.append((file.stem, text))
        if _TERMS_END in text:
            rows += [(file.stem, terms := text[: text.index(_TERMS_END)]), (file.stem, terms + _TERMS_END)]
    return rows


# patterns that Java and RE2 read alike; a notice has a sign, a year or a place for one, which other lines that begin so have not
_YEAR = r"(19|20)[0-9][0-9]"
_COPYRIGHT = rf"(^|\n)[ \t\r*#/;]*(copyright[ \t:,]*((\(c\)|©)[ \t]*[^_ \t\r\n]|{_YEAR}|[\[<{{])|copyright([ \t]+[^ \t\n]+){{1,4}}[ \t]+{_YEAR}|\(c\)[ \t]*(copyright[ \t]*)?{_YEAR}|©|all rights reserved)[^\n]*"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The form that is digested; a null text is empty."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, _COPYRIGHT, "\n")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, _OTHER, " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(c)


def known_texts(spark: SparkSession) -> DataFrame:
    """``license_id, digest`` of the texts and notices above."""
    rows = entire_texts() + [(k, t) for k, ts in NOTICES.items() for t in ts]
    known = digests(spark.createDataFrame(rows, "license_id string, text string"))
    return spark.createDataFrame(known.collect(), known.schema)  # a row of two short values for each text above


def digests(known: DataFrame) -> DataFrame:
    """One row per digest of a caller's ``license_id, text`` table; equal digests take the smallest id, empty texts none."""
    d = known.select("license_id", canonical(F.col("text")).alias("c")).where("c <> '' and license_id is not null")
    return d.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, license_id, notices``, one row per row of ``docs`` in which ``key`` is unique.

    ``license_id``: the licence whose entire text the document is, or null.  ``notices``: ids of the licences that single lines
    of it name, sorted and joined by commas, or null.  A null text is empty and matches nothing; so does a line without words.
    ``known`` has ``license_id, digest``; Spark broadcasts it when it is small.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    whole = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    lines = rows.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    named = lines.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(known, "digest")
    notices = named.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))  # ids of one document
    return whole.join(known, "digest", "left").join(notices, "doc_id", "left").select("doc_id", "digest", "license_id", "notices")


def _canonical_sql(text: str) -> str:
    c = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT}', chr(10), 'g')"
    c = f"' ' || trim(regexp_replace({c}, '{_OTHER}', ' ', 'g')) || ' '"
    for old, new in SPELLINGS.items():
        c = f"replace({c}, ' {old} ', ' {new} ')"
    return f"trim({c})"


def _sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = entire_texts() + [(k, t) for k, ts in NOTICES.items() for t in ts]
    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in rows)
    return f"""
with known as (select sha256(c) as digest, min(license_id) as license_id from (select license_id, {_canonical_sql("text")} as c from (values {values}) v(license_id, text)) where c <> '' group by 1),
whole as (select doc_id, sha256({_canonical_sql("text")}) as digest from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
named as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices from (select doc_id, sha256({_canonical_sql("line")}) as digest from lines) join known using (digest) group by 1)
select doc_id, digest, license_id, notices from whole left join known using (digest) left join named using (doc_id)"""


@common.query("op6_license_digests", _sql())
def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), known_texts(spark))
