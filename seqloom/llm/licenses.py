"""Licence scans by canonical digest.

A text is canonical in lower case, without lines that begin with a copyright mark, with equivalent spellings made one,
and with every run of other characters than letters and digits as one space. Whole canonical texts, and canonical
lines, are hashed (SHA-256) and joined to the digests of KNOWN and of the whole texts in the folder `texts`, a fixed list
that is small enough to broadcast. A title of a short licence and 'All rights reserved' at the beginning do not count in
this join (`canonical_digest` has them). A line with an SPDX-License-Identifier names every identifier of its expression.
LICENSE_SQL knows the list KNOWN and exact canonical texts alone.

All DataFrame functions. Null texts are empty; empty texts and lines match nothing. Results hang on the text alone:
repeated rows get equal ones, extra columns are ignored.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and customary notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
    " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    ' Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
    " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
    " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = [
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + " " + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT}"),
    ("MIT", f"The MIT License (MIT) {_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
SPELLINGS = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("and or ", "and "),
    ("https ", "http "),
    (" copyright owner ", " copyright holder "),
]
# A line that claims a copyright, not one of a licence's own text that happens to begin with the word.
_COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by )|\(c\)|©)[^\n]*"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?md)" + _COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


#: File below `texts` -> licence, named as in KNOWN.
TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
_TITLE = (
    r"^(?:(?:the )?(?:mit license(?: mit)?|mit|isc license(?: isc)?|bsd license|bsd zero clause license(?: 0bsd)?|zero clause bsd license"
    r"|(?:simplified |new |modified |revised |original )?bsd [0-4] clause(?: (?:simplified|new|modified|revised|new or revised))? license"
    r"|(?:simplified|new|modified|revised) bsd license) )?(?:all rights reserved )*"
)
_ID = r"\(*[ \t]*[\p{L}\p{N}][\p{L}\p{N}.+\-]*(?:[ \t]*\))*"
_SPDX = r"(?i)spdx[ \t]*-[ \t]*license[ \t]*-[ \t]*identifier[ \t]*:[ \t]*(" + _ID + r"(?:[ \t]+(?:and|or|with)[ \t]+" + _ID + ")*)"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of TEXTS: as published, with the owner's line of its notice filled in, and without what follows the terms."""
    out = []
    for file, name in TEXTS.items():
        text = resources.files("seqloom.llm").joinpath("texts", f"{file}.txt").read_text("utf-8")
        forms = [text, re.sub(r"(?m)^[^\w\n]*copyright (?:\[yyyy\]|<year>|(?:\(c\) *)?(?:year|19yy))[^\n]*$", "", text, flags=re.I)]
        terms, mark, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(name, form) for form in forms + ([terms, terms + mark] if mark else [])]
    return out


def known(spark: SparkSession) -> DataFrame:
    """(digest, license); one licence per digest."""
    rows = spark.createDataFrame(KNOWN + whole_texts(), "license string, text string")
    return rows.groupBy(body_digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def body_digest(text: Column) -> Column:
    """The digest without a short licence's title."""
    return F.sha2(F.regexp_replace(canonical(text), _TITLE, ""), 256)


def spdx(line: Column) -> Column:
    """The licence identifiers of an SPDX line, exceptions left out; null for other lines."""
    expression = F.regexp_replace(F.regexp_extract(line, _SPDX, 1), r"(?i)[ \t]with[ \t]+[^ \t()]+", " ")
    names = F.filter(F.split(expression, r"(?i)[ \t()]+(?:(?:and|or)(?=[ \t()])[ \t()]+)*"), lambda x: x.rlike(r"^[\p{L}\p{N}]"))
    names = F.transform(names, lambda x: F.regexp_replace(x, r"[.\-]+$", ""))
    return F.when(F.lower(line).contains("spdx"), F.when(F.size(names) > 0, names))


def license_report(documents: DataFrame) -> DataFrame:
    """Per document: the digest of its canonical text, the licence that the whole text is, and those its lines name."""
    spark = documents.sparkSession
    table = F.broadcast(known(spark))  # at most len(KNOWN) rows
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", digest(text).alias("canonical_digest"), body_digest(text).alias("digest"), F.sha2(text, 256).alias("text_digest"))
    lines = documents.select(F.sha2(text, 256).alias("text_digest"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    found = (
        lines.select("text_digest", "at", digest(F.col("line")).alias("digest"), spdx(F.col("line")).alias("spdx"))
        .join(table, "digest", "left")
        .withColumn("names", F.when(F.col("license").isNotNull(), F.array("license")).otherwise(F.col("spdx")))
        .where("names is not null")
        .groupBy("text_digest", "at")
        .agg(F.min("names").alias("names"))
        .groupBy("text_digest")
        .agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))), " ").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    )
    return (
        rows.join(table, "digest", "left")
        .join(found, "text_digest", "left")
        .select(
            "doc_id",
            "canonical_digest",
            F.col("license").alias("text_license"),
            F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
            F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
        )
    )


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m){_COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
LICENSE_SQL = f"""
with known as (
    select sha256({_canonical_sql('t')}) as digest, min(name) as license from (values {_VALUES}) as k(name, t) group by 1
),
docs as (
    select doc_id, row_number() over () as r, coalesce(text, '') as text, sha256({_canonical_sql('text')}) as canonical_digest from documents
),
lines as (
    select r, license
    from (select r, unnest(string_split(text, chr(10))) as line from docs) join known on sha256({_canonical_sql('line')}) = digest
),
found as (
    select r, string_agg(distinct license, ' ' order by license) as line_licenses, count(*) as n_license_lines from lines group by r
)
select doc_id, canonical_digest, license as text_license, coalesce(line_licenses, '') as line_licenses,
       coalesce(n_license_lines, 0)::bigint as n_license_lines
from docs left join known on canonical_digest = digest left join found using (r)
"""
