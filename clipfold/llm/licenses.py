"""Licence scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings no longer matter) and its digest is joined with those of
known licence texts and notices. Whole documents and each of their lines are
looked up; there is no fuzzy match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.llm.store import with_text

#: Spellings that count as equal, after punctuation is gone.
EQUAL = (("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("wilful", "willful"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"))
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright\s*(\(c\)|©|[0-9]{4})|\(c\)\s|©|all rights reserved)"

_PERMIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

#: Known texts and notices, and the licence each stands for.
KNOWN = (
    ("MIT", _PERMIT), ("MIT", "MIT License\n" + _PERMIT), ("MIT", "The MIT License\n" + _PERMIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies.")), ("0BSD", _ISC.format(".")),
    ("BSD-2-Clause", _BSD.format("")), ("BSD-3-Clause", _BSD.format(_NAMES)), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")), ("CC0-1.0", "Licensed under CC0 1.0."),
)


def _canonical(text: Column) -> Column:
    """Words in single blanks, and equal spellings of whole words alike; for texts that are looked up and known ones."""
    out = F.concat(F.lit("  "), F.replace(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), F.lit(" "), F.lit("  ")), F.lit("  "))
    for a, b in EQUAL:
        out = F.replace(out, F.lit(_words(a)), F.lit(_words(b)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _words(spelling: str) -> str:
    """A spelling as whole words: one blank of its own at each end."""
    return f" {spelling.replace(' ', '  ')} "


def _whole(text: str) -> Column:
    """The canonical form of a text without its copyright lines."""
    return _canonical(F.array_join(F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT)), " "))


def digested(known: DataFrame) -> DataFrame:
    """digest and license_id of known texts (license_id, text); texts without a word are none."""
    form = known.select("license_id", _whole("text").alias("form")).filter("form <> ''")
    return form.select(F.sha2("form", 256).alias("digest"), "license_id").distinct()


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, line_no (-1: the whole text), license_id and digest of each match.

    ``known``: texts and notices to look for (license_id, text), of any number
    and size; without it the list of this module, which has no whole text of
    the Apache, GNU, Mozilla and Creative Commons licences. Blank lines match nothing, nor does a null or empty text; repeated rows
    match each for themselves; a digest that ``known`` has for several licences
    gives a row for each; texts of any length are read whole; an empty
    table gives no row; further columns of ``docs`` are not read.
    """
    every = with_text(docs, "doc_id").select("doc_id", F.split(F.lower("text"), "\n").alias("lines"), _whole("text").alias("whole"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), F.when(~x.rlike(COPYRIGHT), F.sha2(_canonical(x), 256)).alias("digest")))
    units = every.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("line_no"), F.sha2("whole", 256).alias("digest"))), each)).alias("u"))
    if known is None:
        # The known texts are a list in this module.
        digests = F.broadcast(digested(docs.sparkSession.createDataFrame(KNOWN, "license_id string, text string")))
    else:
        digests = digested(known)
    return units.select("doc_id", "u.line_no", "u.digest").join(digests, "digest").select("doc_id", "line_no", "license_id", "digest")


def scan_sql() -> str:
    """The same rows from DuckDB, which brings the known texts to their form itself."""
    drop = f"regexp_matches(x, '{COPYRIGHT}')"

    def form(x: str) -> str:
        out = f"'  ' || replace(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || '  '"
        for a, b in EQUAL:
            out = f"replace({out}, '{_words(a)}', '{_words(b)}')"
        return f"trim(replace({out}, '  ', ' '))"

    whole = lambda lines: form("array_to_string(list_filter(" + lines + ", lambda x: NOT " + drop + "), ' ')")
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
    WITH texts(license_id, text) AS (VALUES {known}),
    known AS (SELECT DISTINCT sha256(form) AS digest, license_id FROM (SELECT license_id, {whole("string_split(lower(text), chr(10))")} AS form FROM texts) WHERE form <> ''),
    l AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
    e AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS line_no FROM l),
    u AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, sha256({form("x")}) AS digest FROM e WHERE NOT {drop}
          UNION ALL SELECT doc_id, -1, sha256({whole("lines")}) FROM l)
    SELECT doc_id, line_no, license_id, digest FROM u JOIN known USING (digest)"""
