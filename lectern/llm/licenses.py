"""License scans (3): canonical digest lookup.

A text is brought to a canonical form (lower case; lines that claim copyright dropped; equivalent spellings made one;
everything but letters and digits one space) and its SHA-256 looked up among the digests of known licences: once for
the entire text, and once for each line that can be a notice, so a licence line inside other text is found as well.
Everything is built-in Spark SQL: known digests are a table of proven size, hash-joined to whole texts; lines are
digested and looked up in place, so a text is neither exploded nor shuffled.

Defined cases: null and empty texts have the digest of the empty form and no licence; rows that repeat repeat; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, and spellings that count as equal.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = {
    "MIT": ["MIT License\n\n" + _MIT_GRANT, "The MIT License (MIT)\n\n" + _MIT_GRANT, _MIT_GRANT],
    "ISC": ["ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_REST, _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_REST],
    "0BSD": [_ISC_GRANT + ".\n\n" + _ISC_REST, "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_REST],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_REST, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_REST],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_NAMES + _BSD_REST, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_REST],
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
}
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("whilst", "while")]
# End of fixed values.

# A line that claims copyright: the word before a sign, a colon, "by", a placeholder or a year. A wrapped sentence that happens to begin a line with "copyright" stays.
COPYRIGHT = (
    r"(?m)^[\s*#/;%-]*(?:copyright[\s,]*(?:\(c\)|©|:|by\b|[\[<{]|(?:19|20)[0-9][0-9]\b)[^\n]*|\(c\)\s*(?:copyright|(?:19|20)[0-9][0-9])[^\n]*|©[^\n]*|all rights reserved[.!]?[ \t]*)$"
)
_FSF = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301\s+USA")
_CAN_BE_NOTICE = r"(?i)licen[cs]e|creative ?commons|public domain|cc0|released under"


def canonical(text: Column) -> Column:
    """The form whose digest is looked up."""
    form = F.lower(F.coalesce(text, F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT, " ")
    form = F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def known_digests(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """(license_id, digest) of known texts; their number is fixed by the table above or the caller's."""
    rows = [(name, text) for name, all_ in texts.items() for text in all_]
    if len(rows) > 100_000:
        raise ValueError("more known texts than may be broadcast; join them by digest instead")
    frame = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return frame.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def full_texts() -> dict[str, list[str]]:
    """The licences of license_texts/ by id, each as it is published and in the ways it is commonly passed on."""
    out = {}
    for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        forms = {text, text.replace("https://", "http://"), _FSF.sub("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", text)}
        forms |= {t[: end.end()] for t in forms if (end := re.search("END OF TERMS AND CONDITIONS", t))}  # without the appendix
        # a line that claims copyright is dropped, so it counts whether it stands alone
        forms |= {"\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t)) for t in forms}
        out[path.stem] = sorted(forms)
    return out


def license_scan(docs: DataFrame, known: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, digest, license_id (entire text, or null) and notices (sorted licence ids of licence lines)."""
    spark = docs.sparkSession
    if known is None:
        long = full_texts()
        known = {k: KNOWN.get(k, []) + long.get(k, []) for k in KNOWN | long} | {"notice:" + k: v for k, v in NOTICES.items()}
    whole = known_digests(spark, known)
    lines = {r.digest: r.license_id for r in known_digests(spark, NOTICES if notices is None else notices).collect()}  # bounded above
    lookup = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair]) if lines else F.create_map().cast("map<string,string>")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    candidates = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(_CAN_BE_NOTICE))
    hits = F.transform(candidates, lambda x: F.element_at(lookup, F.sha2(canonical(x), 256)))
    texts = texts.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))).alias("notices"))
    found = texts.join(F.broadcast(whole), "digest", "left")
    return found.select("doc_id", "digest", F.regexp_replace("license_id", "^notice:", "").alias("license_id"), "notices")
